"""License spans: words of a notice must stand together, near their places."""

import random
import re

import pytest

from docloom.llm import license_scan as L


def plain(text, notices=L.NOTICES):
    """Labels of notices by trying every place: the share of words in pairs that stand within NEAR behind their places."""
    words = [w for w in re.split(L.WORD_GAP, text.lower()) if w]
    labels, best = set(), 0.0
    for n in notices:
        tw = n.text.split(" ")
        for d in range(-len(tw), len(words)):
            covered = set()
            for q in range(len(tw) - 1):
                if any(0 <= p < len(words) - 1 and words[p : p + 2] == tw[q : q + 2] for p in range(d + q, d + q + L.NEAR + 1)):
                    covered |= {q, q + 1}
            share = len(covered) / len(tw)
            best = max(best, share)
            if share >= L.MATCH:
                labels.add(n.label)
    return labels, best


def noisy(rnd):
    n = rnd.choice(L.NOTICES).text.split(" ")
    for _ in range(rnd.randint(0, 4)):
        at = rnd.randrange(len(n))
        n[at : at + rnd.randint(0, 1)] = [rnd.choice(["under", "the", "license", "word"])] * rnd.randint(0, 2)
    return " ".join(rnd.choices(["under", "the", "of", "licensed", "x"], k=rnd.randint(0, 9)) + n)


def test_notices_equal_trying_every_place(spark):
    rnd = random.Random(3)
    texts = [(k, noisy(rnd)) for k in range(150)]
    got = {r.doc_id: (set(r.labels.split(",")) - {""}, r.score) for r in L.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string"), L.NOTICES).collect()}
    for k, text in texts:
        labels, best = plain(text)
        assert got[k][0] == labels and got[k][1] == pytest.approx(best), text
    assert 30 < sum(bool(v[0]) for v in got.values()) < 150


@pytest.mark.parametrize("text", [
    "released under under the " + "under the " * 500 + "quite another thing than a mit license", "licensed under something else entirely " + "licensed under " * 300 + "one two three four cc by nc words 4 0",
    "released under " + "word " * 5 + "the mit license",
])
def test_scattered_words_are_no_notice(spark, text):
    (row,) = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert not set(row.labels.split(",")) & {n.label for n in L.NOTICES}
