"""Spelling variants, hard negatives and language model scores against plain versions and on hostile tables."""

import itertools
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import negatives, suffix_tree, variants

EXTRA = ["word", "n", "shard", "role", "label2", "form", "row", "key", "anchor", "score", "token", "context"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA if c not in df.columns])


def odd_texts(seed, docs=120):
    """Words of few letters with all kinds of edits, anagrams, letters above ASCII and one very long word."""
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(7, 10))) for _ in range(25)] + ["abcabca", "aabbcca", "x" * 70]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 60)):
            w = list(rnd.choice(stems))
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = [rnd.choice("abcdeéÀÿ") for _ in range(rnd.randint(0, 1))]
            words.append("".join(w).title() if rnd.random() < 0.1 else "".join(w))
        out.append((i if i % 17 else None if i == 34 else i, rnd.choice([" ", ", ", "1"]).join(words) if i % 13 else None))
    return [*out, out[5], out[5], (500, ""), (501, "1234 !! kurz")]


def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] for w, v in close.items() if v and n[v[0]] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("shard", [5, 10_000])
def test_variants_equal_all_pairs(spark, shard):
    rows = odd_texts(shard)
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    got = variants.group_variants(docs, shard=shard).collect()
    want = plain_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.form for r in got) and any(r.n_near > 3 for r in got)


def test_roots_follow_forms_to_the_last(spark):
    chain = [("abcdefgh", 2), ("abcdefgi", 30), ("abcdefii", 400)]
    whole = next(k for k in range(99) if all(zlib.crc32(f"{k}:{w}".encode()) % 31 for w, _ in chain))
    rows = [(whole, " ".join(w for w, n in chain for _ in range(n)))]
    got = {r.word: r.root for r in variants.group_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {w: "abcdefii" for w, _ in chain}


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = variants.group_variants(clashing(spark.createDataFrame(rows, "doc_id bigint, text string")))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not got.collect()


def test_one_edit():
    words = [w for k in (1, 2, 3, 4) for w in map("".join, itertools.product("ab", repeat=k))] + ["a" * 70, "a" * 71, "a" * 69 + "b"]
    letters = variants.Letters(words)
    i, j = (np.array(x) for x in zip(*itertools.product(range(len(words)), repeat=2)))
    for a, b, good in zip(i, j, variants.one_edit(letters, letters, i, j)):
        x, y = sorted((words[a], words[b]), key=len)
        want = sum(p != q for p, q in zip(x, y)) == 1 if len(x) == len(y) else len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))
        assert good == want, (words[a], words[b])


def plain_negatives(rows):
    clean = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        clean[i] = min(clean.get(i, (v, label)), (v, label))
    clean = {i: (v, (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in clean.items()}
    out = set()
    for a, (v, label) in clean.items():
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (w, _) in clean.items() if i != a and len(w) == len(v)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if clean[i][1] == label][:5]:
            fit = [i for i in order if clean[i][1] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]][:10]
            out |= {(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(fit)}
    return out


@pytest.mark.parametrize("shard", [7, 10_000])
def test_negatives_equal_all_pairs(spark, shard):
    rnd = random.Random(shard)
    centres = [[rnd.gauss(0, 1) for _ in range(9)] for _ in range(6)]
    rows = []
    for i in range(700):
        c = rnd.randrange(6)
        rows.append((i, [x + rnd.gauss(0, 0.4) for x in centres[c]] if i % 5 else centres[0], c if rnd.random() < 0.8 else rnd.randrange(10)))
    rows += [(800, [0.0] * 9, 1), (900, [1.0, 2.0, 3.0], 1), (901, [1.0, 2.0, 2.5], 1), (902, [1.0, 1.0, 1.0], 2), (1000, [], 3), (1001, [], 3), (1002, [], 4)]
    rows += [(None, [1.0] * 9, 1), (1100, None, 1), (1200, [1.0] * 9, None), (1300, [None] * 9, 1), (1400, [float("nan")] * 9, 1), (1500, [float("inf")] * 9, 2)]
    rows += [(300, [9.0] * 9, 1), (1600, [30000.0] * 9, 1), (1601, [29000.0] * 9, 1), (1602, [20000.0] * 9, 2)]
    table = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4))
    got = negatives.hard_negatives(table, shard=shard, sample=64).collect()
    assert {tuple(r) for r in got} == plain_negatives(rows) and len(got) == len(set(got)) and got


def test_negatives_of_nothing(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(100, None, 1)], [(100, [1.0, 2.0], 1)], [(100, [1.0], 1), (101, [1.0], 1)]):
        assert not negatives.hard_negatives(clashing(spark.createDataFrame(rows, schema))).collect()


def test_cells_come_by_falling_bound_and_hold_it(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist(), i % 3) for i in range(400)]
    own = negatives.labelled_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    placed, index = negatives.build(own, cell=8)
    shard = negatives.Shard(placed.toArrow(), index)
    for q in shard.rows[:20]:
        bounds = list(shard.visit(q))
        assert [b for b, *_ in bounds] == sorted((b for b, *_ in bounds), reverse=True) and sum(z - a for _, a, z in bounds) == 400
        assert all((shard.rows[a:z] @ q).max() <= b for b, a, z in bounds)


def test_windows_take_no_python_call_for_every_row():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(4000, 16)))
    books = tuple(negatives.codebook(v[:, h], 6) for h in (slice(0, 8), slice(8, 16)))
    (i, r), (j, s) = (negatives.nearest(v[:, h], b) for h, b in zip((slice(0, 8), slice(8, 16)), books))
    cells = [(a, b, int(m.sum()), r[m].max(), s[m].max()) for a in range(6) for b in range(6) if (m := (i == a) & (j == b)).any()]
    rows = pa.table({"vec_id": np.arange(4000), "label": np.arange(4000) % 3, "v": pa.array(v.tolist()), "i": i, "j": j})
    shard = negatives.Shard(rows, negatives.Index(16, books, cells, 10_000))
    scores = (v @ v[7]).astype(int)
    windows = [(-(1 << 63), int(top), -(1 << 63)) for top in np.sort(scores)[[300, 900, 2000, 3000, 3990]]]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = shard.search(7, 1, 16, v[7], windows, 10, False)
    finally:
        sys.setprofile(None)
    for (_, hi, _), hits in zip(windows, got, strict=True):
        fit = sorted((-scores[k], k) for k in range(4000) if k % 3 != 1 and k != 7 and scores[k] <= hi)[:10]
        assert [(int(-a), k) for a, k in fit] == [(a, k) for a, k in hits]
    assert calls < 1000, calls


def lm_texts(seed):
    rnd = random.Random(seed)
    frequent = [f"w{k}" for k in range(12)]
    passage = "alpha beta gamma Delta epsilon".split()
    rows = []
    for i in range(300):
        words = [w for _ in range(rnd.randint(0, 12)) for w in (passage if rnd.random() < 0.3 else [rnd.choice(frequent), f"rare{rnd.randrange(400)}" if rnd.random() < 0.3 else "w0"])]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (None, "alpha beta"), (301, None), (302, ""), (3, "alpha Beta gamma"), (3, "alpha Beta gamma"), (303, "Été unseen　word " * 9)]


def plain_lm(rows, size, least, transition, cost):
    """doc_id -> sums by a plain suffix tree over dictionaries."""
    docs = [(i, "" if i is None else str(i), (text or "").encode().lower().split() + [b""]) for i, text in rows]
    train = [w for _, k, w in docs if zlib.crc32(k.encode()) % 10]
    c, every = Counter(t for w in train for t in w), Counter(t for _, _, w in docs for t in w)
    total, distinct = sum(c.values()), len(c)
    letters = set(sorted((t for t in every if len(t) <= 64), key=lambda t: (-every[t], t))[:size])
    root = {t: (c[t] + 0.1) / (total + 0.1 * (distinct + 1)) for t in every}
    follow = {1: defaultdict(Counter), 2: defaultdict(Counter)}
    for w in train:
        for at in range(1, len(w)):
            for depth in (1, 2):
                s = tuple(w[at - depth : at])
                if at >= depth and len(s) == depth and w[at] in letters and all(x in letters for x in s):
                    follow[depth][s][w[at]] += 1
    model = {}

    def p(s, t):
        while s and s not in model:
            s = s[1:]
        if not s:
            return root[t]
        stored, bow = model[s]
        return stored[t] if t in stored else bow * p(s[1:], t)

    for depth in (1, 2):
        fitted = {}
        for s, seen in follow[depth].items():
            size_of = c[s[0]] if depth == 1 else follow[1][s[:1]][s[1]]
            moves = {t: n for t, n in seen.items() if n >= transition and size_of >= least}
            moves = {t: n for t, n in moves.items() if n * math.log((n - 0.5) / size_of / p(s[1:], t)) > cost}
            if size_of < least or not moves:
                continue
            bow = 1 - sum(n - 0.5 for n in moves.values()) / size_of
            stored = {t: (n - 0.5) / size_of + bow * p(s[1:], t) for t, n in moves.items()}
            gain = sum(n * math.log(stored[t] / p(s[1:], t)) for t, n in moves.items()) + (size_of - sum(moves.values())) * math.log(bow)
            if gain > cost * (1 + len(moves)):
                fitted[s] = (stored, bow)
        model |= fitted
    out = []
    for i, k, w in docs:
        score = 0.0
        for at, t in enumerate(w):
            s = []
            while len(s) < 2 and at - len(s) > 0 and w[at - len(s) - 1] in letters:
                s.insert(0, w[at - len(s) - 1])
            score += math.log10(p(tuple(s), t))
        out.append((str(i), zlib.crc32(k.encode()) % 10 == 0, len(w), sum(c[t] > 0 for t in w), total, round(sum(math.log10(root[t]) for t in w), 6), round(score, 6)))
    return sorted(out), model, root


@pytest.mark.parametrize("head", [0, 12, 1 << 20])
def test_lm_equals_plain_tree(spark, head):
    rows = lm_texts(4)
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    corpus = suffix_tree.encode(docs, size=40)
    tree = suffix_tree.learn(corpus, least=5, cost=0.5, head=head)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score_documents(corpus, tree).collect())
    want, model, root = plain_lm(rows, 40, 5, 2, 0.5)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-5) and g[6] == pytest.approx(w[6], abs=1e-4)
    assert {len(s) for s in model} == {1, 2}
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than counts on texts it has not seen


@pytest.mark.parametrize(("near", "head"), [(0, 12), (10, 0), (10, 1 << 20)])
def test_lm_knows_words_that_do_not_lie_on_every_task(spark, near, head):
    rows = [*lm_texts(5), *[(400 + i, "zeta " + "long" * 30 + f" seldom{i % 3} eta" if i % 2 else f"omega seldom{i % 3} theta") for i in range(80)]]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    corpus = suffix_tree.encode(docs, near=near)
    got = sorted((str(r.doc_id), r.n_known, r.base_score, r.score) for r in suffix_tree.score_documents(corpus, suffix_tree.learn(corpus, least=5, cost=0.5, head=head)).collect())
    short = [(i, t.replace("long" * 30, "long") if t else t) for i, t in rows]  # the plain tree leaves long words out
    want, model, _ = plain_lm(short, 1 << 30, 5, 2, 0.5)
    assert (b"seldom1",) in model and (b"long", b"seldom1") in model
    for g, w in zip(got, want, strict=True):
        assert g[:2] == (w[0], w[3]) and g[2] == pytest.approx(w[5], abs=1e-5) and g[3] == pytest.approx(w[6], abs=1e-4)


def test_lm_distributions_sum_to_one():
    rows = [r for r in lm_texts(4) if zlib.crc32(str(r[0]).encode()) % 10]  # every token is known, so the unknown one has 0.1 of N + 0.1 (V + 1)
    want, model, root = plain_lm(rows, 40, 5, 2, 0.5)
    unknown = 1 - sum(root.values())
    assert unknown == pytest.approx(0.1 / (want[0][4] + 0.1 * (len(root) + 1)))
    assert any(len(s) == 1 for s in model)
    for s, (stored, bow) in model.items():
        if len(s) == 1:
            rest = sum(p for t, p in root.items() if t not in stored) + unknown
            assert sum(stored.values()) + bow * rest == pytest.approx(1)


def test_lm_of_nothing(spark):
    schema = "doc_id bigint, text string"
    none = clashing(spark.createDataFrame([], schema))
    corpus = suffix_tree.encode(none)
    assert not suffix_tree.score_documents(corpus, suffix_tree.learn(corpus)).collect()
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = clashing(spark.createDataFrame([(held, "nothing to learn from"), (held, None)], schema))
    corpus = suffix_tree.encode(only)
    got = suffix_tree.score_documents(corpus, suffix_tree.learn(corpus)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2 and {r.n_tokens for r in got} == {5, 1}


@pytest.mark.parametrize("depth", [1, 2])
def test_lm_counting_holds_little_at_a_time(depth):
    """Rows of any number of tokens are counted within some MB, and no batch that is passed on is large."""
    rng = np.random.default_rng(7)
    lists = [rng.integers(0, 5000, 300_000, dtype=np.int32) for _ in range(8)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int32()))], ["ids"]) for x in lists]
    tracemalloc.start()
    many, largest = 0, 0
    for batch in suffix_tree.followers(iter(batches), depth, 5000):
        many, largest = many + sum(batch.column("n").to_pylist()), max(largest, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert many == 8 * (300_000 - depth) and largest <= suffix_tree.OUT
    assert peak < 80e6, peak
