"""Quotes found by fingerprints and similar items found behind bounds, against comparing everything."""

import random
import re
from difflib import SequenceMatcher

import pytest

from docloom.operators import grounding as G
from docloom.operators import quotes as Q


def norm(text):
    return " ".join(re.sub("-{2,}", " ", re.sub(r"\s*\|\s*", " ", (text or "").lower())).split())


def corpus(seed, long_doc=600):
    """Pages of few letters, a boilerplate on every page of a long document, null and empty pages."""
    rnd = random.Random(seed)
    line = lambda n: " ".join("".join(rnd.choice("abc ") for _ in range(6)) for _ in range(n))
    pages = [(d, p, rnd.choice([line(rnd.randint(0, 30)), line(8) + " | été -- 🙂 " + line(3)])) for d in range(6) for p in range(1, 8)]
    pages += [(9, p, f"confidential tender document page {p} {line(2)}") for p in range(1, long_doc)] + [(7, 1, None), (7, 2, ""), (None, 1, line(9))]
    quotes = []
    for k in range(250):
        d, p, text = rnd.choice(pages)
        text = norm(text)
        a = rnd.randrange(max(1, len(text)))
        cut = text[a : a + rnd.choice([5, 11, 12, 13, 30, 60])]
        if rnd.random() < 0.3:
            cut = cut[:8] + "x" + cut[9:]
        start = rnd.randint(-1, 6)
        quotes.append((d if rnd.random() < 0.9 else 3, k, cut.upper() if rnd.random() < 0.2 else cut, start, start + rnd.randint(-1, 3)))
    quotes += [(9, 900, "Confidential Tender  document", 300, 310), (9, 901, "confidential tender document page 599", 1, 2), (0, 902, None, 1, 2), (77, 903, "no such document at all", 1, 2)]
    return pages, quotes


PAGES, QUOTES = "doc_id bigint, page_number int, text string", "doc_id bigint, item_id int, source_text string, page_start int, page_end int"


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_of_quotes_equal_comparing_all(spark, seed):
    pages, quotes = corpus(seed)
    got = {r.item_id: r.resolved for r in G.resolve_pages(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(pages, PAGES)).collect()}
    seen = {"exact": 0, "fuzzy": 0}
    for d, k, text, a, b in quotes:
        full, own = norm(text), sorted((p, norm(t)) for dd, p, t in pages if dd == d and d is not None)
        hits = [p for p, t in own if len(full) >= 20 and full in t]
        want = next((p for p in hits if a <= p <= b), hits[0] if hits else None)
        seen["exact"] += want is not None
        if want is None and len(full) >= 25:
            best = max(((SequenceMatcher(None, full, t).ratio(), -p) for p, t in own if a <= p <= b), default=(0, 0))
            want = -best[1] if best[0] >= 0.55 else None
            seen["fuzzy"] += want is not None
        assert got[k] == want, (d, k, text, a, b)
    assert seen["exact"] > 20


def test_fuzzy_pages_equal_comparing_all(spark):
    rnd = random.Random(5)
    words = [f"word{k}" for k in range(40)]
    pages = [(d, p, " ".join(rnd.choices(words, k=8))) for d in range(5) for p in range(1, 6)]
    quotes = []
    for k in range(60):
        d, p, text = rnd.choice(pages)
        own = text.split()
        for _ in range(rnd.randint(1, 4)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        quotes.append((d, k, " ".join(own), 1, rnd.randint(1, 5)))
    got = {r.item_id: r.resolved for r in G.resolve_pages(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(pages, PAGES)).collect()}
    found = 0
    for d, k, text, a, b in quotes:
        own = [(p, t) for dd, p, t in pages if dd == d]
        hits = [p for p, t in own if text in t]
        best = max((SequenceMatcher(None, text, t).ratio(), -p) for p, t in own if a <= p <= b)
        want = (next((p for p in hits if a <= p <= b), hits[0])) if hits else -best[1] if best[0] >= 0.55 else None
        found += want is not None
        assert got[k] == want
    assert found > 30


@pytest.mark.parametrize("prefix", [None, 12, 32])
def test_quotes_in_document_equal_comparing_all(spark, prefix):
    pages, quotes = corpus(3, 20)
    got = {r.item_id: r.in_document for r in G.quote_in_document(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(pages, PAGES), prefix).collect()}
    for d, k, text, *_ in quotes:
        n, own = norm(text), [norm(t) for dd, _, t in pages if dd == d and d is not None]
        stands = len(n) >= 12 and any(n in t or (prefix and len(n) >= prefix and n[:prefix] in t) for t in own)
        assert got[k] == stands, (d, k, text)
    assert sum(got.values()) > 20
    with pytest.raises(ValueError):
        G.quote_in_document(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(pages, PAGES), 11)


def test_no_pages_no_quotes(spark):
    pages, quotes = corpus(3, 5)
    none = spark.createDataFrame([], PAGES)
    assert {r.resolved for r in G.resolve_pages(spark.createDataFrame(quotes, QUOTES), none).collect()} == {None}
    assert not G.resolve_pages(spark.createDataFrame([], QUOTES), spark.createDataFrame(pages, PAGES)).collect()


def test_the_page_index_is_taken_as_it_is(spark):
    pages, quotes = corpus(4, 5)
    index = Q.page_index(spark.createDataFrame(pages, PAGES))
    assert Q.page_index(index) is index
    q = spark.createDataFrame(quotes, QUOTES)
    assert sorted(map(str, G.quote_in_document(q, index).collect())) == sorted(map(str, G.quote_in_document(q, spark.createDataFrame(pages, PAGES)).collect()))


def test_texts_meet_only_by_fingerprint(spark):
    pages, quotes = corpus(4, 5)
    index = Q.page_index(spark.createDataFrame(pages, PAGES))
    needles = G.once(spark.createDataFrame(quotes, QUOTES), "needle", G.norm_cite("source_text"))
    plan = Q.standing(needles, index)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert joins and "Cartesian" not in plan
    # the one join on the document alone is with one row per document, not with its pages
    alone = [line for line in joins if line.count(" = ") == 1]
    assert len(alone) == 1 and "contains" not in alone[0].lower()


def similar(seed):
    rnd = random.Random(seed)
    words = ["bond", "bid", "site", "visit", "date", "payment", "due", "owner", "city", "project"]
    labels = ["bid_deadline_date_time", "owner", "Owner ", None, "project_name"]
    line = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 9)))
    items = [(d, k, rnd.randint(1, 3), "s", rnd.choice(labels), rnd.choice([line(), line(), None])) for d in range(5) for k in range(rnd.randint(0, 25))]
    sources = [(d, k, rnd.choice([line(), line().upper(), ""]), rnd.choice([None, 1, 2, 3]), rnd.choice(["bid_open_date_time", "owner", "other", None])) for d in range(6) for k in range(15)]
    return items, sources


ITEMS, SOURCES = "doc_id bigint, item_seq int, page int, section string, label string, source_text string", "doc_id bigint, source_id int, source_text string, page int, field_key string"


@pytest.mark.parametrize("least", [0.0, 0.4, 0.65])
def test_best_items_equal_comparing_all(spark, least):
    items, sources = similar(7)
    got = {(r.doc_id, r.source_id): (round(r.ratio, 9), r.m_source) for r in G.best_item_match(spark.createDataFrame(sources, SOURCES), spark.createDataFrame(items, ITEMS), least=least).collect()}
    want = {}
    for d, k, text, hint, field in sources:
        own = [i for i in items if i[0] == d and norm(i[5])]
        label = "bid_deadline_date_time" if field == "bid_open_date_time" else field or ""
        same = [i for i in own if (i[4] or "").strip().lower() == label]
        scored = [(SequenceMatcher(None, norm(text), norm(i[5])).ratio() + (0.08 if hint == i[2] else 0.0), -i[1], i[5]) for i in same or own] if norm(text) else []
        scored = [s for s in scored if s[0] > 0 and s[0] >= least]
        if scored:
            want[d, k] = (round(max(scored)[0], 9), max(scored)[2])
    assert got == want and len(got) > 5


def test_bounds_leave_few_pairs(spark):
    items, sources = similar(8)
    rows = G.match_effort(spark.createDataFrame(sources, SOURCES), spark.createDataFrame(items, ITEMS), least=0.4).collect()
    assert sum(r.n_left for r in rows) < 0.7 * sum(r.n_pairs for r in rows)


def test_clauses_are_found_on_their_pages(spark):
    pages = [(1, 3, "An opening remark on the third page."), (1, 13, "Clause 3.5.3 says when payments fall due."), (1, 21, "Section 4.16.1 tells how offers are weighed in detail.")]
    quotes = [(1, 1, "Clause 3.5.3 says when payments fall due.", 1, 30), (1, 2, "Section 4.16.1 tells how offers", 1, 5)]
    got = {r.item_id: r.resolved for r in G.resolve_pages(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {1: 13, 2: 21}
