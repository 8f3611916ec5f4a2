"""Selected chunks are listed by as many tasks as the rows ask for, and as a plain listing does."""

import random

from docloom.fixed import FOCUSED_TYPES
from docloom.operators import retrieval as R


def plain_listed(selected, op):
    out = set()
    for doc in {r[0] for r in selected} | {r[0] for r in op}:
        pins = sorted(o for d, o in op if d == doc)[: R.BROAD_MAX]
        for t in FOCUSED_TYPES:
            pos = {}
            for d, kind, order, p in selected:
                if (d, kind) == (doc, t):
                    pos[order] = min(p, pos.get(order, p))
            if t in R.PIN_TYPES:
                pos |= {o: k - 999 for k, o in enumerate(pins)}
            best = sorted(pos, key=pos.get)[: R.BROAD_MAX if t in R.BROAD_TYPES else R.DEFAULT_MAX]
            best.sort(key=lambda o: (not (t in R.PIN_TYPES and (doc, o) in op), o))
            out |= {(doc, t, o, k + 1) for k, o in enumerate(best)}
    return out


def test_listing_is_the_plain_one_and_is_dealt_by_its_rows(spark):
    rnd = random.Random(3)
    selected = [(d, t, o, p + 1) for d in range(12) for t in FOCUSED_TYPES for p, o in enumerate(rnd.sample(range(1, 60), rnd.randint(0, 20)))]
    selected += [(d, t, o, p + 200) for d, t, o, p in selected[::7]]
    op = {(d, o) for d in range(13) for o in rnd.sample(range(1, 60), rnd.choice([0, 3, 30]))}
    s = spark.createDataFrame(selected, "doc_id bigint, extraction_type string, chunk_order int, pos int")
    o = spark.createDataFrame(sorted(op), "doc_id bigint, chunk_order int")
    for parts in (None, 23):
        rows = R._listed(s, o, parts)
        assert {tuple(r) for r in rows.collect()} == plain_listed(selected, op)
    assert rows.rdd.getNumPartitions() == 23


def test_tasks_of_a_selection_follow_its_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "LISTED_ROWS", 100)
    chunks = spark.range(400).selectExpr(
        "id % 9 AS doc_id", "concat('c', id) AS chunk_id", "cast(id div 9 + 1 AS int) AS chunk_order", "'Scope' AS section_title", "'scope of work' AS chunk_text",
        "'general_section' AS chunk_type", "array('scope') AS tags",
    )
    assert R.keyword_chunks(chunks, R.default_keywords()).rdd.getNumPartitions() == 400 * len(FOCUSED_TYPES) // 100
