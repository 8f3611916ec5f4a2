"""Plain models of the sequential rules, compared with the set-at-a-time forms."""

import random

from pyspark.sql import functions as F

from docloom.config import Config
from docloom.functions import headings as H
from docloom.operators import chunks as C
from docloom.operators import grounding as G
from docloom.operators import retrieval as R
from docloom.operators import sections as S
from docloom.plans.scans import bucketed_row_number, exclusive_scan


def test_exclusive_scan_crosses_blocks(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.randint(-5, 5)) for k in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(7)
    out = exclusive_scan(df, ["k"], "i", {"s": ("sum", "v"), "m": ("max", "v")}, whole={"t": ("sum", "v")}, block=8)
    got = {(r.k, r.i): (r.s, r.m, r.t) for r in out.collect()}
    for k in "ab":
        vals = [v for kk, _, v in rows if kk == k]
        for i in range(300):
            assert got[(k, i)] == (sum(vals[:i]), max(vals[:i]) if i else None, sum(vals))


def test_bucketed_row_number(spark):
    rows = [(i // 9, i, (i * 7) % 50) for i in range(100)]
    df = spark.createDataFrame([("x", b, i) for b, i, _ in rows], "k string, b bigint, i bigint")
    got = {r.i: r.rn for r in bucketed_row_number(df, ["k"], "b", [F.col("i")]).collect()}
    assert got == {i: i + 1 for i in range(100)}


def test_section_parents_equal_a_stack(spark):
    rnd = random.Random(3)
    docs, want = [], {}
    for d in range(20):
        stack = []
        for o in range(rnd.randint(1, 40)):
            depth = rnd.choice([1, 1, 2, 2, 3, 4, 10, 11])
            title = ".".join(str(rnd.randint(1, 9)) for _ in range(depth)) + " Title"
            while stack and stack[-1][0] >= depth:
                stack.pop()
            want[(d, o)] = (stack[-1][1] if stack else None, len(stack) + 1)
            stack.append((depth, o))
            docs.append((d, o, title))
    df = spark.createDataFrame(docs, "doc_id bigint, section_order int, title string").repartition(5)
    got = {(r.doc_id, r.section_order): (r.parent_section_order, r.depth) for r in S.section_hierarchy(df, full_path=True).collect()}
    assert got == want


def test_sections_span_pages_and_partitions(spark):
    pages = [(1, 1, "intro line"), (1, 2, ""), (1, 3, "1 Scope\nfirst"), (1, 4, "second\n2 Terms"), (1, 5, "third"), (2, 1, "1 Only"), (2, 2, "body"), (3, 1, " "), (3, 2, "")]
    want = {
        (1, 0, "Preamble", "intro line", 1, 3), (1, 1, "1 Scope", "first\nsecond", 3, 4), (1, 2, "2 Terms", "third", 4, 5),
        (2, 0, "1 Only", "body", 2, 2), (3, 0, "Document", "", 1, 2),
    }
    for n in (1, 7):
        df = spark.createDataFrame(pages, "doc_id bigint, page_number int, text string").repartition(n)
        assert {tuple(r) for r in S.detect_sections(df).collect()} == want


def test_heading_rules(spark):
    lines = [
        ("2.1 Technical Requirements", True), ("86 miles in length.", False), ("386.336.4189 (fax)", False), ("2700 Judge Fran Way", False),
        ("Annexure A - Forms", True), ("SCOPE OF WORK", True), ("CARR", False), ("AB CD", False), ("1.2 (see below)", False), ("3 call the phone desk", False),
    ]
    df = spark.createDataFrame(lines, "l string, w boolean")
    assert [r.l for r in df.where(H.is_heading("l") != F.col("w")).collect()] == []


def test_split_with_overlap(spark):
    cfg = Config(leaf_max_chars=200)
    text = "\n\n".join(c * 120 for c in "ABC")
    df = spark.createDataFrame([(text,), ("1.1 Scope\n\nShort intro.\n\n2.1 Bonds\n\nBid bond required.",), ("  ",)], "t string")
    got = [r.p for r in df.select(C.split_with_overlap("t", cfg).alias("p")).collect()]
    assert len(got[0]) == 3 and got[0][1].startswith("A" * 100) and got[0][2].startswith("B" * 100)
    assert got[1] == ["1.1 Scope\n\nShort intro.\n\n2.1 Bonds\n\nBid bond required."] and got[2] == []
    # every character of the body is in some part
    assert all(any(c * 120 in p for p in got[0]) for c in "ABC")


def test_chunk_types(spark):
    df = spark.createDataFrame([("Schedule", "Bid Opening March 11", "schedule_table"), ("Security", "Bid bond of 10%", "bond_clause"), ("Annexure B", "x", "form_annex"), ("x", "y", "general_section")], "t string, c string, w string")
    assert df.where(C.chunk_type("t", "c") != F.col("w")).count() == 0


def test_stratified_fill_equals_listing(spark):
    rnd = random.Random(5)
    counts, selected, want = [], [], {}
    for d in range(30):
        n = rnd.randint(1, 60)
        counts.append((d, n))
        have = sorted(rnd.sample(range(1, n + 1), min(n, rnd.randint(0, 5))))
        selected += [(d, "payment_terms", o) for o in have]
        pool = [o for o in range(1, n + 1) if o not in have]
        need = 8 - len(have)
        want[d] = pool if len(pool) <= need else [pool[int(i * (len(pool) / need))] for i in range(need)]
    c = spark.createDataFrame(counts, "doc_id bigint, n bigint")
    s = spark.createDataFrame(selected, "doc_id bigint, extraction_type string, chunk_order int")
    got = {}
    for r in R.stratified_fill(s, c).where("extraction_type = 'payment_terms'").orderBy("fill_seq").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_order)
    assert got == {d: w for d, w in want.items() if w}


def test_section_refs(spark):
    df = spark.createDataFrame([("5.4.4", "4.4 Entirety", "4.4.4"), ("4.4.1", "4.4 Entirety", "4.4.1"), ("Annex", "4.4 E", "Annex")], "r string, t string, w string")
    assert df.where(G.normalize_paragraph_ref("r", "t") != F.col("w")).count() == 0


def test_snap_quote_and_fuzzy(spark):
    pages = spark.createDataFrame([(1, 1, "The  bid bond shall be ten percent of the bid amount.")], "doc_id bigint, page_number int, text string")
    q = spark.createDataFrame([(1, 1, "the bid bond shall be", 1), (1, 2, "Indeed bid bond shall be ten percent overall", 1), (1, 3, "nothing here at all", 1)], "doc_id bigint, item_id int, source_text string, page int")
    got = {r.item_id: r.snapped for r in G.snap_quotes(q, pages).collect()}
    assert got == {1: "the bid bond shall be", 2: "bid bond shall be ten percent", 3: None}


def test_rrf(spark):
    rows = [("q", c, r) for lst in (["a", "b"], ["b", "c"]) for r, c in enumerate(lst)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in R.rrf(df).collect()}
    assert max(got, key=got.get) == "b" and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-12


def test_a_grown_index_equals_a_full_one(spark):
    from docloom.sources.snapshots import read_snapshot

    import tempfile

    rnd = random.Random(9)
    words = ["bond", "bid", "Site", "visit", "due,", "owner", "été"]
    schema = "doc_id bigint, chunk_id string, chunk_order int, chunk_text string, section_title string, tags array<string>"
    chunk = lambda d, k: (d, f"{d}-{k}", k, " ".join(rnd.choices(words, k=rnd.randint(0, 12))), rnd.choice(["Bid", None, ""]), rnd.choice([["visit"], [], None]))
    old = [chunk(d, k) for d in range(12) for k in range(4)]
    kept = [c for c in old if c[0] > 3]
    new = [chunk(d, k) for d in (0, 1, 20) for k in range(3)]  # 0 and 1 come again, 2 and 3 go, 20 is new
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    R.index_chunks(spark.createDataFrame(old, schema), path)
    R.index_chunks(spark.createDataFrame(new, schema), path, spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 20)], "doc_id bigint"))
    full = spark.createDataFrame(kept + new, schema)
    index = read_snapshot(spark, path)
    show = lambda df: sorted(map(str, df.collect()))
    assert show(index) == show(R.postings(full).select(*index.columns))
    queries = spark.createDataFrame([(d, d, q) for d in range(21) for q in ("bid bond bid", "visit été nowhere", "")], "query_id bigint, doc_id bigint, query string")
    assert show(R.bm25_search(queries, index)) == show(R.bm25(queries, full)) and len(show(R.bm25(queries, full))) > 20


def test_bm25_reads_texts_once(spark):
    plan = R.postings(spark.createDataFrame([(1, "a", 1, "x y", "t", ["g"])], "doc_id bigint, chunk_id string, chunk_order int, chunk_text string, section_title string, tags array<string>"))
    q = spark.createDataFrame([(1, 1, "x")], "query_id bigint, doc_id bigint, query string")
    text = R.bm25(q, plan.sparkSession.createDataFrame([(1, "a", 1, "x y", "t", ["g"])], "doc_id bigint, chunk_id string, chunk_order int, chunk_text string, section_title string, tags array<string>"))
    shown = text._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_text" not in shown  # everything comes from the postings
