"""Texts are shuffled before they grow, and shared terms are counted before they are looked at."""

import contextlib
import io
from collections import Counter

from pyspark.sql import functions as F

from docloom.config import Limits
from docloom.operators import chunks as C
from docloom.operators import lexicon as L
from docloom.operators import retrieval as R
from docloom.plans.stage import cut


def plan_of(df, part):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain(extended=True)
    return shown.getvalue().split(f"== {part} Plan ==")[1].split("\n==")[0]


def chunks(spark):
    i = F.col("id")
    return cut(spark.range(60).select(
        F.floor(i / 6).alias("doc_id"), (i % 6 + 1).cast("int").alias("chunk_order"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.lit(1).alias("page_start"),
        F.lit(2).alias("page_end"), F.lit("Scope").alias("section_title"), F.concat(F.lit("bridge work bridge "), (i % 3).cast("string")).alias("chunk_text"), F.array(F.lit("scope")).alias("tags"),
    ))


def test_chunks_are_shuffled_before_they_are_tokens(spark):
    made = R.postings(chunks(spark))
    exchanges = [line for line in plan_of(made, "Physical").splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "term" not in exchanges[0]
    got = {(r.term, r.tf) for r in made.where("chunk_id = 'c7'").collect()}
    assert got == {("", 1), ("bridge", 2), ("work", 1), ("1", 1), ("scope", 2)}


def test_texts_are_not_shuffled_for_every_type(spark):
    c = chunks(spark)
    selected = c.select("doc_id", "chunk_order", F.explode(F.array(F.lit("scope_of_work"), F.lit("payment_terms"))).alias("extraction_type"), F.col("chunk_order").alias("position"))
    made = R.batch_requests(selected, c)
    assert not [line for line in plan_of(made, "Physical").splitlines() if "Exchange hashpartitioning" in line and "extraction_type" in line.split("ENSURE")[0].split("REPARTITION")[0]]
    got = made.where("doc_id = 3 AND extraction_type = 'payment_terms'").orderBy("batch_no").collect()
    assert [(r.chunk_ids, r.n_chunks, r.prompt.count("=== Section: Scope (pages 1-2) ===")) for r in got] == [("c18,c19,c20", 3, 3), ("c21,c22,c23", 3, 3)]


def test_spellings_are_counted_before_they_are_normalised(spark):
    lexicon = spark.createDataFrame([], "extraction_type string, entry_kind string, term_normalized string, term_display string, source string, hit_count bigint, document_count int, is_active boolean, last_seen_at timestamp")
    terms = ["Bid  Bond", "bid bond", "Bid  Bond", " Bid Bond ", "no", "Surety"]
    new = cut(spark.createDataFrame([("payment_terms", t, s, "2024-01-0%d" % (k + 1)) for k, t in enumerate(terms) for s in ("llm", "heuristic")], "extraction_type string, term string, source string, at string").select(
        "extraction_type", "term", "source", F.col("at").cast("timestamp").alias("seen_at")))
    made = L.record_terms(lexicon, new, "term")
    assert "count(1)" in plan_of(made, "Optimized Logical").rpartition("regexp_replace")[2]
    assert {(r.term_normalized, r.term_display, r.hit_count, r.source) for r in made.collect()} == {("bid bond", "Bid Bond", 8, "heuristic"), ("surety", "Surety", 2, "heuristic")}


def test_terms_no_query_needs_are_not_compared(spark):
    rows = [(1, ["A", "b", "C"], ["z"]), (2, ["A", "a ", "C"], ["c", "D", "e"]), (3, ["x"], ["X", "y"]), (4, [], ["p", "q", "r", "s"])]
    lex = cut(spark.createDataFrame(rows, "doc_id bigint, global_terms array<string>, typed_terms array<string>").select("*", F.lit("set_asides").alias("extraction_type"), F.array(F.lit("learned query")).alias("queries")))
    made = L.queries_for_types(lex, Limits(query_terms=3))
    got = {r.doc_id: r["query"] for r in made.collect() if r["query"] not in [*L.STATIC_QUERIES["set_asides"], "learned query"]}
    assert got == {1: "A b C", 2: "A C D", 3: "x y", 4: "p q r"}
    assert Counter(r.doc_id for r in made.collect()) == dict.fromkeys(range(1, 5), 4)
    loaded = spark.createDataFrame([("set_asides", "query", "Learned query", 1)], "extraction_type string, entry_kind string, term_display string, rank int")
    mined = spark.range(20).select(F.floor(F.col("id") / 5).alias("doc_id"), F.col("id").alias("term_seq"), F.concat(F.lit("Project owner "), F.col("id").cast("string")).alias("term"))
    above = plan_of(L.queries_for_types(L.document_lexicon(mined, loaded), Limits(query_terms=3)), "Optimized Logical").partition("Join ")[0]
    assert above.count("Generate explode(array(sort_array(") == 2  # terms of the query and the queries; learned queries and typed terms no more


def test_leaves_are_split_once(spark):
    i = F.col("id")
    sections = cut(spark.range(24).select(
        F.floor(i / 6).alias("doc_id"), (i % 6).alias("section_order"), F.lit("Scope of Work").alias("title"), F.concat(F.lit("build the bridge "), i.cast("string")).alias("content"),
        F.lit(9).alias("page_start"), F.lit(9).alias("page_end"),
    ))
    tables = spark.createDataFrame([], "doc_id bigint, table_idx int, page int, headers array<string>, rows array<array<string>>")
    parsed = spark.createDataFrame([(0, "text", 9), (77, "only text", 3)], "doc_id bigint, structured_text string, total_pages int")
    made = C.build_chunks(parsed, sections, tables)
    assert "posexplode" not in plan_of(made, "Optimized Logical")
    got = {(r.doc_id, r.chunk_order): r.chunk_text for r in made.collect()}
    assert got == {(d, k + 1): f"build the bridge {6 * d + k}" for d in range(4) for k in range(6)} | {(77, 1): "only text"}
