"""Covers are lower-cased once, and repeats are found without comparing every two terms."""

import contextlib
import io
import time

from pyspark.sql import functions as F

from docloom.functions.text import ordered_join
from docloom.operators import lexicon as L


def test_cover_is_lowered_once(spark):
    lines = spark.createDataFrame([(1, 1, "A plan of LAN"), (1, 0, "The rfq follows naics"), (2, 0, "planned")], "doc_id bigint, b int, t string")
    cover = lines.groupBy("doc_id").agg(ordered_join(F.collect_list(F.struct("b", F.col("t").alias("text"))), "\n").alias("cover"))
    out = L.classify_documents(cover)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain(extended=True)
    assert shown.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("lower(") == 1
    assert {r.doc_id: (r.solicitation_type, r.domain) for r in out.collect()} == {1: ("federal_rfq", "it_network"), 2: ("unknown", "general")}


def test_many_terms_of_one_document(spark):
    n = 60_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.when(i % 2 == 0, "Term ").otherwise(" tERM "), (F.floor((i + 1) / 2)).cast("string"))).alias("terms"))
    began = time.time()
    got = L._distinct_ci(df, "kept", F.concat("terms", F.array(F.lit(None).cast("string"), F.lit("last")))).first()["kept"]
    assert got == [f" tERM {i}" for i in range(1, n // 2 + 1)] + ["last"]
    assert time.time() - began < 20
