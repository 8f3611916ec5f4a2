"""The blocks of a page are cut once, however often their numbering reads them."""

from pyspark.sql import functions as F

from docloom.operators import pages as P
from docloom.operators import sections as S


def test_pages_are_cut_to_blocks_once(spark):
    total = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        total.add(1)
        return x

    pages = spark.range(60).select(F.floor(F.col("id") / 6).alias("doc_id"), (F.col("id") % 6 + 1).cast("int").alias("page_number"), F.lit("1 Scope of Work\nthe works are\nmany").alias("text"))
    blocks = P.layout_blocks(pages.withColumn("text", same.asNondeterministic()("text")))
    assert {(r["page"], r["block_seq"], r["type"], r["y"]) for r in blocks.where("doc_id = 3").collect()} == {
        (p, k, t, y) for p in range(1, 7) for k, t, y in ((0, "heading", 0.0), (1, "paragraph", 2.0 * (p - 1) + 1))
    }
    assert total.value == 60


def test_headings_are_searched_for_texts_and_for_counts_only(spark):
    total = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        total.add(1)
        return x

    pages = spark.range(60).select(F.floor(F.col("id") / 6).alias("doc_id"), (F.col("id") % 6 + 1).cast("int").alias("page_number"), F.lit("1 Scope of Work\nthe works are\nmany").alias("text"))
    sections = S.detect_sections(pages.withColumn("text", same.asNondeterministic()("text")))
    assert {(r["section_order"], r["content"], r["page_start"]) for r in sections.where("doc_id = 3").collect()} == {(k, "the works are\nmany", k + 1) for k in range(6)}
    assert total.value <= 3 * 60  # texts, counts and the last page
