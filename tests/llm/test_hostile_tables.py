"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from docloom.llm import bpe, decontaminate, license_scan, line_dedup, quality, secrets, simhash, topk, url_filter, warc  # noqa: E402

LONG = ("lorem ipsum dolor sit amet " * 40 + "\n") * 60
ROWS = [
    (1, "same words in this text here\n" + "x" * 50, "en", "a", 9),
    (1, "same words in this text here\n" + "x" * 50, "en", "a", 9),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, LONG, "de", "b", -4),
    (None, "a row without an id, MIT License, token = 'abcdefgh12345678'", "fr", None, 7),
    (5, "\n \n\t\n", "en", "a", 5),
    (6, "naïve ÄÖ K 漢字 🙂\x00 end", "en", "a", 5),
    (7, "same words in this text here\n" + "x" * 50, "en", "a", 9),
]
# names that operators use inside, and names of their results
EXTRA = ["key", "fp", "n_lines", "n_dropped", "kept_text", "tokens", "t", "d", "q", "_text", "_row", "root", "low_score", "keep", "h", "payload", "rank", "score", "value"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def hostile(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def docs(spark):
    return hostile(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return hostile(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="module")
def labels(spark):
    return hostile(spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int"))


BENCHMARK = [(1, None), (2, ""), (None, "no id on this item of the benchmark at all"), (4, "one two"), (4, "one two")]


@pytest.fixture(scope="module")
def sf_dir(spark, labels, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{root}/labels.parquet")
    hostile(spark.createDataFrame(BENCHMARK, "item_id bigint, text string")).write.parquet(f"{root}/benchmark.parquet")
    return root


def test_line_dedup(docs, none):
    out = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=2).collect()}
    assert (1, 2, 1) in out and (7, 2, 0) in out and (2, 1, 0) in out and (None, 1, 0) in out and (5, 4, 0) in out
    assert line_dedup.dedup_lines(docs).count() == len(ROWS)
    assert line_dedup.dedup_lines(none).count() == 0


def test_bpe(docs, none):
    out = bpe.round_trip(docs).collect()
    assert len(out) == len(ROWS) and all((r.n_tokens == 0) == (r.doc_id in (2, 3)) for r in out)
    assert bpe.round_trip(none).count() == 0
    decoded = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.text_bytes)) for r in decoded) == sorted((r[0] or 0, (r[1] or "").encode()) for r in ROWS)


def test_license_scan(docs, none):
    out = license_scan.scan_licenses(docs).collect()
    assert len(out) == len(ROWS) and sum(r.n_base for r in out) == 1
    assert sum(r.doc_id == 1 for r in out) == 2 and {r.n_words for r in out if r.doc_id in (2, 3, 5)} == {0}
    assert license_scan.scan_licenses(none).count() == 0


def test_decontamination(spark, docs, none):
    items = hostile(spark.createDataFrame(BENCHMARK, "item_id bigint, text string"))
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.clean(docs, items).count() == len(ROWS)


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    assert {r.component_id for r in out if r.doc_id in (2, 3, 5)} == {2} and {r.component_id for r in out if r.doc_id in (1, 7)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6]


def test_secrets(docs, none):
    out = secrets.find_secrets(docs).collect()
    assert len(out) == len(ROWS) and sum(r.n_assign for r in out) == 1
    assert secrets.find_secrets(none).count() == 0


def test_quality(docs, none, labels):
    models = quality.fit(docs, labels)
    assert quality.score_documents(docs, models).count() == len(ROWS)
    assert quality.keep_good(docs, models).columns == docs.columns
    assert quality.fit(none, labels) == {} and quality.fit(docs, labels.where("false")) == {}
    assert quality.score_documents(none, {}).count() == 0


def test_url_filter(spark):
    rows = [(1, None), (2, ""), (3, "://"), (3, "://"), (None, "http://a.org/x"), (4, "no scheme.org/"), (5, "http://EXAMPLE.org/es/" + "y" * 50_000), (6, "http://x.org?q=/"), (7, "s://://example.org/en/1")]
    pages = hostile(spark.createDataFrame(rows, "page_id bigint, url string")).withColumns({"host": F.lit("h"), "rules": F.lit(1), "html": F.lit(None).cast("string")})
    out = [(r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()]
    assert sorted(out, key=str) == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "a.org", "/x", "org/", "allow"), (4, "", "", None, "allow"),
         (5, "example.org", "/es/yyyyy", "example.org/es/", "block"), (6, "x.org", "", None, "allow"), (7, ":", "//example", None, "allow")], key=str)
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_warc(spark):
    rows = [(1, "u", "p" * 200), (2, "u", "p" * 200), (2, "u", "p" * 200), (None, None, "p" * 200), (3, "a\r\nb", None), (4, "", ""), (5, "é", "é" * 60), (6, "é", "short"), (7, "é", "short"), (8, "b", "\r\n\r\nWARC/1.1" + "z" * 300_000)]
    pages = hostile(spark.createDataFrame(rows, "page_id bigint, url string, html string")).drop("payload").withColumn("payload", F.lit("clash"))
    out = sorted([(r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect()])
    assert out == [(0, 200, "revisit", 1), (1, 200, "response", None), (2, 200, "revisit", 1), (2, 200, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 120, "response", None), (6, 5, "response", None), (7, 5, "response", None), (8, 300_012, "response", None)]
    assert warc.archive(pages.where("false")).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 1.0]), (None, [9.0, 9.0]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [1e30, 1.0]), (8, [-1.0, 0.0])]
    table = hostile(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table).collect())
    same = 1024 * 1024 + 2048 * 2048
    assert [x[2:] for x in out if x[0] == 0] == [(7, (1 << 63) - 1), (100, same), (8, -1024 * 1024)] and len([x for x in out if x[0] == 100]) == 3
    assert topk.top_k(table.where("false")).count() == 0


def test_pipeline_stages(spark, docs, none, sf_dir):
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf_dir)
            assert out.columns == table.columns, name
            now = out
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
        assert "tokens" in last.columns and last.count() <= table.count()
