import os
import tempfile
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.sources import files as S
from docloom.sources import snapshots as N
from docloom.streaming import jobs as J


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


DOCS = "doc_id bigint, v string"


def values(df):
    return sorted((r.doc_id, r.v) for r in df.collect())


def test_replace_by_doc_keeps_other_documents(spark):
    path = fresh() + "/t"
    assert N.read_snapshot(spark, path) is None
    assert S.replace_by_doc(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], DOCS), path, buckets=2) == 0
    assert S.replace_by_doc(spark.createDataFrame([(2, "x"), (2, "y")], DOCS), path, buckets=2) == 1
    assert values(N.read_snapshot(spark, path)) == [(1, "a"), (2, "x"), (2, "y"), (3, "c")]
    assert values(N.read_snapshot(spark, path, 0)) == [(1, "a"), (2, "b"), (3, "c")]


def test_documents_without_rows_are_deleted(spark):
    path = fresh() + "/t"
    S.replace_by_doc(spark.createDataFrame([(k, "a") for k in range(9)], DOCS), path, buckets=3)
    gone = spark.createDataFrame([(k,) for k in range(8)], "doc_id bigint")
    S.replace_by_doc(spark.createDataFrame([(4, "b")], DOCS), path, buckets=3, documents=gone)
    assert values(N.read_snapshot(spark, path)) == [(4, "b"), (8, "a")]
    S.replace_by_doc(spark.createDataFrame([], DOCS), path, buckets=3, documents=spark.createDataFrame([(4,), (8,)], "doc_id bigint"))
    assert values(N.read_snapshot(spark, path)) == [] and N.read_snapshot(spark, path).columns == ["doc_id", "v"]


def test_a_write_that_dies_changes_nothing(spark, monkeypatch):
    path = fresh() + "/t"
    S.replace_by_doc(spark.createDataFrame([(1, "a"), (2, "b")], DOCS), path, buckets=2)

    def die(*_):
        raise OSError("killed between the data and the commit")

    with monkeypatch.context() as m:
        m.setattr(N, "commit", die)
        with pytest.raises(OSError):
            S.replace_by_doc(spark.createDataFrame([(1, "half")], DOCS), path, buckets=2)
    assert N.versions(spark, path) == [0] and values(N.read_snapshot(spark, path)) == [(1, "a"), (2, "b")]
    # files of a commit without its success mark do not count either
    N.commit(spark, path, 1, {0: 1, 1: 1})
    os.remove(f"{path}/_commits/v1/_SUCCESS")
    assert values(N.read_snapshot(spark, path)) == [(1, "a"), (2, "b")]
    # the next write takes the same number and its own files
    assert S.replace_by_doc(spark.createDataFrame([(1, "new")], DOCS), path, buckets=2) == 1
    assert values(N.read_snapshot(spark, path)) == [(1, "new"), (2, "b")]


def test_old_versions_are_folded(spark):
    path = fresh() + "/t"
    for k in range(4):
        S.replace_by_doc(spark.createDataFrame([(k, f"v{k}"), (9, f"v{k}")], DOCS), path, buckets=4)
    before = values(N.read_snapshot(spark, path))
    assert N.fold(spark, path, keep=2) and N.versions(spark, path) == [2, 3]
    assert values(N.read_snapshot(spark, path)) == before == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "v3"), (9, "v3")]
    assert (9, "v2") in values(N.read_snapshot(spark, path, 2))
    with pytest.raises(ValueError):
        N.read_snapshot(spark, path, 0)
    assert N.fold(spark, path, keep=2) == []


def test_scan_uploads(spark):
    d = fresh()
    for name, body in (("a.pdf", b"%PDF-1"), ("b.docx", b"%PDF-1"), ("c.txt", b"x"), ("d.pdf", b"")):
        with open(f"{d}/{name}", "wb") as f:
            f.write(body)
    rows = {r.path[-5:]: (r.verdict, r.mime_verdict) for r in S.validate_mime(S.scan_uploads(spark, d)).collect()}
    assert rows["a.pdf"] == ("ok", "ok") and rows[".docx"[-5:]] == ("ok", "mime_extension_mismatch")
    assert rows["c.txt"][0] == "invalid_file_type" and rows["d.pdf"][0] == "empty_file"
    listing = spark.createDataFrame([("d.pdf", 0), ("e.pdf", 60 * 1024 * 1024)], "path string, length bigint")
    assert [r.v for r in listing.orderBy("path").select(S.upload_verdict("path", "length").alias("v")).collect()] == ["empty_file", "file_too_large"]


def test_folders_are_listed_beside_each_other(spark):
    d = fresh()
    for name in ("a.pdf", "x/b.pdf", "x/deep/c.docx", "y/.hidden", "y/empty.docx"):
        os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
        with open(f"{d}/{name}", "wb") as f:
            f.write(b"" if "empty" in name else b"PK\x03\x04 and more")
    os.symlink(f"{d}/nowhere", f"{d}/x/gone.pdf")
    files = S.scan_uploads(spark, d)
    assert files.rdd.getNumPartitions() == 3
    got = {r.path[len(d) + 1 :]: (r.length, r.verdict, bytes(r["head"] or b"")) for r in files.collect()}
    assert got["x/deep/c.docx"] == (13, "ok", b"PK\x03\x04") and got["y/empty.docx"][1] == "empty_file" and got["y/.hidden"][1] == "invalid_file_type"
    assert set(got) >= {"a.pdf", "x/b.pdf", "x/deep/c.docx", "y/.hidden", "y/empty.docx"}
    assert S.read_uploads(spark, d).where("verdict = 'ok'").select("content").count() == 3


def test_results_and_manifest(spark):
    d = fresh()
    with open(d + "/doc_1.json", "w") as f:
        f.write('{"doc_id":"1","filename":"a.pdf","data":{"summary":{"summary_json":{"spec_check_fields":{"project_dates":[{"field_key":"k","text":"t","date":"d","confidence":9}]}}}}}')
    with open(d + "/all_results.json", "w") as f:
        f.write("{}")
    r = S.read_results(spark, d)
    assert r.count() == 1 and r.select(F.col("data.summary.summary_json.spec_check_fields")["project_dates"][0]["confidence"].alias("c")).first().c == 9
    with open(d + "/m.json", "w") as f:
        f.write('{"documents":[{"id":"x","enabled":true,"expect":{"min_row_count":3}}],"thresholds":{"macro_f1":0.8}}')
    assert S.read_manifest(spark, d + "/m.json").first().expect.min_row_count == 3


def stream_of(spark, df):
    d = fresh()
    df.write.mode("overwrite").parquet(d + "/in")
    return spark.readStream.schema(df.schema).parquet(d + "/in"), d


def run(df, d, mode="append"):
    name = "t" + d.rsplit("-", 1)[-1].replace("/", "")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", d + "/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark):
    ups = spark.createDataFrame([("a", dt(2024, 1, 1)), ("a", dt(2024, 1, 1, 0, 5)), ("b", dt(2024, 1, 1))], "checksum string, ts timestamp")
    s, d = stream_of(spark, ups)
    assert sorted(r.checksum for r in run(J.dedup_uploads(s), d).collect()) == ["a", "b"]
    ev = spark.createDataFrame([(dt(2024, 1, 1, 3), "signup"), (dt(2024, 1, 1, 4), "error"), (dt(2024, 1, 9), "signup")], "ts timestamp, event_type string")
    s, d = stream_of(spark, ev)
    rows = run(J.activity_stream(s), d).collect()
    assert [(r.events, r.uploads, r.failed) for r in rows if r.day == dt(2024, 1, 1)] == [(2, 1, 1)]
    fb = spark.createDataFrame([("p", "down", "x")] * 3 + [("q", "down", "")], "extraction_type string, rating string, correct_value string")
    s, d = stream_of(spark, fb)
    assert [(r.extraction_type, r.corrections, r.alert) for r in run(J.threshold_stream(s, 3), d, "complete").collect()] == [("p", 3, True)]


def test_foreach_upsert_continues_and_touches_few_buckets(spark):
    s, d = stream_of(spark, spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"))
    merge = lambda old, new: new if old is None else S.upsert(old, new, ["k"])
    J.foreach_upsert(s, merge, ["k"], d + "/out", d + "/cp2").awaitTermination(120)
    s2, d2 = stream_of(spark, spark.createDataFrame([("b", 5), ("c", 6)], "k string, n int"))
    J.foreach_upsert(s2, merge, ["k"], d + "/out", d2 + "/cp").awaitTermination(120)
    assert sorted((r.k, r.n) for r in J.latest_table(spark, d + "/out").collect()) == [("a", 1), ("b", 5), ("c", 6)]
    assert {r.version for r in spark.read.parquet(d + "/out").collect()} == {0, 1}
    assert sorted((r.k, r.n) for r in J.latest_table(spark, d + "/out", 1).collect()) == [("a", 1), ("b", 2)]


def test_keyed_alerts_and_stale_documents(spark):
    fb = spark.createDataFrame([("p", "down", "x")] * 3 + [("q", "down", ""), ("r", "down", "x")], "extraction_type string, rating string, correct_value string")
    s, d = stream_of(spark, fb)
    assert [(r.extraction_type, r.corrections) for r in run(J.threshold_alerts(s, 3), d).collect()] == [("p", 3)]
    rows = [(1, "queued", dt(2024, 1, 1, 8)), (2, "parsing_processing", dt(2024, 1, 1, 8)), (2, "completed", dt(2024, 1, 1, 9)), (3, "parsing_processing", dt(2024, 1, 1, 8)), (4, "queued", dt(2024, 1, 1, 12))]
    s, d = stream_of(spark, spark.createDataFrame(rows, "doc_id bigint, status string, ts timestamp"))
    got = run(J.stale_stream(s, minutes=30), d).collect()
    assert sorted((r.doc_id, r.status, r.action) for r in got) == [(1, "queued", "requeue"), (3, "parsing_processing", "fail")]


def rows_over_files(spark, build, frames):
    """What a stream gives for files that arrive one after the other, each in a batch of its own."""
    d = fresh()
    os.makedirs(d + "/in")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(d + "/in")
    out = []
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(d + "/in")
        query = build(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", d + "/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    return out


def test_stale_documents_are_requeued_once_and_then_fail(spark):
    schema = "doc_id bigint, status string, ts timestamp"
    steps = [
        [(1, "queued", dt(2024, 1, 1, 8)), (2, "queued", dt(2024, 1, 1, 8)), (3, "uploaded", dt(2024, 1, 1, 8))], [(9, "completed", dt(2024, 1, 1, 9))], [(2, "parsing_processing", dt(2024, 1, 1, 9, 1)), (3, "completed", dt(2024, 1, 1, 9, 1))],
        [(9, "completed", dt(2024, 1, 1, 12))], [(9, "completed", dt(2024, 1, 1, 15))],
    ]
    got = rows_over_files(spark, lambda s: J.stale_stream(s, minutes=30), [spark.createDataFrame(x, schema) for x in steps])
    assert [(r.doc_id, r.action, r.reason) for r in sorted(got, key=lambda r: (r.doc_id, r.action != "requeue"))] == [
        (1, "requeue", None), (1, "fail", "queued job never picked up (re-enqueue already attempted)"),
        (2, "requeue", None), (2, "fail", "processing died mid-stage (parsing_processing)"), (3, "requeue", None),
    ]
    # the batch sweep decides the same for documents whose job carries the mark
    docs = spark.createDataFrame([(1, "queued", dt(2024, 1, 1, 8)), (2, "parsing_processing", dt(2024, 1, 1, 9, 1))], "doc_id bigint, status string, updated_at timestamp")
    jobs = spark.createDataFrame([(1, "a", True, dt(2024, 1, 1)), (2, "b", True, dt(2024, 1, 1))], "doc_id bigint, job_id string, requeued boolean, created_at timestamp")
    want = {(r.doc_id, r.action, r.reason) for r in J.sweep_stale(docs, jobs, "2024-01-01 12:00:00").collect()}
    assert want == {(r.doc_id, r.action, r.reason) for r in got if r.action == "fail"}


def test_stage_stream_equals_the_batch_view(spark):
    import random

    rnd = random.Random(2)
    rows = []
    for k in range(150):
        job, stage, state = rnd.randrange(4), rnd.choice(["parsing", "chunking"]), rnd.choice(["started", "started", "completed", "failed"])
        rows.append((job, k, stage + ("_completed" if state == "completed" else "_processing"), state, dt(2024, 1, 1, 8 + k // 50, k % 50, k % 7)))
    schema = "job_id bigint, event_id bigint, stage string, state string, ts timestamp"
    mixed = sorted(rows, key=lambda r: (r[4], rnd.random()))
    blocks = [mixed[a : a + 30] for a in range(0, 150, 30)]
    for a, b in zip(blocks, blocks[1:]):  # neighbouring files overlap in time
        a[-3:], b[:3] = b[:3], a[-3:]
    end = [(99, 999, "parsing_processing", "completed", dt(2024, 1, 9)), ]
    frames = [spark.createDataFrame(x, schema) for x in [*blocks, end, [(99, 1000, "parsing_processing", "completed", dt(2024, 1, 12))]]]
    got = rows_over_files(spark, lambda s: J.stage_durations_stream(s, "20 minutes", "1 hour"), frames)
    want = J.stage_durations(spark.createDataFrame(rows, schema)).collect()
    shown = lambda r: (r.job_id, r.stage, str(r.started_at), str(r.ended_at), r.state, None if r.seconds is None or r.seconds != r.seconds else round(r.seconds, 3))
    # an open row that was closed later is replaced by the closed one
    closed = {shown(r)[:3] for r in got if r.state != "open"}
    final = sorted(x for x in map(shown, got) if x[0] != 99 and not (x[4] == "open" and x[:3] in closed))
    assert final == sorted(map(shown, want))


def test_result_insights(spark):
    d = fresh()
    with open(d + "/doc_1.json", "w") as f:
        f.write('{"doc_id":"1","data":{"parsed":{"parsing_quality_score":0.5},"insights":[{"extraction_type":"a","payload":{"items":[{"x":1},{"x":2}]},"token_usage":{"prompt_tokens":7}},{"extraction_type":"b"}]}}')
    rows = S.result_insights(S.read_results(spark, d)).collect()
    assert sorted((r.extraction_type, r.n_items, r.prompt_tokens) for r in rows) == [("a", 2, 7), ("b", 0, None)]


def test_rows_of_a_large_bucket_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "TASK_ROWS", 100, raising=False)
    path, rows = fresh() + "/t", [(i % 5, f"v{i}") for i in range(1000)]
    N.replace_documents(spark.createDataFrame(rows, DOCS), path, buckets=1)
    assert values(N.read_snapshot(spark, path)) == sorted(rows)
    files = [f for f in os.listdir(f"{path}/data/v0/doc_bucket=0") if f.endswith(".parquet")]
    assert len(files) > 3
    N.replace_documents(spark.createDataFrame([(1, "new")], DOCS), path, buckets=1)
    assert values(N.read_snapshot(spark, path)) == sorted([r for r in rows if r[0] != 1] + [(1, "new")])
