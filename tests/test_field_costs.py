"""The field table is finalized from rows and notes that are computed once each."""

import contextlib
import io
from pathlib import Path

from pyspark.sql import functions as F

from docloom.functions.dates import parse_date
from docloom.operators import fields as FD
from docloom.plans.stage import cut, stage_root

KEYS = ["bid_deadline_date_time", "project_location", "project_name", "project_description"]


def test_rows_and_notes_are_computed_once(spark):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("rows", "notes")}

    def counted(name):
        total = seen[name]

        @F.udf("string")
        def same(x):
            total.add(1)
            return x

        return same.asNondeterministic()

    i = F.col("id")
    text = {
        "bucket": F.element_at(F.array(*[F.lit(b) for b in ("project_dates", "project_size_location_items", "project_metadata_items", "project_metadata_items")]), (i % 4 + 1).cast("int")),
        "field_key": F.element_at(F.array(*[F.lit(k) for k in KEYS]), (i % 4 + 1).cast("int")), "row_seq": i, "doc_id": F.floor(i / 8),
        "text": F.concat(F.lit("Project thing: value "), i.cast("string"), F.lit(". long enough")), "date": F.when(i % 4 == 0, "March 3, 2026").otherwise(""),
    }
    rows = spark.range(160).select(*FD._blank_row(text))
    rows = rows.withColumn("text", counted("rows")("text"))
    notes = spark.range(20).select(i.alias("doc_id"), F.lit(KEYS[0]).alias("field_key"), counted("notes")(F.lit("Mandatory visit")).alias("note"))
    out, warnings = FD.finalize(rows, notes)
    assert out.count() > 0 and warnings.count() > 0
    assert out.where("field_key = 'project_location'").count() == 20
    assert {name: total.value for name, total in seen.items()} == {"rows": 160, "notes": 20}


def plan_of(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain(extended=True)
    return shown.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def small_rows(spark):
    i = F.col("id")
    date = F.element_at(F.array(F.lit("2026-03-02T10:00:00"), F.lit("March 3, 2019"), F.lit("2026-02-30T10:00:00"), F.lit("2026-03-02T10:00:00\n")), (F.floor(i / 8) % 4 + 1).cast("int"))
    return spark.range(160).select(*FD._blank_row({
        "doc_id": F.floor(i / 8), "row_seq": i, "bucket": F.when(i % 4 == 0, "project_dates").otherwise("project_metadata_items"),
        "field_key": F.when(i % 4 == 0, "bid_deadline_date_time").when(i % 4 == 1, "project_name").when(i % 4 == 2, "project_description").otherwise("project_owner"),
        "text": F.when(i % 4 == 2, F.repeat(F.lit("Build the bridge; "), 6)).otherwise("Thing: value"), "date": F.when(i % 4 == 0, date).otherwise(""),
    }))


def test_only_rows_a_rule_can_change_are_joined(spark):
    rows = cut(small_rows(spark))
    for made, key in ((FD.filter_rows(rows), "project_description"), (FD.rule_end_date(rows), "project_end_date_time"), (FD.rule_award_anchor(rows), "project_end_date_time")):
        before, _, joined = plan_of(made).partition("Join ")
        assert "Union" in before and key in joined
    assert FD.filter_rows(rows).count() == 160


def test_stage_tables_are_packed_and_dates_are_read_once(spark):
    root = Path(stage_root(spark).removeprefix("file:"))
    before = set(root.rglob("*.parquet"))
    out, warnings = FD.finalize(small_rows(spark))
    files = [f for f in set(root.rglob("*.parquet")) - before if f.is_file()]
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert "gettimestamp" not in plan_of(warnings).lower()
    assert FD.READ not in out.columns
    kept = {r.doc_id: (r.date, r.confidence) for r in out.where("bucket = 'project_dates'").collect()}
    wrong = {d for d, (date, c) in kept.items() if "2019" in date}
    assert wrong and all(kept[d][1] == 0 for d in wrong)
    assert {r.doc_id for r in warnings.where("message LIKE 'Date year 2019%'").collect()} == wrong


def test_plain_dates_read_like_written_ones(spark):
    texts = ["2026-03-02T10:00:00", "2026-03-02 10:00:00", "2026-02-30T10:00:00", "2026-03-02T10:00:00\n", "2026-13-02T10:00:00", "2026-03-02T24:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(parse_date("t").alias("a"), parse_date(F.concat(F.lit(" "), "t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a is not None and got[2].a is None and got[3].a == got[0].a
