"""Team analytics, report tables, reviewer notes and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import UNCUT, Limits
from docloom.fixed import CANONICAL_FIELDS, DISPLAY_LABELS, EVENT_FIELDS
from docloom.functions.text import first, head, strip, within
from docloom.operators.feedback import _text, after_label


def _since(df: DataFrame, since, column: str = "created_at") -> DataFrame:
    return df if since is None else df.where(F.col(column) >= F.lit(since).cast("timestamp"))


def _rate(part, whole) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole) * 100, 1)).otherwise(0.0)


def user_insights(users: DataFrame, docs: DataFrame, insights: DataFrame, fb: DataFrame, jobs: DataFrame, since=None) -> DataFrame:
    """One row per user with documents in the window.

    Every fact shrinks to one row per document first and only then meets the documents, so
    facts never multiply each other and hot users cost one row per document.
    """
    d = _since(docs, since).select("doc_id", F.col("uploaded_by").alias("user_id"), "status", "created_at")
    items = insights.groupBy("doc_id").agg(F.sum("n_items").alias("items"))
    votes = fb.groupBy("doc_id").agg(
        F.count_if(F.col("rating") == "down").alias("downs"), F.count_if(F.col("rating") == "up").alias("ups")
    )
    span = F.when(
        (F.col("current_stage") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(),
        F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")),
    )
    runs = jobs.select("doc_id", span.alias("span")).groupBy("doc_id").agg(
        F.count("*").alias("jobs"), F.sum("span").alias("spans"), F.count("span").alias("timed")
    )
    per_doc = d.join(items, "doc_id", "left").join(votes, "doc_id", "left").join(runs, "doc_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per_user = per_doc.groupBy("user_id").agg(
        F.count("*").alias("docs_total"), F.count_if(F.col("status") == "completed").alias("docs_completed"),
        F.count_if(F.col("status") == "failed").alias("docs_failed"), zero("items").alias("fields_extracted"),
        zero("downs").alias("fields_corrected"), zero("ups").alias("fields_confirmed"),
        zero("jobs").alias("jobs"), zero("spans").alias("spans"), zero("timed").alias("timed"),
        F.max("created_at").alias("last_activity"),
    )
    return per_user.join(users.select("user_id", "username"), "user_id").select(
        "user_id", "username", "docs_total", "docs_completed", "docs_failed", "fields_extracted", "fields_corrected",
        "fields_confirmed", _rate("fields_corrected", "fields_extracted").alias("correction_rate"),
        F.when(F.col("timed") > 0, F.round(F.col("spans") / F.col("timed") / 1_000_000, 1)).alias("avg_processing_seconds"),
        F.greatest(F.lit(0), F.col("jobs") - F.col("docs_total")).alias("retry_jobs"), "last_activity",
    )


def accuracy_trend(fb: DataFrame, since=None) -> DataFrame:
    g = _since(fb, since).groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("feedback_total"), F.count_if(F.col("rating") == "down").alias("corrections")
    )
    return g.withColumn("correction_rate", _rate("corrections", "feedback_total"))


def _newest(rows: DataFrame, n: int | None, *order: Column) -> DataFrame:
    return rows if n is None else rows.orderBy(*order).limit(n)


def problem_fields(fb: DataFrame, since=None, top: int | None = None) -> DataFrame:
    counts = _since(fb.where(F.col("rating") == "down"), since).groupBy("field_key").agg(F.count("*").alias("corrections"))
    return _newest(counts, top, F.desc("corrections"), F.col("field_key"))


def failure_stats(docs: DataFrame, since=None) -> DataFrame:
    return _since(docs, since).agg(
        F.count_if(F.col("status") == "failed").alias("documents_failed"), F.count("*").alias("documents_total")
    )


def top_error_codes(jobs: DataFrame, since=None, top: int | None = None) -> DataFrame:
    failed = _since(jobs.where((F.col("current_stage") == "failed") & (_text("error_code") != "")), since)
    return _newest(failed.groupBy("error_code").agg(F.count("*").alias("count")), top, F.desc("count"), F.col("error_code"))


def activity_timeline(docs: DataFrame, since=None) -> DataFrame:
    return _since(docs, since).groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("uploads"), F.count_if(F.col("status") == "completed").alias("completed")
    )


def user_documents(docs: DataFrame, user_id, since=None, top: int | None = None) -> DataFrame:
    mine = _since(docs.where(F.col("uploaded_by") == F.lit(user_id)), since)
    return _newest(mine, top, F.desc("created_at"), F.desc("doc_id")).select(
        "doc_id", "filename", "status", F.round(F.col("size_bytes") / 1048576, 1).alias("size_mb"), "created_at"
    )


def user_detail(docs: DataFrame, items: DataFrame, fb: DataFrame, user_id=None, since=None) -> DataFrame:
    """Extracted and corrected field counts: kind `field`, `corrected` or `corrected_by_document`.

    Without a user the breakdown is made for every user at once.
    """
    d = _since(docs, since).select("doc_id", F.col("uploaded_by").alias("user_id"))
    if user_id is not None:
        d = d.where(F.col("user_id") == F.lit(user_id))
    label = F.coalesce(F.nullif(strip(_text("label")), F.lit("")), F.lit("(unlabeled)"))
    key = F.coalesce(F.nullif(_text("field_key"), F.lit("")), F.lit("(unknown)"))
    none = F.lit(None).cast("bigint")
    f = items.groupBy("doc_id", label.alias("field")).agg(F.count("*").alias("n")).join(d, "doc_id")
    fields = f.groupBy("user_id", "field").agg(F.sum("n").alias("count")).select(
        "user_id", F.lit("field").alias("kind"), none.alias("doc_id"), "field", "count"
    )
    c = fb.where(F.col("rating") == "down").groupBy("doc_id", key.alias("field")).agg(F.count("*").alias("count")).join(d, "doc_id")
    by_doc = c.select("user_id", F.lit("corrected_by_document").alias("kind"), "doc_id", "field", "count")
    total = c.groupBy("user_id", "field").agg(F.sum("count").alias("count")).select(
        "user_id", F.lit("corrected").alias("kind"), none.alias("doc_id"), "field", "count"
    )
    return fields.unionByName(total).unionByName(by_doc)


def insight_snapshot(users: DataFrame, docs: DataFrame, insights: DataFrame, fb: DataFrame, jobs: DataFrame, since=None, limits: Limits = UNCUT) -> DataFrame:
    """One JSON value of the team statistics with its content key.

    Its size is that of the report: one entry per user, and the trend days and corrections that the limits allow.
    """
    def packed(df, *order):
        cols = [c for c in df.columns if c not in ("__o",)]
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*cols).alias("v")))), lambda s: s["v"]).alias("x"))

    u = user_insights(users, docs, insights, fb, jobs, since)
    trend = _newest(accuracy_trend(fb, since), limits.trend_days, F.desc("day"))
    down = _since(fb.where(F.col("rating") == "down"), since)
    recent = _newest(down, limits.recent_corrections, F.desc("created_at"), F.desc("feedback_id")).select(
        "created_at", "feedback_id", "field_key", "extracted_value", "correct_value", "issue_type", "comment"
    )
    parts = {
        "users": packed(u, -F.col("docs_total"), F.col("user_id")),
        "field_problem_ranking": packed(problem_fields(fb, since, limits.problem_fields), -F.col("corrections"), F.col("field_key")),
        "failure_stats": packed(failure_stats(docs, since), F.lit(0)),
        "top_error_codes": packed(top_error_codes(jobs, since, limits.error_codes), -F.col("count"), F.col("error_code")),
        "accuracy_trend": packed(trend, F.col("day")),
        "correction_examples": packed(recent, F.col("created_at"), F.col("feedback_id")),
    }
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), F.to_json("x").alias("json"))
        rows = one if rows is None else rows.unionByName(one)
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "json"))), lambda s: F.concat(F.lit('"'), s["part"], F.lit('":'), s["json"])), ","
    )
    return rows.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("snapshot")).select(
        "snapshot", F.substring(F.sha2("snapshot", 256), 1, 16).alias("cache_key")
    )


def clamp_days(days: int) -> int:
    return max(0, min(int(days), 365))


def build_insights(users: DataFrame, docs: DataFrame, insights: DataFrame, fb: DataFrame, jobs: DataFrame, days: int, now, limits: Limits = UNCUT) -> dict[str, DataFrame]:
    """The whole analytics payload; zero days means all time."""
    import datetime

    days = clamp_days(days)
    since = None if days == 0 else now - datetime.timedelta(days=days)
    return {
        "users": user_insights(users, docs, insights, fb, jobs, since),
        "accuracy_trend": accuracy_trend(fb, since),
        "field_problem_ranking": problem_fields(fb, since, limits.problem_fields),
        "failure_stats": failure_stats(docs, since),
        "top_error_codes": top_error_codes(jobs, since, limits.error_codes),
        "activity_timeline": activity_timeline(docs, since),
    }


def newest_documents(docs: DataFrame, since=None, user_id=None, top: int | None = None) -> DataFrame:
    rows = _since(docs, since)
    if user_id is not None:
        rows = rows.where(F.col("uploaded_by") == F.lit(user_id))
    return _newest(rows, top, F.desc("created_at"), F.desc("doc_id"))


def field_matrix(docs: DataFrame, spec: DataFrame, fb: DataFrame, since=None, user_id=None, top: int | None = None) -> DataFrame:
    """Wrong, Correct or Not found for every canonical field of the newest documents, or of all."""
    chosen = newest_documents(docs, since, user_id, top).select("doc_id", "filename")
    pairs = F.array(*[F.struct(F.lit(k).alias("field_key"), F.lit(v).alias("label")) for k, v in CANONICAL_FIELDS])
    grid = chosen.select("doc_id", "filename", F.explode(pairs).alias("f")).select("doc_id", "filename", "f.field_key", "f.label")
    reason = F.concat_ws(" — ", F.nullif(_text("issue_type"), F.lit("")), F.nullif(_text("comment"), F.lit("")))
    wrong = fb.where(F.col("rating") == "down").groupBy("doc_id", "field_key").agg(
        F.max(F.struct(
            (_text("correct_value") != "").alias("has"), "created_at", "feedback_id", _text("correct_value").alias("correction"),
            F.when(reason != "", reason).otherwise("Marked wrong").alias("reason"),
        )).alias("w")
    )
    found = spec.where(strip(_text("field_key")) != "").select("doc_id", strip("field_key").alias("field_key")).distinct().withColumn("found", F.lit(True))
    return grid.join(wrong, ["doc_id", "field_key"], "left").join(found, ["doc_id", "field_key"], "left").select(
        "doc_id", "filename", "field_key", "label",
        F.when(F.col("w").isNotNull(), "Wrong").when(F.col("found"), "Correct").otherwise("Not found").alias("status"),
        F.coalesce("w.correction", F.lit("")).alias("correction"), F.coalesce("w.reason", F.lit("")).alias("reason"),
    )


def event_matrix(docs: DataFrame, spec: DataFrame, since=None, user_id=None, top: int | None = None) -> DataFrame:
    """Notes of the newest documents, or of all, per event field, for fields that have any note."""
    chosen = newest_documents(docs, since, user_id, top).select("doc_id")
    note = strip(_text("note"))
    notes = spec.where(note != "").join(chosen, "doc_id", "left_semi").groupBy("doc_id", "field_key").agg(
        F.max(F.struct("row_seq", note.alias("n")))["n"].alias("note")
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("field_key"), F.lit(v).alias("label")) for k, v in EVENT_FIELDS])
    grid = chosen.select("doc_id", F.explode(pairs).alias("f")).select("doc_id", "f.field_key", "f.label")
    live = notes.select("field_key").distinct()
    return grid.join(live, "field_key", "left_semi").join(notes, ["doc_id", "field_key"], "left").select(
        "doc_id", F.concat("field_key", F.lit("_events")).alias("field_key"), "label",
        F.when(F.col("note").isNotNull(), "Correct").otherwise("Not found").alias("status"),
        F.coalesce("note", F.lit("")).alias("correction"),
    )


def export_summary(users: DataFrame, period: str, generated: str, scope: str = "All users") -> DataFrame:
    """The metric rows of the report's first sheet."""
    s = users.agg(
        F.count("*").alias("u"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
            "docs_total", "docs_completed", "docs_failed", "fields_extracted", "fields_corrected")]
    )
    rate = F.when(
        F.col("fields_extracted") > 0,
        F.concat(F.round(F.col("fields_corrected") / F.col("fields_extracted") * 100, 1).cast("string"), F.lit("%")),
    ).otherwise("0%")
    rows = [
        ("Period", F.lit(period)), ("Generated", F.lit(generated)), ("Scope", F.lit(scope)),
        ("Active users", F.col("u").cast("string")), ("Documents uploaded", F.col("docs_total").cast("string")),
        ("Documents completed", F.col("docs_completed").cast("string")), ("Documents failed", F.col("docs_failed").cast("string")),
        ("Fields extracted", F.col("fields_extracted").cast("string")),
        ("Fields corrected (thumbs down)", F.col("fields_corrected").cast("string")), ("Overall correction rate", rate),
    ]
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(rows)])
    return s.select(F.explode(entries).alias("e")).select("e.i", "e.metric", "e.value")


def export_scope(requested_user, current_user, is_management: bool):
    """Whose rows an export covers; a general user is pinned to their own."""
    return requested_user if is_management else current_user


def _label_of(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DISPLAY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.replace(key, F.lit("_"), F.lit(" ")))


def admin_notes(docs: DataFrame, spec: DataFrame, fb: DataFrame, threshold: int = 70, limits: Limits = UNCUT) -> DataFrame:
    """One paragraph per document: key facts, corrections, confirmations, open reviews."""
    live = spec.where(~F.coalesce("not_found", F.lit(False)))
    value = F.nullif(F.when(F.col("field_key").endswith("_date_time"), strip(_text("date"))).otherwise(after_label("text")), F.lit(""))
    facts = live.groupBy("doc_id").agg(
        F.count("*").alias("fields_total"),
        F.min(F.when((F.col("field_key") == "project_name") & value.isNotNull(), F.struct("row_seq", value.alias("v"))))["v"].alias("name"),
        F.min(F.when((F.col("field_key") == "bid_deadline_date_time") & value.isNotNull(), F.struct("row_seq", value.alias("v"))))["v"].alias("due"),
    )
    has_summary = spec.select("doc_id").distinct().withColumn("has_summary", F.lit(True))
    down = fb.where(F.col("rating") == "down")
    old, new = strip(_text("extracted_value")), strip(_text("correct_value"))
    why = F.when(strip(_text("comment")) != "", strip("comment")).otherwise(strip(_text("issue_type")))
    label = _label_of(F.col("field_key"))
    piece = F.concat(
        F.when((new != "") & (old != ""), F.concat(label, F.lit(' corrected from "'), head(old, limits.note_value_chars), F.lit('" to "'), head(new, limits.note_value_chars), F.lit('"')))
        .when(new != "", F.concat(label, F.lit(' corrected to "'), head(new, limits.note_value_chars), F.lit('"')))
        .otherwise(F.concat(label, F.lit(" flagged as wrong"))),
        F.when(why != "", F.concat(F.lit(" ("), head(why, limits.note_reason_chars), F.lit(")"))).otherwise(""),
    )
    order = Window.partitionBy("doc_id").orderBy("created_at", "feedback_id")
    first6 = down.select("doc_id", "created_at", "feedback_id", piece.alias("piece")).withColumn("rn", F.row_number().over(order)).where(within("rn", limits.note_pieces))
    pieces = first6.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "piece"))), lambda s: s["piece"]), "; ").alias("pieces"))
    counts = fb.groupBy("doc_id").agg(
        F.count_if(F.col("rating") == "down").alias("n_down"), F.count_if(F.col("rating") == "up").alias("n_up")
    )
    corrected = down.select("doc_id", label.alias("lab")).distinct()
    low = live.where(F.col("confidence") < threshold).select("doc_id", label.alias("lab"), "row_seq").groupBy("doc_id", "lab").agg(F.min("row_seq").alias("o"))
    # at most one label per canonical field and document remains here
    outstanding = low.join(corrected, ["doc_id", "lab"], "left_anti").groupBy("doc_id").agg(
        F.array_join(F.transform(first(F.array_sort(F.collect_list(F.struct("o", "lab"))), limits.note_fields), lambda s: s["lab"]), ", ").alias("outstanding")
    )
    j = docs.select("doc_id")
    for part in (facts, has_summary, pieces, counts, outstanding):
        j = j.join(part, "doc_id", "left")
    due_ts = F.try_to_timestamp("due")
    due = F.when(due_ts.isNotNull(), F.replace(F.date_format(due_ts, "MMMM dd, yyyy, hh:mm a"), F.lit(" 0"), F.lit(" "))).otherwise(F.col("due"))
    key_facts = F.concat_ws(" — ", F.concat(F.lit('"'), F.col("name"), F.lit('"')), F.concat(F.lit("bid deadline "), due))
    total = F.coalesce("fields_total", F.lit(0)).cast("string")
    n_down, n_up = F.coalesce("n_down", F.lit(0)), F.coalesce("n_up", F.lit(0))
    summary = F.coalesce("has_summary", F.lit(False))
    s1 = (
        F.when(key_facts != "", F.concat(F.lit("Processed "), key_facts, F.lit(" with "), total, F.lit(" field(s) extracted.")))
        .when(summary, F.concat(F.lit("Processed with "), total, F.lit(" field(s) extracted.")))
        .otherwise("Document has no completed briefing yet.")
    )
    more = F.when(n_down > 6, F.concat(F.lit(" and "), (n_down - 6).cast("string"), F.lit(" more correction(s)"))).otherwise("")
    s2 = F.when(n_down > 0, F.concat(F.lit("Corrections: "), F.col("pieces"), more, F.lit(".")))
    s3 = F.when(n_up > 0, F.concat(n_up.cast("string"), F.lit(" field(s) confirmed correct by the reviewer.")))
    s4 = F.concat(F.lit("Pending review (low confidence): "), F.col("outstanding"), F.lit("."))
    s5 = F.when(s2.isNull() & s3.isNull() & s4.isNull() & summary & (n_down == 0), "No corrections were needed.")
    return j.select("doc_id", F.concat_ws(" ", s1, s2, s3, s4, s5).alias("note"))


def _seconds(s: Column) -> Column:
    rounded = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(s.isNull(), "—").when(s < 90, F.concat(rounded(s), F.lit("s")))
        .when(s < 5400, F.concat(rounded(s / 60), F.lit("m"))).otherwise(F.concat(F.format_number(s / 3600, 1), F.lit("h")))
    )


def observation_notes(users: DataFrame, limits: Limits = UNCUT) -> DataFrame:
    """Up to five sentences on the team; every pick is an aggregate, nothing is sorted."""
    tie = [-F.col("docs_total"), F.col("user_id")]
    fields = F.col("fields_extracted") >= 20
    row = F.struct("user_id", "username", "docs_completed", "docs_failed", "fields_extracted", "correction_rate", "avg_processing_seconds")

    def pick(cond, key):
        return F.min(F.when(cond, F.struct(key.alias("k"), *tie, row.alias("r"))))["r"]

    a = users.where(F.col("docs_total") > 0).agg(
        pick(F.lit(True), -F.col("docs_completed")).alias("top"),
        pick(fields, F.col("correction_rate")).alias("best"), pick(fields, -F.col("correction_rate")).alias("worst"),
        pick(F.col("docs_failed") > 0, -F.col("docs_failed")).alias("fail"),
        pick(F.col("avg_processing_seconds") < 86400, F.col("avg_processing_seconds")).alias("fast"),
        *[F.sum(c).alias(c) for c in ("fields_extracted", "fields_corrected", "fields_confirmed", "docs_completed", "docs_total")],
    )
    s = lambda c: F.col(c).cast("string")
    pct = F.format_number(F.col("fields_corrected") / F.col("fields_extracted") * 100, 1)
    notes = F.array(
        F.when(F.col("top.docs_completed") > 0, F.concat("top.username", F.lit(" processed the most documents ("), s("top.docs_completed"), F.lit(" completed)."))),
        F.when(F.col("best").isNotNull(), F.concat(
            "best.username", F.lit(" has the best accuracy — only "), s("best.correction_rate"), F.lit("% of "), s("best.fields_extracted"), F.lit(" extracted fields needed correction."))),
        F.when((F.col("worst.user_id") != F.col("best.user_id")) & (F.col("worst.correction_rate") >= 5), F.concat(
            "worst.username", F.lit("'s documents show the highest correction rate ("), s("worst.correction_rate"), F.lit("%) — worth reviewing which fields fail there."))),
        F.when(F.col("fail").isNotNull(), F.concat("fail.username", F.lit(" hit "), s("fail.docs_failed"), F.lit(" failed document(s) — check failure reasons below."))),
        F.when(F.col("fast").isNotNull(), F.concat(F.lit("Fastest average processing: "), F.col("fast.username"), F.lit(" at "), _seconds(F.col("fast.avg_processing_seconds")), F.lit(" per document."))),
        F.when(F.col("fields_extracted") > 0, F.concat(F.lit("Team extracted "), F.format_number("fields_extracted", 0), F.lit(" fields with an overall correction rate of "), pct, F.lit("%."))),
        F.when(F.col("fields_confirmed") > 0, F.concat(s("fields_confirmed"), F.lit(" field(s) explicitly confirmed correct by reviewers."))),
        F.when(F.col("docs_total") > 0, F.concat(s("docs_completed"), F.lit(" of "), s("docs_total"), F.lit(" documents completed successfully ("), F.floor(F.col("docs_completed") / F.col("docs_total") * 100 + 0.5).cast("string"), F.lit("%)."))),
    )
    return a.select(F.posexplode(first(F.array_compact(notes), limits.notes)).alias("i", "note"))


