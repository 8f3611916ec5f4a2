"""Audits of finished documents: golden checks, expectations, field audit, sanity issues, reports and display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed import SINGLETON_KEYS
from docloom.functions.text import col, strip
from docloom.operators.evaluation import golden_values, label_match
from docloom.operators.feedback import _text

# Fields that labels and reports ask for, groups of insights, names of conferences.
LABEL_KEYS = ["bid_deadline_date_time", "project_name", "project_owner", "project_solicitation_number", "question_deadline_date_time", "bid_open_date_time"]
CORE_KEYS = ["bid_deadline_date_time", "project_name", "project_owner"]
LABEL_PREFIX = r"(?i)^(project name|project owner|bid deadline|project solicitation number):\s*"
INSIGHT_GROUPS = [
    ("Qualification & evaluation", ["eligibility_criteria", "evaluation_criteria"]),
    ("Commercial & risk", ["payment_terms", "penalties_and_risks"]),
    ("Technical & delivery", ["technical_requirements", "scope_of_work"]),
    ("Submission package", ["mandatory_documents", "submission_deadlines"]),
]
LARGE_LIST = 12


def _done(c: str) -> Column:
    return F.coalesce(F.col(c) == "completed", F.lit(False))


def spec_profile(spec: DataFrame) -> DataFrame:
    """Rows, mean confidence, keys, surplus rows of singleton fields and rows without key or confidence per document."""
    key = _text("field_key")
    cells = spec.groupBy("doc_id", "bucket", key.alias("field_key")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"),
    )
    surplus = F.when(F.col("field_key").isin(SINGLETON_KEYS), F.col("n") - 1).otherwise(0)
    return cells.groupBy("doc_id").agg(
        F.sum("n").alias("row_count"), F.bround(F.sum("c") / F.sum("nc"), 1).alias("avg_confidence"), F.sum(surplus).alias("surplus"),
        F.collect_set(F.when(F.col("field_key") != "", F.col("field_key"))).alias("keys"),
        F.sum(F.col("n") - F.col("nc")).alias("without_confidence"), F.sum(F.when(F.col("field_key") == "", F.col("n")).otherwise(0)).alias("without_key"),
    )


def evaluate_documents(docs: DataFrame, spec: DataFrame, expect: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per expected document: passed, row_count, avg_confidence and its issues in order of name.

    `docs` carries pipeline_status and summary_status, `expect` min_row_count, min_avg_confidence,
    max_singleton_duplicates and required_field_keys, `labels` field_key and the wanted substrings (`needles`).
    A document that is not completed has only its states as issues.
    """
    values = golden_values(spec)
    wrong = labels.join(values, ["doc_id", "field_key"], "left").where(~label_match(F.coalesce("values", F.array().cast("array<string>")), "contains_any", "needles"))
    wrong = wrong.groupBy("doc_id").agg(F.collect_set("field_key").alias("wrong"))
    j = expect.join(docs.select("doc_id", "pipeline_status", "summary_status"), "doc_id").join(spec_profile(spec), "doc_id", "left").join(wrong, "doc_id", "left")
    none = F.array().cast("array<string>")
    rows = F.coalesce("row_count", F.lit(0))
    said = lambda cond, text: F.when(cond, text)
    live = F.array_compact(F.concat(
        F.array(
            said(rows < F.coalesce("min_row_count", F.lit(1)), F.lit("row_count")),
            said(F.col("avg_confidence") < F.col("min_avg_confidence"), F.lit("avg_confidence")),
            said(F.coalesce("surplus", F.lit(0)) > F.col("max_singleton_duplicates"), F.lit("singleton_duplicates")),
            said(F.col("without_confidence") > 0, F.lit("missing confidence")),
            said(F.col("without_key") > 0, F.lit("missing field_key")),
        ),
        F.transform(F.array_except(F.coalesce("required_field_keys", none), F.coalesce("keys", none)), lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(F.coalesce("wrong", none), lambda k: F.concat(F.lit("label:"), k)),
    ))
    state = F.array_compact(F.array(
        said(~_done("pipeline_status"), F.concat(F.lit("pipeline_status="), _text("pipeline_status"))),
        said(~_done("summary_status"), F.concat(F.lit("summary_status="), _text("summary_status"))),
    ))
    ran = F.size(state) == 0
    out = j.select("doc_id", F.when(ran, rows).otherwise(0).alias("row_count"), F.when(ran, F.col("avg_confidence")).alias("avg_confidence"), F.array_sort(F.when(ran, live).otherwise(state)).alias("issues"))
    return out.withColumn("passed", F.size("issues") == 0)


def significant_tokens(value, whole: int = 48, least: int = 4, limit: int | None = None) -> Column:
    """Substrings that identify a value: the value itself while short, else its longer words."""
    v = strip(F.regexp_replace(col(value), LABEL_PREFIX, ""))
    words = F.filter(F.split(v, r"[\s/,\-–—]+"), lambda w: F.length(w) >= least)
    words = words if limit is None else F.slice(words, 1, limit)
    return F.when(v == "", F.array().cast("array<string>")).when(F.length(v) <= whole, F.array(v)).when(F.size(words) > 0, words).otherwise(F.array(v))


def bootstrap_expectations(docs: DataFrame, spec: DataFrame, limit: int | None = None) -> DataFrame:
    """Expectations of completed documents from their present rows; others come disabled and without any."""
    first = golden_values(spec.where(F.col("field_key").isin(LABEL_KEYS))).where(F.size("values") > 0)
    labels = first.select("doc_id", F.struct("field_key", significant_tokens(F.get("values", F.lit(0)), limit=limit).alias("needles")).alias("l"))
    labels = labels.groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("labels"))
    j = docs.join(spec_profile(spec), "doc_id", "left").join(labels, "doc_id", "left").withColumn("enabled", _done("pipeline_status"))
    mean = F.coalesce("avg_confidence", F.lit(0.0))
    own = lambda c: F.when(F.col("enabled"), c)
    return j.select(
        "doc_id", "enabled", own(F.greatest(F.lit(8), F.coalesce("row_count", F.lit(0)) - 4)).alias("min_row_count"),
        own(F.greatest(F.lit(55), (mean - 15).cast("int"))).alias("min_avg_confidence"), own(F.lit(0)).alias("max_singleton_duplicates"),
        own(F.array_sort(F.transform(F.col("labels"), lambda l: l["field_key"]))).alias("required_field_keys"), own(F.col("labels")).alias("labels"),
    )


def tokens(text, limit: int | None = None) -> Column:
    """Distinct ASCII words of three characters and more, of the first `limit` words where that is given."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_distinct(found if limit is None else F.slice(found, 1, limit))


def audit_fields(spec: DataFrame, value_tokens: int | None = None, source_tokens: int | None = None) -> DataFrame:
    """Share of the words of each row's value that stand in its quote, and what follows from it."""
    date = _text("date")
    value = (
        F.when((F.col("bucket") == "project_dates") & (date != ""), date)
        .when((F.col("bucket") == "bond_items") & (date != ""), F.concat_ws(" | ", _text("text"), date)).otherwise(_text("text"))
    )
    rows = spec.withColumn("__v", tokens(value, value_tokens)).withColumn("__s", tokens("source_text", source_tokens))
    support = F.when((F.size("__v") > 0) & (F.size("__s") > 0), F.size(F.array_intersect("__v", "__s")) / F.size("__v")).otherwise(0.0)
    verified, sure, calc = F.coalesce("citation_verified", F.lit(False)), F.col("confidence"), F.coalesce("calculated", F.lit(False))
    rows = rows.withColumn("support", support)
    flags = F.array_compact(F.array(
        F.when((sure >= 70) & ~verified, F.lit("high_conf_unverified")), F.when(sure < 50, F.lit("low_confidence")), F.when(calc, F.lit("calculated")),
        F.when((F.col("support") < 0.15) & ~calc, F.lit("weak_source_support")), F.when(verified & (F.col("support") >= 0.3), F.lit("grounded")),
    ))
    return rows.select("doc_id", "row_seq", "bucket", "field_key", value.alias("value"), "confidence", verified.alias("citation_verified"), F.bround("support", 2).alias("source_support"), flags.alias("flags"))


def audit_documents(audits: DataFrame) -> DataFrame:
    """Rows, confidence range, verified rate, date fields, missing core fields and suspicious rows per document."""
    odd = F.array_contains("flags", "high_conf_unverified") | F.array_contains("flags", "weak_source_support")
    out = audits.groupBy("doc_id").agg(
        F.count("*").alias("row_count"), F.bround(F.avg("confidence"), 1).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.bround(F.count_if("citation_verified") / F.count("*"), 2).alias("verified_rate"), F.count_if(odd).alias("suspicious"),
        F.array_sort(F.collect_set(F.when(F.col("bucket") == "project_dates", F.col("field_key")))).alias("date_keys"),
        *[F.coalesce(F.bool_or(F.col("field_key") == k), F.lit(False)).alias("__has" + str(i)) for i, k in enumerate(CORE_KEYS)],
    )
    missing = F.array_compact(F.array(*[F.when(~F.col("__has" + str(i)), F.lit(k)) for i, k in enumerate(CORE_KEYS)]))
    return out.withColumn("missing_core", missing).drop(*["__has" + str(i) for i in range(len(CORE_KEYS))])


def sanity_issues(docs: DataFrame, spec: DataFrame) -> DataFrame:
    """Issues (level, message) of every document that a look at its field rows shows."""
    low = F.lower(_text("text"))
    bucket = lambda b: F.count_if(F.col("bucket") == b)
    named = lambda label: F.count_if((F.col("bucket") == "project_metadata_items") & low.startswith(label))
    dated = lambda label: F.count_if((F.col("bucket") == "project_dates") & (strip(low) == label) & (strip(_text("date")) != ""))
    g = spec.groupBy("doc_id").agg(
        bucket("project_metadata_items").alias("meta"), bucket("project_dates").alias("dates"), bucket("project_size_location_items").alias("size"), bucket("bond_items").alias("bonds"),
        named("project name:").alias("names"), named("project solicitation number:").alias("numbers"), dated("bid deadline").alias("bid"), dated("question deadline").alias("question"),
        F.count_if("citation_verified").alias("verified"), F.count("*").alias("total"),
    )
    j = docs.select("doc_id", "pipeline_status", "summary_status").join(g, "doc_id", "left")
    said = lambda cond, level, text: F.when(cond, F.struct(F.lit(level).alias("level"), text.alias("message")))
    note = lambda cond, level, text: said(cond, level, F.lit(text))
    count = lambda text, c: F.concat(F.lit(text + " ("), F.col(c).cast("string"), F.lit(")"))
    failed = ~(_done("pipeline_status") & _done("summary_status"))
    state = F.concat(F.lit("pipeline_status="), _text("pipeline_status"), F.lit(" summary_status="), _text("summary_status"))
    checks = F.array(
        note(F.col("meta") == 0, "warn", "no project_metadata_items"), note(F.col("dates") == 0, "warn", "no project_dates"),
        note(F.col("size") == 0, "warn", "no project_size_location_items"), said(F.col("names") > 1, "warn", count("multiple project_name entries", "names")),
        said(F.col("numbers") > 1, "info", count("multiple solicitation numbers", "numbers")), note(F.col("bid") == 0, "warn", "missing Bid deadline"),
        note(F.col("question") == 0, "info", "missing Question deadline"), note(F.col("bonds") == 0, "warn", "no bond_items"),
        said(F.col("verified") < 0.9 * F.col("total"), "warn", F.concat(F.lit("low citation_verified rate ("), F.col("verified").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))),
    )
    found = F.when(failed, F.array(said(failed, "error", state))).when(F.col("total").isNull(), F.array(note(F.lit(True), "error", "missing spec_check_fields"))).otherwise(F.array_compact(checks))
    return j.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.level", "i.message")


def baseline_by_type(insights: DataFrame) -> DataFrame:
    """Items, empty documents and tokens (all, and spent on empty results) per extraction type and overall (`*`).

    `insights` carries extraction_type, n_items, prompt_tokens and completion_tokens.
    """
    spent = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    empty = F.coalesce("n_items", F.lit(0)) == 0
    kind = F.coalesce(F.nullif(F.col("extraction_type"), F.lit("")), F.lit("unknown")).alias("extraction_type")
    rows = insights.select(kind, F.coalesce("n_items", F.lit(0)).alias("n"), empty.alias("e"), F.coalesce("prompt_tokens", F.lit(0)).alias("p"), F.coalesce("completion_tokens", F.lit(0)).alias("c"), spent.alias("s"))
    out = rows.rollup("extraction_type").agg(
        F.grouping("extraction_type").alias("__g"), F.sum("n").alias("items_total"), F.count_if("e").alias("empty_docs"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"),
        F.sum("s").alias("total_tokens"), F.sum(F.when(F.col("e"), F.col("s")).otherwise(0)).alias("empty_tokens"),
    )
    return out.withColumn("extraction_type", F.when(F.col("__g") == 1, "*").otherwise(F.col("extraction_type"))).drop("__g")


def baseline_totals(results: DataFrame, spec: DataFrame) -> DataFrame:
    """One row: documents, seconds, mean parse quality, summary tokens and share of verified sources.

    `results` carries elapsed_seconds, parsing_quality_score and summary_tokens per document.
    """
    r = results.agg(
        F.count("*").alias("doc_count"), F.round(F.sum(F.coalesce("elapsed_seconds", F.lit(0.0))), 2).alias("elapsed_seconds"),
        F.round(F.avg("parsing_quality_score"), 4).alias("parsing_quality"), F.sum(F.coalesce("summary_tokens", F.lit(0))).alias("summary_tokens"),
    )
    s = spec.agg(F.count_if("citation_verified").alias("verified_sources"), F.count("*").alias("total_sources"))
    pct = F.when(F.col("total_sources") > 0, F.format_string("%.1f%%", 100.0 * F.col("verified_sources") / F.col("total_sources"))).otherwise("n/a")
    both = r.unionByName(s, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("verified_pct", pct)


def display_date(iso) -> Column:
    """March 11, 2026, 10:00 AM of an ISO date and time; without the time where none is given."""
    raw = strip(_text(iso))
    day = F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd")
    time = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})", 1), "T", " "), F.lit("yyyy-MM-dd HH:mm"))
    shown = F.date_format(day, "MMMM d, yyyy")
    timed = F.concat(F.date_format(time, "MMMM d, yyyy"), F.lit(", "), F.date_format(time, "h:mm a"))
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), timed).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), shown)


def value_after_label(source, label) -> Column:
    """What follows a label in a quote, behind a colon or dash, from where the label first stands."""
    src, tag = strip(_text(source)), strip(_text(label))
    at = F.instr(F.lower(src), F.lower(tag))
    rest = strip(F.substr(src, at + F.length(tag)))
    rest = strip(F.regexp_replace(rest, r"^[:\-–]\s*", ""))
    return F.when((src != "") & (tag != "") & (at > 0) & (rest != ""), rest)


def display_label(label) -> Column:
    """Names of the same event brought to one."""
    low = F.lower(col(label))
    return (
        F.when(low.contains("proposer") & low.contains("conference"), "Pre-bid conference (Proposer's Conference)")
        .when(low.contains("pre-proposal") | low.contains("preproposal"), "Pre-bid conference (Pre-Proposal Conference)")
        .when(low.contains("bidder") & low.contains("conference"), "Pre-bid conference (Bidder Conference)")
        .when(low.contains("advertised") | (low == "issue date for rfp"), "RFP issue / advertised date").otherwise(col(label))
    )


def deadline_display(rows: DataFrame) -> DataFrame:
    """Adds display_label and display_value to rows with text, requirement, date, date_time, value and source_text.

    The first of these that is there: the parsed date, what the quote says behind the label, what the requirement
    says behind its colon, the stored value, the requirement, the whole quote.
    """
    label, req, src = strip(_text("text")), strip(_text("requirement")), strip(_text("source_text"))
    colon = F.instr(req, ":")
    before, behind = strip(F.substr(req, F.lit(1), colon - 1)), strip(F.substr(req, colon + 1))
    tag = F.when(label != "", label).when((colon > 0) & (before != ""), before).otherwise(req)
    stored = F.coalesce(*[F.nullif(strip(_text(c)), F.lit("")) for c in ("date_time", "value", "date")])
    r = rows.withColumns({"__tag": tag, "__stored": stored, "__day": F.coalesce(display_date("date"), display_date("date_time"))})
    r = r.withColumn("__said", value_after_label("source_text", "__tag"))
    named, split = F.col("__tag") != "", (colon > 0) & (behind != "")
    value = (
        F.when(named & F.col("__day").isNotNull(), F.col("__day")).when(named & F.col("__said").isNotNull(), F.col("__said")).when(split, behind)
        .when(named & F.col("__stored").isNotNull(), F.col("__stored")).when(named & (req != "") & (req != F.col("__tag")), req).when((src != "") & ~named, src).otherwise(F.col("__stored"))
    )
    own = F.when(named & (F.col("__day").isNotNull() | F.col("__said").isNotNull()), F.col("__tag")).when(split, F.when(before != "", before).when(named, F.col("__tag")).otherwise("Deadline"))
    shown = F.coalesce(own, F.when(named, F.col("__tag")).when(src != "", "Deadline").otherwise("—"))
    return r.withColumn("display_label", display_label(shown)).withColumn("display_value", value).drop("__tag", "__stored", "__day", "__said")


def insight_groups(insights: DataFrame, large: int = LARGE_LIST) -> DataFrame:
    """Group, place in the display order, tone of the confidence and whether the list is long."""
    order = [(t, g, i) for i, (t, g) in enumerate((t, g) for g, types in INSIGHT_GROUPS for t in types)]
    group = F.create_map(*[F.lit(x) for t, g, _ in order for x in (t, g)])
    place = F.create_map(*[F.lit(x) for t, _, i in order for x in (t, i)])
    pct = F.col("confidence") * 100
    return insights.withColumns({
        "group_label": F.coalesce(F.try_element_at(group, F.col("extraction_type")), F.lit("Other")), "place": F.coalesce(F.try_element_at(place, F.col("extraction_type")), F.lit(99)),
        "tone": F.when(pct >= 85, "strong").when(pct >= 70, "moderate").otherwise("weak"), "is_large": F.coalesce(F.col("n_items") > large, F.lit(False)),
    })


