"""Reviewer feedback: intake, vocabulary, training batches, hints and re-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, UNCUT, Config, Limits
from docloom.functions.text import col, first, head, norm_ws, strip, within
from docloom.plans.scans import once

# The instruction text of a training example.
TRAINING_SYSTEM = (
    "You are a procurement document extraction specialist. "
    "Given the following document excerpt, extract the '%s' field accurately. "
    "Return a JSON object with a single key 'value' containing the extracted text. "
    'If not found, return {"value": null}.'
)
ACTIVE_BATCH = ["pending", "uploading", "running"]
FINISHED_BATCH = ["succeeded", "failed", "cancelled"]


def _text(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def ingest_feedback(raw: DataFrame, limits: Limits = UNCUT) -> DataFrame:
    """Valid ratings only, long texts cut to their column sizes where such are given."""
    rating = F.lower(strip(_text("rating")))
    ok = (strip(_text("field_key")) != "") & (strip(_text("extraction_type")) != "") & rating.isin("up", "down")
    cuts = {"extracted_value": limits.value_chars, "correct_value": limits.value_chars, "comment": limits.comment_chars, "source_text_context": limits.context_chars}
    out = raw.where(ok).withColumn("rating", rating)
    out = out.withColumns({"field_key": strip("field_key"), "extraction_type": strip("extraction_type")})
    return out.withColumns({c: head(_text(c), n) for c, n in cuts.items()})


def lexicon_from_feedback(fb: DataFrame, lexicon: DataFrame, limits: Limits = UNCUT) -> DataFrame:
    """Query terms of the lexicon after the corrections in `fb` have been learned."""
    value, source = strip(_text("correct_value")), strip(_text("source_text_context"))
    terms = F.array_compact(F.array(
        F.when((F.col("field_key") != "") & (F.length(value) >= 2), F.concat("field_key", F.lit(": "), head(value, limits.term_value_chars))),
        F.when(F.length(value) >= 4, head(value, limits.term_exact_chars)),
        F.when(F.length(source) >= 20, head(source, limits.term_source_chars)),
    ))
    seen = fb.where(F.col("rating") == "down").select(
        "extraction_type", "created_at", "feedback_id", F.posexplode(terms).alias("slot", "term")
    ).withColumn("term_normalized", head(strip(F.lower("term")), limits.term_chars)).where(F.col("term_normalized") != "")
    new = seen.groupBy("extraction_type", "term_normalized").agg(
        F.count("*").alias("hits"),
        head(F.min(F.struct("created_at", "feedback_id", "slot", "term"))["term"], limits.display_chars).alias("first_display"),
    )
    old = lexicon.where(F.col("entry_kind") == "query").select(
        "extraction_type", "term_normalized", "term_display", "hit_count", "is_active"
    )
    j = old.join(new, ["extraction_type", "term_normalized"], "full_outer")
    return j.select(
        "extraction_type", "term_normalized",
        F.coalesce("term_display", "first_display").alias("term_display"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("hit_count"),
        (F.col("hits").isNotNull() | F.coalesce("is_active", F.lit(False))).alias("is_active"),
    )


def boost_terms(lexicon: DataFrame, fb: DataFrame) -> DataFrame:
    """Every confirmation adds one hit to all active terms of its type."""
    ups = fb.where(F.col("rating") == "up").groupBy("extraction_type").agg(F.count("*").alias("ups"))
    add = F.when(F.col("is_active"), F.coalesce("ups", F.lit(0))).otherwise(0)
    return lexicon.join(ups, "extraction_type", "left").withColumn("hit_count", F.col("hit_count") + add).drop("ups")


def usable_corrections(fb: DataFrame) -> DataFrame:
    return fb.where((F.col("rating") == "down") & (_text("correct_value") != "") & ~F.col("used_in_finetune"))


def finetune_ready(fb: DataFrame, batches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    busy = batches.where(F.col("status").isin(ACTIVE_BATCH)).select("extraction_type")
    n = usable_corrections(fb).groupBy("extraction_type").agg(F.count("*").alias("corrections"))
    return n.where(F.col("corrections") >= cfg.finetune_threshold).join(busy, "extraction_type", "left_anti")


def training_example(cfg: Config = DEFAULT) -> Column:
    excerpt = F.when(_text("source_text_context") != "", F.col("source_text_context")).otherwise(_text("extracted_value"))
    value = F.nullif(strip(_text("correct_value")), F.lit(""))
    answer = F.to_json(F.struct(value.alias("value")), {"ignoreNullFields": "false"})

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(F.struct(F.array(
        message("system", F.format_string(TRAINING_SYSTEM, F.col("field_key"))),
        message("user", F.concat(F.lit("Document excerpt:\n\n"), excerpt)),
        message("assistant", answer),
    ).alias("messages")))


def build_training_set(fb: DataFrame) -> DataFrame:
    """One JSON line per usable correction; the batch order is (created_at, feedback_id)."""
    return usable_corrections(fb).select("extraction_type", "created_at", "feedback_id", training_example().alias("line"))


def training_cost(examples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Token estimate, cost and cost guard per extraction type."""
    a = examples.groupBy("extraction_type").agg(F.count("*").alias("examples"), F.sum(F.length("line")).alias("chars"))
    tokens = F.floor(F.col("chars") / 4) * cfg.finetune_epochs
    cost = tokens / 1_000_000 * cfg.finetune_cost_per_million
    return a.select(
        "extraction_type", "examples", tokens.alias("tokens"), cost.alias("cost_usd"),
        F.when(cost > cfg.finetune_max_cost, "aborted").otherwise("ready").alias("status"),
    )


def mark_used(fb: DataFrame, batches: DataFrame) -> DataFrame:
    """Corrections of the submitted types become used."""
    sent = batches.select("extraction_type").distinct().withColumn("__sent", F.lit(True))
    take = F.coalesce("__sent", F.lit(False)) & (F.col("rating") == "down") & (_text("correct_value") != "")
    return fb.join(sent, "extraction_type", "left").withColumn(
        "used_in_finetune", F.col("used_in_finetune") | take
    ).drop("__sent")


def _hint(limits: Limits) -> Column:
    f, issue = F.col("field_key"), _text("issue_type")
    wrong, right, note = strip(_text("extracted_value")), strip(_text("correct_value")), strip(_text("comment"))
    q = F.lit('"')
    return (
        F.when((issue == "wrong_value") & (wrong != "") & (right != ""),
               F.concat(f, F.lit(": do NOT extract "), q, head(wrong, limits.hint_wrong_chars), q, F.lit(" — correct value is "), q, head(right, limits.hint_right_chars), q))
        .when((issue == "wrong_value") & (right != ""), F.concat(f, F.lit(": correct value should look like "), q, head(right, limits.hint_right_chars), q))
        .when(issue == "missing", F.concat(f, F.lit(": often missed — search cover page, timeline tables, and administrative sections carefully")))
        .when(issue == "wrong_source", F.concat(f, F.lit(": citation must be verbatim from the document section where the value actually appears")))
        .when(note != "", F.concat(f, F.lit(": "), head(note, limits.hint_note_chars)))
        .when(right != "", F.concat(f, F.lit(": expected "), q, head(right, limits.hint_right_chars), q))
        .when(wrong != "", F.concat(f, F.lit(": avoid repeating "), q, head(wrong, limits.hint_wrong_chars), q))
        .otherwise("")
    )


def feedback_hints(fb: DataFrame, groups: dict[str, list[str]], limits: Limits = UNCUT) -> DataFrame:
    """Prompt text of lessons per extraction group from its latest corrections."""
    names = F.array_compact(F.array(*[
        F.when(F.col("field_key").isin(keys), name) for name, keys in groups.items()
    ]))
    rows = fb.where(F.col("rating") == "down").withColumn("group", F.explode(names))
    recent = Window.partitionBy("group").orderBy(F.desc("created_at"), F.desc("feedback_id"))
    # the rank limit is applied before the shuffle, so with one a group costs few rows per task
    last = rows.withColumn("rn", F.row_number().over(recent)).where(within("rn", limits.hint_lookback))
    shown = F.when(head(strip(_text("extracted_value")), limits.hint_key_chars) != "", head(strip(_text("extracted_value")), limits.hint_key_chars)).otherwise(
        head(strip(_text("correct_value")), limits.hint_key_chars)
    )
    firsts = last.select("group", "rn", "field_key", _text("issue_type").alias("issue"), shown.alias("shown"), _hint(limits).alias("hint")).groupBy(
        "group", "field_key", "issue", "shown"
    ).agg(F.min(F.struct("rn", "hint")).alias("p"))
    top = firsts.where(F.col("p.hint") != "").groupBy("group").agg(
        first(F.array_sort(F.collect_list("p")), limits.hints).alias("hs")
    )
    bullets = F.array_join(F.transform("hs", lambda h: F.concat(F.lit("- "), h["hint"])), "\n")
    return top.select(
        "group",
        F.concat(F.lit("\n\nLessons from prior user corrections (do NOT repeat these mistakes):\n"), bullets, F.lit("\n")).alias("hints"),
    )


def after_label(text) -> Column:
    """The part after the first `: `, or the whole text."""
    t = strip(_text(text))
    i = F.instr(t, ": ")
    return F.when(i > 0, F.substr(t, i + 2)).otherwise(t)


def current_values(spec: DataFrame) -> DataFrame:
    """Displayed value per document and field; the longest wins, notes count as `<key>_events`."""
    key = strip(_text("field_key"))
    rows = spec.where((key != "") & ~F.coalesce("not_found", F.lit(False))).select(
        "doc_id", key.alias("k"), "row_seq",
        F.when(strip(_text("date")) != "", strip(_text("date"))).otherwise(after_label("text")).alias("v"),
        strip(_text("note")).alias("n"),
    )
    pick = lambda kind, key, one, two, v: F.when(F.col(v) != "", F.struct(F.lit(kind).alias("kind"), key.alias("field_key"), one.cast("bigint").alias("a"), two.cast("bigint").alias("b"), F.col(v).alias("v")))
    found = F.array_compact(F.array(
        pick(0, F.col("k"), F.length("v"), -F.col("row_seq"), "v"), pick(1, F.concat("k", F.lit("_events")), F.col("row_seq"), F.lit(0), "n"),
    ))
    return rows.select("doc_id", F.explode(found).alias("f")).groupBy("doc_id", "f.field_key", "f.kind").agg(F.max(F.struct("f.a", "f.b", "f.v"))["v"].alias("value")).drop("kind")


def values_match(a, b) -> Column:
    x, y = norm_ws(a), norm_ws(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def recheck(fb: DataFrame, values: DataFrame, checked_at=None) -> DataFrame:
    """Resolution of every correction against the newest values of its document."""
    j = fb.where(F.col("rating") == "down").join(values, ["doc_id", "field_key"], "left")
    j = once(j, "__n", F.struct(norm_ws("value").alias("now"), norm_ws("correct_value").alias("right"), norm_ws("extracted_value").alias("wrong")))
    now, right, wrong = F.col("__n.now"), F.col("__n.right"), F.col("__n.wrong")
    alike = lambda x: (now != "") & (now.contains(x) | x.contains(now))
    outcome = (
        F.when(right != "", F.when(alike(right), "resolved").otherwise("recurred"))
        .when(_text("issue_type") == "missing", F.when(now != "", "resolved").otherwise("recurred"))
        .when((wrong != "") & (now != ""), F.when(~alike(wrong), "resolved").otherwise("recurred"))
        .otherwise("unchecked")
    )
    out = j.withColumn("outcome", outcome)
    return out.withColumns({
        "resolution_status": F.when(F.col("outcome") == "unchecked", F.col("resolution_status")).otherwise(F.col("outcome")),
        "recheck_count": F.col("recheck_count") + F.when(F.col("outcome") == "unchecked", 0).otherwise(1),
    }).drop("value", "__n")


def recheck_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("doc_id").agg(*[
        F.count_if(F.col("outcome") == s).alias(s) for s in ("resolved", "recurred", "unchecked")
    ])


def learning_effectiveness(fb: DataFrame, top: int | None = None) -> DataFrame:
    """Outcome counts of the most corrected fields, or of all, and the total over the fields shown (field_key `*`)."""
    s = F.col("resolution_status")
    per = fb.where(F.col("rating") == "down").groupBy("field_key").agg(
        F.count("*").alias("corrections"), F.count_if(s == "resolved").alias("resolved"),
        F.count_if(s == "recurred").alias("recurred"), F.count_if(s == "pending").alias("pending"),
    )
    per = per if top is None else per.orderBy(F.desc("corrections"), "field_key").limit(top)
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("corrections", "resolved", "recurred", "pending")])
    return per.unionByName(total.withColumn("field_key", F.lit("*")))


def feedback_stats(fb: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Counts per extraction type and overall (`*`), with progress to the training threshold."""
    fixed = (F.col("rating") == "down") & (_text("correct_value") != "")
    g = fb.rollup("extraction_type").agg(
        F.grouping("extraction_type").alias("g"), F.count("*").alias("total"),
        F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"),
        F.count_if(fixed).alias("with_correction"), F.count_if(F.col("used_in_finetune")).alias("used_in_finetune"),
    )
    pct = F.least(F.lit(100), F.floor(F.col("with_correction") * 100 / cfg.finetune_threshold + 0.5))
    return g.select(
        F.when(F.col("g") == 1, "*").otherwise(F.col("extraction_type")).alias("extraction_type"),
        "total", "up", "down", "with_correction", "used_in_finetune", pct.cast("bigint").alias("progress_pct"),
    )


def active_batches(batches: DataFrame, n: int | None = None) -> DataFrame:
    active = batches.where(~F.col("status").isin(FINISHED_BATCH))
    return active if n is None else active.orderBy(F.desc("created_at"), "batch_id").limit(n)


def list_feedback(fb: DataFrame, docs: DataFrame, extraction_type=None, rating=None, used=None, page: int = 1, size: int | None = None, limits: Limits = UNCUT) -> DataFrame:
    rows = fb
    if extraction_type:
        rows = rows.where(F.col("extraction_type") == extraction_type)
    if rating in ("up", "down"):
        rows = rows.where(F.col("rating") == rating)
    if used is not None:
        rows = rows.where(F.col("used_in_finetune") == F.lit(bool(used)))
    # without a size all rows are one page
    shown = rows if size is None else rows.orderBy(F.desc("created_at"), F.desc("feedback_id")).offset((max(page, 1) - 1) * size).limit(size)
    names = docs.select("doc_id", F.col("filename").alias("document_filename"))
    return shown.join(names, "doc_id", "left").withColumns({
        "document_filename": _text("document_filename"), "source_text_context": head(_text("source_text_context"), limits.listed_context_chars),
    })


