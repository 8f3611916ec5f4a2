"""The canonical field table: assembly from items, date rules, merging, confidence, warnings.

Rows live in one long table. Every rule looks at a document through one aggregate row with
the first or best values it needs, never through a list of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.dates import add_duration, date_grounded, long_date, next_business_day, parse_amount, parse_date
from docloom.config import UNCUT, Limits
from docloom.fixed import BOND_LABELS, DEADLINE_LABELS, FIELD_DEFS, SET_ASIDE_KEYS, SINGLETON_KEYS
from docloom.functions.text import WS, col, contains_any, head, literal_array, norm_ws, strip, within, word_count
from docloom.operators.feedback import _text
from docloom.plans.scans import once
from docloom.plans.stage import cut

# Note labels, display order and the wording tests of the post rules.
DATE_NOTE_TARGETS = {
    "bid_deadline_note": "bid_deadline_date_time", "bid_open_note": "bid_open_date_time",
    "pre_bid_note": "pre_bid_deadline_date_time", "site_visit_note": "site_visit_date_time",
    "question_deadline_note": "question_deadline_date_time", "award_note": "municipal_meeting_date_time",
}
EVENTS_LABEL, EVENTS_TARGET = "project_document_acquisition_events", "project_document_acquisition_note"
METADATA_ORDER = [
    "project_name", "project_solicitation_number", "project_owner", "project_sector", "project_value",
    "project_document_acquisition_note", "project_description",
]
ACQUISITION_WORDS = (
    r"(?i)\b(download|obtain|procurement\s+system|portal|website|http|https|log\s*in|login|register|registration|contact|"
    r"pick\s*up|pickup|available\s+at|available\s+via|available\s+on|office\s+at|request\s+documents|request\s+for\s+bidding|"
    r"view\s+this\s+solicitation|bid\s*express|bidx|plan\s*room|planholder|bid\s*net|demandstar|bonfire|planetbids|"
    r"follow\s+this\s+\d+|470)\b"
)
ACQUISITION_REJECT = ["not explicitly stated", "not found in", "not stated", "not specified", "no information", "n/a", "none stated"]
PLACEHOLDER = (
    r"(?i)\b(pending\s+funding|pending\s+approval|tbd|to\s+be\s+determined|not\s+specified|not\s+stated|upon\s+award|contingent|"
    r"\d+\s+(?:calendar\s+|working\s+|business\s+)?days?\s+(?:after|from)\s+(?:award|notice))\b"
)
DURATION = r"(?i)\d+(?:\.\d+)?\s*(?:calendar\s+|working\s+|business\s+)?(?:days?|weeks?|months?|years?)"
CALENDAR = (
    r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
    r"|\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"
)
SOLICITATION_REJECT = [
    "reference no. of document", "document being continued", "continuation sheet", "purchase request number", "requisition",
    "advertisement #", "advertisement#",
]
LOCATIONS = "project_size_location_items"
AFTER_AWARD = r"(?i)(\d+(?:\.\d+)?)\s*(?:calendar\s+|working\s+|business\s+)?days?\s+after\s+award"
APPENDED = 1 << 60
STAGES = "zstd"  # stage tables of the rules are as large as the field table, one after another

SPEC_COLUMNS = [
    "doc_id", "bucket", "row_seq", "field_key", "text", "date", "confidence", "date_grounded", "calculated",
    "awaiting_value", "not_found", "note", "mandatory", "confidence_cap", "page", "section", "source_text",
    "citation_verified",
]


def label_value(items: DataFrame) -> DataFrame:
    """Add lower-case label `l` and value `v`, read from `label: value` where columns are empty."""
    req = strip(_text("requirement"))
    i = F.instr(req, ":")
    left = F.when(i > 0, F.lower(strip(F.substr(req, F.lit(1), i - 1)))).otherwise("")
    right = F.when(i > 0, strip(F.substr(req, i + 1))).otherwise("")
    lab, val = F.lower(strip(_text("label"))), strip(_text("value"))
    return items.withColumns({"l": F.when(lab != "", lab).otherwise(left), "v": F.when(val != "", val).otherwise(right)})


# ---- confidence

def field_confidence(conf, verified, has_source, calculated, awaiting, alias=None) -> Column:
    """0 to 100: the verified quote decides the band, the extractor only moves inside it."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(conf), F.lit(0.55))))
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    score = F.when(yes(verified), base * 10.0 + 90.0).when(yes(has_source), base * 25.0 + 30.0).otherwise(F.least(F.lit(30.0), base * 30.0))
    score = F.when(yes(calculated), F.least(score, F.lit(72.0))).otherwise(score)
    score = F.when(yes(awaiting), F.least(score, F.lit(58.0))).otherwise(score)
    if alias is not None:
        score = F.when(yes(alias), F.least(score, F.lit(95.0))).otherwise(score)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 0).cast("int")


def extraction_confidence(c) -> Column:
    return F.when(col(c) <= 1.0, col(c))


def apply_confidence(rows: DataFrame) -> DataFrame:
    """Rows without a confidence get one; no row exceeds the row it was derived from."""
    own = field_confidence(F.lit(None).cast("double"), "citation_verified", _text("source_text") != "", "calculated", "awaiting_value")
    c = F.coalesce("confidence", own)
    return rows.withColumn("confidence", F.when(F.col("confidence_cap").isNotNull(), F.least(c, F.col("confidence_cap"))).otherwise(c))


def infer_field_key(rows: DataFrame) -> DataFrame:
    """Field keys of legacy rows from their display label and bucket."""
    def table(pairs):
        return F.create_map(*[F.lit(x) for kv in pairs for x in kv])

    text = strip(_text("text"))
    before = strip(F.split(text, ":").getItem(0))
    b = F.col("bucket")
    inferred = (
        F.when(b == "project_dates", F.try_element_at(table((v, k) for k, v in DEADLINE_LABELS.items()), text))
        .when(b == "bond_items", F.try_element_at(table((v, k) for k, v in BOND_LABELS.items()), text))
        .when(b == "set_aside_items", F.when(text != "", "set_aside"))
        .when(text.contains(":"), F.try_element_at(table((label, k) for k, _, label in FIELD_DEFS), before))
    )
    return rows.withColumn("field_key", F.coalesce(F.nullif(_text("field_key"), F.lit("")), inferred))


# ---- assembly

def _entry(branch: int, ok: Column, bucket: Column, key: Column, text: Column, dedupe: Column, date: Column | None = None, grounded: Column | None = None) -> Column:
    """A field row that an item gives, or NULL."""
    return F.when(ok, F.struct(
        F.lit(branch).alias("branch"), bucket.alias("bucket"), key.alias("field_key"), text.alias("text"), (date if date is not None else F.lit("")).alias("date"),
        (grounded if grounded is not None else F.lit(None).cast("boolean")).alias("date_grounded"), dedupe.alias("dedupe"),
    ))


def build_spec_rows(items: DataFrame, key_chars: int | None = None, scope_chars: int | None = None) -> DataFrame:
    """Field rows of every document from its extracted items, first of equal values kept.

    Every item is looked at once and gives as many rows as rules fit it. Values are compared as a whole unless
    `key_chars` (or `scope_chars` for descriptions) says how much of them decides.
    """
    t, l, v = F.col("extraction_type"), F.col("l"), F.col("v")
    own = F.lower(strip(_text("label")))
    after = F.when(F.instr(_text("requirement"), ":") > 0, strip(F.substr(_text("requirement"), F.instr(_text("requirement"), ":") + 1))).otherwise("")
    detail = strip(F.coalesce(F.nullif(_text("value"), F.lit("")), F.nullif(_text("source_text"), F.lit("")), after))
    when = strip(F.coalesce(F.nullif(_text("date_time"), F.lit("")), _text("value")))
    it = once(label_value(items), "__x", F.struct(own.alias("own"), detail.alias("detail"), when.alias("at"), F.when(own != "", own).otherwise(l).alias("either")))
    own, detail, when, either = (F.col("__x." + c) for c in ("own", "detail", "at", "either"))

    bucket_of = F.create_map(*[F.lit(x) for k, b, _ in FIELD_DEFS for x in (k, b)])
    label_of = F.create_map(*[F.lit(x) for k, _, d in FIELD_DEFS for x in (k, d)])
    known = l.isin([k for k, _, _ in FIELD_DEFS])
    shown, bucket, meta = F.try_element_at(label_of, l), F.try_element_at(bucket_of, l), F.lit("project_metadata_items")
    named, short = F.concat(shown, F.lit(": "), v), F.concat(l, F.lit(":"), head(v, key_chars))
    there = v != ""
    plain = known & there & (l != "project_description") & bucket.isin("project_people_items", "project_metadata_items") & ((l != EVENTS_TARGET) | is_valid_acquisition_note(v))

    visit = (either == "municipal_meeting_date_time") & contains_any(F.lower(_text("source_text")), ["site visit", "site-visit"])
    dk = F.when(visit, "pre_bid_deadline_date_time").otherwise(either)
    dlabel = F.try_element_at(F.create_map(*[F.lit(x) for kv in DEADLINE_LABELS.items() for x in kv]), dk)
    blabel = F.try_element_at(F.create_map(*[F.lit(x) for kv in BOND_LABELS.items() for x in kv]), own)
    bond = own.isin(list(BOND_LABELS)) & (detail != "")
    bkey = F.concat(blabel, F.lit(":"), head(detail, key_chars))
    aside = F.when(detail != "", detail).otherwise(strip(_text("requirement")))
    # only the rules of an item's own type are tried
    rules = {
        "eligibility_criteria": [_entry(1, plain, bucket, l, named, short)],
        "mandatory_documents": [_entry(2, plain, bucket, l, named, short), _entry(8, bond, F.lit("bond_items"), own, blabel, bkey, detail)],
        "scope_of_work": [_entry(3, (l == "project_description") & there, meta, l, named, F.concat(l, F.lit(":"), head(v, scope_chars)))],
        "payment_terms": [_entry(4, there, meta, F.lit("project_value"), F.concat(F.coalesce(shown, F.lit("Project value")), F.lit(": "), v), F.concat(F.lit("project_value:"), head(v, key_chars)))],
        "technical_requirements": [_entry(5, (bucket == "project_size_location_items") & there, bucket, l, named, short)],
        "submission_deadlines": [_entry(6, either.isin(list(DEADLINE_LABELS)) & (when != ""), F.lit("project_dates"), dk, dlabel, F.concat(dlabel, F.lit(":"), head(when, key_chars)), when, date_grounded(when, "source_text"))],
        "penalties_and_risks": [_entry(7, bond, F.lit("bond_items"), own, blabel, bkey, detail)],
        "set_asides": [_entry(9, either.isin(SET_ASIDE_KEYS) & (aside != ""), F.lit("set_aside_items"), either, F.when(either == "set_aside", aside).otherwise(F.concat(F.lit("Set-aside: "), aside)), F.concat(either, F.lit(":"), head(aside, key_chars)))],
    }
    found = None
    for kind, entries in rules.items():
        own_rules = F.array(*entries)
        found = F.when(t == kind, own_rules) if found is None else found.when(t == kind, own_rules)
    found = F.array_compact(found)
    verified = F.coalesce("citation_verified", F.lit(False))
    conf = field_confidence(extraction_confidence("confidence"), "citation_verified", _text("source_text") != "", F.lit(False), F.lit(False))
    rows = it.select("doc_id", "item_seq", "page", "section", "source_text", verified.alias("__verified"), conf.alias("confidence"), F.explode(found).alias("f")).select(
        "doc_id", "f.bucket", (F.col("f.branch").cast("bigint") * F.lit(1 << 40) + F.col("item_seq")).alias("row_seq"), "f.field_key", "f.text", "f.date", "confidence", "f.date_grounded",
        F.lit(False).alias("calculated"), F.lit(False).alias("awaiting_value"), F.lit(False).alias("not_found"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("boolean").alias("mandatory"),
        F.lit(None).cast("int").alias("confidence_cap"), "page", "section", "source_text", (F.col("__verified") & F.coalesce("f.date_grounded", F.lit(True))).alias("citation_verified"), "f.dedupe",
    )
    w = Window.partitionBy("doc_id", "bucket", "dedupe").orderBy("row_seq")
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).select(*SPEC_COLUMNS)


def date_notes(items: DataFrame) -> DataFrame:
    """Longest note per document and date field, first one on ties; acquisition events included."""
    typed = items.where(F.col("extraction_type").isin("submission_deadlines", "eligibility_criteria", "mandatory_documents"))
    texts = ["requirement", "label", "value"]
    # the texts are taken once; merged projections would make them again at every use
    it = label_value(once(typed.select("doc_id", "extraction_type", "item_seq", F.struct(*texts).alias("__t")), "__x", F.col("__t")).select("doc_id", "extraction_type", "item_seq", "__x.*"))
    targets = F.create_map(*[F.lit(x) for kv in DATE_NOTE_TARGETS.items() for x in kv])
    own = F.lower(strip(_text("label")))
    dl = F.when(own != "", own).otherwise(F.col("l"))
    value = strip(_text("value"))
    is_date = (F.col("extraction_type") == "submission_deadlines") & dl.isin(list(DATE_NOTE_TARGETS))
    is_event = F.col("extraction_type").isin("eligibility_criteria", "mandatory_documents") & (F.col("l") == EVENTS_LABEL)
    rows = it.where(is_date | is_event).select(
        "doc_id", F.when(is_date, F.try_element_at(targets, dl)).otherwise(EVENTS_TARGET).alias("field_key"),
        F.when(is_date, value).otherwise(F.col("v")).alias("note"), "item_seq",
    ).where(F.col("note") != "")
    return rows.groupBy("doc_id", "field_key").agg(
        F.max(F.struct(F.length("note").alias("n"), (-F.col("item_seq")).alias("o"), F.col("note").alias("note")))["note"].alias("note")
    )


# ---- date rules

def _is(text: str) -> Column:
    return F.lower(strip(_text("text"))) == text


def _dates() -> Column:
    return F.col("bucket") == "project_dates"


def _first(cond: Column, *fields: str) -> Column:
    return F.min(F.when(cond, F.struct("row_seq", *fields)))


def _apart(rows: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Rows a rule can change, which are joined with its facts, and the others, which pass without a shuffle."""
    there = F.coalesce(cond, F.lit(False))
    return rows.where(there), rows.where(~there)


def rule_bid_open(rows: DataFrame) -> DataFrame:
    """Ungrounded bid-open rows go; a document without one gets a copy of its bid deadline."""
    kept = rows.where(~(_dates() & _is("bid open date") & (F.col("date_grounded") == F.lit(False)) & F.col("date_grounded").isNotNull()))
    dates = kept.where(_dates() & (_is("bid open date") | _is("bid deadline")))
    payload = [c for c in SPEC_COLUMNS if c not in ("doc_id", "row_seq")]
    weak = (~F.coalesce("date_grounded", F.lit(False))).cast("int")
    best = dates.groupBy("doc_id").agg(
        F.bool_or(_is("bid open date")).alias("has"),
        F.min(F.when(_is("bid deadline"), F.struct(weak.alias("weak"), "row_seq", *payload))).alias("p"),
    ).where(~F.col("has") & F.col("p").isNotNull())
    made = best.select("doc_id", *[F.col("p." + c).alias(c) for c in payload]).withColumns({
        "row_seq": F.lit(APPENDED).cast("bigint"), "text": F.lit("Bid open date"), "field_key": F.lit("bid_open_date_time"),
        "note": F.lit(None).cast("string"), "mandatory": F.lit(None).cast("boolean"),
    })
    return kept.select(*SPEC_COLUMNS).unionByName(made.select(*SPEC_COLUMNS))


def is_calendar_text(c) -> Column:
    return F.lower(col(c)).rlike(CALENDAR)


def is_placeholder_date(c) -> Column:
    raw = strip(_text(c) if isinstance(c, str) else F.coalesce(c, F.lit("")))
    return (raw == "") | (~is_calendar_text(raw) & raw.rlike(PLACEHOLDER))


def is_duration_text(c) -> Column:
    raw = _text(c) if isinstance(c, str) else F.coalesce(c, F.lit(""))
    return (raw != "") & ~is_calendar_text(raw) & raw.rlike(DURATION)


def _blank_row(columns: dict[str, Column]) -> list[Column]:
    types = {
        "doc_id": None, "bucket": "string", "row_seq": "bigint", "field_key": "string", "text": "string", "date": "string", "confidence": "int",
        "date_grounded": "boolean", "calculated": "boolean", "awaiting_value": "boolean", "not_found": "boolean", "note": "string",
        "mandatory": "boolean", "confidence_cap": "int", "page": "int", "section": "string", "source_text": "string", "citation_verified": "boolean",
    }
    return [columns[c].alias(c) if c in columns else F.lit(None).cast(types[c]).alias(c) for c in SPEC_COLUMNS]


def rule_start_date(rows: DataFrame) -> DataFrame:
    """Start date from the bid opening: 60 days for large projects, else 30, off weekends."""
    start = _dates() & _is("project start date")
    placeholder = start & is_placeholder_date("date")
    opening = _dates() & _is("bid open date")
    value = (F.col("bucket") == "project_metadata_items") & (F.lower(_text("text")).contains("project value") | F.lower(_text("text")).contains("project_value"))
    # rows that say nothing of the three are not brought together
    facts = rows.where(start | opening | value).groupBy("doc_id").agg(
        F.bool_or(start & ~is_placeholder_date("date")).alias("has_start"),
        _first(opening, "date", "confidence").alias("open"), _first(value, "text").alias("val"),
    ).where(~F.col("has_start") & F.col("open").isNotNull())
    amount = parse_amount(F.col("val.text"))
    days = F.when(F.col("val").isNotNull() & (amount > 1_000_000), 60).otherwise(30)
    f = once(once(facts, "opened", parse_date(F.col("open.date"))), "days", days)
    shifted = next_business_day(F.col("opened") + F.make_dt_interval(days=F.col("days")))
    text = F.when(F.col("opened").isNull(), F.col("open.date")).otherwise(
        F.concat(long_date(shifted), F.lit(" (estimated — "), F.col("days").cast("string"), F.lit(" calendar days from Bid open date)"))
    )
    made = f.select(*_blank_row({
        "doc_id": F.col("doc_id"), "bucket": F.lit("project_dates"), "row_seq": F.lit(APPENDED + 1).cast("bigint"), "field_key": F.lit("project_start_date_time"),
        "text": F.lit("Project start date"), "date": text, "calculated": F.lit(True),
        "awaiting_value": F.col("opened").isNotNull() & F.col("val").isNull(), "not_found": F.lit(False),
        "confidence_cap": F.coalesce("open.confidence", F.lit(72)),
    }))
    return rows.where(~placeholder).select(*SPEC_COLUMNS).unionByName(made)


def rule_end_date(rows: DataFrame) -> DataFrame:
    """An end date given as a duration becomes start date plus duration."""
    end = _dates() & (_is("project end date") | (F.col("field_key") == "project_end_date_time"))
    start = _dates() & (_is("project start date") | (F.col("field_key") == "project_start_date_time"))
    facts = rows.where(end | start).groupBy("doc_id").agg(_first(end, "date").alias("e"), _first(start, "date", "confidence").alias("s"))
    both = facts.where(F.col("e").isNotNull() & F.col("s").isNotNull())
    f = once(once(both, "begin", parse_date(F.col("s.date"))), "calc", add_duration("begin", strip("e.date"))).select(
        "doc_id", F.col("e.row_seq").alias("row_seq"), strip("e.date").alias("raw"), F.col("s.confidence").alias("cap"), "calc",
    ).where(F.col("calc").isNotNull())
    ends, others = _apart(rows, end)
    j = ends.join(f, ["doc_id", "row_seq"], "left")
    hit = F.col("calc").isNotNull()
    return others.select(*SPEC_COLUMNS).unionByName(j.withColumns({
        "date": F.when(hit, F.concat(long_date("calc"), F.lit(' (estimated from "'), F.col("raw"), F.lit('")'))).otherwise(F.col("date")),
        "calculated": F.col("calculated") | hit,
        "confidence_cap": F.when(hit & F.col("cap").isNotNull(), F.col("cap")).otherwise(F.col("confidence_cap")),
    }).select(*SPEC_COLUMNS))


def rule_award_anchor(rows: DataFrame) -> DataFrame:
    """`N days after award` becomes a date once the award date is known."""
    facts = rows.where(_dates() & (F.col("field_key") == "municipal_meeting_date_time")).groupBy("doc_id").agg(
        _first(F.lit(True), "date", "confidence").alias("a")
    )
    facts = once(facts, "award", parse_date(F.col("a.date"))).where(F.col("award").isNotNull()).select(
        "doc_id", "award", F.coalesce("a.confidence", F.lit(72)).alias("cap")
    )
    raw = strip(_text("date"))
    n = F.floor(F.nullif(F.regexp_extract(raw, AFTER_AWARD, 1), F.lit("")).cast("double")).cast("int")
    worded, others = _apart(rows, _dates() & F.col("field_key").isin("project_start_date_time", "project_end_date_time") & raw.rlike(AFTER_AWARD))
    j = worded.join(facts, "doc_id", "left")
    hit = F.col("award").isNotNull() & n.isNotNull() & parse_date(raw).isNull()
    j = once(j, "hit", F.coalesce(hit, F.lit(False)))
    hit = F.col("hit")
    moved = F.col("award") + F.make_dt_interval(days=F.coalesce(n, F.lit(0)))
    return others.select(*SPEC_COLUMNS).unionByName(j.withColumns({
        "date": F.when(hit, F.concat(long_date(moved), F.lit(" (estimated — "), n.cast("string"), F.lit(" days after award date "), long_date("award"), F.lit(")"))).otherwise(F.col("date")),
        "calculated": F.col("calculated") | F.coalesce(hit, F.lit(False)),
        "confidence_cap": F.when(hit, F.col("cap")).otherwise(F.col("confidence_cap")),
    }).select(*SPEC_COLUMNS))


def drop_inferred(rows: DataFrame) -> DataFrame:
    return rows.where(~(_dates() & F.coalesce("calculated", F.lit(False)) & ~F.coalesce("date_grounded", F.lit(False))))


def attach_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes go to the first row of their date field; a missing date becomes a not-found row."""
    date_note = notes.where(F.col("field_key") != EVENTS_TARGET).select("doc_id", "field_key", strip("note").alias("n")).where(F.col("n") != "")
    event = notes.where(F.col("field_key") == EVENTS_TARGET).select("doc_id", "field_key", strip("note").alias("n")).where(F.col("n") != "")
    all_notes = date_note.unionByName(event)
    place = _dates() | ((F.col("bucket") == "project_metadata_items") & (F.col("field_key") == EVENTS_TARGET))
    first = rows.where(place).groupBy("doc_id", "field_key").agg(F.min("row_seq").alias("row_seq"))
    placed = all_notes.join(first, ["doc_id", "field_key"])
    low = F.lower("n")
    badge = F.when(
        F.col("field_key").isin("pre_bid_deadline_date_time", "site_visit_date_time"),
        F.when(low.startswith("mandatory"), True).when(low.startswith("non-mandatory") | low.startswith("not mandatory"), False),
    )
    marks = placed.select("doc_id", "row_seq", "n", badge.alias("badge"))
    noted, others = _apart(rows, place)
    out = others.select(*SPEC_COLUMNS).unionByName(noted.join(marks, ["doc_id", "row_seq"], "left").withColumns({
        "note": F.coalesce("n", "note"), "mandatory": F.coalesce("badge", "mandatory"),
    }).select(*SPEC_COLUMNS))
    keys = list(DEADLINE_LABELS)
    label = F.create_map(*[F.lit(x) for kv in DEADLINE_LABELS.items() for x in kv])
    shell = date_note.join(first, ["doc_id", "field_key"], "left_anti").select(*_blank_row({
        "doc_id": F.col("doc_id"), "bucket": F.lit("project_dates"),
        "row_seq": (F.lit(APPENDED + 10) + F.array_position(literal_array(keys), F.col("field_key"))).cast("bigint"),
        "field_key": F.col("field_key"), "text": F.try_element_at(label, F.col("field_key")), "date": F.lit(""), "calculated": F.lit(False),
        "awaiting_value": F.lit(False), "not_found": F.lit(True), "note": F.col("n"), "mandatory": badge,
    }))
    return out.unionByName(shell)


# ---- post rules

def is_valid_acquisition_note(c) -> Column:
    v = strip(F.coalesce(col(c), F.lit("")))
    return (v != "") & ~contains_any(F.lower(v), ACQUISITION_REJECT) & v.rlike(ACQUISITION_WORDS)


def is_solicitation_number(c) -> Column:
    v = strip(F.coalesce(col(c), F.lit("")))
    low = F.lower(v)
    return (
        (v != "") & ~low.isin("null", "none", "n/a", "na", "not stated", "not specified", "tbd")
        & (v.rlike(r"\d") | v.rlike(r"(?i)\b(RFP|RFQ|IFB|CIP|ITB|RFS|NO\.|#)\b"))
        & v.rlike(r"(?i)(?:\b[A-Z0-9][-A-Z0-9./]{2,}\b|\b\d{3,}\b)") & ~contains_any(low, SOLICITATION_REJECT)
    )


def row_value() -> Column:
    t = strip(_text("text"))
    i = F.instr(t, ": ")
    return F.when(i > 0, strip(F.substr(t, i + 2))).when(_text("date") != "", strip("date")).otherwise(t)


def _plain_title(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", " "))


def filter_rows(rows: DataFrame, names_of: DataFrame | None = None) -> DataFrame:
    """Metadata rows whose value cannot be what the field says are dropped.

    Only descriptions are compared with another row, the name of the project, which `names_of` may hold where `rows` are
    part of a table; all others are judged by themselves.
    """
    meta, key, v = F.col("bucket") == "project_metadata_items", F.col("field_key"), F.col("__v")
    names = (rows if names_of is None else names_of).where(meta & (key == "project_name")).groupBy("doc_id").agg(
        F.min(F.struct("row_seq", row_value().alias("v")))["v"].alias("__name")
    )
    described, others = _apart(once(rows, "__v", F.when(F.coalesce(meta, F.lit(True)), row_value())), F.coalesce(meta, F.lit(True)) & (key == "project_description"))
    ok = (
        F.when(key == "project_document_acquisition_note", is_valid_acquisition_note(v))
        .when(key == "project_sector", F.coalesce("citation_verified", F.lit(False)))
        .when(key == "project_solicitation_number", is_solicitation_number(v)).otherwise(True)
    )
    described = described.join(names, "doc_id", "left")
    vn, nn = _plain_title(v), _plain_title(F.coalesce("__name", F.lit("")))
    same = (nn != "") & (nn.contains(vn) | vn.contains(nn))
    prose = (word_count(v) >= 15) | v.contains(".") | v.contains(";")
    told = described.where(~meta | F.coalesce((F.length(v) >= 80) & ~same & prose, F.lit(True)))
    return others.where(~meta | F.coalesce(ok, F.lit(True))).select(*rows.columns).unionByName(told.select(*rows.columns))


def quality_key() -> Column:
    return F.struct(
        F.when(F.col("date_grounded") == F.lit(False), 0).otherwise(1).alias("g"), F.coalesce("citation_verified", F.lit(False)).cast("int").alias("v"),
        F.coalesce("confidence", F.lit(0)).alias("c"), (_text("source_text") != "").cast("int").alias("s"),
    )


def _code_only(v: Column) -> Column:
    i = F.instr(v, ": ")
    left, right = F.substr(v, F.lit(1), i - 1), strip(F.substr(v, i + 2))
    strip_it = (i > 0) & (F.length(left) <= 40) & ~F.lower(left).startswith("http") & (right != "")
    return F.when(strip_it, right).otherwise(v)


# field, label, joiner, limit of the text
MERGED = {
    "project_solicitation_number": ("Project solicitation number", "; ", "merged_chars"),
    "project_document_acquisition_note": ("Project document acquisition note", " • ", "merged_chars"),
    "project_description": ("Project description", "\n\n", "description_chars"),
}


def merge_multi(rows: DataFrame, limits: Limits = UNCUT) -> DataFrame:
    """Several rows of a mergeable metadata field become one, values distinct and in order.

    With a limit of values or characters only as many are gathered.
    """
    mergeable = (F.col("bucket") == "project_metadata_items") & F.col("field_key").isin(list(MERGED))
    sol = F.col("field_key") == "project_solicitation_number"
    # values are read once per row; merged projections would repeat them at every use
    base = once(once(rows.where(mergeable), "__v0", row_value()), "__code", _code_only(F.col("__v0")))
    use = sol & (F.col("__code") != "")
    base = base.withColumn("text", F.when(use, F.concat(F.lit("Project solicitation number: "), "__code")).otherwise(F.col("text")))
    base = once(once(base, "v", F.when(use, F.col("__code")).otherwise(F.col("__v0"))), "norm", norm_ws("v"))
    v = F.col("v")
    valid = F.when(sol, is_solicitation_number(v)).when(F.col("field_key") == "project_document_acquisition_note", is_valid_acquisition_note(v)).otherwise(True)
    keys = ["doc_id", "field_key"]
    values = base.where(valid & (F.col("norm") != "")).groupBy(*keys, "norm").agg(
        F.min(F.struct("row_seq", strip("v").alias("v"))).alias("p")
    )
    w = Window.partitionBy(*keys).orderBy("p.row_seq")
    first = values.withColumn("rn", F.row_number().over(w)).where(within("rn", limits.merged_values))
    joined = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p.v"))), lambda s: s["v"]).alias("vs"))
    payload = [c for c in SPEC_COLUMNS if c not in keys]
    groups = base.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.struct(quality_key().alias("q"), (-F.col("row_seq")).alias("o"), *payload)).alias("w")
    )
    text = None
    for k, (label, joiner, limit) in MERGED.items():
        t = F.concat(F.lit(label + ": "), head(F.array_join("vs", joiner), getattr(limits, limit)))
        text = F.when(F.col("field_key") == k, t) if text is None else text.when(F.col("field_key") == k, t)
    single = F.col("n") == 1
    merged = groups.join(joined, keys, "left").where(single | F.col("vs").isNotNull())
    out = merged.select(*keys, *[F.col("w." + c).alias(c) for c in payload if c != "text"], F.when(single, F.col("w.text")).otherwise(text).alias("text"))
    return rows.where(~F.coalesce(mergeable, F.lit(False))).select(*SPEC_COLUMNS).unionByName(out.select(*SPEC_COLUMNS))


STREET, STATE_ZIP, BARE_CITY = r"\b\d{2,6}\b", r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b", r"(?i)^\s*(in\s+the\s+city\s+of|city\s+of)\b"


def is_bare_jurisdiction(c) -> Column:
    v = strip(F.coalesce(col(c), F.lit("")))
    return v.rlike(BARE_CITY) & ~v.contains(",") & ~v.rlike(STREET)


def address_score(c) -> Column:
    v = strip(F.coalesce(col(c), F.lit("")))
    score = v.rlike(STREET).cast("int") * 2 + v.contains(",").cast("int") + v.rlike(STATE_ZIP).cast("int")
    return F.when((v == "") | is_bare_jurisdiction(v), 0).otherwise(score)


def merge_locations(rows: DataFrame) -> DataFrame:
    """All distinct locations of a document in one row: no value that another one contains."""
    loc = (F.col("bucket") == LOCATIONS) & (F.col("field_key") == "project_location")
    base = once(rows.where(loc), "v", row_value())
    rank = F.struct(address_score("v").alias("a"), quality_key().alias("q"), (-F.col("row_seq")).alias("o"))
    payload = [c for c in SPEC_COLUMNS if c != "doc_id"]
    best = base.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.struct(rank.alias("r"), *payload)).alias("w"))
    norm = F.regexp_replace(F.lower(strip("v")), WS + "+", " ")
    distinct = base.where(strip("v") != "").groupBy("doc_id", norm.alias("norm")).agg(
        F.max(F.struct(rank.alias("r"), strip("v").alias("v"))).alias("p")
    ).withColumn("bare", is_bare_jurisdiction(F.col("p.v")))
    # the distinct values of one document meet inside one row: their joined text is the result
    lists = distinct.groupBy("doc_id").agg(
        F.max(F.col("p.r.a")).alias("top"), F.sort_array(F.collect_list(F.struct(F.col("p.r").alias("r"), F.col("p.v").alias("v"), "norm", "bare")), False).alias("vs")
    ).select("doc_id", F.filter("vs", lambda x: ~(x["bare"] & (F.col("top") > 0))).alias("vs"))
    kept = F.filter("vs", lambda x: ~F.exists("vs", lambda y: (y["norm"] != x["norm"]) & y["norm"].contains(x["norm"])))
    text = F.concat(F.lit("Project location: "), F.array_join(F.transform(kept, lambda x: x["v"]), "; "))
    single = F.col("n") == 1
    out = best.join(lists.select("doc_id", text.alias("merged"), F.size("vs").alias("m")), "doc_id", "left").where(single | (F.col("m") > 0)).select(
        "doc_id", *[F.col("w." + c).alias(c) for c in payload if c != "text"], F.when(single, F.col("w.text")).otherwise(F.col("merged")).alias("text")
    )
    return rows.where(~F.coalesce(loc, F.lit(False))).select(*SPEC_COLUMNS).unionByName(out.select(*SPEC_COLUMNS))


def date_kind() -> Column:
    return F.when(
        F.col("bucket") == "project_dates",
        F.when(F.coalesce("calculated", F.lit(False)), "estimated").when(is_placeholder_date("date"), "non_specific")
        .when(is_duration_text("date"), "duration").otherwise("absolute"),
    )


def _primary() -> Column:
    date = F.regexp_replace(F.lower(strip(_text("date"))), r"\s+(cst|cdt|est|edt|mst|mdt|pst|pdt)\b", "")
    return F.when(F.col("bucket") == "project_dates", F.regexp_replace(date, WS + "+", " ")).otherwise(norm_ws("text"))


def _is_singleton() -> Column:
    return F.coalesce(F.col("field_key").isin(SINGLETON_KEYS), F.lit(False))


def dedupe_rows(rows: DataFrame) -> DataFrame:
    """Best row per singleton field; other fields keep the best row of every distinct value."""
    key = F.when(_is_singleton(), F.lit("")).otherwise(_primary())
    payload = [c for c in rows.columns if c not in ("doc_id", "bucket", "field_key")]
    best = rows.groupBy("doc_id", "bucket", F.coalesce("field_key", F.lit("")).alias("field_key"), key.alias("__k")).agg(
        F.max(F.struct(quality_key().alias("q"), (-F.col("row_seq")).alias("o"), *payload)).alias("w")
    )
    return best.select("doc_id", "bucket", "field_key", *[F.col("w." + c).alias(c) for c in payload]).select(*rows.columns)


def dedupe_warnings(rows: DataFrame) -> DataFrame:
    g = rows.where(_is_singleton()).groupBy("doc_id", "bucket", "field_key").agg(
        F.count("*").alias("n"), F.count_distinct(_primary()).alias("values")
    ).where(F.col("n") > 1)
    warn = F.col("values") > 1
    dropped = (F.col("n") - 1).cast("int")
    return g.select(
        "doc_id", "field_key", "bucket", F.when(warn, "warn").otherwise("info").alias("level"),
        F.when(warn, F.concat(F.lit("Conflicting '"), "field_key", F.lit("' values ("), F.col("values").cast("string"), F.lit(" distinct); kept best citation.")))
        .otherwise(F.concat(F.lit("Resolved "), dropped.cast("string"), F.lit(" duplicate '"), "field_key", F.lit("' row(s); kept best citation."))).alias("message"),
        dropped.alias("dropped_count"),
    )


def _warning(rows: DataFrame, key: Column, bucket: Column, level: str, message: Column) -> DataFrame:
    return rows.select("doc_id", key.alias("field_key"), bucket.alias("bucket"), F.lit(level).alias("level"), message.alias("message"), F.lit(None).cast("int").alias("dropped_count"))


def field_warnings(rows: DataFrame) -> DataFrame:
    key = _text("field_key")
    low = _warning(
        rows.where(F.col("confidence") < 50), key, F.col("bucket"), "warn",
        F.concat(F.lit("Low confidence ("), F.col("confidence").cast("string"), F.lit("%) on '"), F.when(_text("text") != "", F.col("text")).otherwise(key), F.lit("'.")),
    )
    wait = _warning(
        rows.where(F.coalesce("awaiting_value", F.lit(False))), F.when(key != "", key).otherwise("project_start_date_time"), F.col("bucket"), "info",
        F.lit("Project start date uses default 30-day offset; project value not found."),
    )
    has = F.max(F.coalesce(_dates() & (key == "bid_deadline_date_time"), F.lit(False)))
    none = _warning(
        rows.groupBy("doc_id").agg(has.alias("has")).where(~F.col("has") | F.col("doc_id").isNull()), F.lit("bid_deadline_date_time"), F.lit("project_dates"), "warn",
        F.lit("Bid deadline not found in document."),
    )
    return low.unionByName(wait).unionByName(none)


READ = "__ts"


def read_dates(rows: DataFrame) -> DataFrame:
    """Add what the dates of date rows say, where it is not known yet; the rules on years and orders share it."""
    return rows if READ in rows.columns else once(rows, READ, F.when(_dates(), parse_date("date")))


def zero_bad_years(rows: DataFrame) -> DataFrame:
    y = F.year(READ)
    read = read_dates(rows).withColumn("confidence", F.when(F.coalesce(~y.between(2020, 2035), F.lit(False)), 0).otherwise(F.col("confidence")))
    return read.select(*rows.columns)


def date_warnings(rows: DataFrame) -> DataFrame:
    """Years out of range and impossible orders of dates; the last row of a field counts."""
    d = read_dates(rows.where(_dates())).select("doc_id", _text("field_key").alias("field_key"), "row_seq", F.col(READ).alias("ts")).where(F.col("ts").isNotNull())
    y = F.year("ts")
    inside = y.between(2020, 2035)
    bad = _warning(
        d.where(~inside), F.col("field_key"), F.lit("project_dates"), "warn",
        F.concat(F.lit("Date year "), y.cast("string"), F.lit(" out of expected range (2020–2035); likely misread.")),
    )
    last = lambda k: F.max(F.when(F.col("field_key") == k, F.struct("row_seq", "ts")))["ts"]
    p = d.where(inside).groupBy("doc_id").agg(
        last("question_deadline_date_time").alias("q"), last("bid_deadline_date_time").alias("b"), last("pre_bid_deadline_date_time").alias("p"),
        last("project_start_date_time").alias("s"), last("project_end_date_time").alias("e"),
    )
    checks = [
        ("q", "b", "question_deadline_date_time", "Question deadline is after bid deadline — dates may be mislabeled."),
        ("p", "b", "pre_bid_deadline_date_time", "Pre-bid/site-visit date is after bid deadline — dates may be mislabeled."),
        ("s", "e", "project_start_date_time", "Project start date is after project end date — dates may be swapped."),
    ]
    found = F.array_compact(F.array(*[F.when(F.col(a) > F.col(b), F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"))) for a, b, k, m in checks]))
    order = p.select("doc_id", F.explode(found).alias("x"))
    return bad.unionByName(_warning(order, F.col("x.k"), F.lit("project_dates"), "warn", F.col("x.m")))


def merge_warnings(warnings: DataFrame) -> DataFrame:
    """Distinct by document, bucket, field and message."""
    return warnings.groupBy("doc_id", "bucket", "field_key", "message").agg(F.min("level").alias("level"), F.max("dropped_count").alias("dropped_count"))


def finalize(rows: DataFrame, notes: DataFrame | None = None, infer_dates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Date rules, notes, filters, merging, deduplication, confidence and warnings, in order.

    The rules read the rows again and again, so rows and notes are written before them, and the table again after the
    date rules, the merging and the deduplication; the last one with what its dates say. Only fields that are merged are
    written after the filters. Locations and other metadata are merged apart: neither merging reads the rows of the other.
    """
    out = rule_bid_open(cut(rows.select(*SPEC_COLUMNS), STAGES))
    if infer_dates:
        out = rule_award_anchor(rule_end_date(cut(rule_start_date(out), STAGES)))
    else:
        out = drop_inferred(out)
    if notes is not None:
        out = attach_notes(out, cut(notes, STAGES))
    out = cut(out, STAGES)
    many, single = _apart(out, F.col("field_key").isin([*MERGED, "project_location"]) & F.col("bucket").isin("project_metadata_items", LOCATIONS))
    many = cut(filter_rows(many, out), STAGES)
    place = F.col("bucket") == LOCATIONS
    merged = merge_multi(many.where(~place)).unionByName(merge_locations(many.where(place)))
    out = cut(infer_field_key(filter_rows(single, out).unionByName(merged)), STAGES)
    first = dedupe_warnings(out)
    out = cut(zero_bad_years(read_dates(apply_confidence(dedupe_rows(out)))), STAGES)
    warnings = merge_warnings(first.unionByName(field_warnings(out)).unionByName(date_warnings(out)))
    return out.drop(READ).withColumn("date_kind", date_kind()), warnings


def sort_metadata(rows: DataFrame) -> DataFrame:
    """Add the display position of metadata rows."""
    pos = F.array_position(literal_array(METADATA_ORDER), F.col("field_key"))
    return rows.withColumn("display_order", F.when(pos > 0, pos - 1).otherwise(len(METADATA_ORDER)).cast("int"))


def display_value(text, label) -> Column:
    """The value of a row; a leading `label: ` goes only when it is the field's own label."""
    t = strip(F.coalesce(col(text), F.lit("")))
    prefix = F.concat(F.lower(strip(col(label))), F.lit(": "))
    return F.when(F.startswith(F.lower(t), prefix), strip(F.substr(t, F.length(prefix) + 1))).otherwise(t)


def rebind_sources(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Date and bond rows take the quote of their best extraction."""
    lab = F.lower(strip(_text("label")))
    src = F.struct(
        F.coalesce("citation_verified", F.lit(False)).cast("int").alias("v"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("item_seq")).alias("o"),
        F.col("page").alias("page"), F.col("section").alias("section"), _text("source_text").alias("src"), F.coalesce("citation_verified", F.lit(False)).alias("cv"),
    )
    group = F.when(F.col("extraction_type") == "submission_deadlines", "project_dates").when(
        F.col("extraction_type").isin("penalties_and_risks", "mandatory_documents"), "bond_items"
    )
    best = items.select("doc_id", group.alias("bucket"), lab.alias("lookup"), src.alias("s")).where(F.col("bucket").isNotNull() & (F.col("lookup") != "")).groupBy(
        "doc_id", "bucket", "lookup"
    ).agg(F.max("s").alias("s"))
    j = rows.withColumn("lookup", F.when(F.col("field_key") == "bid_open_date_time", "bid_deadline_date_time").otherwise(F.col("field_key"))).join(
        best, ["doc_id", "bucket", "lookup"], "left"
    )
    hit = F.coalesce(F.col("s.src") != "", F.lit(False))
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
    swap = {"page": "s.page", "section": "s.section", "source_text": "s.src", "citation_verified": "s.cv"}
    return j.select(*[pick(swap[c], c) if c in swap else F.col(c) for c in rows.columns])


def repair_all(rows: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Re-run the rules over all stored rows and report which documents change."""
    after, _ = finalize(rows, notes)

    def digest(df):
        line = F.concat_ws("|", "bucket", _text("field_key"), _text("text"), _text("date"), F.coalesce(F.col("confidence").cast("string"), F.lit("")))
        return df.groupBy("doc_id").agg(F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))

    b, a = digest(rows), digest(after).select("doc_id", F.col("h").alias("h2"), F.col("n").alias("n2"))
    return b.join(a, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("rows_before"), F.coalesce("n2", F.lit(0)).alias("rows_after"),
        (~F.col("h").eqNullSafe(F.col("h2")) | ~F.col("n").eqNullSafe(F.col("n2"))).alias("changed"),
    )
