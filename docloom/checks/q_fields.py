"""Dates, money, the field table and its rules."""

from pyspark.sql import functions as F

from docloom.checks import business as B
from docloom.checks.business import SPEC_SQL, sql_list
from docloom.checks.limits import L as LIM
from docloom.checks.registry import query
from docloom.functions import dates as D
from docloom.operators import fields as FD

DATE_FORMS = 10


def order_dates(t):
    """Order dates written in ten ways, one of them unreadable."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % DATE_FORMS
    fmt = lambda p: F.date_format(d, p)
    text = (
        F.when(k == 0, F.concat(fmt("EEEE, MMMM d, yyyy"), F.lit(" at 10:00 AM"))).when(k == 1, F.concat(fmt("M/d/yyyy"), F.lit(" @ 3:05 P.M. PST")))
        .when(k == 2, F.concat(fmt("yyyy-MM-dd"), F.lit("T15:00:00-08:00"))).when(k == 3, F.concat(fmt("MMMM d"), F.lit("th, "), fmt("yyyy")))
        .when(k == 4, F.concat(F.lit("2:30 PM on "), fmt("MMMM d, yyyy"))).when(k == 5, F.concat(fmt("dd-MMM-yyyy"), F.lit(" 14:45")))
        .when(k == 6, F.concat(fmt("MM/dd/yyyy"), F.lit(" 1330"))).when(k == 7, fmt("d MMM yyyy")).when(k == 8, fmt("M/d/yy"))
        .otherwise(F.concat(F.lit("Fall of "), fmt("yyyy")))
    )
    return t.orders.select("o_orderkey", "o_orderdate", text.alias("raw"))


EXPECTED_DATE = """CASE o_orderkey % 10 WHEN 0 THEN o_orderdate + INTERVAL 10 HOUR WHEN 1 THEN o_orderdate + INTERVAL 905 MINUTE WHEN 2 THEN o_orderdate + INTERVAL 15 HOUR
  WHEN 3 THEN o_orderdate WHEN 4 THEN o_orderdate WHEN 5 THEN o_orderdate + INTERVAL 885 MINUTE WHEN 6 THEN o_orderdate + INTERVAL 810 MINUTE WHEN 7 THEN o_orderdate WHEN 8 THEN o_orderdate END"""


@query("fd1_parse_date", f"SELECT o_orderkey, {EXPECTED_DATE} AS parsed FROM orders")
def _(t):
    return order_dates(t).select("o_orderkey", D.parse_date("raw").alias("parsed"))


@query("fd2_parse_amount", """SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 1000 + 0.5 WHEN 1 THEN (o_custkey + 2) * 1000000.0 WHEN 2 THEN o_custkey * 1000.0 WHEN 3 THEN 3000000.0 WHEN 4 THEN o_custkey END AS DOUBLE) AS amount FROM orders""")
def _(t):
    c = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("about $"), F.format_number(F.col("o_custkey") * 1000 + 0.5, 2), F.lit(" in all")))
        .when(k == 1, F.concat(F.lit("$1 to $"), (F.col("o_custkey") + 2).cast("string"), F.lit("M range"))).when(k == 2, F.concat(c, F.lit(" thousand dollars")))
        .when(k == 3, F.lit("Three Million Dollars")).when(k == 4, F.concat(c, F.lit(" USD"))).otherwise("no figure")
    )
    return t.orders.select("o_orderkey", D.parse_amount(text).alias("amount"))


@query("fd3_add_duration", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderdate + to_days(CAST(o_custkey AS INTEGER)) WHEN 1 THEN o_orderdate + to_days(56) WHEN 2 THEN o_orderdate + INTERVAL 6 MONTH WHEN 3 THEN o_orderdate + INTERVAL 24 MONTH
  WHEN 4 THEN o_orderdate + to_days(180) END AS due FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(" working days"))).when(k == 1, "8 weeks").when(k == 2, "six months").when(k == 3, "Two years")
        .when(k == 4, "One hundred eighty (180) calendar days").when(k == 5, "March 11, 2026").otherwise("soon")
    )
    return t.orders.select("o_orderkey", D.add_duration("o_orderdate", text).cast("timestamp_ntz").alias("due"))


@query("fd4_next_business_day", "SELECT o_orderkey, o_orderdate + to_days(CASE dayofweek(o_orderdate) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END) AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.next_business_day("o_orderdate").cast("timestamp_ntz").alias("day"))


@query("fd5_add_months", "SELECT o_orderkey, o_orderdate + to_months(CAST(o_custkey % 40 AS INTEGER)) AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.add_months_clamped("o_orderdate", (F.col("o_custkey") % 40).cast("int")).cast("timestamp_ntz").alias("day"))


def spec_items(t):
    """Items of an order's document with labels of the field registry."""
    keys = B.KEYS + ["bid_deadline_note", "site_visit_note", "set_aside_mbe"]
    k = (F.col("l_partkey") % len(keys)).cast("int")
    lab = B.pick(keys, k)
    types = F.when(lab.endswith("_date_time") | lab.endswith("_note"), "submission_deadlines").when(lab.isin(list(B.BOND_LABELS)), "penalties_and_risks").when(
        lab == "project_description", "scope_of_work").when(lab == "project_value", "payment_terms").when(lab.isin("project_location", "project_square_footage"), "technical_requirements").when(
        lab.startswith("set_aside"), "set_asides").otherwise("eligibility_criteria")
    val = F.when(lab.endswith("_date_time"), F.date_format("l_shipdate", "MMMM d, yyyy")).otherwise(F.concat(F.lit("value "), (F.col("l_partkey") % 7).cast("string")))
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), types.alias("extraction_type"), B._seq().alias("item_seq"),
        F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(lab).alias("label"), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(val).alias("value"),
        F.concat(F.initcap(lab), F.lit(": "), val).alias("requirement"), F.lit(None).cast("string").alias("date_time"), F.col("l_linenumber").alias("page"),
        F.lit("s").alias("section"), F.when(F.col("l_tax") > 0.02, F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" says "), val)).otherwise("").alias("source_text"),
        F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "F").alias("citation_verified"))


_IKEYS = B.KEYS + ["bid_deadline_note", "site_visit_note", "set_aside_mbe"]
SITEMS_SQL = f"""
i0 AS (SELECT *, {sql_list(_IKEYS)}[CAST(l_partkey % {len(_IKEYS)} + 1 AS INTEGER)] AS lab FROM lineitem),
i1 AS (SELECT *, CASE WHEN ends_with(lab, '_date_time') THEN strftime(l_shipdate, '%B %-d, %Y') ELSE 'value ' || (l_partkey % 7) END AS val FROM i0),
si AS (SELECT l_orderkey AS doc_id, {B._SEQ_SQL} AS item_seq, lab, val, CASE WHEN l_tax > 0.02 THEN 'Line ' || l_linenumber || ' says ' || val ELSE '' END AS src, l_discount AS conf, l_linestatus = 'F' AS cv, l_linenumber AS page, l_suppkey FROM i1)"""


@query("fd6_label_value", f"WITH {SITEMS_SQL} SELECT doc_id, item_seq, lab AS l, val AS v FROM si")
def _(t):
    return FD.label_value(spec_items(t)).select("doc_id", "item_seq", "l", "v")


_MAPS = "CASE lab " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, _, v in B.FIELDS) + " END"
_BUCK = "CASE lab " + " ".join(f"WHEN '{k}' THEN '{b}'" for k, b, _ in B.FIELDS) + " END"
CONF_SQL = "CAST(round_even(CASE WHEN {cv} THEN 90 + 10 * {c} WHEN {src} <> '' THEN 30 + 25 * {c} ELSE least(30, 30 * {c}) END, 0) AS BIGINT)"


@query("fd7_build_spec_rows", f"""WITH {SITEMS_SQL},
s1 AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE lab END AS own, CASE WHEN lab = 'set_aside_mbe' THEN 'set_aside_items' ELSE {_BUCK} END AS bucket FROM si),
s2 AS (SELECT *, CASE WHEN bucket = 'project_dates' THEN {_MAPS} WHEN bucket = 'bond_items' THEN {_MAPS} WHEN bucket = 'set_aside_items' THEN 'Set-aside: ' || CASE WHEN own <> '' THEN val WHEN src <> '' THEN src ELSE val END ELSE {_MAPS} || ': ' || val END AS text,
   CASE WHEN bucket = 'project_dates' THEN CASE WHEN own = '' THEN '' ELSE val END WHEN bucket = 'bond_items' THEN CASE WHEN own = '' THEN '' ELSE val END ELSE '' END AS date FROM s1 WHERE bucket IS NOT NULL),
s3 AS (SELECT * FROM s2 WHERE NOT (bucket IN ('project_dates', 'bond_items') AND own = '') AND lab <> 'project_document_acquisition_note')
SELECT doc_id, bucket, lab AS field_key, text, date, {CONF_SQL.format(cv='cv', c='conf', src='src')} AS confidence,
  cv AND NOT (bucket = 'project_dates' AND src = '') AS citation_verified
FROM s3 QUALIFY row_number() OVER (PARTITION BY doc_id, bucket, lab, CASE WHEN bucket IN ('project_dates', 'bond_items') THEN substr(date, 1, 80) ELSE text END ORDER BY item_seq) = 1""")
def _(t):
    return FD.build_spec_rows(spec_items(t), 80, 400).select("doc_id", "bucket", "field_key", "text", "date", "confidence", "citation_verified")


@query("fd7_date_notes", f"""WITH {SITEMS_SQL} SELECT doc_id, CASE lab WHEN 'bid_deadline_note' THEN 'bid_deadline_date_time' ELSE 'site_visit_date_time' END AS field_key, arg_min(val, item_seq) AS note
  FROM si WHERE lab IN ('bid_deadline_note', 'site_visit_note') AND l_suppkey % 4 <> 0 GROUP BY 1, 2""")
def _(t):
    return FD.date_notes(spec_items(t))


@query("fd8_date_grounded", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN contains(strftime(o_orderdate, '%-m/%-d'), '') WHEN 1 THEN CAST(day(o_orderdate) AS VARCHAR) = CAST(o_custkey % 28 AS VARCHAR) ELSE o_custkey % 2 = 0 END AS g FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 3
    fmt = lambda p: F.date_format("o_orderdate", p)
    value = F.when(k == 0, fmt("M/d/yyyy")).when(k == 1, fmt("MMMM d")).otherwise(fmt("yyyy-MM-dd"))
    quote = F.when(k == 0, F.concat(F.lit("on "), fmt("M/d"), F.lit(" noon"))).when(k == 1, F.concat(fmt("MMMM"), F.lit("  the "), (F.col("o_custkey") % 28).cast("string"))).otherwise(
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("due "), fmt("yyyy-MM-dd"))).otherwise("due"))
    return t.orders.select("o_orderkey", D.date_grounded(value, quote).alias("g"))


def spec(t):
    """Field rows with every column of the field table."""
    s = B.spec(t)
    return s.withColumns({
        "mandatory": F.lit(None).cast("boolean"), "confidence_cap": F.lit(None).cast("int"), "section": F.lit("s"),
        "note": F.nullif("note", F.lit("")),
    }).select(*FD.SPEC_COLUMNS)


SHOWN = ["doc_id", "bucket", "row_seq", "field_key", "text", "date", "confidence", "calculated"]


@query("fd9_rule_bid_open", f"""WITH {SPEC_SQL}, k AS (SELECT * FROM spec WHERE NOT (lower(text) = 'bid open date' AND NOT date_grounded)),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY date_grounded DESC, row_seq) AS rn FROM k WHERE lower(text) = 'bid deadline' AND doc_id NOT IN (SELECT doc_id FROM k WHERE lower(text) = 'bid open date'))
SELECT doc_id, bucket, row_seq, field_key, text, date, confidence, calculated FROM k UNION ALL SELECT doc_id, bucket, 1152921504606846976, 'bid_open_date_time', 'Bid open date', date, confidence, calculated FROM m WHERE rn = 1""")
def _(t):
    return FD.rule_bid_open(spec(t)).select(*SHOWN)


@query("fd10_rule_start_date", f"""WITH {SPEC_SQL}, o AS (SELECT doc_id, arg_min(date, row_seq) AS date, arg_min(confidence, row_seq) AS c FROM spec WHERE field_key = 'bid_open_date_time' GROUP BY 1),
v AS (SELECT doc_id, arg_min(text, row_seq) AS text FROM spec WHERE field_key = 'project_value' GROUP BY 1),
m AS (SELECT o.doc_id, c, v.text IS NULL AS w, CAST(o.date AS TIMESTAMP) + to_days(30) AS d FROM o LEFT JOIN v USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM spec WHERE field_key = 'project_start_date_time'))
SELECT doc_id, row_seq, field_key, date, NULL::BIGINT AS confidence_cap, awaiting_value FROM spec
UNION ALL SELECT doc_id, 1152921504606846977, 'project_start_date_time', strftime(d + to_days(CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END), '%B %d, %Y') || ' (estimated — 30 calendar days from Bid open date)', c, w FROM m""")
def _(t):
    return FD.rule_start_date(spec(t)).select("doc_id", "row_seq", "field_key", "date", "confidence_cap", "awaiting_value")


def durations(t):
    """Field rows whose end dates are written as durations."""
    end = F.col("field_key") == "project_end_date_time"
    return spec(t).withColumn("date", F.when(end & (F.col("confidence") < 60), "90 calendar days").when(end, "120 days after award").otherwise(F.col("date")))


DUR_SQL = SPEC_SQL + ", du AS (SELECT * REPLACE (CASE WHEN field_key = 'project_end_date_time' AND confidence < 60 THEN '90 calendar days' WHEN field_key = 'project_end_date_time' THEN '120 days after award' ELSE date END AS date) FROM spec)"


@query("fd11_rule_end_date", f"""WITH {DUR_SQL}, s AS (SELECT doc_id, arg_min(date, row_seq) AS d, arg_min(confidence, row_seq) AS c FROM du WHERE field_key = 'project_start_date_time' GROUP BY 1),
e AS (SELECT doc_id, min(row_seq) AS row_seq, arg_min(date, row_seq) AS raw FROM du WHERE field_key = 'project_end_date_time' GROUP BY 1)
SELECT du.doc_id, du.row_seq, CASE WHEN e.raw IS NOT NULL AND s.d IS NOT NULL THEN strftime(CAST(s.d AS TIMESTAMP) + to_days(CASE WHEN e.raw LIKE '90%' THEN 90 ELSE 120 END), '%B %d, %Y') || ' (estimated from "' || raw || '")' ELSE date END AS date,
  CASE WHEN e.raw IS NOT NULL AND s.d IS NOT NULL THEN c END AS confidence_cap FROM du LEFT JOIN e ON e.doc_id = du.doc_id AND e.row_seq = du.row_seq LEFT JOIN s ON s.doc_id = e.doc_id""")
def _(t):
    return FD.rule_end_date(durations(t)).select("doc_id", "row_seq", "date", "confidence_cap")


@query("fd12_rule_award_anchor", f"""WITH {DUR_SQL}, a AS (SELECT doc_id, CAST(arg_min(date, row_seq) AS TIMESTAMP) AS d, arg_min(confidence, row_seq) AS c FROM du WHERE field_key = 'municipal_meeting_date_time' GROUP BY 1)
SELECT du.doc_id, row_seq, CASE WHEN d IS NOT NULL AND date LIKE '%after award' THEN strftime(d + to_days(120), '%B %d, %Y') || ' (estimated — 120 days after award date ' || strftime(d, '%B %d, %Y') || ')' ELSE date END AS date,
  CASE WHEN d IS NOT NULL AND date LIKE '%after award' THEN c END AS confidence_cap FROM du LEFT JOIN a USING (doc_id)""")
def _(t):
    return FD.rule_award_anchor(durations(t)).select("doc_id", "row_seq", "date", "confidence_cap")


@query("fd13_drop_inferred", f"WITH {SPEC_SQL} SELECT doc_id, row_seq FROM spec WHERE NOT (bucket = 'project_dates' AND calculated AND NOT date_grounded)")
def _(t):
    return FD.drop_inferred(spec(t)).select("doc_id", "row_seq")


def notes(t):
    n = t.lineitem.where("l_quantity > 40").groupBy("l_orderkey").agg(F.max("l_partkey").alias("p"))
    return n.select(F.col("l_orderkey").alias("doc_id"), B.pick(["site_visit_date_time", "bid_deadline_date_time", "project_document_acquisition_note"], F.col("p") % 3).alias("field_key"),
                    F.concat(F.when(F.col("p") % 2 == 0, "Mandatory visit ").otherwise("Not mandatory "), F.col("p").cast("string")).alias("note"))


@query("fd14_attach_notes", f"""WITH {SPEC_SQL}, n AS (SELECT l_orderkey AS doc_id, ['site_visit_date_time', 'bid_deadline_date_time', 'project_document_acquisition_note'][CAST(max(l_partkey) % 3 + 1 AS INTEGER)] AS fk,
   CASE WHEN max(l_partkey) % 2 = 0 THEN 'Mandatory visit ' ELSE 'Not mandatory ' END || max(l_partkey) AS n, max(l_partkey) % 2 = 0 AS m FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
w AS (SELECT doc_id, field_key, row_seq, note, not_found, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY row_seq) AS r FROM spec),
f AS (SELECT w.doc_id, w.field_key, w.row_seq, n.n AS nn, n.fk, n.m FROM w JOIN n ON n.doc_id = w.doc_id AND n.fk = w.field_key WHERE w.r = 1)
SELECT w.doc_id, w.field_key, w.row_seq, coalesce(f.nn, nullif(w.note, '')) AS note, CASE WHEN f.fk = 'site_visit_date_time' THEN f.m END AS mandatory, w.not_found FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.field_key = w.field_key AND f.row_seq = w.row_seq
UNION ALL SELECT n.doc_id, n.fk, 1152921504606846976 + 10 + CASE n.fk WHEN 'bid_deadline_date_time' THEN 1 ELSE 6 END, n.n, CASE WHEN n.fk = 'site_visit_date_time' THEN n.m END, true FROM n ANTI JOIN f ON f.doc_id = n.doc_id AND f.fk = n.fk WHERE n.fk <> 'project_document_acquisition_note'""")
def _(t):
    return FD.attach_notes(spec(t), notes(t)).select("doc_id", "field_key", "row_seq", "note", "mandatory", "not_found")


def worded(t):
    """Field rows with texts that the filters accept or reject."""
    k = F.col("row_seq") % 4
    key = F.col("field_key")
    v = (
        F.when(key == "project_document_acquisition_note", F.when(k == 0, "Download from the portal").when(k == 1, "N/A, obtain nothing").otherwise("By courier"))
        .when(key == "project_solicitation_number", F.when(k == 0, "RFP-001").when(k == 1, "requisition 77").when(k == 2, "Bid No: AFE-H051").otherwise("tbd"))
        .when(key == "project_description", F.when(k < 2, F.repeat(F.lit("build the bridge; "), 6)).otherwise("short"))
        .when(key == "project_location", F.when(k == 0, "City of Republic").when(k == 1, "12 Main Street").when(k == 2, "12 Main Street, Springfield, IL 62701").otherwise("Clark County"))
    )
    return spec(t).withColumn("text", F.when(v.isNotNull(), F.concat(F.initcap(F.replace("field_key", F.lit("_"), F.lit(" "))), F.lit(": "), v)).otherwise(F.col("text")))


WORDED_SQL = SPEC_SQL + """,
wv AS (SELECT *, row_seq % 4 AS k, CASE field_key WHEN 'project_document_acquisition_note' THEN CASE row_seq % 4 WHEN 0 THEN 'Download from the portal' WHEN 1 THEN 'N/A, obtain nothing' ELSE 'By courier' END
  WHEN 'project_solicitation_number' THEN CASE row_seq % 4 WHEN 0 THEN 'RFP-001' WHEN 1 THEN 'requisition 77' WHEN 2 THEN 'Bid No: AFE-H051' ELSE 'tbd' END
  WHEN 'project_description' THEN CASE WHEN row_seq % 4 < 2 THEN repeat('build the bridge; ', 6) ELSE 'short' END
  WHEN 'project_location' THEN CASE row_seq % 4 WHEN 0 THEN 'City of Republic' WHEN 1 THEN '12 Main Street' WHEN 2 THEN '12 Main Street, Springfield, IL 62701' ELSE 'Clark County' END END AS nv FROM spec)"""


@query("fd15_filter_rows", f"""WITH {WORDED_SQL} SELECT doc_id, row_seq, field_key FROM wv WHERE CASE field_key WHEN 'project_document_acquisition_note' THEN k = 0 WHEN 'project_solicitation_number' THEN k IN (0, 2)
  WHEN 'project_description' THEN k < 2 WHEN 'project_sector' THEN citation_verified ELSE true END""")
def _(t):
    return FD.filter_rows(worded(t)).select("doc_id", "row_seq", "field_key")


@query("fd16_date_kind", f"""WITH {DUR_SQL} SELECT doc_id, row_seq, CASE WHEN bucket = 'project_dates' THEN CASE WHEN calculated THEN 'estimated' WHEN date = '120 days after award' THEN 'non_specific' WHEN date = '90 calendar days' THEN 'duration' ELSE 'absolute' END END AS date_kind FROM du""")
def _(t):
    return durations(t).select("doc_id", "row_seq", FD.date_kind().alias("date_kind"))


@query("fd17_merge_multi", f"""WITH {WORDED_SQL},
b AS (SELECT doc_id, field_key, row_seq, CASE WHEN nv = 'Bid No: AFE-H051' THEN 'AFE-H051' ELSE trim(nv) END AS v, citation_verified, confidence FROM wv WHERE field_key IN ('project_solicitation_number', 'project_document_acquisition_note', 'project_description')),
ok AS (SELECT * FROM b WHERE CASE field_key WHEN 'project_solicitation_number' THEN v IN ('RFP-001', 'AFE-H051') WHEN 'project_document_acquisition_note' THEN v = 'Download from the portal' ELSE true END),
d AS (SELECT doc_id, field_key, v, min(row_seq) AS r FROM ok GROUP BY 1, 2, 3),
j AS (SELECT doc_id, field_key, CASE field_key WHEN 'project_solicitation_number' THEN string_agg(v, '; ' ORDER BY r) WHEN 'project_description' THEN string_agg(v, chr(10) || chr(10) ORDER BY r) ELSE string_agg(v, ' • ' ORDER BY r) END AS t FROM d GROUP BY doc_id, field_key),
g AS (SELECT doc_id, field_key, count(*) AS n, arg_max(row_seq, (citation_verified, confidence, -row_seq)) AS row_seq, arg_max(v, (citation_verified, confidence, -row_seq)) AS v1 FROM b GROUP BY 1, 2)
SELECT g.doc_id, g.field_key, g.row_seq, CASE WHEN n = 1 THEN v1 ELSE t END AS v FROM g LEFT JOIN j ON j.doc_id = g.doc_id AND j.field_key = g.field_key WHERE n = 1 OR t IS NOT NULL""")
def _(t):
    w = worded(t).withColumn("date_grounded", F.lit(None).cast("boolean"))
    out = FD.merge_multi(w, LIM).where(F.col("field_key").isin("project_solicitation_number", "project_document_acquisition_note", "project_description"))
    return out.select("doc_id", "field_key", "row_seq", F.trim(F.regexp_extract("text", r"(?s)^[A-Za-z ]+: (.*)$", 1)).alias("v"))


@query("fd18_address_score", r"""WITH n AS (SELECT s_suppkey AS id, upper(n_name) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT id, 1 AS kind, 'City of ' || v AS v FROM n UNION ALL SELECT id, 2, s_name || ', ' || v || ' AB ' || (10000 + id) FROM n JOIN supplier ON s_suppkey = id UNION ALL SELECT doc_id, 3, trim(split_part(text, chr(10), 1)) FROM documents),
b AS (SELECT *, regexp_matches(v, '(^|\W)\d{2,6}(\W|$)') AS st, contains(v, ',') AS cm, regexp_matches(v, '(^|\W)[A-Z]{2}\s+\d{5}(-\d{4})?(\W|$)') AS zip FROM a),
c AS (SELECT *, regexp_matches(v, '(?i)^\s*(in\s+the\s+city\s+of|city\s+of)(\W|$)') AND NOT cm AND NOT st AS bare FROM b)
SELECT id, kind, CASE WHEN v = '' OR bare THEN 0 ELSE st::INT * 2 + cm::INT + zip::INT END::BIGINT AS score, bare FROM c""")
def _(t):
    n = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.upper("n_name").alias("v"), "s_name")
    place = n.select("id", F.lit(1).alias("kind"), F.concat(F.lit("City of "), "v").alias("v"))
    full = n.select("id", F.lit(2).alias("kind"), F.concat("s_name", F.lit(", "), "v", F.lit(" AB "), (F.col("id") + 10000).cast("string")).alias("v"))
    lines = t.documents.select(F.col("doc_id").alias("id"), F.lit(3).alias("kind"), F.trim(F.split("text", "\n")[0]).alias("v"))
    a = place.unionByName(full).unionByName(lines)
    return a.select("id", "kind", FD.address_score("v").alias("score"), FD.is_bare_jurisdiction("v").alias("bare"))


@query("fd19_merge_locations", f"""WITH {WORDED_SQL}, l AS (SELECT doc_id, nv, k, max((citation_verified, confidence, -row_seq)) AS q, count(*) AS c FROM wv WHERE field_key = 'project_location' GROUP BY 1, 2, 3),
t AS (SELECT doc_id, sum(c) AS n, bool_or(k IN (1, 2)) AS scored, bool_or(k = 2) AS long FROM l GROUP BY 1),
s AS (SELECT l.*, n, CASE k WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 0 END AS a, n = 1 OR ((k <> 0 OR NOT scored) AND (k <> 1 OR NOT long)) AS keep FROM l JOIN t USING (doc_id))
SELECT doc_id, 'Project location: ' || string_agg(nv, '; ' ORDER BY a DESC, q DESC) AS text FROM s WHERE keep GROUP BY 1""")
def _(t):
    w = worded(t).withColumn("date_grounded", F.lit(None).cast("boolean"))
    return FD.merge_locations(w).where("field_key = 'project_location'").select("doc_id", F.regexp_replace("text", "^Project Location", "Project location").alias("text"))


@query("fd20_quality_key", f"WITH {SPEC_SQL} SELECT doc_id, row_seq, CAST(date_grounded AS BIGINT) AS g, CAST(citation_verified AS BIGINT) AS v, confidence AS c, CAST(1 AS BIGINT) AS s FROM spec")
def _(t):
    return spec(t).select("doc_id", "row_seq", FD.quality_key().alias("q")).select("doc_id", "row_seq", "q.g", "q.v", "q.c", "q.s")


SINGLE_SQL = "field_key IN (" + ", ".join("'" + k + "'" for k in FD.SINGLETON_KEYS) + ")"


@query("fd21_dedupe_rows", f"""WITH {SPEC_SQL} SELECT doc_id, bucket, field_key, row_seq FROM spec QUALIFY row_number() OVER (PARTITION BY doc_id, bucket, field_key, CASE WHEN {SINGLE_SQL} THEN '' WHEN bucket = 'project_dates' THEN lower(date) ELSE lower(text) END
  ORDER BY date_grounded DESC, citation_verified DESC, confidence DESC, row_seq) = 1""")
def _(t):
    return FD.dedupe_rows(spec(t)).select("doc_id", "bucket", "field_key", "row_seq")


@query("fd21_dedupe_warnings", f"""WITH {SPEC_SQL}, g AS (SELECT doc_id, bucket, field_key, count(*) AS n, count(DISTINCT CASE WHEN bucket = 'project_dates' THEN lower(date) ELSE lower(text) END) AS v FROM spec WHERE {SINGLE_SQL} GROUP BY 1, 2, 3)
SELECT doc_id, field_key, bucket, CASE WHEN v > 1 THEN 'warn' ELSE 'info' END AS level, CASE WHEN v > 1 THEN 'Conflicting ''' || field_key || ''' values (' || v || ' distinct); kept best citation.'
  ELSE 'Resolved ' || (n - 1) || ' duplicate ''' || field_key || ''' row(s); kept best citation.' END AS message, n - 1 AS dropped_count FROM g WHERE n > 1""")
def _(t):
    return FD.dedupe_warnings(spec(t))


FIELD_WARN_SQL = SPEC_SQL + """, fw AS (
SELECT doc_id, field_key, bucket, 'warn' AS level, 'Low confidence (' || confidence || '%) on ''' || text || '''.' AS message FROM spec WHERE confidence < 50
UNION ALL SELECT doc_id, field_key, bucket, 'info', 'Project start date uses default 30-day offset; project value not found.' FROM spec WHERE awaiting_value
UNION ALL SELECT DISTINCT doc_id, 'bid_deadline_date_time', 'project_dates', 'warn', 'Bid deadline not found in document.' FROM spec WHERE doc_id NOT IN (SELECT doc_id FROM spec WHERE field_key = 'bid_deadline_date_time'))"""


@query("fd22_field_warnings", f"WITH {FIELD_WARN_SQL} SELECT * FROM fw")
def _(t):
    return FD.field_warnings(spec(t)).drop("dropped_count")


@query("fd23_date_warnings", f"""WITH {SPEC_SQL}, d AS (SELECT doc_id, field_key, row_seq, CAST(date AS TIMESTAMP) + to_years(24) AS ts FROM spec WHERE bucket = 'project_dates'),
p AS (SELECT doc_id, arg_max(ts, row_seq) FILTER (WHERE field_key = 'question_deadline_date_time') AS q, arg_max(ts, row_seq) FILTER (WHERE field_key = 'bid_deadline_date_time') AS b, arg_max(ts, row_seq) FILTER (WHERE field_key = 'pre_bid_deadline_date_time') AS p,
  arg_max(ts, row_seq) FILTER (WHERE field_key = 'project_start_date_time') AS s, arg_max(ts, row_seq) FILTER (WHERE field_key = 'project_end_date_time') AS e FROM d WHERE year(ts) BETWEEN 2020 AND 2035 GROUP BY 1)
SELECT doc_id, field_key, 'Date year ' || year(ts) || ' out of expected range (2020–2035); likely misread.' AS message FROM d WHERE year(ts) NOT BETWEEN 2020 AND 2035
UNION ALL SELECT doc_id, 'question_deadline_date_time', 'Question deadline is after bid deadline — dates may be mislabeled.' FROM p WHERE q > b
UNION ALL SELECT doc_id, 'pre_bid_deadline_date_time', 'Pre-bid/site-visit date is after bid deadline — dates may be mislabeled.' FROM p WHERE p > b
UNION ALL SELECT doc_id, 'project_start_date_time', 'Project start date is after project end date — dates may be swapped.' FROM p WHERE s > e""")
def _(t):
    later = F.date_format(F.to_timestamp("date") + F.make_ym_interval(F.lit(24)), "yyyy-MM-dd'T'HH:mm:ss")
    return FD.date_warnings(spec(t).withColumn("date", F.when(F.col("date") != "", later).otherwise(""))).select("doc_id", "field_key", "message")


@query("fd24_merge_warnings", f"WITH {FIELD_WARN_SQL} SELECT DISTINCT doc_id, bucket, field_key, message, level FROM fw")
def _(t):
    w = FD.field_warnings(spec(t))
    return FD.merge_warnings(w.unionByName(w)).drop("dropped_count")


@query("fd25_field_confidence", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round_even(least(CASE WHEN l_linestatus = 'F' THEN 90 + 10 * c WHEN l_returnflag = 'R' THEN 30 + 25 * c ELSE least(30, 30 * c) END,
  CASE WHEN l_tax > 0.06 THEN 72 ELSE 100 END, CASE WHEN l_tax < 0.02 THEN 58 ELSE 100 END, CASE WHEN l_quantity > 40 THEN 95 ELSE 100 END), 0) AS BIGINT) AS confidence
FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 0.55 ELSE l_quantity / 32 END AS c FROM lineitem)""")
def _(t):
    c = F.when(F.col("l_quantity") > 25, F.lit(None).cast("double")).otherwise(F.col("l_quantity") / 32)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", FD.field_confidence(
        c, F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", F.col("l_tax") > 0.06, F.col("l_tax") < 0.02, F.col("l_quantity") > 40).alias("confidence"))


@query("fd26_infer_field_key", f"WITH {SPEC_SQL} SELECT doc_id, row_seq, CASE WHEN row_seq % 2 = 0 AND bucket = 'bond_items' THEN NULL ELSE field_key END AS field_key FROM spec")
def _(t):
    return FD.infer_field_key(spec(t).withColumn("field_key", F.when(F.col("row_seq") % 2 == 0, "").otherwise(F.col("field_key")))).select("doc_id", "row_seq", "field_key")


@query("fd27_sort_metadata", f"WITH {SPEC_SQL} SELECT doc_id, row_seq, coalesce(nullif(list_position({sql_list(FD.METADATA_ORDER)}, field_key), 0) - 1, 7)::BIGINT AS display_order FROM spec WHERE bucket = 'project_metadata_items'")
def _(t):
    return FD.sort_metadata(spec(t).where("bucket = 'project_metadata_items'")).select("doc_id", "row_seq", "display_order")


@query("fd27_display_value", f"WITH {SPEC_SQL} SELECT doc_id, row_seq, CASE WHEN row_seq % 2 = 0 AND contains(text, ': ') THEN substr(text, strpos(text, ': ') + 2) ELSE text END AS v FROM spec")
def _(t):
    label = F.when(F.col("row_seq") % 2 == 0, F.element_at(F.split("text", ": "), 1)).otherwise("Other")
    return spec(t).select("doc_id", "row_seq", FD.display_value("text", label).alias("v"))


@query("fd28_rebind_sources", f"""WITH {SPEC_SQL}, {SITEMS_SQL},
b AS (SELECT doc_id, lab, arg_max(src, (cv, conf, -item_seq)) AS src FROM si WHERE l_suppkey % 4 <> 0 AND (ends_with(lab, '_date_time') OR lab IN ({", ".join("'" + k + "'" for k in B.BOND_LABELS)})) GROUP BY 1, 2)
SELECT s.doc_id, row_seq, CASE WHEN coalesce(b.src, '') <> '' THEN b.src ELSE source_text END AS source_text FROM spec s LEFT JOIN b ON b.doc_id = s.doc_id AND b.lab = CASE field_key WHEN 'bid_open_date_time' THEN 'bid_deadline_date_time' ELSE field_key END""")
def _(t):
    return FD.rebind_sources(spec(t), spec_items(t)).select("doc_id", "row_seq", "source_text")


@query("fd29_finalize_rows")
def _(t):
    rows, _w = FD.finalize(FD.build_spec_rows(spec_items(t), 80, 400), FD.date_notes(spec_items(t)))
    return rows


@query("fd29_finalize_inferred")
def _(t):
    rows, _w = FD.finalize(worded(t), None, infer_dates=True)
    return rows


@query("fd29_finalize_warnings")
def _(t):
    _r, warnings = FD.finalize(worded(t), notes(t))
    return warnings


@query("fd30_repair_all")
def _(t):
    return FD.repair_all(worded(t))


