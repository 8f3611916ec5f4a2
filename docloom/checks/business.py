"""Users, documents, jobs, feedback and field rows derived from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.fixed import BOND_LABELS, DEADLINE_LABELS, FIELD_DEFS, FOCUSED_TYPES
from docloom.functions.text import literal_array

# key, bucket, label of every field the derived rows use
FIELDS = (
    list(FIELD_DEFS)
    + [(k, "project_dates", v) for k, v in DEADLINE_LABELS.items()]
    + [(k, "bond_items", v) for k, v in BOND_LABELS.items()]
)
KEYS = [f[0] for f in FIELDS]
ISSUES = ["wrong_value", "missing", "wrong_source", ""]
STATES = ["pending", "resolved", "recurred"]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index):
    return F.element_at(literal_array(values), (index + 1).cast("int"))


def docs(t):
    return t.orders.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("uploaded_by"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
        .when(F.col("o_orderkey") % 4 == 0, "queued").otherwise("parsing_processing").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
        F.concat(F.lit("REF-"), (F.col("o_custkey") % 97).cast("string")).alias("tender_reference"),
        F.col("o_orderpriority").alias("tender_title"),
        F.concat(F.lit("Version "), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("version_label"),
    )


DOCS_SQL = """
docs AS (SELECT o_orderkey AS doc_id, o_custkey AS uploaded_by,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 4 = 0 THEN 'queued' ELSE 'parsing_processing' END AS status,
  o_orderdate AS created_at, 'order_' || o_orderkey || '.pdf' AS filename, CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes,
  'REF-' || (o_custkey % 97) AS tender_reference, o_orderpriority AS tender_title, 'Version ' || (o_orderkey % 4 + 1) AS version_label FROM orders)"""


def users(t):
    return t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@Example.com")).alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "management").when(F.col("c_mktsegment") == "BUILDING", "").alias("role"),
    )


USERS_SQL = """
users AS (SELECT c_custkey AS user_id, c_name AS username, lower(c_name) || '@Example.com' AS email,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'management' WHEN 'BUILDING' THEN '' END AS role FROM customer)"""

def _seq():
    return (
        F.col("l_linenumber") * F.lit(10**13) + F.col("l_partkey") * F.lit(10**7) + F.col("l_suppkey") * 100
        + F.col("l_quantity").cast("int")
    )


_SEQ_SQL = "(l_linenumber * 10000000000000 + l_partkey * 10000000 + l_suppkey * 100 + CAST(l_quantity AS INTEGER))"


def insights(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("extraction_type")).agg(F.count("*").alias("n_items"))


def items(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), _seq().alias("item_seq"),
        F.when(F.col("l_suppkey") % 9 == 0, " ").otherwise(pick(KEYS, F.col("l_partkey") % len(KEYS))).alias("label"),
    )


ITEMS_SQL = f"""
bitems AS (SELECT l_orderkey AS doc_id, CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE {sql_list(KEYS)}[CAST(l_partkey % {len(KEYS)} + 1 AS INTEGER)] END AS label FROM lineitem)"""


def jobs(t):
    o = t.orders
    first = o.select(
        F.concat(F.lit("a-"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("parsing_processing").alias("current_stage"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("E"), (F.col("o_custkey") % 12).cast("string"))).otherwise("").alias("error_code"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 900 + 1).cast("decimal(18,6)"))).alias("completed_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("retry_count"),
    )
    again = t.lineitem.where("l_linenumber = 7").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("d")).select(
        F.concat(F.lit("b-"), F.col("l_orderkey").cast("string")).alias("job_id"), F.col("l_orderkey").alias("doc_id"),
        F.lit("failed").alias("current_stage"), F.lit("RETRY").alias("error_code"), F.col("d").alias("created_at"),
        F.col("d").alias("started_at"), F.lit(None).cast(dict(o.dtypes)["o_orderdate"]).alias("completed_at"), F.lit(1).alias("retry_count"),
    )
    return first.unionByName(again)


JOBS_SQL = """
jobs AS (SELECT 'a-' || o_orderkey AS job_id, o_orderkey AS doc_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'parsing_processing' END AS current_stage,
  CASE WHEN o_orderstatus = 'P' THEN 'E' || (o_custkey % 12) ELSE '' END AS error_code, o_orderdate AS created_at, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(CAST(o_orderkey % 900 + 1 AS INTEGER)) END AS completed_at, o_orderkey % 4 AS retry_count FROM orders
  UNION ALL SELECT 'b-' || l_orderkey, l_orderkey, 'failed', 'RETRY', max(l_shipdate), max(l_shipdate), NULL, 1 FROM lineitem WHERE l_linenumber = 7 GROUP BY l_orderkey)"""


def feedback(t):
    l = t.lineitem
    s = lambda c: F.col(c).cast("string")
    return l.where("l_returnflag in ('R', 'A')").select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("feedback_id"),
        F.col("l_orderkey").alias("doc_id"), pick(KEYS, F.col("l_partkey") % len(KEYS)).alias("field_key"),
        pick(FOCUSED_TYPES, F.col("l_partkey") % 8).alias("extraction_type"),
        F.when(F.col("l_returnflag") == "R", "down").otherwise("up").alias("rating"),
        pick(ISSUES, F.col("l_suppkey") % 4).alias("issue_type"),
        F.concat(F.lit("value "), s("l_partkey")).alias("extracted_value"),
        F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("value "), s("l_suppkey"), F.lit(" of "), s("l_partkey"))).alias("correct_value"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("note "), s("l_linenumber"))).otherwise("").alias("comment"),
        F.concat(F.lit("Line "), s("l_linenumber"), F.lit(" of order "), s("l_orderkey")).alias("source_text_context"),
        (F.col("l_linestatus") == "F").alias("used_in_finetune"),
        pick(STATES, F.col("l_linenumber") % 3).alias("resolution_status"), F.lit(0).alias("recheck_count"),
        F.col("l_shipdate").alias("created_at"),
    )


FEEDBACK_SQL = f"""
fb AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS feedback_id, l_orderkey AS doc_id,
  {sql_list(KEYS)}[CAST(l_partkey % {len(KEYS)} + 1 AS INTEGER)] AS field_key, {sql_list(FOCUSED_TYPES)}[CAST(l_partkey % 8 + 1 AS INTEGER)] AS extraction_type,
  CASE l_returnflag WHEN 'R' THEN 'down' ELSE 'up' END AS rating, {sql_list(ISSUES)}[CAST(l_suppkey % 4 + 1 AS INTEGER)] AS issue_type,
  'value ' || l_partkey AS extracted_value, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'value ' || l_suppkey || ' of ' || l_partkey END AS correct_value,
  CASE WHEN l_linenumber % 2 = 0 THEN 'note ' || l_linenumber ELSE '' END AS comment, 'Line ' || l_linenumber || ' of order ' || l_orderkey AS source_text_context,
  l_linestatus = 'F' AS used_in_finetune, {sql_list(STATES)}[CAST(l_linenumber % 3 + 1 AS INTEGER)] AS resolution_status, 0 AS recheck_count, l_shipdate AS created_at
  FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""


def spec(t):
    """Field rows of an order's document, one per line item."""
    k = (F.col("l_partkey") % len(KEYS)).cast("int")
    deadline = pick(KEYS, k).endswith("_date_time")
    value = F.concat(F.lit("value "), (F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(" of the works")).otherwise(""))
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), pick([f[1] for f in FIELDS], k).alias("bucket"), _seq().alias("row_seq"), pick(KEYS, k).alias("field_key"),
        F.when(deadline, pick([f[2] for f in FIELDS], k)).otherwise(F.concat(pick([f[2] for f in FIELDS], k), F.lit(": "), value)).alias("text"),
        F.when(deadline, F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T10:00:00"))).otherwise("").alias("date"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("confidence"), (F.col("l_returnflag") != "N").alias("date_grounded"),
        (F.col("l_tax") > 0.07).alias("calculated"), (F.col("l_quantity") == 49).alias("awaiting_value"),
        (F.col("l_quantity") == 50).alias("not_found"),
        F.when(F.col("l_quantity") < 5, F.concat(F.lit("note "), F.col("l_suppkey").cast("string"))).otherwise("").alias("note"),
        (F.col("l_linestatus") == "F").alias("citation_verified"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" says "), value).alias("source_text"),
        (F.col("l_linenumber") + 0).cast("int").alias("page"),
    )


_VALUE_SQL = "'value ' || (l_partkey % 7) || CASE WHEN l_suppkey % 5 = 0 THEN ' of the works' ELSE '' END"
SPEC_SQL = f"""
spec AS (SELECT l_orderkey AS doc_id, {sql_list([f[1] for f in FIELDS])}[k] AS bucket, {_SEQ_SQL} AS row_seq, {sql_list(KEYS)}[k] AS field_key,
  CASE WHEN {sql_list(KEYS)}[k] LIKE '%\\_date\\_time' ESCAPE '\\' THEN {sql_list([f[2] for f in FIELDS])}[k] ELSE {sql_list([f[2] for f in FIELDS])}[k] || ': ' || {_VALUE_SQL} END AS text,
  CASE WHEN {sql_list(KEYS)}[k] LIKE '%\\_date\\_time' ESCAPE '\\' THEN strftime(l_shipdate, '%Y-%m-%d') || 'T10:00:00' ELSE '' END AS date,
  CAST(round(l_discount * 1000) AS BIGINT) AS confidence, l_returnflag <> 'N' AS date_grounded, l_tax > 0.07 AS calculated, l_quantity = 49 AS awaiting_value,
  l_quantity = 50 AS not_found, CASE WHEN l_quantity < 5 THEN 'note ' || l_suppkey ELSE '' END AS note, l_linestatus = 'F' AS citation_verified,
  'Line ' || l_linenumber || ' says ' || {_VALUE_SQL} AS source_text, l_linenumber AS page
  FROM (SELECT *, CAST(l_partkey % {len(KEYS)} + 1 AS INTEGER) AS k FROM lineitem))"""
