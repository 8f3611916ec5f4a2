"""Intake, listings, feedback loop and team analytics."""

from pyspark.sql import functions as F

from docloom.checks import business as B
from docloom.checks.business import DOCS_SQL, FEEDBACK_SQL, ITEMS_SQL, JOBS_SQL, SPEC_SQL, USERS_SQL, sql_list
from docloom.checks.limits import L as LIM
from docloom.checks.registry import query
from docloom.fixed import ACTIVE_STAGES, CANONICAL_FIELDS, DISPLAY_LABELS, EVENT_FIELDS
from docloom.operators import analytics as A
from docloom.operators import feedback as FB
from docloom.operators import intake as I

SINCE = "1997-01-01 00:00:00"


@query("src3_sanitize_filename", """SELECT page_id, coalesce(nullif(substr(regexp_replace(list_last(regexp_split_to_array(url, '[/\\\\]')), '[^A-Za-z0-9_.\\-]', '_', 'g'), 1, 255), ''), 'document') AS name FROM pages""")
def _(t):
    return t.pages.select("page_id", I.sanitize_filename("url", LIM.filename_chars).alias("name"))


@query("cor1_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(t):
    return I.with_checksum(t.documents, "text").select("doc_id", "checksum")


@query("cor2_exact_duplicates", """
WITH c AS (SELECT d.doc_id, sha256(text) AS checksum, l.doc_id IS NOT NULL AS stored FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT checksum, max(doc_id) AS sid FROM c WHERE stored GROUP BY 1), f AS (SELECT checksum, min(doc_id) AS fid FROM c WHERE NOT stored GROUP BY 1)
SELECT doc_id AS upload_id, checksum, CASE WHEN sid IS NOT NULL THEN 'duplicate_of_stored' WHEN fid < doc_id THEN 'duplicate_in_batch' ELSE 'new' END AS verdict,
  CASE WHEN sid IS NOT NULL THEN sid WHEN fid < doc_id THEN fid END AS duplicate_of
FROM c LEFT JOIN s USING (checksum) JOIN f USING (checksum) WHERE NOT stored""")
def _(t):
    c = I.with_checksum(t.documents, "text").select("doc_id", "checksum")
    stored = c.join(t.labels, "doc_id", "left_semi").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    new = c.join(t.labels, "doc_id", "left_anti").select(F.col("doc_id").alias("upload_id"), "checksum")
    return I.flag_exact_duplicates(new, stored)


@query("cor3_normalize_reference", "SELECT s_suppkey, substr(regexp_replace(upper(trim('  ref ' || s_name || '  no ' || s_nationkey || ' ')), '\\s+', '-', 'g'), 1, 128) AS ref FROM supplier")
def _(t):
    raw = F.concat(F.lit("  ref "), "s_name", F.lit("  no "), F.col("s_nationkey").cast("string"), F.lit(" "))
    return t.supplier.select("s_suppkey", I.normalize_reference(raw, LIM.reference_chars).alias("ref"))


def uploads(t):
    return t.orders.select(
        F.col("o_orderkey").alias("upload_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.concat(F.lit(" ref  "), F.col("o_custkey").cast("string"))).alias("reference"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("title"))


def tenders(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("REF-"), F.col("c_custkey").cast("string")).alias("reference_code"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("tender_id"),
        F.col("c_name").alias("title"))


@query("cor4_resolve_tenders", """
WITH u AS (SELECT o_orderkey AS upload_id, CASE WHEN o_orderstatus = 'P' THEN 'AUTO-' || upper(substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 10)) ELSE 'REF-' || o_custkey END AS reference_code,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS title FROM orders),
t AS (SELECT 'REF-' || c_custkey AS reference_code, 'T' || c_custkey AS known_id, c_name AS known_title FROM customer WHERE c_mktsegment = 'BUILDING'),
f AS (SELECT DISTINCT ON (reference_code) reference_code, title AS first_title FROM u ORDER BY reference_code, upload_id)
SELECT u.upload_id, u.reference_code, coalesce(known_id, substr(sha256(u.reference_code), 1, 16)) AS tender_id,
  CASE WHEN known_id IS NOT NULL THEN known_title ELSE coalesce(first_title, u.reference_code) END AS tender_title, known_id IS NULL AS created
FROM u JOIN f USING (reference_code) LEFT JOIN t USING (reference_code)""")
def _(t):
    return I.resolve_tenders(uploads(t), tenders(t), LIM.reference_chars)


VTYPES = ["original", "revision", "corrigendum", "addendum", "clarification", "annexure", "other"]


def version_uploads(t):
    return t.orders.where("o_orderstatus <> 'F'").select(
        (F.col("o_custkey") % 97).alias("tender_id"), F.col("o_orderkey").alias("doc_id"), B.pick(VTYPES, F.col("o_orderkey") % 7).alias("version_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Rush").otherwise("").alias("label"), F.col("o_orderdate").alias("arrived_at"))


def versions(t):
    """Stored versions: the finished orders, numbered per tender in key order."""
    from pyspark.sql import Window
    w = Window.partitionBy("tender_id").orderBy("doc_id")
    base = t.orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 101).alias("tender_id"), F.col("o_orderkey").alias("doc_id"))
    n = F.count("*").over(Window.partitionBy("tender_id"))
    return base.withColumn("version_sequence", F.row_number().over(w)).withColumn("is_current", F.col("version_sequence") == n).select(
        "tender_id", "doc_id", F.lit("original").alias("version_type"), "version_sequence",
        F.concat(F.lit("Version "), F.col("version_sequence").cast("string")).alias("version_label"), "is_current")


VERSIONS_SQL = """
versions AS (SELECT o_custkey % 101 AS tender_id, o_orderkey AS doc_id, 'original' AS version_type,
  row_number() OVER (PARTITION BY o_custkey % 101 ORDER BY o_orderkey) AS version_sequence,
  'Version ' || row_number() OVER (PARTITION BY o_custkey % 101 ORDER BY o_orderkey) AS version_label,
  row_number() OVER (PARTITION BY o_custkey % 101 ORDER BY o_orderkey DESC) = 1 AS is_current FROM orders WHERE o_orderstatus = 'F')"""


@query("cor5_attach_versions", f"""
WITH {VERSIONS_SQL},
up AS (SELECT o_custkey % 97 AS tender_id, o_orderkey AS doc_id, {sql_list(VTYPES)}[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS version_type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Rush' ELSE '' END AS label, o_orderdate AS arr FROM orders WHERE o_orderstatus <> 'F'),
top AS (SELECT tender_id, max(version_sequence) AS m FROM versions GROUP BY 1),
r AS (SELECT up.*, coalesce(m, 0) + row_number() OVER (PARTITION BY up.tender_id ORDER BY arr, doc_id) AS s,
  row_number() OVER (PARTITION BY up.tender_id ORDER BY arr DESC, doc_id DESC) = 1 AS cur FROM up LEFT JOIN top ON top.tender_id = up.tender_id)
SELECT tender_id, doc_id, version_type, version_sequence, version_label, is_current AND tender_id NOT IN (SELECT tender_id FROM up) AS is_current FROM versions
UNION ALL SELECT tender_id, doc_id, version_type, s, CASE WHEN label <> '' THEN label ELSE CASE version_type WHEN 'original' THEN 'Version ' || s WHEN 'revision' THEN 'Revision ' || s
  WHEN 'corrigendum' THEN 'Corrigendum ' || CASE WHEN s <= 26 THEN chr(CAST(64 + s AS INTEGER)) ELSE CAST(s AS VARCHAR) END WHEN 'addendum' THEN 'Addendum ' || s
  WHEN 'clarification' THEN 'Clarification ' || s WHEN 'annexure' THEN 'Annexure ' || s ELSE 'Document ' || s END END, cur FROM r""")
def _(t):
    return I.attach_versions(version_uploads(t), versions(t))


@query("cor6_tender_summary", f"""WITH {VERSIONS_SQL}, ten AS (SELECT DISTINCT c_custkey % 120 AS tender_id FROM customer)
SELECT ten.tender_id, count(v.doc_id) AS version_count, max(version_label) FILTER (WHERE is_current) AS current_version
FROM ten LEFT JOIN versions v USING (tender_id) GROUP BY 1""")
def _(t):
    return I.tender_summary(t.customer.select((F.col("c_custkey") % 120).alias("tender_id")).distinct(), versions(t))


@query("cor7_delete_documents", f"""WITH {VERSIONS_SQL}, gone AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')),
kept AS (SELECT * FROM versions WHERE doc_id NOT IN (SELECT doc_id FROM gone))
SELECT 'versions' AS part, tender_id, doc_id FROM kept
UNION ALL SELECT 'tenders', tender_id, NULL FROM (SELECT DISTINCT c_custkey % 120 AS tender_id FROM customer) WHERE tender_id IN (SELECT tender_id FROM kept)
  OR tender_id NOT IN (SELECT tender_id FROM versions WHERE doc_id IN (SELECT doc_id FROM gone))
UNION ALL SELECT 'items', NULL, l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM gone)""")
def _(t):
    ids = t.orders.where("o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')").select(F.col("o_orderkey").alias("doc_id"))
    ten = t.customer.select((F.col("c_custkey") % 120).alias("tender_id")).distinct()
    out = I.delete_documents(ids, {"items": B.items(t)}, ten, versions(t))
    none = F.lit(None).cast("bigint")
    return (
        out["versions"].select(F.lit("versions").alias("part"), "tender_id", "doc_id")
        .unionByName(out["tenders"].select(F.lit("tenders").alias("part"), "tender_id", none.alias("doc_id")))
        .unionByName(out["items"].select(F.lit("items").alias("part"), none.alias("tender_id"), "doc_id")))


@query("cor8_resolve_roles", f"""WITH {USERS_SQL} SELECT user_id, CASE WHEN lower(email) = 'customer#000000007@example.com' THEN 'admin' ELSE coalesce(nullif(role, ''), 'user') END AS resolved_role FROM users""")
def _(t):
    return I.resolve_roles(B.users(t), "customer#000000007@example.com").select("user_id", "resolved_role")


@query("cor9_visible_documents", f"WITH {DOCS_SQL} SELECT doc_id, status FROM docs WHERE uploaded_by = 7")
def _(t):
    return I.visible_documents(B.docs(t), 7, False).select("doc_id", "status")


@query("cor9_visible_tenders", f"WITH {DOCS_SQL}, {VERSIONS_SQL} SELECT DISTINCT tender_id FROM versions WHERE doc_id IN (SELECT doc_id FROM docs WHERE uploaded_by = 7)")
def _(t):
    v = versions(t)
    return I.visible_tenders(v.select("tender_id").distinct(), v, B.docs(t), 7, False)


@query("cor10_backfill_owner", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey END AS uploaded_by FROM orders")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("uploaded_by"))
    return I.backfill_owner(d, 1)


@query("cor11_list_documents", f"""WITH {DOCS_SQL} SELECT doc_id, filename, created_at FROM docs WHERE status IN ('queued', {", ".join("'" + s + "'" for s in ACTIVE_STAGES)})
  AND (contains(lower(filename), '12') OR contains(lower(tender_title), '12') OR contains(lower(tender_reference), '12') OR contains(lower(version_label), '12'))
  ORDER BY created_at DESC, doc_id DESC LIMIT 25 OFFSET 25""")
def _(t):
    return I.list_documents(B.docs(t), "processing", " 12 ", page=2).select("doc_id", "filename", "created_at")


@query("cor12_dashboard_stats", f"""WITH {DOCS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status IN ('queued', 'parsing_processing')) AS processing, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(DISTINCT tender_reference) AS tenders, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM docs""")
def _(t):
    return I.dashboard_stats(B.docs(t))


SSTATES = ["completed", "processing", "failed", "pending"]


def summaries(t):
    return t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version")).agg(F.max("l_partkey").alias("p")).select(
        "doc_id", "version", B.pick(SSTATES, F.col("p") % 4).alias("status"), (F.col("p") % 3 == 0).alias("is_current"))


SUMMARIES_SQL = f"""
summ AS (SELECT l_orderkey AS doc_id, l_linenumber AS version, {sql_list(SSTATES)}[CAST(max(l_partkey) % 4 + 1 AS INTEGER)] AS status, max(l_partkey) % 3 = 0 AS is_current
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"""


@query("cor13_progress_phase", f"""WITH {DOCS_SQL}, {SUMMARIES_SQL},
cur AS (SELECT DISTINCT ON (doc_id) doc_id, status AS ss FROM summ WHERE is_current ORDER BY doc_id, version DESC)
SELECT doc_id, status, ss AS summary_status, CASE WHEN status = 'failed' OR coalesce(ss, '') = 'failed' THEN 'failed' WHEN status = 'completed' AND coalesce(ss, '') = 'completed' THEN 'ready'
  WHEN coalesce(ss, '') = 'processing' OR status = 'completed' THEN 'analyzing' ELSE 'reading' END AS phase,
  CASE WHEN status = 'completed' AND coalesce(ss, '') <> 'completed' THEN 'parsing_completed' ELSE status END AS progress_stage
FROM docs LEFT JOIN cur USING (doc_id)""")
def _(t):
    return I.progress_phase(B.docs(t), summaries(t))


@query("cor14_next_summary_version", f"""WITH {SUMMARIES_SQL} SELECT doc_id, CAST(version AS BIGINT) AS version, status, false AS is_current FROM summ
UNION ALL SELECT doc_id, max(version) + 1, 'processing', true FROM summ GROUP BY 1""")
def _(t):
    return I.next_summary_version(summaries(t))


@query("cor14_current_insights", f"""WITH {SUMMARIES_SQL}, ins AS (SELECT l_orderkey AS doc_id, l_linenumber AS summary_version, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT doc_id, CAST(summary_version AS BIGINT) AS summary_version, n FROM ins WHERE (doc_id, summary_version) IN (SELECT doc_id, version FROM summ WHERE is_current)""")
def _(t):
    ins = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("summary_version")).agg(F.count("*").alias("n"))
    return I.current_insights(ins, summaries(t))


@query("cor15_latest_job", f"WITH {JOBS_SQL} SELECT doc_id, job_id, current_stage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1")
def _(t):
    return I.latest_job(B.jobs(t)).select("doc_id", "job_id", "current_stage")


@query("cor16_plan_restart", f"""WITH {DOCS_SQL}, done AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_returnflag = 'R')
SELECT doc_id, status, CASE WHEN status = 'failed' THEN 'restart' WHEN status = 'queued' THEN 'start' ELSE 'reject' END AS action,
  CASE WHEN status = 'failed' AND doc_id IN (SELECT doc_id FROM done) THEN 'chunking' WHEN status IN ('failed', 'queued') THEN 'intake' END AS restart_stage FROM docs""")
def _(t):
    parsed = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "completed").otherwise("failed").alias("parsing_status"))
    return I.plan_restart(B.docs(t), parsed)


# ---- feedback loop

@query("fb1_ingest_feedback", """SELECT doc_id, conv, lower(trim(role2)) AS rating, substr(text, 1, 2000) AS extracted_value, substr(text, 1, 1000) AS comment, length(substr(text, 1, 4000)) AS n FROM (
  SELECT conv_id AS doc_id, turn AS conv, CASE role WHEN 'user' THEN ' UP ' WHEN 'assistant' THEN 'down' ELSE role END AS role2, text FROM conversations) WHERE lower(trim(role2)) IN ('up', 'down')""")
def _(t):
    raw = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("conv"), F.when(F.col("role") == "user", " UP ").when(F.col("role") == "assistant", "down").otherwise(F.col("role")).alias("rating"),
        F.lit("k").alias("field_key"), F.lit("t").alias("extraction_type"), F.col("text").alias("extracted_value"), F.col("text").alias("correct_value"), F.col("text").alias("comment"), F.col("text").alias("source_text_context"))
    return FB.ingest_feedback(raw, LIM).select("doc_id", "conv", "rating", "extracted_value", "comment", F.length("source_text_context").alias("n"))


def lexicon(t):
    return t.part.select(
        B.pick(B.FOCUSED_TYPES, F.col("p_partkey") % 8).alias("extraction_type"), F.when(F.col("p_size") % 2 == 0, "query").otherwise("term").alias("entry_kind"),
        F.concat(F.lit("value "), F.col("p_partkey").cast("string")).alias("term_normalized"), F.concat(F.lit("Value "), F.col("p_partkey").cast("string")).alias("term_display"),
        F.col("p_size").alias("hit_count"), F.lit(1).alias("document_count"), (F.col("p_size") % 3 != 0).alias("is_active"))


LEXICON_SQL = f"""
lex AS (SELECT {sql_list(B.FOCUSED_TYPES)}[CAST(p_partkey % 8 + 1 AS INTEGER)] AS extraction_type, CASE WHEN p_size % 2 = 0 THEN 'query' ELSE 'term' END AS entry_kind,
  'value ' || p_partkey AS term_normalized, 'Value ' || p_partkey AS term_display, p_size AS hit_count, 1 AS document_count, p_size % 3 <> 0 AS is_active FROM part)"""


@query("fb2_lexicon_from_feedback", f"""WITH {FEEDBACK_SQL}, {LEXICON_SQL},
c AS (SELECT extraction_type, created_at, feedback_id, 0 AS slot, field_key || ': ' || substr(correct_value, 1, 120) AS term FROM fb WHERE rating = 'down' AND length(correct_value) >= 2
  UNION ALL SELECT extraction_type, created_at, feedback_id, 1, substr(correct_value, 1, 128) FROM fb WHERE rating = 'down' AND length(correct_value) >= 4
  UNION ALL SELECT extraction_type, created_at, feedback_id, 2, substr(source_text_context, 1, 80) FROM fb WHERE rating = 'down' AND length(source_text_context) >= 20),
n AS (SELECT extraction_type, lower(term) AS term_normalized, count(*) AS hits, arg_min(term, (created_at, feedback_id, slot)) AS d FROM c GROUP BY 1, 2),
q AS (SELECT * FROM lex WHERE entry_kind = 'query')
SELECT coalesce(q.extraction_type, n.extraction_type) AS extraction_type, coalesce(q.term_normalized, n.term_normalized) AS term_normalized, coalesce(term_display, d) AS term_display,
  coalesce(hit_count, 0) + coalesce(hits, 0) AS hit_count, hits IS NOT NULL OR coalesce(is_active, false) AS is_active
FROM q FULL JOIN n ON q.extraction_type = n.extraction_type AND q.term_normalized = n.term_normalized""")
def _(t):
    return FB.lexicon_from_feedback(B.feedback(t), lexicon(t), LIM)


@query("fb3_boost_terms", f"""WITH {FEEDBACK_SQL}, {LEXICON_SQL}, u AS (SELECT extraction_type, count(*) AS ups FROM fb WHERE rating = 'up' GROUP BY 1)
SELECT extraction_type, entry_kind, term_normalized, hit_count + CASE WHEN is_active THEN coalesce(ups, 0) ELSE 0 END AS hit_count FROM lex LEFT JOIN u USING (extraction_type)""")
def _(t):
    return FB.boost_terms(lexicon(t), B.feedback(t)).select("extraction_type", "entry_kind", "term_normalized", "hit_count")


BSTATES = ["succeeded", "running", "failed", "pending", "cancelled"]


def batches(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("batch_id"), B.pick(B.FOCUSED_TYPES, F.col("s_suppkey") % 5).alias("extraction_type"), B.pick(BSTATES, F.col("s_nationkey") % 5).alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_nationkey")).alias("created_at"))


BATCHES_SQL = f"""
batches AS (SELECT s_suppkey AS batch_id, {sql_list(B.FOCUSED_TYPES)}[CAST(s_suppkey % 5 + 1 AS INTEGER)] AS extraction_type, {sql_list(BSTATES)}[CAST(s_nationkey % 5 + 1 AS INTEGER)] AS status,
  DATE '2024-01-01' + s_nationkey AS created_at FROM supplier)"""
USABLE_SQL = "rating = 'down' AND correct_value <> '' AND NOT used_in_finetune"


@query("fb4_finetune_ready", f"""WITH {FEEDBACK_SQL}, {BATCHES_SQL} SELECT extraction_type, count(*) AS corrections FROM fb WHERE {USABLE_SQL}
  AND extraction_type NOT IN (SELECT extraction_type FROM batches WHERE status IN ('pending', 'uploading', 'running')) GROUP BY 1 HAVING count(*) >= 50""")
def _(t):
    return FB.finetune_ready(B.feedback(t), batches(t))


LINE_SQL = """'{"messages":[{"role":"system","content":"' || 'You are a procurement document extraction specialist. Given the following document excerpt, extract the ''' || field_key || ''' field accurately. Return a JSON object with a single key ''value'' containing the extracted text. If not found, return {\\"value\\": null}.'
  || '"},{"role":"user","content":"Document excerpt:\\n\\n' || source_text_context || '"},{"role":"assistant","content":"{\\"value\\":\\"' || correct_value || '\\"}"}]}'"""


@query("fb5_training_set", f"WITH {FEEDBACK_SQL} SELECT extraction_type, created_at, feedback_id, {LINE_SQL} AS line FROM fb WHERE {USABLE_SQL}")
def _(t):
    return FB.build_training_set(B.feedback(t))


@query("fb5_training_cost", f"""WITH {FEEDBACK_SQL}, x AS (SELECT extraction_type, count(*) AS examples, sum(length({LINE_SQL})) // 4 * 3 AS tk FROM fb WHERE {USABLE_SQL} GROUP BY 1)
SELECT extraction_type, examples, CAST(tk AS BIGINT) AS tokens, tk / 1000000 * 3.0 AS cost_usd, CASE WHEN tk / 1000000 * 3.0 > 5 THEN 'aborted' ELSE 'ready' END AS status FROM x""")
def _(t):
    return FB.training_cost(FB.build_training_set(B.feedback(t)))


@query("fb5_mark_used", f"""WITH {FEEDBACK_SQL}, {BATCHES_SQL} SELECT feedback_id, field_key, used_in_finetune OR (rating = 'down' AND correct_value <> '' AND extraction_type IN (SELECT extraction_type FROM batches WHERE status = 'running')) AS used_in_finetune FROM fb""")
def _(t):
    return FB.mark_used(B.feedback(t), batches(t).where("status = 'running'")).select("feedback_id", "field_key", "used_in_finetune")


GROUPS = {"identity": ["project_name", "project_owner", "project_solicitation_number"], "dates": ["bid_deadline_date_time", "bid_open_date_time", "site_visit_date_time"], "bonds": list(B.BOND_LABELS)}
_IN = {g: "(" + ", ".join("'" + k + "'" for k in ks) + ")" for g, ks in GROUPS.items()}


@query("fb6_feedback_hints", f"""WITH {FEEDBACK_SQL},
g AS ({" UNION ALL ".join(f"SELECT '{g}' AS grp, * FROM fb WHERE rating = 'down' AND field_key IN {x}" for g, x in _IN.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY created_at DESC, feedback_id DESC) AS rn FROM g QUALIFY rn <= 100),
h AS (SELECT *, CASE WHEN issue_type = 'wrong_value' AND correct_value <> '' THEN field_key || ': do NOT extract "' || extracted_value || '" — correct value is "' || correct_value || '"'
   WHEN issue_type = 'missing' THEN field_key || ': often missed — search cover page, timeline tables, and administrative sections carefully'
   WHEN issue_type = 'wrong_source' THEN field_key || ': citation must be verbatim from the document section where the value actually appears'
   WHEN comment <> '' THEN field_key || ': ' || comment WHEN correct_value <> '' THEN field_key || ': expected "' || correct_value || '"'
   ELSE field_key || ': avoid repeating "' || extracted_value || '"' END AS hint FROM r),
d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY grp, field_key, issue_type, extracted_value ORDER BY rn) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rn) AS o FROM d)
SELECT grp AS "group", chr(10) || chr(10) || 'Lessons from prior user corrections (do NOT repeat these mistakes):' || chr(10) || string_agg('- ' || hint, chr(10) ORDER BY o) || chr(10) AS hints FROM k WHERE o <= 8 GROUP BY 1""")
def _(t):
    return FB.feedback_hints(B.feedback(t), GROUPS, LIM)


VALUES_SQL = SPEC_SQL + """,
vr AS (SELECT doc_id, field_key, row_seq, note, CASE WHEN date <> '' THEN date ELSE CASE WHEN contains(text, ': ') THEN substr(text, strpos(text, ': ') + 2) ELSE text END END AS v FROM spec WHERE NOT not_found),
vals AS (SELECT doc_id, field_key, arg_max(v, (length(v), -row_seq)) AS value FROM vr WHERE v <> '' GROUP BY 1, 2
  UNION ALL SELECT doc_id, field_key || '_events', arg_max(note, row_seq) FROM vr WHERE note <> '' GROUP BY 1, 2)"""


@query("fb7_current_values", f"WITH {VALUES_SQL} SELECT * FROM vals")
def _(t):
    return FB.current_values(B.spec(t))


@query("fb8_values_match", f"""WITH {FEEDBACK_SQL} SELECT feedback_id, comment <> '' AND contains(lower(source_text_context), 'order ' || right(comment, 1)) OR (comment <> '' AND contains(lower(comment), lower(source_text_context))) AS m FROM fb WHERE comment <> ''""".replace("contains(lower(source_text_context), 'order ' || right(comment, 1))", "contains(lower(source_text_context), 'order ' || substr(comment, 6))"))
def _(t):
    return B.feedback(t).where("comment <> ''").select("feedback_id", FB.values_match(
        F.concat(F.lit("  ORDER  "), F.substring("comment", 6, 9)), "source_text_context").alias("m"))


@query("fb9_recheck", f"""WITH {FEEDBACK_SQL}, {VALUES_SQL},
j AS (SELECT fb.*, coalesce(value, '') AS nv FROM fb LEFT JOIN vals USING (doc_id, field_key) WHERE rating = 'down'),
o AS (SELECT *, CASE WHEN correct_value <> '' THEN CASE WHEN nv <> '' AND (contains(lower(nv), lower(correct_value)) OR contains(lower(correct_value), lower(nv))) THEN 'resolved' ELSE 'recurred' END
  WHEN issue_type = 'missing' THEN CASE WHEN nv <> '' THEN 'resolved' ELSE 'recurred' END
  WHEN nv <> '' THEN CASE WHEN NOT (contains(lower(nv), lower(extracted_value)) OR contains(lower(extracted_value), lower(nv))) THEN 'resolved' ELSE 'recurred' END ELSE 'unchecked' END AS outcome FROM j)
SELECT feedback_id, field_key, outcome, CASE WHEN outcome = 'unchecked' THEN resolution_status ELSE outcome END AS resolution_status, CAST(CASE WHEN outcome = 'unchecked' THEN 0 ELSE 1 END AS BIGINT) AS recheck_count FROM o""")
def _(t):
    return FB.recheck(B.feedback(t), FB.current_values(B.spec(t))).select("feedback_id", "field_key", "outcome", "resolution_status", "recheck_count")


@query("fb10_learning_effectiveness", f"""WITH {FEEDBACK_SQL},
p AS (SELECT field_key, count(*) AS corrections, count(*) FILTER (WHERE resolution_status = 'resolved') AS resolved, count(*) FILTER (WHERE resolution_status = 'recurred') AS recurred,
  count(*) FILTER (WHERE resolution_status = 'pending') AS pending FROM fb WHERE rating = 'down' GROUP BY 1 ORDER BY corrections DESC, field_key LIMIT 20)
SELECT * FROM p UNION ALL SELECT '*', CAST(sum(corrections) AS BIGINT), CAST(sum(resolved) AS BIGINT), CAST(sum(recurred) AS BIGINT), CAST(sum(pending) AS BIGINT) FROM p""")
def _(t):
    return FB.learning_effectiveness(B.feedback(t), 20)


@query("fb11_feedback_stats", f"""WITH {FEEDBACK_SQL}, a AS (SELECT coalesce(extraction_type, '*') AS extraction_type, count(*) AS total, count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down,
  count(*) FILTER (WHERE rating = 'down' AND correct_value <> '') AS with_correction, count(*) FILTER (WHERE used_in_finetune) AS used_in_finetune FROM fb GROUP BY ROLLUP (fb.extraction_type))
SELECT *, least(100, CAST(floor(with_correction * 100 / 50 + 0.5) AS BIGINT)) AS progress_pct FROM a""")
def _(t):
    return FB.feedback_stats(B.feedback(t))


@query("fb11_active_batches", f"WITH {BATCHES_SQL} SELECT batch_id, extraction_type, status FROM batches WHERE status NOT IN ('succeeded', 'failed', 'cancelled') ORDER BY created_at DESC, batch_id LIMIT 5")
def _(t):
    return FB.active_batches(batches(t), 5).select("batch_id", "extraction_type", "status")


@query("fb12_list_feedback", f"""WITH {FEEDBACK_SQL}, {DOCS_SQL}, p AS (SELECT * FROM fb WHERE rating = 'down' AND extraction_type = 'payment_terms' ORDER BY created_at DESC, feedback_id DESC LIMIT 50 OFFSET 50)
SELECT feedback_id, doc_id, field_key, substr(source_text_context, 1, 200) AS source_text_context, coalesce(filename, '') AS document_filename FROM p LEFT JOIN docs USING (doc_id)""")
def _(t):
    return FB.list_feedback(B.feedback(t), B.docs(t), "payment_terms", "down", page=2, size=50, limits=LIM).select("feedback_id", "doc_id", "field_key", "source_text_context", "document_filename")


# ---- analytics

INSIGHTS_SQL = f"""{USERS_SQL}, {DOCS_SQL}, {FEEDBACK_SQL}, {JOBS_SQL},
d AS (SELECT * FROM docs WHERE created_at >= TIMESTAMP '{SINCE}'),
it AS (SELECT l_orderkey AS doc_id, count(*) AS items FROM lineitem GROUP BY 1),
vo AS (SELECT doc_id, count(*) FILTER (WHERE rating = 'down') AS downs, count(*) FILTER (WHERE rating = 'up') AS ups FROM fb GROUP BY 1),
jo AS (SELECT doc_id, count(*) AS jobs, sum(date_diff('second', started_at, completed_at)) FILTER (WHERE current_stage = 'completed') AS spans,
  count(*) FILTER (WHERE current_stage = 'completed' AND completed_at IS NOT NULL) AS timed FROM jobs GROUP BY 1),
pu AS (SELECT uploaded_by AS user_id, count(*) AS docs_total, count(*) FILTER (WHERE status = 'completed') AS docs_completed, count(*) FILTER (WHERE status = 'failed') AS docs_failed,
  CAST(coalesce(sum(items), 0) AS BIGINT) AS fields_extracted, CAST(coalesce(sum(downs), 0) AS BIGINT) AS fields_corrected, CAST(coalesce(sum(ups), 0) AS BIGINT) AS fields_confirmed,
  CAST(coalesce(sum(jobs), 0) AS BIGINT) AS nj, sum(spans) AS spans, sum(timed) AS timed, max(created_at) AS last_activity
  FROM d LEFT JOIN it USING (doc_id) LEFT JOIN vo USING (doc_id) LEFT JOIN jo USING (doc_id) GROUP BY 1),
ui AS (SELECT user_id, username, docs_total, docs_completed, docs_failed, fields_extracted, fields_corrected, fields_confirmed,
  CASE WHEN fields_extracted > 0 THEN round(fields_corrected / fields_extracted * 100, 1) ELSE 0.0 END AS correction_rate,
  CASE WHEN timed > 0 THEN round(CAST(spans AS DOUBLE) / CAST(timed AS DOUBLE), 1) END AS avg_processing_seconds, greatest(0, nj - docs_total) AS retry_jobs, last_activity
  FROM pu JOIN users USING (user_id))"""


def user_rows(t, since=SINCE):
    return A.user_insights(B.users(t), B.docs(t), B.insights(t), B.feedback(t), B.jobs(t), since)


@query("an1_user_insights", f"WITH {INSIGHTS_SQL} SELECT * FROM ui")
def _(t):
    return user_rows(t)


@query("an2_accuracy_trend", f"""WITH {FEEDBACK_SQL} SELECT CAST(created_at AS DATE) AS day, count(*) AS feedback_total, count(*) FILTER (WHERE rating = 'down') AS corrections,
  round(count(*) FILTER (WHERE rating = 'down') / count(*) * 100, 1) AS correction_rate FROM fb WHERE created_at >= TIMESTAMP '{SINCE}' GROUP BY 1""")
def _(t):
    return A.accuracy_trend(B.feedback(t), SINCE)


@query("an3_problem_fields", f"WITH {FEEDBACK_SQL} SELECT field_key, count(*) AS corrections FROM fb WHERE rating = 'down' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(t):
    return A.problem_fields(B.feedback(t), top=15)


@query("an3_problem_fields_whole", f"WITH {FEEDBACK_SQL} SELECT field_key, count(*) AS corrections FROM fb WHERE rating = 'down' GROUP BY 1")
def _(t):
    return A.problem_fields(B.feedback(t))


@query("an4_failure_stats", f"WITH {DOCS_SQL} SELECT count(*) FILTER (WHERE status = 'failed') AS documents_failed, count(*) AS documents_total FROM docs WHERE created_at >= TIMESTAMP '{SINCE}'")
def _(t):
    return A.failure_stats(B.docs(t), SINCE)


@query("an4_top_error_codes", f"WITH {JOBS_SQL} SELECT error_code, count(*) AS count FROM jobs WHERE current_stage = 'failed' AND error_code <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(t):
    return A.top_error_codes(B.jobs(t), top=8)


@query("an5_activity_timeline", f"WITH {DOCS_SQL} SELECT CAST(created_at AS DATE) AS day, count(*) AS uploads, count(*) FILTER (WHERE status = 'completed') AS completed FROM docs GROUP BY 1")
def _(t):
    return A.activity_timeline(B.docs(t))


@query("an6_user_documents", f"WITH {DOCS_SQL} SELECT doc_id, filename, status, round(size_bytes / 1048576, 1) AS size_mb, created_at FROM docs WHERE uploaded_by = 7 ORDER BY created_at DESC, doc_id DESC LIMIT 200")
def _(t):
    return A.user_documents(B.docs(t), 7, top=200)


@query("an6_user_detail", f"""WITH {DOCS_SQL}, {FEEDBACK_SQL}, {ITEMS_SQL},
f AS (SELECT uploaded_by AS user_id, coalesce(nullif(trim(label), ''), '(unlabeled)') AS field, count(*) AS count FROM bitems JOIN docs USING (doc_id) GROUP BY 1, 2),
c AS (SELECT uploaded_by AS user_id, doc_id, field_key AS field, count(*) AS count FROM fb JOIN docs USING (doc_id) WHERE rating = 'down' GROUP BY 1, 2, 3)
SELECT user_id, 'field' AS kind, NULL::BIGINT AS doc_id, field, count FROM f UNION ALL SELECT user_id, 'corrected_by_document', doc_id, field, count FROM c
UNION ALL SELECT user_id, 'corrected', NULL, field, CAST(sum(count) AS BIGINT) FROM c GROUP BY 1, 4""")
def _(t):
    return A.user_detail(B.docs(t), B.items(t), B.feedback(t))


@query("an7_insight_snapshot")
def _(t):
    return A.insight_snapshot(B.users(t), B.docs(t), B.insights(t), B.feedback(t), B.jobs(t), SINCE, LIM)


@query("an8_build_insights")
def _(t):
    import datetime
    out = A.build_insights(B.users(t), B.docs(t), B.insights(t), B.feedback(t), B.jobs(t), 400, datetime.datetime(1999, 1, 1), LIM)
    parts = None
    for name, df in out.items():
        one = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("row"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


_CANON = " UNION ALL ".join(f"SELECT '{k}' AS field_key, '{v}' AS label" for k, v in CANONICAL_FIELDS)
_EVENTS = " UNION ALL ".join(f"SELECT '{k}' AS field_key, '{v}' AS label" for k, v in EVENT_FIELDS)


@query("an9_field_matrix", f"""WITH {DOCS_SQL}, {FEEDBACK_SQL}, {SPEC_SQL}, canon AS ({_CANON}),
n AS (SELECT doc_id, filename FROM docs ORDER BY created_at DESC, doc_id DESC LIMIT 100),
w AS (SELECT DISTINCT ON (doc_id, field_key) doc_id, field_key, correct_value AS correction, CASE WHEN issue_type = '' AND comment = '' THEN 'Marked wrong' WHEN issue_type = '' THEN comment WHEN comment = '' THEN issue_type ELSE issue_type || ' — ' || comment END AS reason
  FROM fb WHERE rating = 'down' ORDER BY doc_id, field_key, correct_value <> '' DESC, created_at DESC, feedback_id DESC),
s AS (SELECT DISTINCT doc_id, field_key FROM spec)
SELECT n.doc_id, n.filename, canon.field_key, label, CASE WHEN w.doc_id IS NOT NULL THEN 'Wrong' WHEN s.doc_id IS NOT NULL THEN 'Correct' ELSE 'Not found' END AS status,
  coalesce(correction, '') AS correction, coalesce(reason, '') AS reason
FROM n CROSS JOIN canon LEFT JOIN w ON w.doc_id = n.doc_id AND w.field_key = canon.field_key LEFT JOIN s ON s.doc_id = n.doc_id AND s.field_key = canon.field_key""")
def _(t):
    return A.field_matrix(B.docs(t), B.spec(t), B.feedback(t), top=100)


@query("an10_event_matrix", f"""WITH {DOCS_SQL}, {SPEC_SQL}, ev AS ({_EVENTS}), n AS (SELECT doc_id FROM docs ORDER BY created_at DESC, doc_id DESC LIMIT 100),
nt AS (SELECT doc_id, field_key, arg_max(note, row_seq) AS note FROM spec JOIN n USING (doc_id) WHERE note <> '' GROUP BY 1, 2)
SELECT n.doc_id, ev.field_key || '_events' AS field_key, label, CASE WHEN note IS NOT NULL THEN 'Correct' ELSE 'Not found' END AS status, coalesce(note, '') AS correction
FROM n CROSS JOIN ev LEFT JOIN nt ON nt.doc_id = n.doc_id AND nt.field_key = ev.field_key WHERE ev.field_key IN (SELECT field_key FROM nt)""")
def _(t):
    return A.event_matrix(B.docs(t), B.spec(t), top=100)


@query("an9_field_matrix_whole", f"""WITH {DOCS_SQL}, {FEEDBACK_SQL}, {SPEC_SQL}, canon AS ({_CANON}),
n AS (SELECT doc_id, filename FROM docs),
w AS (SELECT DISTINCT ON (doc_id, field_key) doc_id, field_key, correct_value AS correction, CASE WHEN issue_type = '' AND comment = '' THEN 'Marked wrong' WHEN issue_type = '' THEN comment WHEN comment = '' THEN issue_type ELSE issue_type || ' — ' || comment END AS reason
  FROM fb WHERE rating = 'down' ORDER BY doc_id, field_key, correct_value <> '' DESC, created_at DESC, feedback_id DESC),
s AS (SELECT DISTINCT doc_id, field_key FROM spec)
SELECT n.doc_id, n.filename, canon.field_key, label, CASE WHEN w.doc_id IS NOT NULL THEN 'Wrong' WHEN s.doc_id IS NOT NULL THEN 'Correct' ELSE 'Not found' END AS status,
  coalesce(correction, '') AS correction, coalesce(reason, '') AS reason
FROM n CROSS JOIN canon LEFT JOIN w ON w.doc_id = n.doc_id AND w.field_key = canon.field_key LEFT JOIN s ON s.doc_id = n.doc_id AND s.field_key = canon.field_key""")
def _(t):
    return A.field_matrix(B.docs(t), B.spec(t), B.feedback(t))


@query("an10_event_matrix_whole", f"""WITH {DOCS_SQL}, {SPEC_SQL}, ev AS ({_EVENTS}), n AS (SELECT doc_id FROM docs),
nt AS (SELECT doc_id, field_key, arg_max(note, row_seq) AS note FROM spec JOIN n USING (doc_id) WHERE note <> '' GROUP BY 1, 2)
SELECT n.doc_id, ev.field_key || '_events' AS field_key, label, CASE WHEN note IS NOT NULL THEN 'Correct' ELSE 'Not found' END AS status, coalesce(note, '') AS correction
FROM n CROSS JOIN ev LEFT JOIN nt ON nt.doc_id = n.doc_id AND nt.field_key = ev.field_key WHERE ev.field_key IN (SELECT field_key FROM nt)""")
def _(t):
    return A.event_matrix(B.docs(t), B.spec(t))


@query("an11_export_summary", f"""WITH {INSIGHTS_SQL}, s AS (SELECT count(*) AS u, CAST(sum(docs_total) AS BIGINT) AS a, CAST(sum(docs_completed) AS BIGINT) AS b, CAST(sum(docs_failed) AS BIGINT) AS c,
  CAST(sum(fields_extracted) AS BIGINT) AS e, CAST(sum(fields_corrected) AS BIGINT) AS f FROM ui)
SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])::BIGINT AS i, unnest(['Period', 'Generated', 'Scope', 'Active users', 'Documents uploaded', 'Documents completed', 'Documents failed', 'Fields extracted', 'Fields corrected (thumbs down)', 'Overall correction rate']) AS metric,
  unnest(['All time', 'now', 'All users', CAST(u AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(e AS VARCHAR), CAST(f AS VARCHAR), CAST(round(f / e * 100, 1) AS VARCHAR) || '%']) AS value FROM s""")
def _(t):
    return A.export_summary(user_rows(t), "All time", "now")


@query("an12_export_scope", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE uploaded_by = 7 ORDER BY created_at DESC, doc_id DESC LIMIT 100")
def _(t):
    return A.newest_documents(B.docs(t), user_id=A.export_scope(None, 7, False), top=100).select("doc_id")


_LAB = "CASE field_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY_LABELS.items()) + " ELSE replace(field_key, '_', ' ') END"


@query("an13_admin_notes", f"""WITH {DOCS_SQL}, {FEEDBACK_SQL}, {SPEC_SQL},
live AS (SELECT *, {_LAB} AS lab, nullif(CASE WHEN ends_with(field_key, '_date_time') THEN date WHEN contains(text, ': ') THEN substr(text, strpos(text, ': ') + 2) ELSE text END, '') AS v FROM spec WHERE NOT not_found),
fa AS (SELECT doc_id, count(*) AS n, arg_min(v, row_seq) FILTER (WHERE field_key = 'project_name' AND v IS NOT NULL) AS name, arg_min(v, row_seq) FILTER (WHERE field_key = 'bid_deadline_date_time' AND v IS NOT NULL) AS due FROM live GROUP BY 1),
hs AS (SELECT DISTINCT doc_id FROM spec),
dn AS (SELECT *, {_LAB} AS lab, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, feedback_id) AS rn FROM fb WHERE rating = 'down'),
pc AS (SELECT doc_id, string_agg(CASE WHEN correct_value <> '' THEN lab || ' corrected from "' || extracted_value || '" to "' || correct_value || '"' ELSE lab || ' flagged as wrong' END
   || CASE WHEN comment <> '' THEN ' (' || comment || ')' WHEN issue_type <> '' THEN ' (' || issue_type || ')' ELSE '' END, '; ' ORDER BY rn) FILTER (WHERE rn <= 6) AS pieces, count(*) AS nd FROM dn GROUP BY 1),
up AS (SELECT doc_id, count(*) AS nu FROM fb WHERE rating = 'up' GROUP BY 1),
lo AS (SELECT doc_id, lab, min(row_seq) AS o FROM live WHERE confidence < 70 GROUP BY 1, 2),
ou AS (SELECT doc_id, string_agg(lab, ', ' ORDER BY o) AS outs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM lo WHERE (doc_id, lab) NOT IN (SELECT doc_id, lab FROM dn)) WHERE r <= 6 GROUP BY 1),
kf AS (SELECT docs.doc_id, hs.doc_id IS NOT NULL AS summary, concat_ws(' — ', '"' || name || '"', 'bid deadline ' || replace(strftime(CAST(due AS TIMESTAMP), '%B %d, %Y, %I:%M %p'), ' 0', ' ')) AS k, coalesce(n, 0) AS n, pieces, nd, nu, outs
  FROM docs LEFT JOIN fa USING (doc_id) LEFT JOIN hs USING (doc_id) LEFT JOIN pc USING (doc_id) LEFT JOIN up USING (doc_id) LEFT JOIN ou USING (doc_id))
SELECT doc_id, concat_ws(' ', CASE WHEN k <> '' THEN 'Processed ' || k || ' with ' || n || ' field(s) extracted.' WHEN summary THEN 'Processed with ' || n || ' field(s) extracted.' ELSE 'Document has no completed briefing yet.' END,
  'Corrections: ' || pieces || CASE WHEN nd > 6 THEN ' and ' || (nd - 6) || ' more correction(s)' ELSE '' END || '.', nu || ' field(s) confirmed correct by the reviewer.', 'Pending review (low confidence): ' || outs || '.',
  CASE WHEN summary AND nd IS NULL AND nu IS NULL AND outs IS NULL THEN 'No corrections were needed.' END) AS note FROM kf""")
def _(t):
    return A.admin_notes(B.docs(t), B.spec(t), B.feedback(t), limits=LIM)


@query("an14_observation_notes", f"""WITH {INSIGHTS_SQL},
b AS (SELECT 1 AS o, username || ' processed the most documents (' || docs_completed || ' completed).' AS note FROM (SELECT * FROM ui ORDER BY docs_completed DESC, docs_total DESC, user_id LIMIT 1) WHERE docs_completed > 0
 UNION ALL SELECT 2, username || ' has the best accuracy — only ' || correction_rate || '% of ' || fields_extracted || ' extracted fields needed correction.' FROM (SELECT * FROM ui WHERE fields_extracted >= 20 ORDER BY correction_rate, docs_total DESC, user_id LIMIT 1)
 UNION ALL SELECT 3, username || '''s documents show the highest correction rate (' || correction_rate || '%) — worth reviewing which fields fail there.' FROM (SELECT * FROM ui WHERE fields_extracted >= 20 ORDER BY correction_rate DESC, docs_total DESC, user_id LIMIT 1) WHERE correction_rate >= 5
 UNION ALL SELECT 4, username || ' hit ' || docs_failed || ' failed document(s) — check failure reasons below.' FROM (SELECT * FROM ui WHERE docs_failed > 0 ORDER BY docs_failed DESC, docs_total DESC, user_id LIMIT 1)
 UNION ALL SELECT 5, 'Fastest average processing: ' || username || ' at ' || CASE WHEN s < 90 THEN CAST(CAST(floor(s + 0.5) AS BIGINT) AS VARCHAR) || 's' ELSE CAST(CAST(floor(s / 60 + 0.5) AS BIGINT) AS VARCHAR) || 'm' END || ' per document.'
   FROM (SELECT *, avg_processing_seconds AS s FROM ui WHERE avg_processing_seconds < 86400 ORDER BY avg_processing_seconds, docs_total DESC, user_id LIMIT 1))
SELECT o - 1 AS i, note FROM b""".replace("SELECT o - 1 AS i, note FROM b", "SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS BIGINT) AS i, note FROM b"))
def _(t):
    return A.observation_notes(user_rows(t), LIM)
