"""Job events, stale sweep, streams in their batch form, upserts and summary JSON."""

import uuid

from pyspark.sql import functions as F

from docloom.checks import business as B
from docloom.checks.business import DOCS_SQL, JOBS_SQL
from docloom.checks.q_business import LEXICON_SQL, lexicon
from docloom.checks.q_fields import spec
from docloom.checks.limits import L as LIM
from docloom.checks.registry import query
from docloom.operators import fields as FD
from docloom.plans.stage import stage_root
from docloom.sources import files as S
from docloom.sources.snapshots import read_snapshot
from docloom.streaming import jobs as J

STAGES = ["intake", "parsing", "chunking"]


def stage_events(t):
    e = t.events
    k = F.col("event_type")
    st = F.when(k.isin("signup", "view", "click"), "started").when(k == "purchase", "completed").otherwise("failed")
    return e.select(
        F.col("user_id").alias("job_id"), "event_id", "ts", st.alias("state"),
        F.concat(B.pick(STAGES, F.col("event_id") % 3), F.when(st == "completed", "_completed").otherwise("_processing")).alias("stage"))


EV_SQL = f"""
ev AS (SELECT user_id AS job_id, event_id, ts, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'started' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS state, {B.sql_list(STAGES)}[CAST(event_id % 3 + 1 AS INTEGER)] AS stage FROM events),
w AS (SELECT *, lag(state) OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) AS ps, lag(ts) OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) AS pt, lead(state) OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) AS ns FROM ev)"""


@query("st1_stage_durations", f"""WITH {EV_SQL} SELECT job_id, stage, CASE WHEN ps = 'started' THEN pt END AS started_at, ts AS ended_at, state, CASE WHEN ps = 'started' THEN date_diff('microsecond', pt, ts) / 1000000 END AS seconds FROM w WHERE state <> 'started'
UNION ALL SELECT job_id, stage, ts, NULL, 'open', NULL FROM w WHERE state = 'started' AND coalesce(ns, 'started') = 'started'""")
def _(t):
    return J.stage_durations(stage_events(t))


@query("st1_job_state", f"""WITH {EV_SQL}, d AS (SELECT job_id, stage, min((ts, event_id)) AS o FROM ev WHERE state = 'completed' GROUP BY 1, 2), l AS (SELECT job_id, string_agg(stage, ',' ORDER BY o) AS c FROM d GROUP BY 1),
n AS (SELECT job_id, arg_max(stage || CASE WHEN state = 'completed' THEN '_completed' ELSE '_processing' END, (ts, event_id)) AS current_stage FROM ev GROUP BY 1) SELECT n.job_id, current_stage, c AS completed_stages FROM n LEFT JOIN l USING (job_id)""")
def _(t):
    return J.job_state(stage_events(t)).withColumn("completed_stages", F.array_join("completed_stages", ","))


@query("st2_sweep_stale", f"""WITH {DOCS_SQL}, {JOBS_SQL}, la AS (SELECT doc_id, arg_max(job_id LIKE 'b-%', (created_at, job_id)) AS rq FROM jobs GROUP BY 1)
SELECT doc_id, status, CASE WHEN status = 'queued' AND NOT coalesce(rq, false) THEN 'requeue' ELSE 'fail' END AS action,
  CASE WHEN status = 'queued' AND NOT coalesce(rq, false) THEN NULL WHEN status = 'queued' THEN 'queued job never picked up (re-enqueue already attempted)' ELSE 'processing died mid-stage (' || status || ')' END AS reason
FROM docs LEFT JOIN la USING (doc_id) WHERE status NOT IN ('completed', 'failed') AND created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 30 MINUTE""")
def _(t):
    jobs = B.jobs(t).withColumn("requeued", F.col("job_id").startswith("b-"))
    return J.sweep_stale(B.docs(t).withColumn("updated_at", F.col("created_at")), jobs, "1998-06-01 00:00:00")


@query("st3_failure_events", f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN retry_count < 3 THEN 'retry' ELSE 'fail' END AS action, CASE current_stage WHEN 'parsing_processing' THEN 'parsing_failure' ELSE 'intake_failure' END AS error_type FROM jobs""")
def _(t):
    e = B.jobs(t).select("job_id", F.col("current_stage").alias("stage"), "retry_count", F.col("error_code").alias("message"))
    return J.failure_events(e, message_chars=LIM.error_chars).select("job_id", "action", "error.error_type")


@query("st4_drop_cancelled", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def _(t):
    jobs = B.jobs(t).withColumn("current_stage", F.when(F.col("error_code") == "RETRY", "cancelled").otherwise(F.col("current_stage")))
    return J.drop_cancelled(B.docs(t), jobs).select("doc_id")


@query("st7_activity", """SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'signup') AS uploads, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1""")
def _(t):
    return J.activity_stream(t.events)


@query("snk2_upsert", f"""WITH {LEXICON_SQL}, u AS (SELECT extraction_type, entry_kind, term_normalized, 'NEW' AS term_display, 5 AS hit_count FROM lex WHERE is_active UNION ALL SELECT 'x', 'term', s_name, s_name, 1 FROM supplier)
SELECT coalesce(l.extraction_type, u.extraction_type) AS extraction_type, coalesce(l.entry_kind, u.entry_kind) AS entry_kind, coalesce(l.term_normalized, u.term_normalized) AS term_normalized, coalesce(u.term_display, l.term_display) AS term_display, CAST(coalesce(l.hit_count, 0) + coalesce(u.hit_count, 0) AS BIGINT) AS hit_count
FROM lex l FULL JOIN u ON l.extraction_type = u.extraction_type AND l.entry_kind = u.entry_kind AND l.term_normalized = u.term_normalized""")
def _(t):
    cols = ["extraction_type", "entry_kind", "term_normalized", "term_display", "hit_count"]
    lex = lexicon(t)
    u = lex.where("is_active").withColumn("term_display", F.lit("NEW")).withColumn("hit_count", F.lit(5)).select(*cols)
    s = t.supplier.select(F.lit("x").alias("extraction_type"), F.lit("term").alias("entry_kind"), F.col("s_name").alias("term_normalized"), F.col("s_name").alias("term_display"), F.lit(1).alias("hit_count"))
    return S.upsert(lex.select(*cols), u.unionByName(s), cols[:3], ["hit_count"])


@query("snk5_summary_json")
def _(t):
    return S.to_summary_json(spec(t), FD.field_warnings(spec(t)))


@query("snk1_replace_by_doc", """SELECT doc_id, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE lang <> 'fr'""")
def _(t):
    # all documents, then a version that changes the German ones and deletes the French ones
    docs, path = t.documents.select("doc_id", "lang", F.col("n_chars").cast("bigint").alias("n_chars")), f"{stage_root(t.spark)}/docs-{uuid.uuid4().hex}"
    S.replace_by_doc(docs, path, 16)
    S.replace_by_doc(docs.where("lang = 'de'").withColumn("n_chars", F.col("n_chars") + 1), path, 16, documents=docs.where("lang in ('de', 'fr')"))
    return read_snapshot(t.spark, path).drop("lang")


@query("snk4_jsonl_round_trip", "SELECT doc_id, length(text) AS n FROM documents")
def _(t):
    path = f"{stage_root(t.spark)}/lines-{uuid.uuid4().hex}"
    S.write_jsonl(t.documents.select(F.to_json(F.struct("doc_id", "text")).alias("line")), path)
    return t.spark.read.schema("doc_id bigint, text string").json(path).select("doc_id", F.length("text").alias("n"))


@query("snk6_results_round_trip", "SELECT doc_id, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    path = f"{stage_root(t.spark)}/results-{uuid.uuid4().hex}"
    S.write_results(t.documents.groupBy("doc_id", "lang").agg(F.count("*").alias("n")), path, 16)
    return t.spark.read.schema("doc_id bigint, lang string, n bigint").json(path).select("doc_id", "lang", "n")
