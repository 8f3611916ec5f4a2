"""Conversations and evaluation."""

from pyspark.sql import functions as F

from docloom.checks.adapters import CHUNKS_SQL, ITEMS_SQL, as_chunks, as_items
from docloom.checks.business import SPEC_SQL
from docloom.checks.q_fields import spec
from docloom.checks.q_grounding import cite_sql
from docloom.checks.q_retrieval import KW, SELECT_SQL, chat_hits
from docloom.checks.limits import L as LIM
from docloom.checks.registry import query
from docloom.functions.text import norm_cite
from docloom.operators import conversations as CV
from docloom.operators import evaluation as EV
from docloom.operators import retrieval as R
from docloom.plans.scans import once
from docloom.plans.stage import cut

HIST_SQL = """
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
hist AS (SELECT conv_id, count(*) AS n_messages, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS history FROM h WHERE rn BETWEEN 2 AND 12 AND role IN ('user', 'assistant') GROUP BY 1)"""


@query("cv1_history", f"WITH {HIST_SQL} SELECT * FROM hist")
def _(t):
    return CV.history(t.conversations)


def ranked_hits(t):
    h = R.ranked(chat_hits(t), 5)
    return h.join(as_chunks(t.documents).select("chunk_id", "section_title", "page_start", "page_end", "chunk_text"), "chunk_id")


CTX_SQL = CHUNKS_SQL + """,
cq AS (SELECT conv_id || '-' || turn AS query_id, conv_id, conv_id AS doc_id, text FROM conversations WHERE role = 'user'),
ch AS (SELECT query_id, c.*, (chunk_order * 17 % 100) / 100 AS score FROM cq JOIN chunks c USING (doc_id) WHERE (doc_id + chunk_order) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (chunk_order * 17 % 100) / 100 DESC, chunk_order, chunk_id) <= 5),
ctx AS (SELECT query_id, string_agg('[CHUNK_ID=' || chunk_id || ' | ' || section_title || ' | p.' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END || ' | score=' || score || ']' || chr(10) || chunk_text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, chunk_order) AS context FROM ch GROUP BY 1)"""


@query("cv2_context_blocks", f"WITH {CTX_SQL} SELECT * FROM ctx")
def _(t):
    return CV.context_blocks(ranked_hits(t))


def questions(t):
    c = t.conversations.where("role = 'user'")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "text")


@query("cv3_chat_requests", f"""WITH {CTX_SQL}, {HIST_SQL} SELECT cq.query_id, cq.conv_id, CASE WHEN trim(text) = '' THEN 'empty_message' WHEN length(trim(text)) > 8000 THEN 'message_too_long' WHEN context IS NULL THEN 'refused' ELSE 'ready' END AS status,
  CASE WHEN trim(text) <> '' AND length(trim(text)) <= 8000 AND context IS NOT NULL THEN coalesce('PRIOR CONVERSATION:' || chr(10) || history || chr(10) || chr(10), '') || 'CONTEXT (document excerpts only):' || chr(10) || context || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || trim(text) END AS prompt
FROM cq LEFT JOIN ctx USING (query_id) LEFT JOIN hist ON hist.conv_id = cq.conv_id""")
def _(t):
    return CV.chat_requests(questions(t), CV.context_blocks(ranked_hits(t)), CV.history(t.conversations)).drop("answer")


@query("cv4_finalize_answers", f"""WITH {CTX_SQL}, a AS (SELECT conv_id || '-' || (turn - 1) AS query_id, text, turn % 5 = 3 AS rf FROM conversations WHERE role = 'assistant'), n AS (SELECT query_id, count(*) AS n FROM ch GROUP BY 1)
SELECT query_id, rf OR trim(text) = '' OR n IS NULL AS refused, coalesce(n, 0) AS n_citations FROM a LEFT JOIN n USING (query_id)""")
def _(t):
    a = t.conversations.where("role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("query_id"), F.col("text").alias("answer"), (F.col("turn") % 5 == 3).alias("refused"))
    return CV.finalize_answers(a, ranked_hits(t)).drop("answer")


@query("cv5_clean_followups", """WITH q AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 200 AND lower(x) <> lower(trim(text))) AS l FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM q), d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(x) ORDER BY i) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rn FROM d)
SELECT q.conv_id, q.turn, coalesce(string_agg(x, '|' ORDER BY i) FILTER (WHERE rn <= 4), '') AS f FROM q LEFT JOIN r ON r.conv_id = q.conv_id AND r.turn = q.turn GROUP BY 1, 2""")
def _(t):
    c = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "text", F.split("text", "\n").alias("qs"))
    return c.select("conv_id", "turn", F.array_join(CV.clean_followups("qs", "text", LIM), "|").alias("f"))


@query("cv5_latest_followups", "SELECT conv_id, arg_max(text, turn) AS follow_ups FROM conversations WHERE role = 'assistant' GROUP BY 1")
def _(t):
    return CV.latest_followups(t.conversations.withColumn("follow_ups", F.col("text")))


@query("cv6_session_titles", "SELECT conv_id, substr(t, 1, 80) || CASE WHEN length(t) > 80 THEN '…' ELSE '' END AS title FROM (SELECT conv_id, trim(arg_min(text, turn), chr(10) || ' ') AS t FROM conversations WHERE role = 'user' GROUP BY 1)")
def _(t):
    return CV.session_titles(t.conversations, LIM)


@query("ev1_golden_values", f"WITH {SPEC_SQL} SELECT doc_id, field_key, string_agg(CASE WHEN date <> '' THEN date ELSE text END, '|' ORDER BY row_seq) AS values FROM spec GROUP BY 1, 2")
def _(t):
    return EV.golden_values(spec(t)).withColumn("values", F.array_join("values", "|"))


@query("ev2_label_match", f"""WITH {SPEC_SQL}, g AS (SELECT doc_id, field_key, list(lower(CASE WHEN date <> '' THEN date ELSE text END)) AS v FROM spec GROUP BY 1, 2)
SELECT doc_id, field_key, len(list_filter(v, lambda x: contains(x, 'value 3') OR contains(x, 'works'))) > 0 AS any_hit, len(list_filter(v, lambda x: contains(x, 'value 3') AND contains(x, 'works'))) > 0 AS all_hit,
  len(list_filter(v, lambda x: regexp_matches(x, 'value [2-4]'))) > 0 AS regex_hit FROM g""")
def _(t):
    n = F.array(F.lit("Value 3"), F.lit("works"))
    g = EV.golden_values(spec(t))
    return g.select("doc_id", "field_key", EV.label_match("values", "contains_any", n).alias("any_hit"), EV.label_match("values", "contains_all", n).alias("all_hit"),
                    EV.label_match("values", "regex", F.array(F.lit("value [2-4]"))).alias("regex_hit"))


def scores(t):
    return spec(t).select("field_key", (F.col("page") < 6).alias("expected"), (F.col("confidence") > 20).alias("found"), F.col("citation_verified").alias("correct"))


METRICS_SQL = SPEC_SQL + """,
c AS (SELECT field_key, count(*) FILTER (WHERE confidence > 20 AND citation_verified) AS tp, count(*) FILTER (WHERE confidence > 20 AND NOT citation_verified) AS fp,
  count(*) FILTER (WHERE NOT (confidence > 20 AND citation_verified) AND page < 6) AS fn FROM spec GROUP BY 1),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
m AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM p),
met AS (SELECT field_key, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM m UNION ALL SELECT '*', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(p), 4), round(avg(r), 4), round(avg(f), 4) FROM m)"""


@query("ev4_field_metrics", f"WITH {METRICS_SQL} SELECT * FROM met")
def _(t):
    return EV.field_metrics(scores(t))


@query("ev5_gate", f"""WITH {METRICS_SQL}, d AS (SELECT CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS n FROM labels),
v AS (SELECT 'min_passing' AS "check", n AS value, 8.0 AS threshold FROM d UNION ALL SELECT 'macro_recall', recall, 0.85 FROM met WHERE field_key = '*' UNION ALL SELECT 'macro_f1', f1, 0.2 FROM met WHERE field_key = '*' UNION ALL SELECT 'recall:project_name', recall, 0.1 FROM met WHERE field_key = 'project_name')
SELECT "check", CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, value >= threshold AS passed FROM v""")
def _(t):
    return EV.gate(EV.field_metrics(scores(t)), t.labels.select((F.col("quality") == 1).alias("passed")), {"min_passing": 8, "macro_recall": 0.85, "macro_f1": 0.2, "recall:project_name": 0.1})


TRUTH_SQL = ITEMS_SQL + f""",
tr AS (SELECT doc_id, extraction_type, {cite_sql('source_text')} AS passage, arg_min(source_text, item_seq) AS source_text FROM items WHERE citation_verified AND extraction_type <> 'payment_terms' AND trim(source_text) <> '' GROUP BY 1, 2, 3)"""


def truth(t):
    return EV.retrieval_truth(as_items(t.documents), "payment_terms")


@query("ev7_retrieval_truth", f"WITH {TRUTH_SQL} SELECT * FROM tr")
def _(t):
    return truth(t)


def type_hits(t):
    c = cut(once(as_chunks(t.documents), "hay", norm_cite("chunk_text")))
    sel = R.keyword_select(R.keyword_scores(c, KW)).withColumn("rank", F.col("rn"))
    return sel.join(c.select("doc_id", "chunk_order", "hay"), ["doc_id", "chunk_order"]).select("doc_id", "extraction_type", "rank", "hay")


RANKS_SQL = SELECT_SQL + ", " + "items AS" + ITEMS_SQL.split("items AS", 1)[1] + f""",
tr AS (SELECT doc_id, extraction_type, {cite_sql('source_text')} AS passage, arg_min(source_text, item_seq) AS source_text FROM items WHERE citation_verified AND extraction_type <> 'payment_terms' AND trim(source_text) <> '' GROUP BY 1, 2, 3),
th AS (SELECT tk.doc_id, tk.extraction_type, rn AS rank, {cite_sql('chunk_text')} AS hay FROM tk JOIN chunks USING (doc_id, chunk_order)),
ph AS (SELECT tr.doc_id, tr.extraction_type, passage, rank FROM tr JOIN th USING (doc_id, extraction_type) WHERE CASE WHEN length(source_text) >= 40 THEN contains(hay, passage)
  ELSE passage <> '' AND len(list_intersect(list_distinct(string_split(passage, ' ')), string_split(hay, ' '))) / len(list_distinct(string_split(passage, ' '))) >= 0.8 END),
pr AS (SELECT doc_id, extraction_type, passage, min(rank) AS rank FROM ph GROUP BY 1, 2, 3)"""


@query("ev8_passage_ranks", f"WITH {RANKS_SQL} SELECT * FROM pr")
def _(t):
    return EV.passage_ranks(truth(t), type_hits(t))


@query("ev9_retrieval_metrics", f"""WITH {RANKS_SQL}, g AS (SELECT doc_id, extraction_type, count(*) AS n FROM tr GROUP BY 1, 2), r AS (SELECT doc_id, extraction_type, min(rank) AS f, count(*) AS m FROM pr GROUP BY 1, 2),
j AS (SELECT g.doc_id, g.extraction_type AS et, n, f, coalesce(m, 0) AS m, l.doc_id IS NOT NULL AS ix FROM g LEFT JOIN r USING (doc_id, extraction_type) LEFT JOIN labels l ON l.doc_id = g.doc_id)
SELECT coalesce(et, '*') AS extraction_type, count(*) FILTER (WHERE ix) AS groups, count(*) FILTER (WHERE NOT ix) AS skipped, round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE ix), 4) AS recall_at_1, round(avg(CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE ix), 4) AS recall_at_3,
  round(avg(CASE WHEN f <= 8 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE ix), 4) AS recall_at_8, round(avg(CASE WHEN f <= 8 THEN 1.0::DOUBLE / f ELSE 0 END) FILTER (WHERE ix), 4) AS mrr_at_8,
  round(CAST(sum(m) FILTER (WHERE ix) AS DOUBLE) / CAST(sum(n) FILTER (WHERE ix) AS DOUBLE), 4) AS citation_recall, round(avg(CASE WHEN f IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE ix), 4) AS hit_rate FROM j GROUP BY ROLLUP (et)""")
def _(t):
    return EV.retrieval_metrics(truth(t), type_hits(t), t.labels)


@query("ev9_latency", "WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT round(max(value) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)), 2) AS p50, round(max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)), 2) AS p95 FROM o")
def _(t):
    return EV.latency_percentiles(t.events, "value")


@query("ev10_misses", f"WITH {RANKS_SQL} SELECT doc_id, extraction_type, passage FROM tr WHERE (doc_id, extraction_type, passage) NOT IN (SELECT doc_id, extraction_type, passage FROM ph WHERE rank <= 8)")
def _(t):
    return EV.misses(truth(t), type_hits(t)).select("doc_id", "extraction_type", "passage")


@query("ev14_deadline_audit", f"""WITH {SPEC_SQL}, r AS (SELECT doc_id, date, row_number() OVER (PARTITION BY doc_id ORDER BY row_seq) AS rn FROM spec WHERE field_key = 'bid_deadline_date_time'), g AS (SELECT doc_id, count(*) AS n, string_agg(date, ' | ' ORDER BY rn) FILTER (WHERE rn <= 3) AS v FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS deadlines, coalesce(v, '') AS first_values, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'multiple' ELSE 'ok' END AS state FROM (SELECT DISTINCT doc_id FROM spec) d LEFT JOIN g USING (doc_id)""")
def _(t):
    return EV.deadline_audit(spec(t), LIM.audit_values)


@query("ev15_verified_low", f"WITH {SPEC_SQL} SELECT doc_id, row_seq, field_key, confidence FROM spec WHERE citation_verified AND confidence < 90")
def _(t):
    return EV.verified_low(spec(t))


@query("ev16_compare_selections", f"""WITH {SELECT_SQL}, j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.extraction_type, b.extraction_type) AS extraction_type, a.doc_id IS NOT NULL AS ia, b.doc_id IS NOT NULL AS ib FROM tk a FULL JOIN kws b ON a.doc_id = b.doc_id AND a.extraction_type = b.extraction_type AND a.chunk_order = b.chunk_order)
SELECT doc_id, extraction_type, count(*) FILTER (WHERE ia AND ib) AS shared, count(*) FILTER (WHERE NOT ib) AS only_first, count(*) FILTER (WHERE NOT ia) AS only_second FROM j GROUP BY 1, 2""")
def _(t):
    c = as_chunks(t.documents)
    return EV.compare_selections(R.keyword_select(R.keyword_scores(c, KW)), R.keyword_chunks(c, KW))


@query("ev17_confidence_completeness", f"""WITH {SPEC_SQL}, x AS (SELECT doc_id, field_key, CASE WHEN confidence > 5 THEN confidence END AS c FROM spec) SELECT doc_id, count(*) AS rows, count(*) FILTER (WHERE c IS NULL) AS missing, count(DISTINCT field_key) FILTER (WHERE c IS NULL) AS fields_missing, count(*) FILTER (WHERE c IS NULL) = 0 AS passed FROM x GROUP BY ROLLUP (doc_id)""")
def _(t):
    return EV.confidence_completeness(spec(t).withColumn("confidence", F.when(F.col("confidence") > 5, F.col("confidence"))))


@query("ev18_chunk_profile", f"""WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS raw_sections, count(*) FILTER (WHERE chunk_type <> 'cover_metadata') AS logical_sections, count(*) AS chunks, min(length(chunk_text)) AS min_chars, CAST(floor(avg(length(chunk_text))) AS BIGINT) AS avg_chars,
  max(length(chunk_text)) AS max_chars, count(DISTINCT chunk_type) AS chunk_types FROM chunks GROUP BY 1""")
def _(t):
    c = as_chunks(t.documents)
    return EV.chunk_profile(c, c.where("chunk_type <> 'cover_metadata'"), c)


