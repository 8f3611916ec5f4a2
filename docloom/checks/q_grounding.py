"""Grounding, citations, backfills and retry planning."""

from pyspark.sql import functions as F

from docloom.checks.adapters import ITEMS_SQL, PAGES_SQL, as_chunks, as_items, as_pages
from docloom.checks.q_pages import WS_SQL
from docloom.checks.q_sections_chunks import any_sql
from docloom.checks.registry import query
from docloom.fixed import FOCUSED_TYPES
from docloom.functions.text import norm_cite, norm_ws
from docloom.operators import grounding as G


def ws_sql(c):
    return f"trim(regexp_replace(lower({c}), '{WS_SQL}+', ' ', 'g'))"


def cite_sql(c):
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '{WS_SQL}*\|{WS_SQL}*', ' ', 'g'), '-{{2,}}', ' ', 'g'), '{WS_SQL}+', ' ', 'g'))"


@query("gr1_normalize", f"SELECT page_id, {ws_sql('html')} AS a, {cite_sql('html')} AS b FROM pages")
def _(t):
    return t.pages.select("page_id", norm_ws("html").alias("a"), norm_cite("html").alias("b"))


_VARIANTS = [v for vs in G.LABEL_ALIASES.values() for v in vs] + ["project_name"]
_CASE = " ".join(f"WHEN '{v}' THEN '{c}'" for c, vs in G.LABEL_ALIASES.items() for v in vs)
_LIST = "[" + ", ".join(f"'{v}'" for v in _VARIANTS) + "]"


@query("gr2_canonical_label", f"""WITH {ITEMS_SQL}, e AS (SELECT event_type, event_id FROM events)
SELECT doc_id, item_seq, CASE label {_CASE} ELSE upper(replace(label, '_', ' ')) END AS label FROM items
UNION ALL SELECT event_id, -1, CASE event_type || '_date_time' {_CASE} ELSE upper(event_type) || ' DATE TIME' END FROM e""")
def _(t):
    spoken = lambda c: G.canonical_label(F.upper(F.replace(c, F.lit("_"), F.lit(" "))))
    items = as_items(t.documents).select("doc_id", F.col("item_seq").cast("bigint").alias("item_seq"), spoken(F.col("label")).alias("label"))
    events = t.events.select(F.col("event_id").alias("doc_id"), F.lit(-1).cast("bigint").alias("item_seq"), spoken(F.concat("event_type", F.lit("_date_time"))).alias("label"))
    return items.unionByName(events)


def batched(t):
    i = as_items(t.documents)
    return i.withColumn("batch_no", F.floor(F.col("item_seq") / 12)).withColumn("date_time", F.lit("")).withColumn(
        "requirement", F.when(F.col("item_seq") % 3 == 0, "").otherwise(F.concat(F.lit("  "), F.upper("label"))))


@query("gr3_validate_items", f"""WITH {ITEMS_SQL}, b AS (SELECT doc_id, item_seq, item_seq // 12 AS bn, CASE WHEN item_seq % 3 = 0 THEN label || ': ' || value ELSE upper(label) END AS requirement FROM items)
SELECT doc_id, item_seq, requirement FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, bn, substr({ws_sql('requirement')}, 1, 200) ORDER BY item_seq) = 1""")
def _(t):
    return G.validate_items(batched(t), key_chars=200).select("doc_id", "item_seq", "requirement")


@query("gr4_section_refs", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '§4.4.' || (o_orderkey % 9) WHEN 1 THEN '4.4 Entirety' WHEN 2 THEN '4.4.2 Notice' ELSE 'Annex' END AS label FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 4
    ref = F.when(k == 0, F.concat(F.lit("5.4."), (F.col("o_orderkey") % 9).cast("string"))).when(k == 1, "12").when(k == 2, "5.4.2 Notice").otherwise("Annex")
    return t.orders.select("o_orderkey", ref.alias("r"), F.lit("4.4 Entirety").alias("title")).select("o_orderkey", G.normalize_section_label("r", "title").alias("label"))


def quotes(t):
    """Facts as quotes; a part is reworded, a part gets table marks, hints are off by one."""
    i = as_items(t.documents)
    s = F.when(F.col("item_seq") % 4 == 1, F.concat(F.lit("rumoured "), "source_text", F.lit(" and nothing else"))).when(
        F.col("item_seq") % 4 == 2, F.replace("source_text", F.lit(" "), F.lit(" | "))).otherwise(F.col("source_text"))
    return i.select("doc_id", F.col("item_seq").alias("item_id"), "item_seq", "extraction_type", "label", "value", "requirement", s.alias("source_text"),
                    (F.col("page") + F.col("item_seq") % 2).alias("page_start"), (F.col("page") + 2).alias("page_end"), "page", "section", "section_path", "confidence")


PAGE_ROWS_SQL = "page_rows" + PAGES_SQL.split("page_rows", 1)[1]
QUOTES_SQL = ITEMS_SQL + ", " + PAGE_ROWS_SQL + f""",
qu AS (SELECT *, page + item_seq % 2 AS ps, page + 2 AS pe, CASE item_seq % 4 WHEN 1 THEN 'rumoured ' || source_text || ' and nothing else' WHEN 2 THEN replace(source_text, ' ', ' | ') ELSE source_text END AS s FROM items),
hay AS (SELECT doc_id, page_number, {cite_sql('text')} AS hay FROM page_rows),
nq AS (SELECT *, {cite_sql('s')} AS nf, {cite_sql('substr(s, 1, 80)')} AS n8 FROM qu)"""


@query("gr5_resolve_pages", f"""WITH {QUOTES_SQL}, h AS (SELECT nq.doc_id, item_seq, page_number, page_number BETWEEN ps AND pe AS ins FROM nq JOIN hay USING (doc_id) WHERE (length(nf) >= 24 AND contains(hay, nf)) OR (length(n8) >= 20 AND contains(hay, n8)))
SELECT nq.doc_id, nq.item_seq AS item_id, coalesce(min(page_number) FILTER (WHERE ins), min(page_number))::BIGINT AS resolved FROM nq LEFT JOIN h ON h.doc_id = nq.doc_id AND h.item_seq = nq.item_seq GROUP BY 1, 2""")
def _(t):
    return G.resolve_pages(quotes(t), as_pages(t.documents), fuzzy=False, prefix=80).select("doc_id", "item_id", "resolved")


@query("gr5_resolve_pages_fuzzy")
def _(t):
    return G.resolve_pages(quotes(t), as_pages(t.documents), prefix=80, fuzzy_prefix=50).select("doc_id", "item_id", "resolved")


@query("gr6_canonicalize_items")
def _(t):
    r = G.resolve_pages(quotes(t), as_pages(t.documents), prefix=80, fuzzy_prefix=50)
    c = as_chunks(t.documents).select("doc_id", (F.col("chunk_order") - 1).alias("item_seq"), "chunk_text", "section_title")
    return G.canonicalize_items(r.join(c, ["doc_id", "item_seq"]).withColumn("total_pages", F.lit(0)).withColumn("date_time", F.lit("")), prefix=40, max_source=2000).select(
        "doc_id", "item_id", "page", "section", "confidence", "citation_verified", "requirement")


@query("gr7_merge_items", f"WITH {ITEMS_SQL} SELECT doc_id, extraction_type, item_seq FROM items QUALIFY row_number() OVER (PARTITION BY doc_id, extraction_type, substr({ws_sql('requirement')}, 1, 200) ORDER BY item_seq) = 1")
def _(t):
    return G.merge_items(as_items(t.documents), key_chars=200).select("doc_id", "extraction_type", "item_seq")


@query("gr8_aggregate_confidence", f"WITH {ITEMS_SQL}, q AS (SELECT *, CAST(round(confidence * 10000) AS BIGINT) AS c FROM items) SELECT doc_id, extraction_type, (2 * sum(c) + count(*)) // (2 * count(*)) / 10000 AS confidence, count(*) AS n_items FROM q GROUP BY 1, 2")
def _(t):
    return G.aggregate_confidence(as_items(t.documents))


@query("gr9_missing_types", f"WITH {ITEMS_SQL} SELECT doc_id, ty AS extraction_type FROM (SELECT doc_id, unnest([{', '.join(repr(x) for x in FOCUSED_TYPES)}]) AS ty FROM documents) WHERE (doc_id, ty) NOT IN (SELECT doc_id, extraction_type FROM items)")
def _(t):
    return G.missing_types(t.documents, as_items(t.documents))


INDOC_SQL = QUOTES_SQL + """, ind AS (SELECT nq.doc_id, nq.item_seq, coalesce(bool_or(length(nf) >= 12 AND (contains(hay, nf) OR (length(nf) >= 32 AND contains(hay, substr(nf, 1, 32))))), false) AS ok FROM nq LEFT JOIN hay USING (doc_id) GROUP BY 1, 2)"""


@query("gr10_quote_in_document", f"WITH {INDOC_SQL} SELECT doc_id, item_seq AS item_id, ok AS in_document FROM ind")
def _(t):
    return G.quote_in_document(quotes(t), as_pages(t.documents), prefix=32).select("doc_id", "item_id", "in_document")


@query("gr11_citation_lookup", f"""WITH {INDOC_SQL} SELECT doc_id, substr(nf, 1, 160) AS key, arg_min(page, item_seq)::BIGINT AS page, arg_min(section, item_seq) AS section, substr(arg_min(s, item_seq), 1, 2000) AS source_text
FROM nq JOIN ind USING (doc_id, item_seq) WHERE ok GROUP BY 1, 2""")
def _(t):
    return G.citation_lookup(quotes(t), as_pages(t.documents), 32, 160, 2000).drop("section_path")


@query("gr12_canonicalize_sources", f"""WITH {INDOC_SQL}, lk AS (SELECT doc_id, substr(nf, 1, 160) AS key, arg_min(page, item_seq) AS p FROM nq JOIN ind USING (doc_id, item_seq) WHERE ok GROUP BY 1, 2)
SELECT nq.doc_id, nq.item_seq AS source_id, coalesce(lk.p, 99)::BIGINT AS page FROM nq LEFT JOIN lk ON lk.doc_id = nq.doc_id AND lk.key = substr(nf, 1, 160)""")
def _(t):
    q = quotes(t)
    s = q.select("doc_id", F.col("item_seq").alias("source_id"), "source_text", F.lit(99).alias("page"), "section")
    return G.canonicalize_sources(s, G.citation_lookup(q, as_pages(t.documents), 32, 160, 2000), 160).select("doc_id", "source_id", "page")


def sources(t):
    return quotes(t).select("doc_id", F.col("item_seq").alias("source_id"), "source_text", "page", "section", F.col("label").alias("field_key"))


def plain_items(t):
    return as_items(t.documents)


@query("gr13_best_item_match")
def _(t):
    return G.best_item_match(sources(t), plain_items(t), 160).select("doc_id", "source_id", F.round("ratio", 6).alias("ratio"), "m_page")


@query("gr14_enforce_verbatim")
def _(t):
    return G.enforce_verbatim(sources(t), plain_items(t), as_pages(t.documents), 32, 160, 2000)


def strip_sql(c):
    return f"regexp_replace(regexp_replace({c}, '^{WS_SQL}+', ''), '{WS_SQL}+$', '')"


# the longest of all runs of as many words as it takes for one run to reach 24 characters
@query("gr15_snap_quotes", f"""WITH {QUOTES_SQL},
pw AS (SELECT doc_id, page_number, {ws_sql('text')} AS hw FROM page_rows),
qw AS (SELECT qu.doc_id, item_seq, s, page, {ws_sql('s')} AS ns, string_split(trim(regexp_replace(s, '{WS_SQL}+', ' ', 'g')), ' ') AS w, coalesce(hw, '') AS hw FROM qu LEFT JOIN pw ON pw.doc_id = qu.doc_id AND page_number = page),
part AS (SELECT *, ns <> '' AND contains(hw, ns) AS stands FROM qw),
st AS (SELECT doc_id, item_seq, w, hw, unnest(range(1, len(w) + 1)) AS i FROM part WHERE NOT stands AND ns <> '' AND hw <> ''),
en AS (SELECT *, unnest(range(i, len(w) + 1)) AS j FROM st),
rn AS (SELECT doc_id, item_seq, i, j - i + 1 AS size, array_to_string(w[i:j], ' ') AS run, hw FROM en),
ok AS (SELECT *, length(run) AS chars FROM rn WHERE size >= 3 AND length(run) >= 10 AND contains(hw, lower(run))),
en2 AS (SELECT doc_id, item_seq, max(size) FILTER (WHERE chars >= 24) AS enough FROM ok GROUP BY 1, 2),
pk AS (SELECT ok.* FROM ok JOIN en2 USING (doc_id, item_seq) WHERE (chars >= 12 AND size >= coalesce(enough, 0)) OR (i = 1 AND size = 3)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_seq ORDER BY chars >= 12 AND size >= coalesce(enough, 0) DESC, chars DESC, size DESC, i) = 1)
SELECT part.doc_id, part.item_seq AS item_id, s AS source_text, page::BIGINT AS page, CASE WHEN stands THEN {strip_sql('s')} ELSE pk.run END AS snapped, stands OR pk.run IS NOT NULL AS highlightable
FROM part LEFT JOIN pk ON pk.doc_id = part.doc_id AND pk.item_seq = part.item_seq""")
def _(t):
    return G.snap_quotes(quotes(t).select("doc_id", "item_id", "source_text", "page"), as_pages(t.documents))


@query("gr16_ground_citations")
def _(t):
    c = as_chunks(t.documents)
    hits = c.select(F.col("doc_id").alias("query_id"), "doc_id", "chunk_id", "chunk_text", "section_title", "page_start", "page_end")
    cites = as_items(t.documents).select(F.col("doc_id").alias("query_id"), "doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("item_seq").cast("string")).alias("chunk_id"),
                                         F.col("item_seq").alias("cite_id"), "source_text", "page", F.lit("").alias("section"))
    return G.ground_citations(cites, hits, as_pages(t.documents), 80, 50, 512, 2000)


@query("gr17_source_references", f"""WITH {ITEMS_SQL} SELECT doc_id, item_seq, page, substr(section, 1, 512) AS section_label, substr(source_text, 1, 2000) AS source_text, substr(requirement, 1, 500) AS excerpt, CAST(round(confidence, 4) AS DOUBLE) AS confidence, extraction_type AS trace_type FROM items""")
def _(t):
    return G.source_references(as_items(t.documents), 512, 1024, 2000, 500).withColumn("trace_type", F.col("trace.type")).drop("trace", "section_path")


def id_items(t):
    """Items whose identifiers partly repeat the bare codes of the cover."""
    return as_items(t.documents).withColumn("label", F.when(F.col("label") == "solicitation_number", "project_solicitation_number").otherwise(F.col("label"))).withColumn(
        "value", F.when(F.col("label") == "project_solicitation_number", F.concat(F.lit("P-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("item_seq").cast("string"))).otherwise(F.col("value")))


@query("gr18_backfill_ids", rf"""WITH {PAGES_SQL}, cv AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_number) AS c FROM page_rows WHERE page_number <= 5 GROUP BY 1)
SELECT doc_id, 'Project No.: ' || regexp_extract(c, '(?i)PROJECT\s*NO\.?\s*:?\s*([A-Z0-9][-A-Z0-9/]*)', 1) AS value FROM cv WHERE regexp_matches(c, '(?i)PROJECT\s*NO\.?\s*:?\s*([A-Z0-9][-A-Z0-9/]*)')""")
def _(t):
    return G.backfill_ids(as_pages(t.documents), id_items(t), 5).select("doc_id", "value")


@query("gr19_backfill_contract_time", rf"""WITH {ITEMS_SQL}, {PAGE_ROWS_SQL},
cv AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_number) AS c FROM page_rows WHERE page_number <= 5 GROUP BY 1)
SELECT doc_id, regexp_extract(c, '(?i)CONTRACT\s*TIME\s*:?\s*(\d+)', 1) || ' calendar days' AS value FROM cv WHERE regexp_matches(c, 'Contract Time: \d+ calendar days') AND doc_id IN (SELECT doc_id FROM items WHERE label IN ('bid_deadline', 'question_deadline', 'project_end_date'))""")
def _(t):
    return G.backfill_contract_time(as_pages(t.documents), as_items(t.documents), 5).select("doc_id", "value")


@query("gr20_backfill_locations", rf"""WITH {PAGES_SQL}, cv AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_number) AS c FROM page_rows WHERE page_number <= 5 GROUP BY 1)
SELECT doc_id, trim(trim(regexp_replace(regexp_extract(c, '(?i)LOCATION\s*:?\s*([^\n\r]{{3,160}})', 1), '\s+', ' ', 'g')), ' :-') AS value FROM cv WHERE regexp_matches(c, '(?i)LOCATION\s*:?\s*([^\n\r]{{3,160}})')""")
def _(t):
    return G.backfill_locations(as_pages(t.documents), as_items(t.documents).withColumn("label", F.lit("owner")), 5).select("doc_id", "value")


@query("gr21_split_certified_checks", f"""WITH {ITEMS_SQL}, r AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND label = 'certified_check' THEN 'certified_checks' ELSE label END AS lb FROM items),
h AS (SELECT DISTINCT doc_id FROM r WHERE lb = 'certified_checks')
SELECT doc_id, item_seq, lb AS label, requirement FROM r UNION ALL SELECT doc_id, item_seq, 'certified_checks', 'certified_checks: ' || value FROM r WHERE doc_id NOT IN (SELECT doc_id FROM h) AND ({any_sql('lower(source_text)', ['certified check', 'bank check', 'money order'])} OR {any_sql('lower(requirement)', ['certified check', 'bank check', 'money order'])})""")
def _(t):
    i = as_items(t.documents).withColumn("label", F.when((F.col("doc_id") % 2 == 0) & (F.col("label") == "certified_check"), "certified_checks").otherwise(F.col("label")))
    return G.split_certified_checks(i).select("doc_id", "item_seq", "label", "requirement")


@query("gr22_penalty_severity", rf"""WITH {ITEMS_SQL}, x AS (SELECT *, CASE item_seq % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'minor' WHEN 2 THEN NULL ELSE 'odd' END AS sv, lower(trim(requirement) || ' ' || trim(source_text)) AS tx FROM items),
y AS (SELECT *, CASE coalesce(lower(sv), 'medium') WHEN 'high' THEN 2 WHEN 'minor' THEN 0 ELSE 1 END AS a, CASE WHEN regexp_matches(tx, '{G.CRITICAL}') THEN 2 WHEN regexp_matches(tx, '{G.MEDIUM}') THEN 1 ELSE 0 END AS b FROM x)
SELECT doc_id, item_seq, ['low', 'medium', 'critical'][greatest(a, b) + 1] AS severity FROM y""")
def _(t):
    k = F.col("item_seq") % 4
    s = F.when(k == 0, "High").when(k == 1, "minor").when(k == 2, F.lit(None).cast("string")).otherwise("odd")
    return as_items(t.documents).withColumn("sv", s).select("doc_id", "item_seq", G.penalty_severity("sv", "requirement", "source_text").alias("severity"))


@query("gr23_retry_plan", f"""WITH {ITEMS_SQL}, m AS (SELECT doc_id, 'eligibility_criteria' AS et, 'missing:project_name' AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM items WHERE label = 'project_name')
 UNION ALL SELECT doc_id, 'submission_deadlines', 'missing:bid_deadline_date_time' FROM documents
 UNION ALL SELECT doc_id, 'submission_deadlines', 'empty_extraction' FROM documents WHERE lang = 'en')
SELECT doc_id, et AS extraction_type, string_agg(r, ',' ORDER BY r) AS reasons FROM m GROUP BY 1, 2""")
def _(t):
    spec = as_items(t.documents).select("doc_id", F.col("label").alias("field_key"))
    ins = t.documents.select("doc_id", F.lit("submission_deadlines").alias("extraction_type"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("n_items"))
    return G.retry_plan(t.documents, spec, ins)


@query("gr24_apply_retry", f"""WITH {ITEMS_SQL}, o AS (SELECT doc_id, extraction_type, item_seq, requirement, 0 AS nw FROM items WHERE item_seq < 20 UNION ALL SELECT doc_id, extraction_type, item_seq, CASE WHEN doc_id % 2 = 0 THEN requirement ELSE requirement || ' again' END, 1 FROM items WHERE item_seq < 20),
m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, extraction_type, substr({ws_sql('requirement')}, 1, 200) ORDER BY nw, item_seq) = 1),
g AS (SELECT doc_id, extraction_type FROM m GROUP BY 1, 2 HAVING count(*) > (SELECT count(*) FROM items i WHERE i.item_seq < 20 AND i.doc_id = m.doc_id AND i.extraction_type = m.extraction_type))
SELECT doc_id, extraction_type, item_seq FROM m WHERE (doc_id, extraction_type) IN (SELECT * FROM g) UNION ALL SELECT doc_id, extraction_type, item_seq FROM o WHERE nw = 0 AND (doc_id, extraction_type) NOT IN (SELECT * FROM g)""".replace(" WHERE item_seq < 20", "").replace("WHERE i.item_seq < 20 AND ", "WHERE "))
def _(t):
    i = as_items(t.documents).select("doc_id", "extraction_type", F.col("item_seq").cast("bigint").alias("item_seq"), "requirement")
    new = i.withColumn("requirement", F.when(F.col("doc_id") % 2 == 0, F.col("requirement")).otherwise(F.concat("requirement", F.lit(" again"))))
    return G.apply_retry(i, new, 200).select("doc_id", "extraction_type", "item_seq")


@query("gr25_citation_targets", f"""WITH {ITEMS_SQL}, d AS (SELECT doc_id, extraction_type AS owner_id, page, item_seq AS source_seq, item_seq % 3 = 1 AS hl FROM items QUALIFY row_number() OVER (PARTITION BY doc_id, extraction_type, page, {ws_sql('source_text')} ORDER BY item_seq) = 1)
SELECT doc_id, owner_id, source_seq, row_number() OVER (PARTITION BY doc_id, owner_id ORDER BY NOT hl, source_seq) = 1 AS is_primary, row_number() OVER (PARTITION BY doc_id, owner_id, page ORDER BY source_seq) = 1 AS first_on_page FROM d""")
def _(t):
    s = as_items(t.documents).select("doc_id", F.col("extraction_type").alias("owner_id"), "page", "source_text", F.col("item_seq").alias("source_seq"), (F.col("item_seq") % 3 == 1).alias("highlightable"))
    return G.citation_targets(s).select("doc_id", "owner_id", "source_seq", "is_primary", "first_on_page")


@query("gr26_identity_context", f"""WITH {ITEMS_SQL}, g AS (SELECT doc_id, substr(arg_min(value, item_seq) FILTER (WHERE label = 'project_name' AND trim(value) <> ''), 1, 120) AS project_name FROM items GROUP BY 1) SELECT doc_id, project_name FROM g WHERE project_name IS NOT NULL""")
def _(t):
    return G.identity_context(as_items(t.documents), 120).select("doc_id", "project_name")
