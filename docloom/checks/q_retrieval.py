"""Classification, vocabulary, ranking and context building."""

import uuid

from pyspark.sql import functions as F

from docloom.checks.adapters import BLOCKS_SQL, CHUNKS_SQL, ITEMS_SQL, PAGES_SQL, as_chunks, as_items, as_pages
from docloom.checks.business import sql_list
from docloom.checks.limits import L as LIM
from docloom.checks.q_business import LEXICON_SQL, lexicon
from docloom.checks.q_pages import WS_SQL
from docloom.checks.q_sections_chunks import any_sql
from docloom.checks.registry import query
from docloom.fixed import FOCUSED_TYPES
from docloom.operators import lexicon as L
from docloom.operators import retrieval as R
from docloom.plans.stage import cut, stage_root
from docloom.sources.snapshots import read_snapshot

COVER_SQL = PAGES_SQL + """,
cover AS (SELECT doc_id, trim(substr(coalesce(string_agg('--- Page ' || page_number || ' ---' || chr(10) || trim(text, chr(10) || ' '), chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE trim(text, chr(10) || ' ') <> ''), ''), 1, 12000)) AS cover
  FROM page_rows WHERE page_number <= 3 GROUP BY 1)"""


def covers(t):
    return L.cover_text(as_pages(t.documents), as_chunks(t.documents), limits=LIM)


@query("lx1_cover_text", f"WITH {COVER_SQL} SELECT doc_id, cover FROM cover")
def _(t):
    return covers(t).withColumn("cover", F.trim("cover"))


def class_sql(text: str, table, default: str) -> str:
    def hit(m):
        esc = "".join("\\" + c if c in "./-'+" else c for c in m).replace("'", "''")
        left = "(^|[^\\p{L}\\p{N}_])" if m[0].isalnum() else ""
        right = "($|[^\\p{L}\\p{N}_])" if m[-1].isalnum() else "[\\p{L}\\p{N}_]"
        return f"CAST(regexp_matches({text}, '{left}{esc}{right}') AS INTEGER)"
    scores = {k: "(" + " + ".join(hit(m) for m in ms) + ")" for k, ms in table.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    return f"CASE WHEN {best} = 0 THEN '{default}' " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in scores.items()) + " END"


# the labels of the derived facts decide the class here: short texts keep the restatement readable
@query("lx2_classify_documents", f"""WITH {BLOCKS_SQL}, c AS (SELECT doc_id, lower(string_agg(CASE k WHEN 0 THEN 'The RFQ follows naics and sealed bids' WHEN 2 THEN 'bidders send sealed bids by hvac'
   WHEN 5 THEN 'Request for proposal, wi-fi and LAN' WHEN 8 THEN 'prequalification of a far site' ELSE fact END || chr(10) || body, chr(10) ORDER BY b)) AS x FROM blocks GROUP BY 1)
SELECT doc_id, {class_sql('x', L.SOLICITATION_MARKERS, 'unknown')} AS solicitation_type, {class_sql('x', L.DOMAIN_MARKERS, 'general')} AS domain FROM c""")
def _(t):
    from docloom.checks.adapters import as_blocks
    from docloom.functions.text import ordered_join
    k = F.col("k")
    line = F.when(k == 0, "The RFQ follows naics and sealed bids").when(k == 2, "bidders send sealed bids by hvac").when(k == 5, "Request for proposal, wi-fi and LAN").when(k == 8, "prequalification of a far site").otherwise(F.col("fact"))
    c = as_blocks(t.documents).groupBy("doc_id").agg(ordered_join(F.collect_list(F.struct("b", F.concat(line, F.lit("\n"), "body").alias("text"))), "\n").alias("cover"))
    return L.classify_documents(c)


@query("lx3_mine_terms")
def _(t):
    return L.mined_terms(covers(t), "cover", LIM.mined_terms)


def mined(t):
    """Facts as mined terms, one per block."""
    return as_items(t.documents).select("doc_id", F.col("item_seq").alias("term_seq"), F.col("requirement").alias("term"))


MINED_SQL = ITEMS_SQL + ", mined AS (SELECT doc_id, item_seq AS term_seq, requirement AS term FROM items)"
ROUTED_SQL = MINED_SQL + f""", th AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {any_sql('lower(term)', L.HOOKS[t])} THEN '{t}' END" for t in FOCUSED_TYPES)}], lambda x: x IS NOT NULL) AS ts FROM mined),
routed AS (SELECT doc_id, term_seq, term, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE {sql_list(FOCUSED_TYPES)} END) AS extraction_type FROM th)"""


@query("lx4_route_terms", f"WITH {ROUTED_SQL} SELECT * FROM routed")
def _(t):
    return L.route_terms(mined(t))


@query("lx5_document_lexicon", f"""WITH {ROUTED_SQL}, {LEXICON_SQL},
ld AS (SELECT *, row_number() OVER (PARTITION BY extraction_type, entry_kind ORDER BY hit_count DESC, term_display, term_normalized) AS r FROM lex WHERE is_active QUALIFY r <= 60),
d AS (SELECT DISTINCT doc_id FROM mined), ty AS (SELECT unnest({sql_list(FOCUSED_TYPES)}) AS extraction_type),
tt AS (SELECT d.doc_id, ld.extraction_type, term_display AS term, 0 AS g, r AS o FROM d, ld WHERE entry_kind = 'term' UNION ALL SELECT doc_id, extraction_type, term, 1, term_seq FROM routed),
tk AS (SELECT doc_id, extraction_type, trim(term) AS term, min((g, o)) AS o FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, extraction_type, lower(trim(term)) ORDER BY g, o) AS rn FROM tt WHERE length(trim(term)) >= 3) WHERE rn = 1 GROUP BY 1, 2, 3),
gl AS (SELECT doc_id, string_agg(trim(term), '|' ORDER BY term_seq) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(term)) ORDER BY term_seq) AS rn FROM mined) WHERE rn = 1 GROUP BY 1),
ql AS (SELECT extraction_type, string_agg(term_display, '|' ORDER BY r) AS q FROM ld WHERE entry_kind = 'query' AND length(term_display) >= 8 GROUP BY 1),
ta AS (SELECT doc_id, extraction_type, string_agg(term, '|' ORDER BY o) AS ts FROM tk GROUP BY 1, 2)
SELECT d.doc_id, ty.extraction_type, gl.g AS global_terms, coalesce(ta.ts, '') AS typed_terms, coalesce(ql.q, '') AS queries
FROM d CROSS JOIN ty LEFT JOIN gl ON gl.doc_id = d.doc_id LEFT JOIN ta ON ta.doc_id = d.doc_id AND ta.extraction_type = ty.extraction_type LEFT JOIN ql ON ql.extraction_type = ty.extraction_type""")
def _(t):
    out = L.document_lexicon(mined(t), L.load_lexicon(lexicon(t), LIM.lexicon_terms))
    return out.withColumns({c: F.array_join(c, "|") for c in ("global_terms", "typed_terms", "queries")})


LOADED_SQL = LEXICON_SQL + """,
loaded AS (SELECT *, row_number() OVER (PARTITION BY extraction_type, entry_kind ORDER BY hit_count DESC, term_display, term_normalized) AS rank FROM lex WHERE is_active QUALIFY rank <= 60)"""


@query("lx6_load_lexicon", f"WITH {LOADED_SQL} SELECT extraction_type, entry_kind, term_display, rank FROM loaded")
def _(t):
    return L.load_lexicon(lexicon(t), LIM.lexicon_terms).select("extraction_type", "entry_kind", "term_display", "rank")


@query("lx7_cache_sufficient", f"""WITH {LEXICON_SQL}, ty AS (SELECT unnest({sql_list(FOCUSED_TYPES)}) AS extraction_type),
c AS (SELECT ty.extraction_type, count(lex.term_normalized) AS n FROM ty LEFT JOIN lex ON lex.extraction_type = ty.extraction_type AND is_active AND entry_kind = 'term' GROUP BY 1) SELECT bool_and(n >= 8) AS sufficient FROM c""")
def _(t):
    return L.cache_sufficient(lexicon(t))


def part_lexicon(t):
    """A vocabulary that knows the owner facts of the documents."""
    known = as_items(t.documents).where("label in ('owner', 'project_value')").groupBy("extraction_type", F.lower("requirement").alias("term_normalized")).agg(F.count("*").alias("hit_count"))
    return known.select("extraction_type", F.lit("term").alias("entry_kind"), "term_normalized", F.initcap("term_normalized").alias("term_display"), "hit_count",
                        F.lit(1).alias("document_count"), F.lit(True).alias("is_active"), F.lit("heuristic").alias("source"), F.lit("2024-01-01").cast("timestamp_ntz").alias("last_seen_at"))


KNOWN_LEX_SQL = """
klex AS (SELECT extraction_type, lower(requirement) AS term_normalized, count(*) AS hit_count FROM items WHERE label IN ('owner', 'project_value') GROUP BY 1, 2)"""


@query("lx8_novel_terms", f"WITH {ITEMS_SQL}, {KNOWN_LEX_SQL} SELECT doc_id, item_seq AS term_seq, requirement AS term FROM items WHERE item_seq < 30 AND trim(regexp_replace(lower(requirement), '\\s+', ' ', 'g')) NOT IN (SELECT term_normalized FROM klex)")
def _(t):
    return L.novel_terms(mined(t), part_lexicon(t), LIM.novel_terms).drop("norm")


@query("lx8_skip_vocabulary_pass", f"""WITH {ITEMS_SQL}, {KNOWN_LEX_SQL}, {LEXICON_SQL}, ok AS (SELECT bool_and(n >= 8) AS s FROM (SELECT extraction_type, count(*) FILTER (WHERE is_active AND entry_kind = 'term') AS n FROM lex GROUP BY 1)),
nv AS (SELECT DISTINCT doc_id FROM items WHERE item_seq < 30 AND trim(regexp_replace(lower(requirement), '\\s+', ' ', 'g')) NOT IN (SELECT term_normalized FROM klex))
SELECT d.doc_id, (SELECT s FROM ok) AND nv.doc_id IS NULL AS skip FROM (SELECT doc_id FROM documents) d LEFT JOIN nv USING (doc_id)""")
def _(t):
    return L.skip_vocabulary_pass(t.documents, mined(t), lexicon(t), part_lexicon(t), LIM.novel_terms)


@query("lx9_record_terms", f"""WITH {ITEMS_SQL}, {KNOWN_LEX_SQL},
n AS (SELECT extraction_type, trim(regexp_replace(lower(requirement), '\\s+', ' ', 'g')) AS tn, count(*) AS uses, arg_max(trim(requirement), (doc_id * 1000 + item_seq, trim(requirement))) AS d FROM items WHERE length(trim(requirement)) >= 3 GROUP BY 1, 2)
SELECT coalesce(k.extraction_type, n.extraction_type) AS extraction_type, coalesce(k.term_normalized, n.tn) AS term_normalized, coalesce(k.hit_count, 0) + coalesce(uses, 0) AS hit_count, substr(d, 1, 512) AS term_display
FROM klex k FULL JOIN n ON k.extraction_type = n.extraction_type AND k.term_normalized = n.tn""")
def _(t):
    new = as_items(t.documents).select("extraction_type", F.col("requirement").alias("term"), F.lit("heuristic").alias("source"),
                                       F.timestamp_micros(F.col("doc_id") * 1000 + F.col("item_seq")).cast("timestamp_ntz").alias("seen_at"))
    lex = part_lexicon(t).withColumn("term_display", F.lit(None).cast("string"))
    return L.record_terms(lex, new, "term", limits=LIM).select("extraction_type", "term_normalized", "hit_count", "term_display")


@query("lx10_persist_lexicon")
def _(t):
    lex = lexicon(t).withColumn("source", F.lit("heuristic")).withColumn("last_seen_at", F.lit("2024-01-01").cast("timestamp"))
    return L.persist_lexicon(lex, cut(L.document_lexicon(mined(t), L.load_lexicon(lex, LIM.lexicon_terms))), "2024-02-01 00:00:00", LIM).drop("last_seen_at")


def hits(t):
    """Chunk scores per document and type."""
    c = as_chunks(t.documents)
    return c.select("doc_id", "chunk_id", "chunk_order", F.explode(F.array(*[F.lit(x) for x in FOCUSED_TYPES])).alias("extraction_type")).withColumn(
        "score", ((F.col("doc_id") * 7 + F.col("chunk_order") * 13 + F.length("extraction_type")) % 50) / 50)


HITS_SQL = CHUNKS_SQL + f""",
hits AS (SELECT doc_id, chunk_id, chunk_order, et AS extraction_type, ((doc_id * 7 + chunk_order * 13 + length(et)) % 50) / 50 AS score FROM (SELECT *, unnest({sql_list(FOCUSED_TYPES)}) AS et FROM chunks))"""


@query("lx11_enrich_from_hits")
def _(t):
    return L.enrich_from_hits(hits(t), as_chunks(t.documents), limits=LIM)


def classes(t):
    return t.documents.select("doc_id", F.when(F.col("lang") == "en", "it_network").otherwise("general").alias("domain"),
                              F.when(F.col("source") < "src5", "federal_rfq").when(F.col("lang") == "de", "state_ifb").otherwise("rfp").alias("solicitation_type"))


_OV = " UNION ALL ".join(f"SELECT {i} AS seq, '{a}' AS axis, '{v}' AS v, '{t}' AS extraction_type, '{q}' AS query" for i, (a, v, t, q) in enumerate(L.OVERRIDES))


@query("lx12_route_queries", f"""WITH c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'it_network' ELSE 'general' END AS domain, CASE WHEN source < 'src5' THEN 'federal_rfq' WHEN lang = 'de' THEN 'state_ifb' ELSE 'rfp' END AS st FROM documents), o AS ({_OV})
SELECT doc_id, extraction_type, query, CAST(seq AS BIGINT) AS seq FROM c JOIN o ON (axis = 'domain' AND v = domain) OR (axis = 'solicitation_type' AND v = st)""")
def _(t):
    return L.route_queries(classes(t))


@query("lx12_route_queries_off", f"WITH o AS ({_OV}) SELECT doc_id, extraction_type, query, CAST(seq AS BIGINT) AS seq FROM documents CROSS JOIN o")
def _(t):
    return L.route_queries(classes(t), routing=False)


_ST = " UNION ALL ".join(f"SELECT '{t}' AS extraction_type, {i} AS i, '{q}' AS q" for t, qs in L.STATIC_QUERIES.items() for i, q in enumerate(qs))


@query("lx13_queries_for_types", f"""WITH {MINED_SQL}, st AS ({_ST}), {LEXICON_SQL},
ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extraction_type ORDER BY hit_count DESC, term_display, term_normalized) AS r FROM lex WHERE is_active AND entry_kind = 'query') WHERE r <= 60 AND length(term_display) >= 8),
g AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY term_seq) AS o FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(term)) ORDER BY term_seq) AS rn FROM mined) WHERE rn = 1),
docs6 AS (SELECT doc_id, string_agg(trim(term), ' ' ORDER BY o) AS tq, count(*) AS n FROM g WHERE o <= 6 GROUP BY 1)
SELECT d.doc_id, st.extraction_type, q AS query FROM docs6 d CROSS JOIN st UNION ALL SELECT d.doc_id, ld.extraction_type, term_display FROM docs6 d CROSS JOIN ld
UNION ALL SELECT doc_id, ty, tq FROM docs6 CROSS JOIN (SELECT unnest({sql_list(FOCUSED_TYPES)}) AS ty)""")
def _(t):
    return L.queries_for_types(L.document_lexicon(mined(t), L.load_lexicon(lexicon(t).where("entry_kind = 'query'"), LIM.lexicon_terms)), LIM).drop("query_seq")


@query("lx14_unknown_labels", f"WITH {ITEMS_SQL} SELECT label, count(*) AS n FROM items WHERE label NOT IN ('project_name', 'owner') GROUP BY 1")
def _(t):
    return L.unknown_labels(as_items(t.documents), ["project_name", "owner"])


# ---- retrieval

def vectors(t):
    return t.embeddings.select(F.col("label").cast("bigint").alias("doc_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("chunk_order"), "embedding")


def vec_queries(t):
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return t.embeddings.join(first, ["label", "vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("doc_id"), "embedding")


DENSE_SQL = """
v AS (SELECT CAST(label AS BIGINT) AS doc_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT doc_id, vec_id AS query_id, e FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) = 1),
s AS (SELECT q.query_id, v.doc_id, v.vec_id AS chunk_id, greatest(0.0, list_cosine_similarity(q.e, v.e)) AS raw FROM q JOIN v USING (doc_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rn, max(raw) OVER (PARTITION BY query_id) AS best FROM s)"""


@query("rt1_dense_topk", f"WITH {DENSE_SQL} SELECT query_id, doc_id, chunk_id, chunk_id AS chunk_order, round(raw, 4) AS score FROM top WHERE rn <= 12 AND (raw >= 0.18 OR best < 0.18)")
def _(t):
    return R.dense_topk(vec_queries(t), vectors(t), 12, 0.18)


@query("rt2_merge_query_hits", f"""WITH {HITS_SQL}, m AS (SELECT doc_id, chunk_id, max(score) AS score, min(chunk_order) AS chunk_order FROM hits GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_order, chunk_id) AS rank FROM m QUALIFY rank <= 8""")
def _(t):
    return R.merge_query_hits(hits(t), 8, keys=("doc_id",))


def chat_queries(t):
    c = t.conversations
    return c.where("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("conv_id").alias("doc_id"),
        F.concat(F.when(F.col("turn") % 4 == 0, "When is the Pre-Bid? ").when(F.col("turn") % 4 == 2, "Which deadline? ").otherwise(""), F.trim("text")).alias("query"))


CHATQ_SQL = """
cq AS (SELECT conv_id || '-' || turn AS query_id, conv_id AS doc_id, CASE turn % 4 WHEN 0 THEN 'When is the Pre-Bid? ' WHEN 2 THEN 'Which deadline? ' ELSE '' END || trim(text) AS query FROM conversations WHERE role = 'user')"""


@query("rt3_expand_queries", f"""WITH {CHATQ_SQL} SELECT query_id, doc_id, CAST(0 AS BIGINT) AS variant, query FROM cq WHERE query <> ''
UNION ALL SELECT query_id, doc_id, CAST(v AS BIGINT), p FROM cq, (SELECT unnest([1, 2]) AS v, unnest({sql_list(R.EXPANSIONS)}) AS p) WHERE {any_sql('lower(query)', R.EXPANSION_KEYS)}""")
def _(t):
    return R.expand_queries(chat_queries(t))


PINS_SQL = CHATQ_SQL + "," + CHUNKS_SQL + f""",
st AS (SELECT doc_id, min(chunk_order) AS stop FROM chunks WHERE chunk_type = 'schedule_table' GROUP BY 1),
pins AS (SELECT query_id, c.doc_id, chunk_id, chunk_order, 0.5::DOUBLE AS score FROM cq JOIN chunks c USING (doc_id) LEFT JOIN st USING (doc_id)
  WHERE {any_sql('lower(query)', R.TIMELINE_MARKERS)} AND (chunk_type IN ('schedule_table') OR (chunk_type = 'cover_metadata' AND page_start <= 3)
   OR (page_start = 1 AND (contains(lower(chunk_text), 'issue date') OR contains(lower(chunk_text), 'bid period')))) AND (stop IS NULL OR chunk_order <= stop))"""


@query("rt4_timeline_pins", f"WITH {PINS_SQL} SELECT * FROM pins")
def _(t):
    return R.timeline_pins(chat_queries(t), as_chunks(t.documents))


def chat_hits(t):
    return chat_queries(t).join(as_chunks(t.documents).select("doc_id", "chunk_id", "chunk_order"), "doc_id").where(
        "(doc_id + chunk_order) % 3 <> 0").select("query_id", "doc_id", "chunk_id", "chunk_order", ((F.col("chunk_order") * 17 % 100) / 100).alias("score"))


CHATHITS_SQL = PINS_SQL + ", ch AS (SELECT query_id, doc_id, chunk_id, chunk_order, (chunk_order * 17 % 100) / 100 AS score FROM cq JOIN chunks USING (doc_id) WHERE (doc_id + chunk_order) % 3 <> 0)"


@query("rt5_merge_pins_override", f"""WITH {CHATHITS_SQL} SELECT query_id, doc_id, chunk_id, max(chunk_order) AS chunk_order, max(score) AS score FROM (SELECT * FROM ch UNION ALL SELECT * FROM pins) GROUP BY 1, 2, 3""")
def _(t):
    return R.merge_pins(chat_hits(t), R.timeline_pins(chat_queries(t), as_chunks(t.documents)))


@query("rt5_merge_pins_additive", f"""WITH {CHATHITS_SQL}, lo AS (SELECT query_id, min(score) AS lo FROM ch GROUP BY 1)
SELECT * FROM ch UNION ALL SELECT p.query_id, p.doc_id, p.chunk_id, p.chunk_order, CASE WHEN coalesce(lo, 0) > 0 THEN lo * 0.5 ELSE 0.000001 END FROM pins p LEFT JOIN lo USING (query_id)
WHERE (p.query_id, p.chunk_id) NOT IN (SELECT query_id, chunk_id FROM ch)""")
def _(t):
    return R.merge_pins(chat_hits(t), R.timeline_pins(chat_queries(t), as_chunks(t.documents)), "additive")


@query("rt6_retrieve", f"""WITH {DENSE_SQL}, h AS (SELECT query_id, doc_id, chunk_id, round(raw, 4) AS score FROM top WHERE rn <= 8),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS rank, count(*) FILTER (WHERE score >= 0.25) OVER (PARTITION BY query_id) AS n FROM h)
SELECT query_id, doc_id, chunk_id, chunk_id AS chunk_order, score, rank FROM f WHERE (n > 0 AND score >= 0.25) OR (n = 0 AND rank <= 3)""")
def _(t):
    q = vec_queries(t)
    chunks = vectors(t).select("doc_id", "chunk_id", "chunk_order", F.lit(9).alias("page_start"), F.lit("").alias("chunk_text"), F.lit("general_section").alias("chunk_type"))
    return R.retrieve(q.select("query_id", "doc_id", F.lit("plain").alias("query")), q.withColumn("variant", F.lit(0)), chunks, vectors(t), 8, 0.25).select(
        "query_id", "doc_id", "chunk_id", "chunk_order", "score", "rank")


def search_chunks(t):
    """All documents as chunks; vectors are dealt to them in turn, and the vector's label groups them."""
    vectors = t.embeddings.agg(F.count("*")).scalar()
    return t.documents.withColumn("at", F.pmod("doc_id", vectors)).join(t.embeddings, F.col("at") == F.col("vec_id")).select(
        F.col("label").cast("bigint").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_order"), F.col("text").alias("chunk_text"),
        F.col("source").alias("section_title"), F.array("lang").alias("tags"), "embedding")


def search_queries(t):
    return t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("doc_id"), F.col("text").alias("query"), "embedding")


TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
BM25_SQL = f"""
sc AS (SELECT CAST(label AS BIGINT) AS doc_id, doc_id AS chunk_id, {TOK.format("text || ' ' || source || ' ' || lang")} AS toks, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON doc_id % (SELECT count(*) FROM embeddings) = vec_id),
qq AS (SELECT item_id AS query_id, item_id % 10 AS doc_id, list_distinct({TOK.format('text')}) AS ts, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON item_id = vec_id),
qt AS (SELECT query_id, doc_id, unnest(ts) AS term FROM qq), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM sc),
tf AS (SELECT doc_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, len(toks) AS dl, unnest(toks) AS term FROM sc) GROUP BY 1, 2, 3, 4), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (doc_id, term) JOIN df USING (term), st GROUP BY 1, 2, 3)"""


@query("rt7_bm25", f"WITH {BM25_SQL} SELECT query_id, doc_id, chunk_id, chunk_id AS chunk_order, score FROM bm")
def _(t):
    return R.bm25(search_queries(t), search_chunks(t))


HYBRID_SQL = BM25_SQL + """,
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r FROM bm QUALIFY r < 16),
dn AS (SELECT query_id, sc.doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, chunk_id) - 1 AS r FROM (
   SELECT query_id, sc.doc_id, chunk_id, greatest(0.0, list_cosine_similarity(qq.e, sc.e)) AS raw FROM qq JOIN sc USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) <= 16) sc),
fu AS (SELECT query_id, doc_id, chunk_id, round(sum(1.0 / (60 + r + 1)), 6) AS score FROM (SELECT query_id, doc_id, chunk_id, r FROM kw UNION ALL SELECT query_id, doc_id, chunk_id, r FROM dn) GROUP BY 1, 2, 3)"""


@query("rt7_stored_index", f"WITH {BM25_SQL} SELECT query_id, doc_id, chunk_id, chunk_id AS chunk_order, score FROM bm")
def _(t):
    # the index grows in two batches of documents, and part of the first comes again with the second
    chunks, path = search_chunks(t), f"{stage_root(t.spark)}/index-{uuid.uuid4().hex}"
    R.index_chunks(chunks.where(F.col("doc_id") % 3 != 0), path, buckets=16)
    R.index_chunks(chunks.where(F.col("doc_id") % 3 != 1), path, buckets=16)
    return R.bm25_search(search_queries(t), read_snapshot(t.spark, path))


@query("rt7_hybrid_search", f"WITH {HYBRID_SQL} SELECT query_id, doc_id, chunk_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM fu QUALIFY rank < 16")
def _(t):
    return R.hybrid_search(search_queries(t), search_chunks(t), search_chunks(t)).select("query_id", "doc_id", "chunk_id", "score", "rank")


@query("rt8_rrf", f"""WITH {HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY score DESC, chunk_order) - 1 AS rank FROM hits)
SELECT doc_id, chunk_id, round(sum((length(extraction_type) % 3 + 1) / (60 + rank + 1)), 6) AS score FROM r GROUP BY 1, 2""")
def _(t):
    r = R.ranked(hits(t), keys=("doc_id", "extraction_type")).withColumn("weight", (F.length("extraction_type") % 3 + 1).cast("double"))
    return R.rrf(r, ("doc_id", "chunk_id")).withColumn("score", F.round("score", 6))


@query("rt10_prefer_rerank", f"""WITH {HITS_SQL}, p AS (SELECT doc_id, extraction_type, chunk_id, chunk_order, CASE WHEN chunk_order % 2 = 0 THEN chunk_order / 100 ELSE score END AS score FROM hits)
SELECT doc_id, extraction_type, chunk_id, score, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY score DESC, chunk_order, chunk_id) - 1 AS rank FROM p""")
def _(t):
    h = hits(t).withColumn("query_id", F.concat_ws("-", F.col("doc_id").cast("string"), "extraction_type")).withColumn("rerank_score", F.when(F.col("chunk_order") % 2 == 0, F.col("chunk_order") / 100))
    return R.prefer_rerank(h).select("doc_id", "extraction_type", "chunk_id", "score", "rank")


KW = R.default_keywords()


def score_sql(etype: str) -> str:
    x = "lower(section_title || ' ' || chunk_text)"
    n = "(" + (" + ".join(f"CAST(contains({x}, '{w}') AS INTEGER)" for w in KW[etype]) or "0") + ")"
    tags = " + ".join(
        f"CASE WHEN contains(' ' || tags || ' ', ' {g} ') AND ({n} > 0 OR {str(any(w in g for w in KW[etype])).lower()}) THEN 2 ELSE 0 END" for g in ("deadline", "payment", "risk"))
    boost = " ".join(f"WHEN '{c}' THEN {b}" for c, b in R.BOOSTS.get(etype, {}).items())
    return f"CAST({n} + {tags} + {f'CASE chunk_type {boost} ELSE 0 END' if boost else '0'} AS DOUBLE)"


SCORES_SQL = CHUNKS_SQL + ", sco AS (" + " UNION ALL ".join(f"SELECT doc_id, chunk_id, chunk_order, '{t}' AS extraction_type, {score_sql(t)} AS score FROM chunks" for t in FOCUSED_TYPES) + ")"
BROAD = "extraction_type <> 'submission_deadlines'"
TOPK_SQL = SCORES_SQL + f", tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY score DESC, chunk_order) AS rn FROM sco WHERE score > 0 QUALIFY rn <= CASE WHEN {BROAD} THEN 14 ELSE 10 END)"


@query("rt11_keyword_select", f"WITH {TOPK_SQL} SELECT * FROM tk")
def _(t):
    return R.keyword_select(R.keyword_scores(as_chunks(t.documents), KW))


FILL_SQL = TOPK_SQL + f""",
ty AS (SELECT unnest({sql_list(FOCUSED_TYPES)}) AS extraction_type), cn AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1),
hv AS (SELECT doc_id, extraction_type, count(*) AS h FROM tk GROUP BY 1, 2),
wn AS (SELECT cn.doc_id, ty.extraction_type, n, CASE WHEN {BROAD.replace('extraction_type', 'ty.extraction_type')} THEN 8 ELSE 4 END - coalesce(h, 0) AS want FROM cn CROSS JOIN ty LEFT JOIN hv ON hv.doc_id = cn.doc_id AND hv.extraction_type = ty.extraction_type),
pl AS (SELECT w.doc_id, w.extraction_type, want, c.chunk_order, row_number() OVER (PARTITION BY w.doc_id, w.extraction_type ORDER BY c.chunk_order) - 1 AS idx, count(*) OVER (PARTITION BY w.doc_id, w.extraction_type) AS sz
  FROM wn w JOIN chunks c USING (doc_id) WHERE want > 0 AND (w.doc_id, w.extraction_type, c.chunk_order) NOT IN (SELECT doc_id, extraction_type, chunk_order FROM tk)),
ix AS (SELECT DISTINCT doc_id, extraction_type, i, CASE WHEN sz <= want THEN i ELSE CAST(floor(i * (sz / want)) AS BIGINT) END AS idx FROM (SELECT DISTINCT doc_id, extraction_type, sz, want, unnest(range(0, least(sz, want))) AS i FROM pl)),
fl AS (SELECT pl.doc_id, pl.extraction_type, i AS fill_seq, chunk_order FROM pl JOIN ix USING (doc_id, extraction_type, idx))"""


@query("rt12_stratified_fill", f"WITH {FILL_SQL} SELECT * FROM fl")
def _(t):
    c = as_chunks(t.documents)
    return R.stratified_fill(R.keyword_select(R.keyword_scores(c, KW)), c.groupBy("doc_id").agg(F.count("*").alias("n")))


OP_SQL = any_sql("lower(section_title || ' ' || chunk_text)", R.OPERATIONAL_MARKERS)
PIN_IN = "('scope_of_work', 'technical_requirements')"


def listed_sql(src: str, name: str) -> str:
    return f"""{name}p AS (SELECT doc_id, chunk_order, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order) AS r FROM opc),
{name}a AS (SELECT s.doc_id, s.extraction_type, s.chunk_order, s.pos FROM {src} s UNION ALL SELECT doc_id, t, chunk_order, r - 1000 FROM {name}p, (SELECT unnest(['scope_of_work', 'technical_requirements']) AS t) WHERE r <= 14),
{name}b AS (SELECT doc_id, extraction_type, chunk_order, min(pos) AS pos FROM {name}a GROUP BY 1, 2, 3),
{name}c AS (SELECT *, (doc_id, chunk_order) IN (SELECT doc_id, chunk_order FROM opc) AS op, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY pos) AS rn FROM {name}b),
{name} AS (SELECT doc_id, extraction_type, chunk_order, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY CASE WHEN extraction_type IN {PIN_IN} AND op THEN 0 ELSE 1 END, chunk_order) AS position FROM {name}c
  WHERE rn <= CASE WHEN {BROAD} THEN 14 ELSE 10 END)"""


SELECT_SQL = FILL_SQL + f""", opc AS (SELECT doc_id, chunk_order FROM chunks WHERE {OP_SQL}),
sel0 AS (SELECT doc_id, extraction_type, chunk_order, rn AS pos FROM tk UNION ALL SELECT doc_id, extraction_type, chunk_order, fill_seq + 100 FROM fl), """ + listed_sql("sel0", "kws")


@query("rt13_pin_operational", f"WITH {SELECT_SQL} SELECT * FROM kws")
def _(t):
    return R.keyword_chunks(as_chunks(t.documents), KW)


FUSE_SQL = SELECT_SQL + f""", {HITS_SQL.split(",", 0)[0].replace(CHUNKS_SQL, '').lstrip(',')},
hy AS (SELECT *, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY score DESC, chunk_order) - 1 AS rank FROM hits WHERE score >= 0.5),
rf AS (SELECT doc_id, extraction_type, chunk_order, sum(1.0 / (60 + rank + 1)) AS score FROM (SELECT doc_id, extraction_type, chunk_order, position - 1 AS rank FROM kws UNION ALL SELECT doc_id, extraction_type, chunk_order, rank FROM hy) GROUP BY 1, 2, 3),
fz AS (SELECT *, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY round(CAST(score AS DOUBLE), 12) DESC, chunk_order) AS pos FROM rf WHERE (doc_id, extraction_type) IN (SELECT doc_id, extraction_type FROM hy) QUALIFY pos <= CASE WHEN {BROAD} THEN 14 ELSE 10 END),
fused AS (SELECT doc_id, extraction_type, chunk_order, row_number() OVER (PARTITION BY doc_id, extraction_type ORDER BY chunk_order) AS position FROM fz
  UNION ALL SELECT doc_id, extraction_type, chunk_order, position FROM kws WHERE (doc_id, extraction_type) NOT IN (SELECT doc_id, extraction_type FROM hy))"""


@query("rt9_fuse_selections", f"WITH {FUSE_SQL} SELECT * FROM fused")
def _(t):
    h = hits(t).where("score >= 0.5")
    return R.fuse_selections(R.keyword_chunks(as_chunks(t.documents), KW), h).drop("pos")


@query("rt14_select_chunks", f"WITH {FUSE_SQL}, fs AS (SELECT doc_id, extraction_type, chunk_order, position AS pos FROM fused), " + listed_sql("fs", "fin") + " SELECT * FROM fin")
def _(t):
    return R.select_chunks(as_chunks(t.documents), KW, hits(t).where("score >= 0.5"))


def _squeeze_sql(side: str) -> str:
    return rf"trim(regexp_replace(substr(text, greatest(at0 - {side}, 0) + 1, at0 - greatest(at0 - {side}, 0) + n + {side}), '{WS_SQL}+', ' ', 'g'))"


WIDER_SQL = FILL_SQL.replace("THEN 14 ELSE 10", "THEN 28 ELSE 20").replace("THEN 8 ELSE 4", "THEN 16 ELSE 8")


@query("rt15_wider_selection", f"WITH {WIDER_SQL} SELECT doc_id, extraction_type, chunk_order, rn AS pos FROM tk UNION ALL SELECT doc_id, extraction_type, chunk_order, fill_seq + 1000 FROM fl")
def _(t):
    return R.wider_selection(as_chunks(t.documents), KW)


@query("rt16_context_text", f"WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN chunk_order % 2 = 0 THEN chunk_text || section_title ELSE chunk_text END AS text FROM chunks")
def _(t):
    parent = F.when(F.col("chunk_order") % 2 == 0, F.concat("chunk_text", "section_title")).otherwise("x")
    return as_chunks(t.documents).withColumn("parent", parent).select("chunk_id", R.context_text("parent", "chunk_text").alias("text"))


TRIM_WORDS = ["bid", "ing", "que"]


@query("rt17_trim_paragraphs", f"""WITH p0 AS (SELECT doc_id, text, t2, unnest(string_split(t2, chr(10) || chr(10))) AS p, unnest(range(0, len(string_split(t2, chr(10) || chr(10))))) AS i FROM (SELECT doc_id, text, replace(text, chr(10), chr(10) || chr(10)) AS t2 FROM documents)),
p1 AS (SELECT doc_id, t2, trim(p) AS p, i, CASE WHEN {any_sql('lower(trim(p))', TRIM_WORDS)} THEN 0 ELSE 1 END AS g FROM p0 WHERE trim(p) <> ''),
p2 AS (SELECT *, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY g, i) AS total FROM p1),
p3 AS (SELECT *, max(CASE WHEN total > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g, i) AS stopped FROM p2),
p4 AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY g, i) AS x FROM p3 WHERE stopped = 0 GROUP BY 1)
SELECT d.doc_id, CASE WHEN length(t2) <= 900 THEN t2 ELSE coalesce(x, substr(t2, 1, 900)) END AS text FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t2 FROM documents) d LEFT JOIN p4 USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t2")).select("doc_id", R.trim_paragraphs("t2", TRIM_WORDS, 900).alias("text"))


@query("rt18_batch_requests", f"""WITH {SELECT_SQL}, j AS (SELECT kws.*, (position - 1) // 3 AS batch_no, c.chunk_id, c.page_start, c.page_end, c.section_title, '=== Section: ' || section_title || ' (pages ' || page_start || '-' || page_end || ') ===' || chr(10) || chunk_text AS text
   FROM kws JOIN chunks c USING (doc_id, chunk_order))
SELECT doc_id, extraction_type, batch_no, string_agg(text, chr(10) || chr(10) ORDER BY position) AS prompt, string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids,
  arg_min(section_title, position) || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' more)' ELSE '' END AS section_label, min(page_start) AS page_start, max(page_end) AS page_end,
  CASE WHEN extraction_type IN ('technical_requirements', 'set_asides') THEN 'fast' WHEN extraction_type = 'payment_terms' THEN 'ft-1' ELSE 'strong' END AS model FROM j GROUP BY 1, 2, 3""")
def _(t):
    c = as_chunks(t.documents)
    return R.batch_requests(R.keyword_chunks(c, KW), c, finetuned={"payment_terms": "ft-1"}).drop("first_title", "n_chunks")


@query("rt22_trim_middle", """SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 5200) || '|...|' || substr(text, length(text) - 2795 + 1) END AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", R.trim_middle("text", 8000, "|...|").alias("text"))


@query("rt24_keyword_search", rf"""WITH {PAGES_SQL}, h AS (SELECT doc_id, page_number, text, regexp_extract_all(text, '(?i)bid|project|the') AS hs, regexp_split_to_array(text, '(?i)bid|project|the') AS gs FROM page_rows),
e AS (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM h),
p AS (SELECT doc_id, page_number, i - 1 AS seq, hs[i] AS term, length(hs[i]) AS n, text, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS at0 FROM e)
SELECT doc_id, page_number, seq, term, {_squeeze_sql('45')} AS snippet, {_squeeze_sql('15')} AS anchor, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, seq) AS rn FROM p QUALIFY rn <= 300""")
def _(t):
    return R.keyword_search(as_pages(t.documents), ["bid", "project", "the"], 300)


@query("rt25_keyword_map", """SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'own:' || c_name || ':a,b' ELSE 'd1:One:x,y;d2:Two:z' END AS map, c_mktsegment = 'BUILDING' AS customised FROM customer""")
def _(t):
    e = lambda i, l, k: F.struct(F.lit(i).alias("id"), l.alias("label"), k.alias("keywords"))
    none = F.array().cast("array<struct<id:string,label:string,keywords:array<string>>>")
    own = F.array(e(" own ", F.col("c_name"), F.array(F.lit(" a"), F.lit(""), F.lit("b"))), e("", F.lit("x"), F.array(F.lit("q"))))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", own).otherwise(none).alias("keyword_map"))
    out = R.keyword_map(users, [("d1", "One", ["x", "y"]), ("d2", "Two", ["z"])])
    return out.select("user_id", F.array_join(F.transform("keyword_map", lambda m: F.concat_ws(":", m["id"], m["label"], F.array_join(m["keywords"], ","))), ";").alias("map"), "customised")


def index_tables(t):
    c = as_chunks(t.documents).select("doc_id", "chunk_id", "chunk_order", F.when(F.col("chunk_order") % 3 == 0, "p").otherwise("").alias("prefix"))
    n = c.groupBy("doc_id").agg(F.count("*").alias("chunk_count")).join(t.labels, "doc_id")
    index = n.select("doc_id", (F.col("chunk_count") + F.col("toxic")).alias("chunk_count"), F.when(F.col("quality") == 1, "a").otherwise("b").alias("backend"))
    old = c.join(t.labels, "doc_id", "left_semi").select("doc_id", F.when(F.col("chunk_order") == 2, "gone").otherwise(F.col("chunk_id")).alias("chunk_id"))
    return c, index, old


INDEX_SQL = CHUNKS_SQL + """, cn AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1),
idx AS (SELECT doc_id, n + toxic AS chunk_count, CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS backend FROM cn JOIN labels USING (doc_id)),
old AS (SELECT doc_id, CASE WHEN chunk_order = 2 THEN 'gone' ELSE chunk_id END AS chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query("rt26_sync_vector_index", f"""WITH {INDEX_SQL}, w AS (SELECT cn.doc_id, n FROM cn LEFT JOIN idx USING (doc_id) WHERE NOT coalesce(idx.chunk_count = n AND backend = 'a', false))
SELECT 'upsert' AS action, doc_id, chunk_id, NULL::BIGINT AS chunk_count FROM chunks WHERE doc_id IN (SELECT doc_id FROM w)
UNION ALL SELECT 'delete', doc_id, chunk_id, NULL FROM old WHERE doc_id IN (SELECT doc_id FROM w) AND (doc_id, chunk_id) NOT IN (SELECT doc_id, chunk_id FROM chunks)
UNION ALL SELECT 'records', doc_id, 'a', n FROM w UNION ALL SELECT 'records', doc_id, backend, chunk_count FROM idx WHERE doc_id NOT IN (SELECT doc_id FROM w)""")
def _(t):
    c, index, old = index_tables(t)
    out = R.sync_vector_index(index, old, c, "a")
    none = F.lit(None).cast("bigint")
    return (out["upsert"].select(F.lit("upsert").alias("action"), "doc_id", "chunk_id", none.alias("chunk_count"))
            .unionByName(out["delete"].select(F.lit("delete").alias("action"), "doc_id", "chunk_id", none.alias("chunk_count")))
            .unionByName(out["records"].select(F.lit("records").alias("action"), "doc_id", F.col("backend").alias("chunk_id"), "chunk_count")))


@query("rt27_index_status", f"WITH {INDEX_SQL} SELECT doc_id, doc_id IN (SELECT doc_id FROM old) AND doc_id IN (SELECT doc_id FROM idx) AS indexed FROM documents")
def _(t):
    c, index, old = index_tables(t)
    return R.index_status(t.documents, index, old)


@query("rt29_plan_index_work", f"""WITH {INDEX_SQL}, v AS (SELECT doc_id, count(*) AS vectors FROM old GROUP BY 1), c AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE chunk_order % 3 <> 0) AS missing_prefix FROM chunks GROUP BY 1)
SELECT doc_id, chunks, coalesce(vectors, 0) AS vectors, missing_prefix, coalesce(vectors, 0) = 0 AS needs_index, chunks <> coalesce(vectors, 0) AS post_check_failed FROM documents JOIN c USING (doc_id) LEFT JOIN v USING (doc_id)""")
def _(t):
    c, index, old = index_tables(t)
    return R.plan_index_work(t.documents, c, old)
