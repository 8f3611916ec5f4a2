"""Quote matching over whole quotes and keys, beside the runs that stand for quotes by prefixes."""

from pyspark.sql import functions as F

from docloom.checks.adapters import as_pages
from docloom.checks.q_grounding import QUOTES_SQL, quotes, sources, plain_items
from docloom.checks.registry import query
from docloom.operators import grounding as G

WHOLE_SQL = QUOTES_SQL + """,
st AS (SELECT nq.doc_id, nq.item_seq, page_number, page_number BETWEEN ps AND pe AS ins, length(nf) AS n FROM nq JOIN hay ON hay.doc_id = nq.doc_id AND length(nf) >= 12 AND contains(hay, nf)),
ind AS (SELECT nq.doc_id, nq.item_seq, count(st.page_number) > 0 AS ok FROM nq LEFT JOIN st ON st.doc_id = nq.doc_id AND st.item_seq = nq.item_seq GROUP BY 1, 2),
lk AS (SELECT nq.doc_id, nf AS key, arg_min(page, item_seq) AS p, arg_min(section, item_seq) AS section, trim(arg_min(s, item_seq)) AS source_text FROM nq JOIN ind USING (doc_id, item_seq) WHERE ok GROUP BY 1, 2)"""


@query("gr5_resolve_pages_whole", f"""WITH {WHOLE_SQL}, h AS (SELECT * FROM st WHERE n >= 20)
SELECT nq.doc_id, nq.item_seq AS item_id, coalesce(min(page_number) FILTER (WHERE ins), min(page_number))::BIGINT AS resolved FROM nq LEFT JOIN h ON h.doc_id = nq.doc_id AND h.item_seq = nq.item_seq GROUP BY 1, 2""")
def _(t):
    return G.resolve_pages(quotes(t), as_pages(t.documents), fuzzy=False).select("doc_id", "item_id", "resolved")


@query("gr5_resolve_pages_fuzzy_whole")
def _(t):
    return G.resolve_pages(quotes(t), as_pages(t.documents)).select("doc_id", "item_id", "resolved")


@query("gr10_quote_in_document_whole", f"WITH {WHOLE_SQL} SELECT doc_id, item_seq AS item_id, ok AS in_document FROM ind")
def _(t):
    return G.quote_in_document(quotes(t), as_pages(t.documents)).select("doc_id", "item_id", "in_document")


@query("gr11_citation_lookup_whole", f"WITH {WHOLE_SQL} SELECT doc_id, key, p::BIGINT AS page, section, source_text FROM lk")
def _(t):
    return G.citation_lookup(quotes(t), as_pages(t.documents)).drop("section_path")


@query("gr12_canonicalize_sources_whole", f"""WITH {WHOLE_SQL}
SELECT nq.doc_id, nq.item_seq AS source_id, coalesce(lk.p, 99)::BIGINT AS page FROM nq LEFT JOIN lk ON lk.doc_id = nq.doc_id AND lk.key = nf""")
def _(t):
    s = quotes(t).select("doc_id", F.col("item_seq").alias("source_id"), "source_text", F.lit(99).alias("page"), "section")
    return G.canonicalize_sources(s, G.citation_lookup(quotes(t), as_pages(t.documents))).select("doc_id", "source_id", "page")


@query("gr13_best_item_match_whole")
def _(t):
    return G.best_item_match(sources(t), plain_items(t)).select("doc_id", "source_id", F.round("ratio", 6).alias("ratio"), "m_page")


@query("gr13_pairs_compared")
def _(t):
    return G.match_effort(sources(t), plain_items(t), least=0.4)


@query("gr14_enforce_verbatim_whole")
def _(t):
    return G.enforce_verbatim(sources(t), plain_items(t), as_pages(t.documents))
