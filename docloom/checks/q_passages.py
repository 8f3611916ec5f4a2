"""Page slices, section and description anchors, group contexts and quote ranges."""

from pyspark.sql import functions as F

from docloom.checks.adapters import PAGES_SQL, as_pages
from docloom.checks.q_grounding import quotes, strip_sql
from docloom.checks.registry import query
from docloom.operators import passages as P

GROUPS = {
    "bonds": ["bid bond", "bid security", "certified check", "surety"], "project_value": ["estimated value", "budget"],
    "location_and_size": ["location:", "main street", "county"], "dates_notes": ["questions due", "bid due"], "set_asides": ["mbe", "small business"],
}
BUDGET = 6000


def numbered(t):
    """Pages whose headings carry the point that a designator has."""
    return as_pages(t.documents).withColumn("text", F.regexp_replace("text", r"(?m)^(\d+(?:\.\d+)?) ", "$1. "))


NUMBERED_SQL = PAGES_SQL + r", nr AS (SELECT doc_id, page_number, regexp_replace(text, '(?m)^(\d+(?:\.\d+)?) ', '\1. ', 'g') AS text FROM page_rows)"


def hits_sql():
    counts = [f"SELECT doc_id, page_number, {'true' if g == P.LOCATION else 'false'} AS opening, '{g}' AS group_id, " + " + ".join(f"contains(low, '{w}')::INT" for w in words) + " AS n FROM lw" for g, words in GROUPS.items()]
    return " UNION ALL ".join(counts)


SLICE_SQL = f"""{PAGES_SQL}, lw AS (SELECT doc_id, page_number, lower(text) AS low FROM page_rows), m AS ({hits_sql()}),
ln AS (SELECT doc_id, page_number, length({strip_sql('text')}) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS at FROM page_rows),
sc AS (SELECT m.doc_id, m.group_id, m.page_number, ln.len, 10 * m.n + (coalesce(a.n, 0) > 0)::INT + (coalesce(b.n, 0) > 0)::INT + CASE WHEN m.opening AND ln.at <= 5 THEN 5 ELSE 0 END AS score
  FROM m JOIN ln USING (doc_id, page_number) LEFT JOIN m a ON a.doc_id = m.doc_id AND a.group_id = m.group_id AND a.page_number = m.page_number - 1
  LEFT JOIN m b ON b.doc_id = m.doc_id AND b.group_id = m.group_id AND b.page_number = m.page_number + 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY score DESC, page_number) AS k FROM sc WHERE score > 0 AND len > 0),
gr AS (SELECT doc_id, group_id, page_number, score, k, CASE WHEN len + 20 <= {BUDGET} THEN len + 20 ELSE 0 END AS used, len + 20 <= {BUDGET} AS selected FROM rk WHERE k = 1
  UNION ALL SELECT rk.doc_id, rk.group_id, rk.page_number, rk.score, rk.k, gr.used + CASE WHEN gr.used + rk.len + 20 <= {BUDGET} THEN rk.len + 20 ELSE 0 END, gr.used + rk.len + 20 <= {BUDGET}
  FROM gr JOIN rk ON rk.doc_id = gr.doc_id AND rk.group_id = gr.group_id AND rk.k = gr.k + 1)"""


@query("rt19_page_slice", f"WITH RECURSIVE {SLICE_SQL} SELECT doc_id, group_id, page_number::BIGINT AS page_number, score::BIGINT AS score, selected FROM gr")
def _(t):
    return P.page_slice(as_pages(t.documents), GROUPS, BUDGET)


def quality_sql(after):
    """Score of what follows a title, with the 800 characters already taken."""
    a = strip_sql(after)
    return rf"""(SELECT CASE WHEN a = '' THEN 0 WHEN en >= 2 AND pr < 2 THEN greatest(1, (length(a) + 50 * pr + 20 * se) // 10) ELSE length(a) + 50 * pr + 20 * se END FROM (
  SELECT a, len(regexp_extract_all(substr(a, 1, 500), '(?i)\b(?:the|shall|contractor|vendor|county|office|design|build)\b')) AS pr, len(regexp_extract_all(substr(a, 1, 300), '(?m)^\s*\d+\.\s+[\pL\pN_]')) AS en,
  len(regexp_extract_all(a, '[.!?]')) AS se FROM (SELECT {a} AS a)))"""


NEEDLES = ["Scope of Work", "Bid Schedule", "Payment Terms"]


@query("rt20_best_section_slice", f"""WITH RECURSIVE {PAGES_SQL}, d AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_number) AS text FROM page_rows GROUP BY 1),
n AS (SELECT unnest(range(0, {len(NEEDLES)})) AS no, unnest([{', '.join(repr(x) for x in NEEDLES)}]) AS needle),
pc AS (SELECT doc_id, no, needle, text, string_split(text, needle) AS p FROM d, n WHERE contains(text, needle)),
ht AS (SELECT *, unnest(range(1, len(p))) AS i FROM pc),
ps AS (SELECT doc_id, no, i, needle, text, 1 + (i - 1) * length(needle) + list_sum(list_transform(p[1:i], lambda x: length(x))) AS start FROM ht),
q AS (SELECT doc_id, no, i, start::BIGINT AS start, {quality_sql('substr(text, (start + length(needle))::BIGINT, 800)')} AS score FROM ps),
b AS (SELECT * FROM q WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no, i) = 1)
SELECT doc_id, b.start, b.score::BIGINT AS score, sha256(substr(d.text, b.start)) AS section FROM b JOIN d USING (doc_id)""")
def _(t):
    pages = as_pages(t.documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    texts = pages.select("doc_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))
    return P.best_section_slice(texts, NEEDLES).withColumn("section", F.sha2("section", 256))


@query("rt21_description_pages")
def _(t):
    return P.description_pages(numbered(t), BUDGET)


@query("rt23_group_context")
def _(t):
    return P.group_context(numbered(t), GROUPS, BUDGET)


@query("rt28_locate_quote")
def _(t):
    return P.locate_quote(quotes(t).select("doc_id", "item_id", "source_text", F.col("page_start").alias("page")), as_pages(t.documents))
