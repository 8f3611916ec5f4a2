"""Headings, sections, hierarchy, layout blocks and chunks."""

from pyspark.sql import functions as F

from docloom.checks.adapters import CHUNKS_SQL, LINES_SQL, PAGES_SQL, as_chunks, as_pages
from docloom.checks.q_pages import PARAS_SQL, WS_SQL, order_tables, paragraphs, scored, strip_sql
from docloom.checks.limits import L as LIM
from docloom.checks.registry import query
from docloom.functions import headings as H
from docloom.operators import chunks as C
from docloom.operators import pages as P
from docloom.operators import sections as S
from docloom.plans.stage import cut


def derived_lines(t):
    return as_pages(t.documents).select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("j", "line"))


PLINES_SQL = PAGES_SQL + """,
pl AS (SELECT doc_id, page_number, j - 1 AS j, l[j] AS line FROM (
   SELECT doc_id, page_number, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, page_number, string_split(text, chr(10)) AS l FROM page_rows)))"""

KNOWN_SQL = "(" + ", ".join("'" + k + "'" for k in H.KNOWN_TITLES) + ")"
ANY_KNOWN_SQL = "(" + " OR ".join(f"contains(lower(s), '{k}')" for k in H.KNOWN_TITLES) + ")"


def words_sql(c: str) -> str:
    return f"len(regexp_split_to_array({c}, '{WS_SQL}+'))"


NUMBERED_SQL = rf"""(regexp_matches(s, '^\d{{1,2}}(\.\d{{1,2}})*\s+.+$') AND regexp_matches(r, '\p{{L}}.*\p{{L}}') AND NOT starts_with(r, '(')
  AND NOT regexp_matches(r, '(?i)\b(fax|tel|phone)\b') AND NOT regexp_matches(r, '^\p{{Ll}}')
  AND NOT (regexp_matches(r, '(?i)\bmiles\b') AND regexp_matches(r, '(?i)\blength\b'))
  AND NOT (ends_with(r, '.') AND {words_sql('r')} >= 4))"""
HEADING_SQL = rf"""(length(s) BETWEEN 1 AND 200 AND ({NUMBERED_SQL}
  OR regexp_matches(s, '(?i)^(annexure|annex|appendix)\s+[a-z0-9]+(\s*[-–:]\s*.+)?\s*$') OR lower(s) IN {KNOWN_SQL}
  OR (regexp_matches(s, '^[A-Z][A-Z0-9\s\-/&]{{3,80}}$') AND {words_sql('s')} BETWEEN 2 AND 12
      AND NOT ({words_sql('s')} = 2 AND length(s) <= 10))
  OR ({words_sql('s')} <= 8 AND NOT ends_with(s, '.') AND {ANY_KNOWN_SQL}
      AND NOT regexp_matches(s, '(^|[^\p{{L}}])\p{{Ll}}|\p{{L}}\p{{Lu}}'))))"""
MARKED_SQL = PLINES_SQL + rf""",
marked AS (SELECT doc_id, page_number, j, line, {HEADING_SQL} AS h, {NUMBERED_SQL} AS numbered,
   trim(regexp_replace(s, '^(\d+(\.\d+)*)\s+(.+)$', '\1 \3')) AS title
 FROM (SELECT *, regexp_extract(s, '^\d{{1,2}}(\.\d{{1,2}})*\s+(.+)$', 2) AS r FROM (SELECT *, {strip_sql('line')} AS s FROM pl)))"""


@query("sec1_numbered_heading", f"WITH {MARKED_SQL} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, j, numbered FROM marked")
def _(t):
    return derived_lines(t).select("doc_id", "page_number", "j", H.is_numbered_heading("line").alias("numbered"))


@query("sec2_heading", f"WITH {MARKED_SQL} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, j, h FROM marked")
def _(t):
    return derived_lines(t).select("doc_id", "page_number", "j", H.is_heading("line").alias("h"))


@query("sec3_heading_title", f"WITH {MARKED_SQL} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, j, title FROM marked WHERE h")
def _(t):
    return derived_lines(t).where(H.is_heading("line")).select("doc_id", "page_number", "j", H.heading_title("line").alias("title"))


SECTIONS_SQL = MARKED_SQL + f""",
live AS (SELECT m.*, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY page_number, j) AS sec
  FROM marked m WHERE (doc_id, page_number) IN (SELECT doc_id, page_number FROM page_rows WHERE {strip_sql('text')} <> '')),
lastp AS (SELECT doc_id, max(page_number) AS last_page FROM page_rows GROUP BY 1),
g AS (SELECT doc_id, sec, max(title) FILTER (WHERE h) AS title,
   {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY page_number, j) FILTER (WHERE NOT h), '')")} AS content,
   max(page_number) FILTER (WHERE h) AS hp, min(page_number) FILTER (WHERE NOT h) AS lp FROM live GROUP BY 1, 2),
nxt AS (SELECT g.*, lead(hp) OVER (PARTITION BY doc_id ORDER BY sec) AS np FROM g),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_order FROM nxt WHERE sec > 0 OR content <> ''),
sections AS (
  SELECT doc_id, section_order, coalesce(title, 'Preamble') AS title, content,
    CASE WHEN section_order = 0 THEN coalesce(lp, hp) ELSE hp END AS page_start, coalesce(np, last_page) AS page_end
  FROM kept JOIN lastp USING (doc_id)
  UNION ALL SELECT doc_id, 0, 'Document', '', 1, last_page FROM lastp WHERE doc_id NOT IN (SELECT doc_id FROM kept))"""


@query("sec4_detect_sections", f"""WITH {SECTIONS_SQL}
SELECT doc_id, section_order, title, content, CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end FROM sections""")
def _(t):
    return S.detect_sections(as_pages(t.documents))


def sections(t):
    return cut(S.detect_sections(as_pages(t.documents)), "zstd")


def hierarchy(t):
    return cut(S.section_hierarchy(sections(t)), "zstd")


def typed_blocks(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_seq", "text")).select(
        "doc_id", "block_seq", F.when(F.col("block_seq") % 3 == 1, "heading").otherwise("para").alias("kind"),
        F.trim("text").alias("text"), F.when(F.col("block_seq") % 2 == 0, (F.col("block_seq") % 4 + 1)).alias("level"))


@query("sec5_sections_from_blocks", f"""WITH {LINES_SQL},
b AS (SELECT doc_id, i, i % 3 = 1 AS h, trim(line) AS line, CASE WHEN i % 2 = 0 THEN i % 4 + 1 END AS level FROM doc_lines),
n AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM b),
g AS (SELECT doc_id, sec, max(line) FILTER (WHERE h) AS title, max(level) FILTER (WHERE h) AS level,
  {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT h), '')")} AS content FROM n GROUP BY 1, 2),
r AS (SELECT *, CAST(coalesce(sum(CASE WHEN sec = 0 OR content <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sec
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section_order FROM g),
lv AS (SELECT doc_id, section_order, arg_max(level, sec) FILTER (WHERE level IS NOT NULL) AS explicit_level FROM r GROUP BY 1, 2)
SELECT doc_id, section_order, coalesce(title, 'Preamble') AS title, content, CAST(1 AS BIGINT) AS page_start, CAST(1 AS BIGINT) AS page_end,
  explicit_level FROM r JOIN lv USING (doc_id, section_order) WHERE sec = 0 OR content <> ''""")
def _(t):
    return S.sections_from_blocks(typed_blocks(t))


ROLE_HEAD_SQL = "(role IN ('title', 'sectionHeading') OR (role = '' AND " + HEADING_SQL + "))"


@query("sec5b_sections_from_roles", rf"""WITH {PARAS_SQL},
p AS (SELECT doc_id, i, page_number, line, {ROLE_HEAD_SQL} AS h, trim(regexp_replace(s, '^(\d+(\.\d+)*)\s+(.+)$', '\1 \3')) AS title
  FROM (SELECT *, regexp_extract(s, '^\d{{1,2}}(\.\d{{1,2}})*\s+(.+)$', 2) AS r FROM (SELECT *, line AS s FROM paras WHERE line <> ''))),
n AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY page_number, i) AS sec FROM p),
lastp AS (SELECT doc_id, max(page_number) AS last_page FROM paras GROUP BY 1),
g AS (SELECT doc_id, sec, max(title) FILTER (WHERE h) AS title, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT h), '')) AS content,
  max(page_number) FILTER (WHERE h) AS hp, min(page_number) FILTER (WHERE NOT h) AS lp FROM n GROUP BY 1, 2
  UNION ALL SELECT doc_id, 0, NULL, '', NULL, NULL FROM (SELECT doc_id, min(sec) AS m FROM n GROUP BY 1) WHERE m > 0),
x AS (SELECT *, lead(hp) OVER (PARTITION BY doc_id ORDER BY sec) AS np FROM g)
SELECT doc_id, CAST(sec AS BIGINT) AS section_order, coalesce(title, 'Preamble') AS title, content,
  CAST(CASE WHEN sec = 0 THEN coalesce(lp, 1) ELSE hp END AS BIGINT) AS page_start, CAST(coalesce(np, last_page) AS BIGINT) AS page_end
FROM x JOIN lastp USING (doc_id)""")
def _(t):
    return S.sections_from_roles(paragraphs(t))


def elements(t):
    i = F.col("seq")
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).select(
        "doc_id", "seq", F.when(i % 6 == 2, "section_header").when(i % 9 == 4, "title").otherwise("text").alias("label"),
        "text", (F.floor(i / 10) + 1).cast("int").alias("page"), (i % 4).alias("depth"))


@query("sec5b_sections_from_elements", f"""WITH {LINES_SQL},
e AS (SELECT doc_id, i, trim(line) AS line, i // 10 + 1 AS page, i % 4 AS depth, (i % 6 = 2 OR i % 9 = 4) AND trim(line) <> '' AS h FROM doc_lines),
n AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM e),
g AS (SELECT doc_id, sec, max(line) FILTER (WHERE h) AS title, max(depth + 1) FILTER (WHERE h) AS level, max(page) FILTER (WHERE h) AS hp,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT h AND line <> ''), '') AS content, max(page) AS seen FROM n GROUP BY 1, 2),
x AS (SELECT *, lead(hp) OVER (PARTITION BY doc_id ORDER BY sec) AS np FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_order, coalesce(title, 'Preamble') AS title, content,
  CAST(coalesce(hp, 1) AS BIGINT) AS page_start, CAST(coalesce(np, seen) AS BIGINT) AS page_end, CAST(coalesce(level, 1) AS BIGINT) AS level
FROM x WHERE content <> '' OR title IS NOT NULL""")
def _(t):
    return S.sections_from_elements(elements(t))


LEVEL_SQL = r"""CASE WHEN regexp_matches(title, '^\d{1,2}(\.\d{1,2})*\s+') THEN len(string_split(regexp_extract(title, '^(\d+(\.\d+)*)', 1), '.')) ELSE 1 END"""
HIER_SQL = SECTIONS_SQL + f""",
lev AS (SELECT *, {LEVEL_SQL} AS level FROM sections),
par AS (SELECT a.doc_id, a.section_order, max(b.section_order) AS parent_section_order FROM lev a JOIN lev b
  ON a.doc_id = b.doc_id AND b.section_order < a.section_order AND b.level < a.level GROUP BY 1, 2),
hier AS (SELECT a.*, par.parent_section_order, CASE WHEN p.title IS NULL THEN a.title ELSE p.title || ' > ' || a.title END AS section_path
  FROM lev a LEFT JOIN par ON a.doc_id = par.doc_id AND a.section_order = par.section_order
  LEFT JOIN lev p ON p.doc_id = a.doc_id AND p.section_order = par.parent_section_order)"""


@query("sec6_section_level", f"WITH {SECTIONS_SQL} SELECT doc_id, section_order, {LEVEL_SQL} AS level FROM sections")
def _(t):
    return sections(t).select("doc_id", "section_order", H.section_level("title").alias("level"))


@query("sec7_section_hierarchy", f"""WITH {HIER_SQL}
SELECT doc_id, section_order, level, CAST(parent_section_order AS BIGINT) AS parent_section_order, section_path FROM hier""")
def _(t):
    return hierarchy(t).select(
        "doc_id", "section_order", "level", "parent_section_order", "section_path")


@query("sec8_section_tree", f"""WITH RECURSIVE {HIER_SQL},
up AS (SELECT doc_id, section_order, title AS full_path, parent_section_order AS pp, 1 AS depth FROM hier
  UNION ALL SELECT u.doc_id, u.section_order, h.title || ' > ' || u.full_path, h.parent_section_order, u.depth + 1
  FROM up u JOIN hier h ON h.doc_id = u.doc_id AND h.section_order = u.pp),
kids AS (SELECT doc_id, parent_section_order AS section_order, count(*) AS n FROM hier WHERE parent_section_order IS NOT NULL GROUP BY 1, 2)
SELECT u.doc_id, u.section_order, CAST(u.depth AS BIGINT) AS depth, u.full_path AS section_path, coalesce(n, 0) AS child_count
FROM up u LEFT JOIN kids k ON u.doc_id = k.doc_id AND u.section_order = k.section_order WHERE pp IS NULL""")
def _(t):
    return S.section_tree(sections(t)).select(
        "doc_id", "section_order", "depth", "section_path", "child_count")


@query("pg6_layout_blocks", f"""WITH {SECTIONS_SQL},
runs AS (SELECT doc_id, page_number, j, h, title, line,
   sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id, page_number ORDER BY j) AS isl FROM live),
blk AS (SELECT doc_id, page_number, isl, h, max(title) FILTER (WHERE h) AS ht,
    {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT h), '')")} AS body FROM runs GROUP BY 1, 2, 3, 4),
kept2 AS (SELECT doc_id, page_number, isl, h, CASE WHEN h THEN ht ELSE body END AS text FROM blk WHERE h OR body <> ''),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY isl, NOT h) - 1 AS block_seq,
   row_number() OVER (PARTITION BY doc_id ORDER BY page_number, isl, NOT h) - 1 AS y FROM kept2),
so AS (SELECT doc_id, page_start, title, max(section_order) AS section_order FROM sections GROUP BY 1, 2, 3)
SELECT num.doc_id, CAST(page_number AS BIGINT) AS page, block_seq, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS type,
  substr(text, 1, 4000) AS text, CASE WHEN h THEN 0.0::DOUBLE ELSE CAST(y AS DOUBLE) END AS y,
  CASE WHEN h THEN so.section_order END AS section_order
FROM num LEFT JOIN so ON so.doc_id = num.doc_id AND so.page_start = page_number AND so.title = text""")
def _(t):
    pages = as_pages(t.documents)
    return P.layout_blocks(pages, S.detect_sections(pages), block_chars=LIM.block_chars).select(
        "doc_id", "page", "block_seq", "type", "text", "y", "section_order")


@query("pg6_table_blocks", """WITH tab AS (SELECT l_orderkey AS doc_id,
   CASE l_orderkey % 3 WHEN 0 THEN 'Line | Due Date | Flag' || chr(10) WHEN 1 THEN 'Line | Bid Bond | Flag' || chr(10) ELSE '' END AS head,
   string_agg(l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS body
   FROM lineitem GROUP BY 1, 2)
SELECT doc_id, doc_id % 5 + 1 AS page, 'table' AS type, substr(head || body, 1, 4000) AS text FROM tab""")
def _(t):
    none = as_pages(t.documents).where("text is null")
    return P.layout_blocks(none, tables=order_tables(t), block_chars=LIM.block_chars).select("doc_id", "page", "type", "text")


@query("pg10_structured_text", f"""WITH {SECTIONS_SQL}
SELECT doc_id, {strip_sql("string_agg('## ' || title || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY section_order)")} AS structured_text
FROM sections GROUP BY 1""")
def _(t):
    return P.structured_text(S.detect_sections(as_pages(t.documents)))


@query("pg11_content_summary", f"""WITH {SECTIONS_SQL},
raw AS (SELECT doc_id, coalesce(string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10)) FILTER (WHERE text <> ''), '') AS r,
  count(*) AS page_count FROM page_rows GROUP BY 1),
s AS (SELECT doc_id, count(*) AS section_count FROM sections GROUP BY 1)
SELECT doc_id, length(r) > 0 AS content_ready, length(r) AS raw_text_length, page_count, section_count FROM raw JOIN s USING (doc_id)""")
def _(t):
    pages = as_pages(t.documents)
    return P.content_summary(pages, S.detect_sections(pages))


@query("pg12_parse_summary", f"""WITH {SECTIONS_SQL},
p AS (SELECT doc_id, count(*) AS total_pages, CAST(0 AS BIGINT) AS ocr_pages FROM page_rows GROUP BY 1),
s AS (SELECT doc_id, count(*) AS section_count FROM sections GROUP BY 1),
tab AS (SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS tables_count FROM lineitem GROUP BY 1),
b AS (SELECT doc_id, count(*) AS layout_blocks_count FROM (
  SELECT doc_id, page_number, isl, h FROM (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id, page_number ORDER BY j) AS isl FROM live)
  GROUP BY 1, 2, 3, 4 HAVING h OR {strip_sql("string_agg(line, chr(10))")} <> '') GROUP BY 1)
SELECT p.doc_id, total_pages, ocr_pages, coalesce(section_count, 0) AS section_count, coalesce(tables_count, 0) AS tables_count,
  coalesce(layout_blocks_count, 0) AS layout_blocks_count
FROM p LEFT JOIN s USING (doc_id) LEFT JOIN tab USING (doc_id) LEFT JOIN b USING (doc_id)""")
def _(t):
    pages = scored(t)
    return P.parse_summary(pages, S.detect_sections(pages), order_tables(t), P.layout_blocks(pages)).drop("quality")


# ---- chunks

def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def cover_sql(t="title", c="content", p="page_start") -> str:
    return (f"({p} <= 2 AND ({c} = '' OR (length({c}) < 40 AND upper({t}) = {t} AND "
            f"len(regexp_split_to_array({t}, '{WS_SQL}+')) <= 8)))")


def ctype_sql(title="title", content="content") -> str:
    t = f"lower({title} || chr(10) || {content})"
    annex = " OR ".join(f"starts_with({t}, '{m}') OR contains({t}, chr(10) || '{m}')" for m in C.ANNEX_MARKERS)
    return (f"CASE WHEN {any_sql(t, C.SCHEDULE_MARKERS)} THEN 'schedule_table' WHEN {any_sql(t, C.BOND_MARKERS)} THEN 'bond_clause' "
            f"WHEN {annex} THEN 'form_annex' ELSE 'general_section' END")


def tags_sql(title: str, ctype: str | None = None) -> str:
    parts = [f"CASE WHEN {any_sql(f'lower({title})', words)} THEN '{tag}' END" for tag, words in C.SECTION_TAGS.items()]
    if ctype:
        parts.append(f"CASE WHEN {ctype} = 'cover_metadata' THEN 'eligibility' WHEN {ctype} = 'bond_clause' THEN 'payment' END")
        parts.append(f"CASE WHEN {ctype} IN ('cover_metadata', 'schedule_table') THEN 'deadline' WHEN {ctype} = 'bond_clause' THEN 'risk' END")
    return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ',')"


@query("ch1_cover_fragment", f"WITH {SECTIONS_SQL} SELECT doc_id, section_order, {cover_sql()} AS cover FROM sections")
def _(t):
    return sections(t).select(
        "doc_id", "section_order", C.is_cover_fragment("title", "content", "page_start").alias("cover"))


LOGICAL_SQL = HIER_SQL + f""",
cov AS (SELECT *, {cover_sql()} AS cover FROM hier),
runs2 AS (SELECT *, sum(CASE WHEN cover THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY section_order) AS run FROM cov),
mc AS (SELECT doc_id, min(section_order) AS section_order, count(*) FILTER (WHERE lower(title) <> 'preamble') AS nt,
   arg_min(title, section_order) FILTER (WHERE lower(title) <> 'preamble') AS ft,
   coalesce(string_agg(title || chr(10) || content, chr(10) || chr(10) ORDER BY section_order) FILTER (WHERE content <> ''), '') AS content,
   min(page_start) AS page_start, max(page_end) AS page_end FROM runs2 WHERE cover GROUP BY doc_id, run),
logical AS (
  SELECT doc_id, section_order, CASE WHEN nt = 1 THEN ft ELSE 'Cover / Front Matter' END AS title, content, page_start, page_end, 1 AS level,
    CASE WHEN nt = 1 THEN ft ELSE 'Cover / Front Matter' END AS section_path, CAST(NULL AS BIGINT) AS parent_section_order, 'cover_metadata' AS chunk_type FROM mc
  UNION ALL SELECT doc_id, section_order, title, content, page_start, page_end, level, section_path, parent_section_order, {ctype_sql()}
  FROM cov WHERE NOT cover AND content <> '')"""


def logical(t):
    return C.consolidate_sections(hierarchy(t))


@query("ch2_consolidate_sections", f"""WITH {LOGICAL_SQL} SELECT doc_id, section_order, title, content, CAST(page_start AS BIGINT) AS page_start,
  CAST(page_end AS BIGINT) AS page_end, CAST(level AS BIGINT) AS level, section_path, CAST(parent_section_order AS BIGINT) AS parent_section_order, chunk_type FROM logical""")
def _(t):
    return logical(t)


@query("ch3_chunk_type", f"WITH {SECTIONS_SQL} SELECT doc_id, section_order, {ctype_sql()} AS chunk_type FROM sections")
def _(t):
    return sections(t).select("doc_id", "section_order", C.chunk_type("title", "content").alias("chunk_type"))


@query("ch4_section_tags", f"WITH {LOGICAL_SQL} SELECT doc_id, section_order, {tags_sql('title', 'chunk_type')} AS tags FROM logical")
def _(t):
    return logical(t).select("doc_id", "section_order", F.array_join(C.section_tags("title", "chunk_type"), ",").alias("tags"))


@query("ch5_text_units", rf"""WITH {LINES_SQL},
txt AS (SELECT doc_id, string_agg(CASE WHEN i % 5 = 3 THEN '' WHEN i % 5 = 1 THEN (i + 1) || '.2 ' || trim(line) ELSE trim(line) END, chr(10) ORDER BY i) AS text
  FROM doc_lines GROUP BY 1),
blk AS (SELECT doc_id, bi, trim(bs[bi], chr(10) || ' ') AS b FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS bi
  FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS bs FROM txt))),
ln AS (SELECT doc_id, bi, li, ls[li] AS line FROM (SELECT doc_id, bi, ls, unnest(range(1, len(ls) + 1)) AS li
  FROM (SELECT doc_id, bi, string_split(b, chr(10)) AS ls FROM blk WHERE b <> ''))),
u AS (SELECT *, sum(CASE WHEN li > 1 AND regexp_matches(line, '^\d+(\.\d+)+\s+[A-Za-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, bi ORDER BY li) AS un FROM ln),
units AS (SELECT doc_id, bi, un, string_agg(line, chr(10) ORDER BY li) AS unit FROM u GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bi, un) - 1 AS unit_no, unit FROM units""")
def _(t):
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 5 == 3, "").when(i % 5 == 1, F.concat((i + 1).cast("string"), F.lit(".2 "), F.trim(x))).otherwise(F.trim(x)))
    text = t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))
    return text.select("doc_id", F.posexplode(C.text_units("text")).alias("unit_no", "unit"))


def parts_sql(source: str, most: int = 1600, tail: int = 160) -> str:
    """CTEs that split the texts of `source` (id, text) into `parts` (id, leaf, n_leaves, part); the fold is a recursion over pieces."""
    ws = WS_SQL
    return rf"""
split_b AS (SELECT id, bi, {strip_sql('bs[bi]')} AS b FROM (SELECT id, bs, unnest(range(1, len(bs) + 1)) AS bi FROM (SELECT id, regexp_split_to_array(text, '\n{ws}*\n') AS bs FROM {source}))),
split_l AS (SELECT id, bi, li, {strip_sql('ls[li]')} AS line FROM (SELECT id, bi, ls, unnest(range(1, len(ls) + 1)) AS li FROM (SELECT id, bi, string_split(b, chr(10)) AS ls FROM split_b WHERE b <> ''))),
split_u AS (SELECT *, sum(CASE WHEN li > 1 AND regexp_matches(line, '^\d+(\.\d+)+{ws}+[A-Za-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY id, bi ORDER BY li) AS un FROM split_l),
split_n AS (SELECT id, bi, un, string_agg(line, chr(10) ORDER BY li) AS unit FROM split_u GROUP BY 1, 2, 3),
split_x AS (SELECT id, bi, un, xs, length(unit) > {most} AS long, unnest(range(1, len(xs) + 1)) AS k FROM (SELECT *, CASE WHEN length(unit) > {most} THEN string_split(unit, chr(10)) ELSE [unit] END AS xs FROM split_n)),
split_p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY bi, un, k) AS i, xs[k] AS t, CASE WHEN long THEN 1 ELSE 2 END AS gap, long AND k = 1 AS opens, count(*) OVER (PARTITION BY id) AS n FROM split_x),
split_r AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS part, CAST(0 AS BIGINT) AS used, n FROM split_p
  UNION ALL SELECT id, i, list_concat(done, list_filter([CASE WHEN carry THEN part END, CASE WHEN rest IS NOT NULL AND gap = 1 AND spent + size > {most} THEN rest END], lambda x: x IS NOT NULL)),
    CASE WHEN rest IS NULL OR (gap = 1 AND spent + size > {most}) THEN t ELSE rest || chr(10) || chr(10) || t END,
    CASE WHEN rest IS NOT NULL AND gap = 1 AND spent + size > {most} THEN length(t) ELSE CASE WHEN rest IS NULL AND NOT carry THEN 0 ELSE spent END + size END, n
  FROM (SELECT *, CASE WHEN carry THEN CASE WHEN {strip_sql(f'right(part, {tail})')} <> '' THEN right(part, {tail}) END ELSE part END AS rest, CASE WHEN carry THEN length(right(part, {tail})) ELSE used END AS spent
    FROM (SELECT split_p.id, split_p.i, done, part, used, split_p.n, t, gap, length(t) + gap AS size, part IS NOT NULL AND (opens OR (gap = 2 AND used + length(t) + gap > {most})) AS carry FROM split_r JOIN split_p ON split_p.id = split_r.id AND split_p.i = split_r.i + 1))),
split_e AS (SELECT id, unnest(range(1, len(xs) + 1)) AS j, xs FROM (SELECT id, list_filter(list_transform(list_append(done, part), lambda x: {strip_sql('x')}), lambda x: x <> '') AS xs FROM split_r WHERE i = n)),
split_k AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS j, CAST([] AS VARCHAR[]) AS kept, CAST(len(xs) AS BIGINT) AS n FROM split_e
  UNION ALL SELECT split_e.id, split_e.j, CASE WHEN length(xs[split_e.j]) < {tail} AND coalesce(contains(kept[-1], xs[split_e.j]), false) THEN kept ELSE list_append(kept, xs[split_e.j]) END, n FROM split_k JOIN split_e ON split_e.id = split_k.id AND split_e.j = split_k.j + 1),
parts AS (SELECT id, leaf - 1 AS leaf, len(kept) AS n_leaves, kept[leaf] AS part FROM (SELECT id, kept, unnest(range(1, len(kept) + 1)) AS leaf FROM split_k WHERE j = n))"""


@query("ch6_split_with_overlap", f"WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), {parts_sql('src')} SELECT id AS doc_id, leaf AS part, part AS text FROM parts")
def _(t):
    return t.documents.select("doc_id", F.posexplode(C.split_with_overlap("text")).alias("part", "text"))


@query("ch7_section_chunks", f"""WITH RECURSIVE {LOGICAL_SQL.strip()},
typed AS (SELECT * REPLACE (CASE WHEN chunk_type = 'general_section' THEN {ctype_sql()} ELSE chunk_type END AS chunk_type) FROM logical),
src AS (SELECT doc_id || '-' || section_order AS id, content AS text FROM logical), {parts_sql('src')}
SELECT doc_id, title AS section_title, part AS chunk_text, CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end, chunk_type, section_order, CAST(level AS BIGINT) AS section_level, section_path, CAST(parent_section_order AS BIGINT) AS parent_section_order,
  leaf AS leaf_index, CAST(n_leaves AS BIGINT) AS leaf_count, substr(content, 1, 6000) AS parent_text, length(content) AS parent_char_count, {tags_sql('title', 'chunk_type')} AS tags, regexp_extract(title, '^(\\d+(\\.\\d+)*)', 1) AS section_prefix, CASE WHEN leaf > 0 THEN 160 ELSE 0 END AS overlap_chars
FROM typed JOIN parts ON parts.id = doc_id || '-' || section_order""")
def _(t):
    return C.section_chunks(logical(t), limits=LIM).withColumn("tags", F.array_join("tags", ","))


def page_tables(t):
    """Order tables placed on the pages of a customer's document."""
    o = t.orders.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("cust"))
    return order_tables(t).join(o, F.col("doc_id") == F.col("ok")).select(
        F.col("cust").alias("doc_id"), F.col("ok").cast("int").alias("table_idx"), "page", "headers", "rows")


TAB_CHUNKS_SQL = """
tab AS (SELECT o_custkey AS doc_id, o_orderkey AS table_idx, o_orderkey % 5 + 1 AS page, o_orderkey % 3 AS k,
   CASE o_orderkey % 3 WHEN 0 THEN 'Line | Due Date | Flag' || chr(10) || '--- | --- | ---' || chr(10)
      WHEN 1 THEN 'Line | Bid Bond | Flag' || chr(10) || '--- | --- | ---' || chr(10) ELSE '' END AS head,
   string_agg(l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS body
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5),
tc AS (SELECT doc_id, table_idx, page, 'Table (page ' || page || ')' AS section_title, head || body AS chunk_text,
   CASE k WHEN 0 THEN 'schedule_table' WHEN 1 THEN 'bond_clause' ELSE 'table' END AS chunk_type,
   row_number() OVER (PARTITION BY doc_id, page ORDER BY table_idx) AS rn FROM tab),
table_chunks AS (SELECT * EXCLUDE (rn) FROM tc WHERE chunk_type <> 'schedule_table' OR rn = 1)"""


@query("ch8_table_chunks", f"WITH {TAB_CHUNKS_SQL} SELECT *, CASE WHEN chunk_type = 'schedule_table' THEN 'deadline' ELSE '' END AS tags FROM table_chunks")
def _(t):
    return C.table_chunks(page_tables(t)).withColumn("tags", F.array_join("tags", ","))


@query("ch9_dedupe_table_chunks", f"""WITH {TAB_CHUNKS_SQL},
sec AS (SELECT DISTINCT doc_id, substr(chunk_text, 1, 30) AS h FROM table_chunks WHERE chunk_type = 'schedule_table' AND page = 1),
SELF AS (SELECT 1)
SELECT doc_id, table_idx, page, chunk_type FROM table_chunks t WHERE chunk_type <> 'schedule_table' OR NOT EXISTS (
  SELECT 1 FROM sec WHERE sec.doc_id = t.doc_id AND (contains(h, substr(t.chunk_text, 1, 200)) OR contains(substr(t.chunk_text, 1, 200), h)))""".replace(",\nSELF AS (SELECT 1)", ""))
def _(t):
    tables = C.table_chunks(page_tables(t))
    sections = tables.where("page = 1").select("doc_id", "chunk_type", F.substring("chunk_text", 1, 30).alias("chunk_text"))
    return C.dedupe_table_chunks(tables, sections, LIM.table_key_chars).select("doc_id", "table_idx", "page", "chunk_type")


@query("ch10_build_chunks")
def _(t):
    pages = as_pages(t.documents)
    sections = hierarchy(t)
    parsed = P.structured_text(sections).join(pages.groupBy("doc_id").agg(F.max("page_number").alias("total_pages")), "doc_id")
    tables = page_tables(t).join(t.documents.select("doc_id"), "doc_id", "left_semi")
    return C.build_chunks(parsed, sections, tables, limits=LIM).withColumn("tags", F.array_join("tags", ","))


@query("ch11_contextualized_text", f"""WITH {CHUNKS_SQL} SELECT chunk_id,
  CASE WHEN chunk_order % 3 = 0 THEN chunk_text ELSE 'From ' || section_title || chr(10) || chr(10) || chunk_text END AS text FROM chunks""")
def _(t):
    prefix = F.when(F.col("chunk_order") % 3 != 0, F.concat(F.lit("From "), "section_title"))
    return as_chunks(t.documents).select("chunk_id", C.contextualized_text(prefix, "chunk_text").alias("text"))


@query("ch12_embedding_requests", f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_order, (chunk_order - 1) // 100 AS batch_no,
  substr(chunk_text, 1, 9000) AS input_text FROM chunks""")
def _(t):
    return C.embedding_requests(as_chunks(t.documents), limits=LIM)


@query("ch13_chunk_stats", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_type, count(*) AS n_chunks FROM chunks GROUP BY 1, 2")
def _(t):
    return C.chunk_stats(as_chunks(t.documents))
