"""Page quality and layout."""

from pyspark.sql import functions as F

from docloom.checks.adapters import LINES_SQL, PAGES_SQL, as_pages
from docloom.checks.registry import query
from docloom.operators import pages as P


def scored(t):
    """Derived pages with a quality column."""
    return as_pages(t.documents).withColumn("quality", P.page_quality("text")).withColumn(
        "method", F.lit("native_pdf")).withColumn("ocr_used", F.lit(False))


WS_SQL = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def quality_sql(c: str) -> str:
    """Scalar SQL of the page score; `c` must be an already stripped column."""
    n = f"length({c})"
    ratio = rf"(({n} - length(regexp_replace({c}, '[\p{{L}}\p{{N}}\s\x0b\x1c-\x1f\x85\p{{Z}}]', '', 'g'))) * 1.0 / {n}"
    garbled = rf" * CASE WHEN regexp_matches({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 0.5 ELSE 1.0 END)"
    r = ratio + garbled
    few = f"len(regexp_split_to_array({c}, '{WS_SQL}+')) < 5 AND {r} < 0.6"
    pen = f"least(0.4, ({n} - length(replace({c}, chr(65533), ''))) * 1.0 / {n} / 0.05 * 0.2)"
    score = f"greatest(0.0, least(1.0, {r} * CASE WHEN {few} THEN 0.6 ELSE 1.0 END - {pen}))"
    return (
        f"CASE WHEN {n} = 0 THEN 0.0 WHEN {n} < 25 THEN 0.15 "
        f"ELSE round(CAST({score} * CASE WHEN {n} < 80 THEN 0.75 ELSE 1.0 END AS DOUBLE), 4) END"
    )


SCORED_SQL = PAGES_SQL + f""",
scored AS (SELECT doc_id, page_number, text, CAST({quality_sql('s')} AS DOUBLE) AS quality
  FROM (SELECT *, {strip_sql('text')} AS s FROM page_rows))"""


@query("pg1_page_quality", f"WITH {SCORED_SQL} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, quality FROM scored")
def _(t):
    return scored(t).select("doc_id", "page_number", "quality")


@query("pg1_html_quality", f"""
SELECT page_id, CAST({quality_sql('s')} AS DOUBLE) AS quality
FROM (SELECT page_id, {strip_sql('html')} AS s FROM pages)""")
def _(t):
    return t.pages.select("page_id", P.page_quality("html").alias("quality"))


# the raw page markup stands in for a noisy native text, its tag-free form for the second reading
@query("pg2_choose_page_text", f"""
WITH a AS (SELECT page_id, {strip_sql("regexp_replace(html, '[A-Za-z ]', '', 'g')")} AS s1,
     {strip_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS s2 FROM pages),
q AS (SELECT page_id, CAST({quality_sql('s1')} AS DOUBLE) AS nq, CAST({quality_sql('s2')} AS DOUBLE) AS oq FROM a)
SELECT page_id, CASE WHEN nq < 0.35 AND oq > nq THEN 'ocr' ELSE 'native_pdf' END AS method,
  nq < 0.35 AND oq > nq AS ocr_used, CASE WHEN nq < 0.35 AND oq > nq THEN oq ELSE nq END AS quality FROM q""")
def _(t):
    key = [F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number")]
    native = t.pages.select(*key, F.regexp_replace("html", "[A-Za-z ]", "").alias("text"))
    ocr = t.pages.select(*key, F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return P.choose_page_text(native, ocr).select(F.col("doc_id").alias("page_id"), "method", "ocr_used", "quality")


DOCQ_SQL = SCORED_SQL + """,
docq AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE text = '') AS empty_pages,
  coalesce((2 * sum(q) + count(q)) // (2 * count(q)) / 10000, 0.0) AS quality FROM (SELECT *, CASE WHEN text <> '' THEN CAST(round(quality * 10000) AS BIGINT) END AS q FROM scored) GROUP BY 1)"""


@query("pg3_document_quality", f"WITH {DOCQ_SQL} SELECT doc_id, quality FROM docq")
def _(t):
    return P.document_quality(scored(t))


@query("pg4_needs_fallback", f"""WITH {DOCQ_SQL} SELECT doc_id, pages, empty_pages, quality,
  quality < 0.45 OR empty_pages * 1.0 / pages > 0.5 AS needs_fallback FROM docq""")
def _(t):
    return P.needs_fallback(scored(t))


@query("pg4_choose_parse", f"""
WITH l AS (SELECT page_id, CAST({quality_sql('s')} AS DOUBLE) AS q FROM (SELECT page_id, {strip_sql("regexp_replace(html, '[a-z]', '', 'g')")} AS s FROM pages)),
a AS (SELECT page_id, CAST({quality_sql('s')} AS DOUBLE) AS q FROM (SELECT page_id, {strip_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS s FROM pages))
SELECT l.page_id AS doc_id, l.q AS local_quality, a.q AS alt_quality, l.q < 0.45 AS needs_fallback,
  CASE WHEN l.q < 0.45 AND a.q >= l.q THEN 'alternative' ELSE 'local' END AS chosen
FROM l JOIN a USING (page_id)""")
def _(t):
    base = t.pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), "html")
    local = base.withColumn("text", F.regexp_replace("html", "[a-z]", "")).withColumn("quality", P.page_quality("text"))
    alt = base.withColumn("text", F.regexp_replace("html", "<[^>]*>", " ")).withColumn("quality", P.page_quality("text"))
    return P.choose_parse(base.select("doc_id"), local, alt)


NORM_LINE = rf"trim(regexp_replace(line, '{WS_SQL}+', ' ', 'g'))"
REPEAT_SQL = PAGES_SQL + f""",
pl AS (SELECT doc_id, page_number, j, l[j] AS line FROM (
   SELECT doc_id, page_number, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, page_number, string_split(text, chr(10)) AS l FROM page_rows))),
nl AS (SELECT *, {NORM_LINE} AS n FROM pl),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY j) AS up,
   row_number() OVER (PARTITION BY doc_id, page_number ORDER BY j DESC) AS dn,
   count(*) OVER (PARTITION BY doc_id, page_number) AS c FROM nl WHERE n <> ''),
cand AS (SELECT DISTINCT doc_id, page_number, n FROM ranked
   WHERE (up <= 3 OR (c > 3 AND dn <= 3)) AND length(n) BETWEEN 3 AND 80 AND regexp_matches(n, '\\p{{L}}')),
npages AS (SELECT doc_id, count(*) AS pages FROM page_rows GROUP BY 1),
rep AS (SELECT doc_id, n, count(*) AS page_count FROM cand JOIN npages USING (doc_id) GROUP BY doc_id, n, pages
   HAVING count(*) >= greatest(2, CAST(floor(0.30 * pages) AS BIGINT)))"""


@query("pg5_repeating_lines", f"WITH {REPEAT_SQL} SELECT doc_id, n AS line, page_count FROM rep")
def _(t):
    return P.repeating_lines(as_pages(t.documents))


@query("pg5_strip_repeating_lines", f"""WITH {REPEAT_SQL},
gone AS (SELECT nl.doc_id, nl.page_number, nl.j FROM nl JOIN cand USING (doc_id, page_number, n) JOIN rep USING (doc_id, n))
SELECT nl.doc_id, CAST(nl.page_number AS BIGINT) AS page_number,
  coalesce(string_agg(nl.line, chr(10) ORDER BY nl.j) FILTER (WHERE gone.j IS NULL), '') AS text
FROM nl LEFT JOIN gone ON nl.doc_id = gone.doc_id AND nl.page_number = gone.page_number AND nl.j = gone.j GROUP BY 1, 2""")
def _(t):
    return P.strip_repeating_lines(as_pages(t.documents))


@query("pg7_polygon_bbox", """
SELECT vec_id, list_min(xs) AS x0, list_min(ys) AS y0, list_max(xs) AS x1, list_max(ys) AS y1 FROM (
  SELECT vec_id, list_transform(range(1, len(embedding) + 1, 2), lambda i: CAST(embedding[i] AS DOUBLE)) AS xs,
    list_transform(range(2, len(embedding) + 1, 2), lambda i: CAST(embedding[i] AS DOUBLE)) AS ys FROM embeddings)""")
def _(t):
    box = P.polygon_bbox(F.col("embedding").cast("array<double>"))
    return t.embeddings.select("vec_id", box.alias("b")).select(
        "vec_id", *[F.col("b")[i].alias(n) for i, n in enumerate(["x0", "y0", "x1", "y1"])])


def order_tables(t):
    """One table per order: header and one row per line item."""
    row = F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", row.alias("r")))), lambda s: s["r"]
        ).alias("rows")
    ).select("doc_id", F.lit(0).alias("table_idx"), (F.col("doc_id") % 5 + 1).cast("int").alias("page"),
             F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Line"), F.lit("Due Date"), F.lit("Flag")))
             .when(F.col("doc_id") % 3 == 1, F.array(F.lit("Line"), F.lit("Bid Bond"), F.lit("Flag")))
             .otherwise(F.array().cast("array<string>")).alias("headers"), "rows")


ORDER_TABLES_SQL = """
tab AS (SELECT l_orderkey AS doc_id, l_orderkey % 5 + 1 AS page,
   CASE l_orderkey % 3 WHEN 0 THEN 'Line | Due Date | Flag' WHEN 1 THEN 'Line | Bid Bond | Flag' ELSE '' END AS head,
   string_agg(l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS body
   FROM lineitem GROUP BY 1, 2, 3)"""


@query("pg8_table_text", f"""WITH {ORDER_TABLES_SQL}
SELECT doc_id, CASE WHEN head = '' THEN body ELSE head || chr(10) || body END AS plain,
  CASE WHEN head = '' THEN body ELSE head || chr(10) || '--- | --- | ---' || chr(10) || body END AS markdown FROM tab""")
def _(t):
    return order_tables(t).select(
        "doc_id", P.table_to_text("headers", "rows").alias("plain"), P.table_to_markdown("headers", "rows").alias("markdown"))


@query("pg9_raw_text", f"""WITH {PAGES_SQL}
SELECT doc_id, coalesce(string_agg('--- Page ' || page_number || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number)
  FILTER (WHERE text <> ''), '') AS raw_text FROM page_rows GROUP BY 1""")
def _(t):
    return P.raw_text(as_pages(t.documents))


@query("pg11_page_map", f"""WITH {SCORED_SQL}
SELECT doc_id, CAST(page_number AS BIGINT) AS page, CAST(0 AS BIGINT) AS start_offset, length(text) AS end_offset, quality,
  'native_pdf' AS method, false AS ocr_used FROM scored""")
def _(t):
    return P.page_map(scored(t))


def loose_cells(t):
    """Line items as loose table cells; absent columns stay blank on the grid."""
    base = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("p"), F.max("l_returnflag").alias("f"))
    cells = F.array(
        F.struct(F.lit(0).alias("c"), F.col("p").cast("string").alias("x")),
        F.struct(F.when(F.col("f") == "R", 3).otherwise(1).alias("c"), F.col("f").alias("x")),
    )
    return base.select("l_orderkey", "l_linenumber", F.explode(cells).alias("s")).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.lit(1).alias("page"),
        F.col("l_linenumber").alias("row_idx"), F.col("s.c").alias("col_idx"), F.col("s.x").alias("text"))


@query("pg13_tables_from_cells", """
WITH base AS (SELECT l_orderkey AS doc_id, l_linenumber AS r, max(l_partkey) AS p, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
cells AS (SELECT doc_id, r, 0 AS c, CAST(p AS VARCHAR) AS x FROM base UNION ALL
  SELECT doc_id, r, CASE WHEN f = 'R' THEN 3 ELSE 1 END, f FROM base),
size AS (SELECT doc_id, max(r) + 1 AS nr, max(c) + 1 AS nc FROM cells GROUP BY 1),
grid AS (SELECT doc_id, r, unnest(range(0, nc)) AS c FROM (SELECT doc_id, nc, unnest(range(0, nr)) AS r FROM size)),
filled AS (SELECT g.doc_id, g.r, g.c, coalesce(x, '') AS x FROM grid g LEFT JOIN cells k ON g.doc_id = k.doc_id AND g.r = k.r AND g.c = k.c),
line AS (SELECT doc_id, r, string_agg(x, '|' ORDER BY c) AS l FROM filled GROUP BY 1, 2)
SELECT doc_id, max(l) FILTER (WHERE r = 0) AS headers, coalesce(string_agg(l, ';' ORDER BY r) FILTER (WHERE r > 0), '') AS body
FROM line GROUP BY 1""")
def _(t):
    return P.tables_from_cells(loose_cells(t)).select(
        "doc_id", F.array_join("headers", "|").alias("headers"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("body"))


def paragraphs(t):
    """Document lines as role-tagged paragraphs."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        "doc_id", (F.floor(F.col("i") / 7) * 2 + 1).cast("int").alias("page_number"), F.col("i").alias("para_seq"), "text",
        F.when(F.col("i") % 5 == 0, "title").when(F.col("i") % 5 == 3, "sectionHeading")
        .when(F.col("i") % 5 == 1, "footnote").otherwise("").alias("role"),
        F.array(F.col("i") * 1.0, F.lit(2.0), F.lit(5.0), F.col("i") * 0.5).alias("polygon"))


PARAS_SQL = LINES_SQL + """,
paras AS (SELECT doc_id, i, i // 7 * 2 + 1 AS page_number, trim(line) AS line,
  CASE i % 5 WHEN 0 THEN 'title' WHEN 3 THEN 'sectionHeading' WHEN 1 THEN 'footnote' ELSE '' END AS role FROM doc_lines)"""


@query("pg14_pages_from_paragraphs", f"""WITH {PARAS_SQL},
every AS (SELECT doc_id, unnest(range(1, n + 1)) AS page_number FROM (SELECT doc_id, max(page_number) AS n FROM paras GROUP BY 1)),
filled AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM paras WHERE line <> '' GROUP BY 1, 2),
j AS (SELECT doc_id, page_number, coalesce(text, '') AS text FROM every LEFT JOIN filled USING (doc_id, page_number))
SELECT doc_id, page_number, text, CAST({quality_sql('text')} AS DOUBLE) AS quality FROM j""")
def _(t):
    return P.pages_from_paragraphs(paragraphs(t))


@query("pg14_blocks_from_paragraphs", f"""WITH {PARAS_SQL}
SELECT doc_id, page_number, i AS para_seq, CASE WHEN role IN ('title', 'sectionHeading') THEN 'heading' ELSE 'paragraph' END AS type,
  line AS text, coalesce(nullif(role, ''), 'body') AS role, least(i, 5.0) || ',' || least(2.0, i * 0.5) AS bbox_low
FROM paras WHERE line <> ''""")
def _(t):
    return P.blocks_from_paragraphs(paragraphs(t)).select(
        "doc_id", "page_number", "para_seq", "type", "text", "role",
        F.concat_ws(",", F.col("bbox")[0].cast("decimal(20,1)"), F.col("bbox")[1].cast("decimal(20,1)")).alias("bbox_low"))
