"""Shapes the given tables into the tables the operators expect, in Spark and in SQL.

Every line block of a document gets a clause heading and one labelled fact sentence whose
parts come from the document itself, so headings, markers, dates and amounts all occur and
their number grows with the corpus. The SQL strings restate the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import literal_array

PAGE_LINES = 6

# Headings and fact labels used for the derived text.
HEADS = [
    "Bid Schedule", "Scope of Work", "Performance Bond", "Payment Terms", "Technical Requirements",
    "Evaluation Criteria", "Liquidated Damages", "Submission Deadline", "Bidder Eligibility",
    "Annexure Forms", "Maintenance Support", "General Conditions",
]
LABELS = [
    "project_name", "bid_deadline", "bid_bond", "solicitation_number", "project_end_date",
    "project_value", "project_location", "owner", "question_deadline", "certified_check",
]
TYPES = [
    "eligibility_criteria", "submission_deadlines", "penalties_and_risks", "eligibility_criteria",
    "submission_deadlines", "payment_terms", "technical_requirements", "eligibility_criteria",
    "submission_deadlines", "penalties_and_risks",
]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index):
    return F.element_at(literal_array(values), (index + 1).cast("int"))


def _number(b):
    return F.when(b % 2 == 0, (F.floor(b / 2) + 1).cast("string")).otherwise(
        F.concat((F.floor(b / 2) + 1).cast("string"), F.lit(".1"))
    )


def _heading(doc, b):
    return F.concat(_number(b), F.lit(" "), _pick(HEADS, (doc + b) % 12))


def _fact(doc, b, line):
    k = (doc * 3 + b) % 10
    day = F.date_add(F.lit("2026-01-05").cast("date"), ((doc + b) % 300).cast("int"))
    words = F.regexp_extract(line, "^[^ ]+( [^ ]+){0,3}", 0)
    num = lambda c: c.cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("Project Name: "), words))
        .when(k == 1, F.concat(F.lit("Bid Due Date: "), F.date_format(day, "MMMM d, yyyy"), F.lit(" at 10:00 AM")))
        .when(k == 2, F.concat(F.lit("Bid Bond: "), num(doc % 10 + 1), F.lit("% of the bid amount")))
        .when(k == 3, F.concat(F.lit("Project No. P-"), num(doc), F.lit("-"), num(b)))
        .when(k == 4, F.concat(F.lit("Contract Time: "), num(doc % 200 + 30), F.lit(" calendar days")))
        .when(k == 5, F.concat(F.lit("Estimated value: $"), num((doc % 90 + 1) * 25000)))
        .when(k == 6, F.concat(F.lit("Location: "), num(doc % 900 + 10), F.lit(" Main Street, Springfield, IL 627"), F.lpad(num(doc % 100), 2, "0")))
        .when(k == 7, F.concat(F.lit("Owner: City of "), F.regexp_extract(line, "^[^ ]+", 0)))
        .when(k == 8, F.concat(F.lit("Questions due by "), F.date_format(day, "M/d/yyyy")))
        .otherwise(F.concat(F.lit("Certified check required for bid security of lot "), num(b)))
    )


def as_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): blocks of lines with derived headings and facts."""
    doc = F.col("doc_id")
    lines = F.split("text", "\n")

    def expand(x, j, p):
        i = p * PAGE_LINES + j
        b = F.floor(i / 4)
        return F.when(i % 4 == 0, F.array(_heading(doc, b), _fact(doc, b, x), x)).otherwise(F.array(x))

    last = F.floor((F.size("l") - 1) / PAGE_LINES)
    pages = F.transform(
        F.sequence(F.lit(0).cast("bigint"), last),
        lambda p: F.array_join(
            F.flatten(
                F.transform(
                    F.slice(F.col("l"), (p * PAGE_LINES + 1).cast("int"), PAGE_LINES), lambda x, j: expand(x, j, p)
                )
            ),
            "\n",
        ),
    )
    return documents.select("doc_id", lines.alias("l")).select(
        "doc_id", F.posexplode(pages).alias("p", "text")
    ).select("doc_id", (F.col("p") + 1).cast("int").alias("page_number"), "text")


_FACT_SQL = """
  CASE (doc_id * 3 + b) % 10
   WHEN 0 THEN 'Project Name: ' || regexp_extract(line, '^[^ ]+( [^ ]+){0,3}')
   WHEN 1 THEN 'Bid Due Date: ' || strftime(DATE '2026-01-05' + CAST((doc_id + b) % 300 AS INTEGER), '%B %-d, %Y') || ' at 10:00 AM'
   WHEN 2 THEN 'Bid Bond: ' || (doc_id % 10 + 1) || '% of the bid amount'
   WHEN 3 THEN 'Project No. P-' || doc_id || '-' || b
   WHEN 4 THEN 'Contract Time: ' || (doc_id % 200 + 30) || ' calendar days'
   WHEN 5 THEN 'Estimated value: $' || ((doc_id % 90 + 1) * 25000)
   WHEN 6 THEN 'Location: ' || (doc_id % 900 + 10) || ' Main Street, Springfield, IL 627' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')
   WHEN 7 THEN 'Owner: City of ' || regexp_extract(line, '^[^ ]+')
   WHEN 8 THEN 'Questions due by ' || strftime(DATE '2026-01-05' + CAST((doc_id + b) % 300 AS INTEGER), '%-m/%-d/%Y')
   ELSE 'Certified check required for bid security of lot ' || b END"""

_NUMBER_SQL = "CASE WHEN b % 2 = 0 THEN CAST(b // 2 + 1 AS VARCHAR) ELSE (b // 2 + 1) || '.1' END"

LINES_SQL = f"""
doc_lines AS (
  SELECT doc_id, i - 1 AS i, l[i] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
block_lines AS (SELECT *, i // 4 AS b FROM doc_lines)"""

PAGES_SQL = LINES_SQL + f""",
page_rows AS (
  SELECT doc_id, CAST(i // {PAGE_LINES} + 1 AS INTEGER) AS page_number,
    string_agg(CASE WHEN i % 4 = 0 THEN ({_NUMBER_SQL}) || ' ' || {_sql_list(HEADS)}[CAST((doc_id + b) % 12 + 1 AS INTEGER)]
        || chr(10) || {_FACT_SQL} || chr(10) || line ELSE line END, chr(10) ORDER BY i) AS text
  FROM block_lines GROUP BY 1, 2)"""


def as_blocks(documents: DataFrame) -> DataFrame:
    """One row per block of four lines: heading, fact sentence, body and page range."""
    doc, b = F.col("doc_id"), F.col("b")
    lines = F.split("text", "\n")
    n = F.size("l")
    blocks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / 4)),
        lambda x: F.slice(F.col("l"), (x * 4 + 1).cast("int"), 4),
    )
    return (
        documents.select("doc_id", lines.alias("l"))
        .select("doc_id", n.alias("n"), F.posexplode(blocks).alias("b", "part"))
        .withColumn("b", b.cast("bigint"))
        .select(
            "doc_id", "b",
            ((doc * 3 + b) % 10).alias("k"),
            _heading(doc, b).alias("title"),
            _fact(doc, b, F.element_at("part", 1)).alias("fact"),
            F.array_join("part", "\n").alias("body"),
            (F.floor(b * 4 / PAGE_LINES) + 1).cast("int").alias("page_start"),
            (F.floor(F.least(b * 4 + 3, F.col("n") - 1) / PAGE_LINES) + 1).cast("int").alias("page_end"),
        )
    )


BLOCKS_SQL = LINES_SQL + f""",
blocks AS (
  SELECT doc_id, b, (doc_id * 3 + b) % 10 AS k,
    ({_NUMBER_SQL}) || ' ' || {_sql_list(HEADS)}[CAST((doc_id + b) % 12 + 1 AS INTEGER)] AS title,
    {_FACT_SQL.replace('line', 'first_line')} AS fact, body,
    (b * 4) // {PAGE_LINES} + 1 AS page_start, last_i // {PAGE_LINES} + 1 AS page_end
  FROM (SELECT doc_id, b, arg_min(line, i) AS first_line, string_agg(line, chr(10) ORDER BY i) AS body, max(i) AS last_i
        FROM block_lines GROUP BY 1, 2))"""


def as_items(documents: DataFrame) -> DataFrame:
    """Labelled facts, one per block, in the `item` shape."""
    k = F.col("k")
    value = F.coalesce(
        F.nullif(F.regexp_extract("fact", r"^[^:]*: (.*)$", 1), F.lit("")), F.col("fact")
    )
    return as_blocks(documents).select(
        "doc_id",
        _pick(TYPES, k).alias("extraction_type"),
        F.col("b").cast("int").alias("item_seq"),
        F.concat(_pick(LABELS, k), F.lit(": "), value).alias("requirement"),
        _pick(LABELS, k).alias("label"),
        value.alias("value"),
        F.col("page_start").alias("page"),
        F.col("title").alias("section"),
        F.col("title").alias("section_path"),
        F.col("fact").alias("source_text"),
        ((F.col("doc_id") + F.col("b")) % 11 / 10).alias("confidence"),
        ((F.col("doc_id") + F.col("b")) % 5 != 0).alias("citation_verified"),
        "body",
    )


ITEMS_SQL = BLOCKS_SQL + f""",
items AS (
  SELECT doc_id, {_sql_list(TYPES)}[CAST(k + 1 AS INTEGER)] AS extraction_type, b AS item_seq,
    {_sql_list(LABELS)}[CAST(k + 1 AS INTEGER)] AS label,
    {_sql_list(LABELS)}[CAST(k + 1 AS INTEGER)] || ': ' || value AS requirement,
    value, page_start AS page, title AS section, title AS section_path, fact AS source_text,
    ((doc_id + b) % 11) / 10 AS confidence, (doc_id + b) % 5 <> 0 AS citation_verified, body
  FROM (SELECT *, coalesce(nullif(regexp_extract(fact, '^[^:]*: (.*)$', 1), ''), fact) AS value FROM blocks))"""


def as_chunks(documents: DataFrame) -> DataFrame:
    """Blocks in the `chunk` shape (no further splitting)."""
    head_no = (F.col("doc_id") + F.col("b")) % 12
    return as_blocks(documents).select(
        "doc_id",
        (F.col("b") + 1).cast("int").alias("chunk_order"),
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("chunk_id"),
        F.col("title").alias("section_title"),
        "page_start", "page_end",
        F.concat("fact", F.lit("\n"), "body").alias("chunk_text"),
        F.when(F.col("b") == 0, "cover_metadata").when(head_no == 0, "schedule_table")
        .when(head_no == 2, "bond_clause").otherwise("general_section").alias("chunk_type"),
        F.when(head_no == 0, F.array(F.lit("deadline"))).when(head_no == 2, F.array(F.lit("payment"), F.lit("risk")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
    )


CHUNKS_SQL = BLOCKS_SQL + """,
chunks AS (
  SELECT doc_id, b + 1 AS chunk_order, doc_id || '-' || b AS chunk_id, title AS section_title, page_start, page_end,
    fact || chr(10) || body AS chunk_text,
    CASE WHEN b = 0 THEN 'cover_metadata' WHEN (doc_id + b) % 12 = 0 THEN 'schedule_table'
      WHEN (doc_id + b) % 12 = 2 THEN 'bond_clause' ELSE 'general_section' END AS chunk_type,
    CASE WHEN (doc_id + b) % 12 = 0 THEN 'deadline' WHEN (doc_id + b) % 12 = 2 THEN 'payment risk' ELSE '' END AS tags
  FROM blocks)"""
