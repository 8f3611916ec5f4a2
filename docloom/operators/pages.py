"""Page quality, layout cleaning and page-level text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.functions.headings import heading_title, is_heading
from docloom.functions.numbers import mean_4dp
from docloom.functions.text import WS, bound, col, collapse, head, lines_of, ordered_join, strip
from docloom.plans.scans import exclusive_scan, once
from docloom.plans.stage import cut

# Character classes of the quality score.
READABLE = r"[\p{L}\p{N}\s\x0b\x1c-\x1f\x85\p{Z}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def page_quality(text, cfg: Config = DEFAULT) -> Column:
    """Share of readable characters with penalties, 0 to 1."""

    def scored(s):
        n = F.length(s)
        # runs of readable characters are removed in one pass; what is left is unreadable
        readable = n - F.length(F.regexp_replace(s, READABLE + "+", ""))
        penalty = F.least(F.lit(0.4), (n - F.length(F.replace(s, F.lit("\ufffd"), F.lit("")))) / n / 0.05 * 0.2)

        def finish(ratio):
            few = (ratio < 0.6) & (F.size(F.split(s, WS + "+")) < 5)
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(few, ratio * 0.6).otherwise(ratio) - penalty))
            return F.round(score * F.when(n < 80, 0.75).otherwise(1.0), 4)

        ratio = readable / n * F.when(s.rlike(CONTROL), 0.5).otherwise(1.0)
        return F.when(n == 0, 0.0).when(n < cfg.min_page_text_length, 0.15).otherwise(bound(ratio, finish))

    return bound(strip(F.coalesce(col(text), F.lit(""))), scored)


def choose_page_text(native: DataFrame, ocr: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Keep the recognised text of a poor page only when it scores strictly higher."""
    n = native.select("doc_id", "page_number", F.col("text").alias("native_text"), page_quality("text", cfg).alias("nq"))
    o = ocr.select("doc_id", "page_number", F.col("text").alias("ocr_text"), page_quality("text", cfg).alias("oq"))
    take = (F.col("nq") < cfg.quality_ocr_threshold) & F.coalesce(F.col("oq") > F.col("nq"), F.lit(False))
    return n.join(o, ["doc_id", "page_number"], "left").select(
        "doc_id", "page_number",
        F.when(take, F.col("ocr_text")).otherwise(F.col("native_text")).alias("text"),
        F.when(take, "ocr").otherwise("native_pdf").alias("method"),
        take.alias("ocr_used"),
        F.when(take, F.col("oq")).otherwise(F.col("nq")).alias("quality"),
    )


def is_blank(text) -> Column:
    return strip(F.coalesce(col(text), F.lit(""))) == ""


def document_quality(pages: DataFrame) -> DataFrame:
    """Mean score of the non-empty pages; pages carry text and quality."""
    return pages.groupBy("doc_id").agg(
        F.coalesce(mean_4dp("quality", ~is_blank("text")), F.lit(0.0)).alias("quality")
    )


def needs_fallback(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Scanned or garbled documents: poor mean quality or mostly empty pages."""
    agg = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.count_if(is_blank("text")).alias("empty_pages"),
        F.coalesce(mean_4dp("quality", ~is_blank("text")), F.lit(0.0)).alias("quality"),
    )
    poor = (F.col("quality") < cfg.fallback_quality_threshold) | (F.col("empty_pages") / F.col("pages") > 0.5)
    return agg.withColumn("needs_fallback", poor)


def choose_parse(documents: DataFrame, local: DataFrame, alternative: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Which parse to keep per document; a document without pages counts as scanned."""
    l = needs_fallback(local, cfg).select("doc_id", F.col("quality").alias("local_quality"), "needs_fallback")
    a = document_quality(alternative).select("doc_id", F.col("quality").alias("alt_quality"))
    j = documents.select("doc_id").join(l, "doc_id", "left").join(a, "doc_id", "left")
    needed = F.coalesce(F.col("needs_fallback"), F.lit(True))
    local_q = F.coalesce(F.col("local_quality"), F.lit(0.0))
    take = needed & F.coalesce(F.col("alt_quality") >= local_q, F.lit(False))
    return j.select(
        "doc_id", local_q.alias("local_quality"), "alt_quality", needed.alias("needs_fallback"),
        F.when(take, "alternative").otherwise("local").alias("chosen"),
    )


def _edge_candidates(lines: Column) -> Column:
    """Normalised first three and last three non-blank lines that can be running headers."""
    normed = F.filter(F.transform(lines, collapse), lambda l: l != "")
    n = F.size(normed)
    edges = F.concat(F.slice(normed, 1, 3), F.when(n > 3, F.slice(normed, F.greatest(n - 2, F.lit(1)), 3)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(
        F.filter(edges, lambda l: (F.length(l) >= 3) & (F.length(l) <= 80) & l.rlike(r"\p{L}"))
    )


def repeating_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, line) that recur at page edges of at least 30 % of the pages (two at least)."""
    cand = pages.select("doc_id", F.explode(_edge_candidates(lines_of("text"))).alias("line"))
    counts = cand.groupBy("doc_id", "line").agg(F.count("*").alias("page_count")).where(F.col("page_count") >= 2)
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return counts.join(totals, "doc_id").where(
        F.col("page_count") >= F.greatest(F.lit(2), F.floor(F.lit(0.30) * F.col("pages")))
    ).select("doc_id", "line", "page_count")


def strip_repeating_lines(pages: DataFrame) -> DataFrame:
    """Drop running headers and footers from every page where they stand at an edge."""
    with_cand = pages.withColumn("__lines", lines_of("text"))
    # only (doc, page, line) keys travel through the joins; the page text is joined once
    hits = (
        with_cand.select("doc_id", "page_number", F.explode(_edge_candidates(F.col("__lines"))).alias("line"))
        .join(repeating_lines(pages).select("doc_id", "line"), ["doc_id", "line"])
        .groupBy("doc_id", "page_number")
        .agg(F.collect_set("line").alias("__remove"))  # six lines per page at most
    )
    kept = F.array_join(F.filter("__lines", lambda l: ~F.array_contains(F.col("__remove"), collapse(l))), "\n")
    return with_cand.join(hits, ["doc_id", "page_number"], "left").select(
        *[c for c in pages.columns if c != "text"],
        F.when(F.col("__remove").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


def polygon_bbox(polygon) -> Column:
    p = col(polygon)
    xs = F.filter(p, lambda _, i: i % 2 == 0)
    ys = F.filter(p, lambda _, i: i % 2 == 1)
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(p) >= 4, box).otherwise(F.array().cast("array<double>"))


def table_to_text(headers, rows) -> Column:
    r = F.transform(col(rows), lambda x: F.array_join(x, " | "))
    h = col(headers)
    lines = F.when(F.size(h) > 0, F.concat(F.array(F.array_join(h, " | ")), r)).otherwise(r)
    return F.array_join(lines, "\n")


def table_to_markdown(headers, rows) -> Column:
    r = F.transform(col(rows), lambda x: F.array_join(x, " | "))
    h = col(headers)
    rule = F.array_join(F.transform(h, lambda _: F.lit("---")), " | ")
    lines = F.when(F.size(h) > 0, F.concat(F.array(F.array_join(h, " | "), rule), r)).otherwise(r)
    return F.array_join(lines, "\n")


def raw_text(pages: DataFrame) -> DataFrame:
    """One text per document with a page marker before each non-empty page."""
    part = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.col("text"))
    return pages.groupBy("doc_id").agg(
        ordered_join(
            F.collect_list(F.when(F.col("text") != "", F.struct("page_number", part.alias("text")))), "\n\n"
        ).alias("raw_text")
    )


def structured_text(sections: DataFrame) -> DataFrame:
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), strip("content"), F.lit("\n"))
    return sections.groupBy("doc_id").agg(
        strip(ordered_join(F.collect_list(F.struct("section_order", part.alias("text"))), "\n")).alias("structured_text")
    )


def page_map(pages: DataFrame) -> DataFrame:
    return pages.select(
        "doc_id", F.col("page_number").alias("page"), F.lit(0).alias("start_offset"),
        F.length("text").alias("end_offset"), "quality", "method", "ocr_used",
    )


def content_summary(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Readiness, raw text length (markers and blank lines included), page and section counts."""
    marker = F.length(F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n")))
    filled = F.col("text") != ""
    p = pages.groupBy("doc_id").agg(
        (F.coalesce(F.sum(F.when(filled, F.length("text") + marker + 2)), F.lit(0))).alias("__len"),
        F.count("*").alias("page_count"),
    )
    s = sections.groupBy("doc_id").agg(F.count("*").alias("section_count"))
    return p.join(s, "doc_id", "left").select(
        "doc_id", (F.col("__len") > 0).alias("content_ready"),
        F.greatest(F.col("__len") - 2, F.lit(0)).alias("raw_text_length"), "page_count",
        F.coalesce("section_count", F.lit(0)).alias("section_count"),
    )


def parse_summary(pages: DataFrame, sections: DataFrame, tables: DataFrame, blocks: DataFrame) -> DataFrame:
    p = pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), F.count_if("ocr_used").alias("ocr_pages"),
        F.coalesce(mean_4dp("quality", ~is_blank("text")), F.lit(0.0)).alias("quality"),
    )
    out = p
    for df, name in ((sections, "section_count"), (tables, "tables_count"), (blocks, "layout_blocks_count")):
        out = out.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    return out.fillna(0, ["section_count", "tables_count", "layout_blocks_count"])


def layout_blocks(pages: DataFrame, sections: DataFrame | None = None, tables: DataFrame | None = None, block_chars: int | None = None) -> DataFrame:
    """Heading lines and paragraph runs per page, numbered inside the page, tables after them.

    `block_seq` is the position on the page; a paragraph's y is the number of blocks of the
    whole document before it, found with a blocked scan over one small row per page.
    """
    live = pages.where(~is_blank("text")).select("doc_id", F.col("page_number").cast("bigint").alias("page_number"), "text")
    rows = once(live, "lines", lines_of("text"))
    rows = once(rows, "flags", F.transform("lines", is_heading))
    rows = once(rows, "cuts", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("flags", i - 1)))
    rows = once(rows, "runs", _page_runs())
    # the scan reads its rows three times, and headings are the cost of a page
    counted = cut(rows.select("doc_id", "page_number", "runs", F.size("runs").cast("bigint").alias("blocks_on_page")))
    offsets = exclusive_scan(
        counted, ["doc_id"], "page_number", {"blocks_before": ("sum", "blocks_on_page")},
        slim=counted.select("doc_id", "page_number", "blocks_on_page"),
    )
    text = offsets.select(
        "doc_id", "page_number", "blocks_before", F.posexplode("runs").alias("block_seq", "run")
    ).select(
        "doc_id", F.col("page_number").cast("int").alias("page"), "block_seq",
        F.when(F.col("run.heading"), "heading").otherwise("paragraph").alias("type"),
        head("run.text", block_chars).alias("text"),
        F.when(F.col("run.heading"), "sectionHeading").otherwise("body").alias("role"),
        F.when(F.col("run.heading"), 0.0)
        .otherwise((F.col("blocks_before") + F.col("block_seq")).cast("double")).alias("y"),
    )
    if sections is not None:
        # the map keeps the last section of a (page, title)
        s = sections.groupBy("doc_id", F.col("page_start").alias("page"), F.col("title").alias("text")).agg(
            F.max("section_order").alias("section_order")
        ).withColumn("type", F.lit("heading"))
        text = text.join(s, ["doc_id", "page", "type", "text"], "left")
    else:
        text = text.withColumn("section_order", F.lit(None).cast("int"))
    cols = ["doc_id", "page", "block_seq", "type", "text", "role", "y", "section_order"]
    if tables is None:
        return text.select(*cols)
    body = strip(table_to_text("headers", "rows"))
    t = tables.where(body != "").select(
        "doc_id", "page", (F.col("table_idx") + 1_000_000).cast("int").alias("block_seq"), F.lit("table").alias("type"),
        head(body, block_chars).alias("text"), F.lit("table").alias("role"), F.lit(None).cast("double").alias("y"),
        F.lit(None).cast("int").alias("section_order"),
    )
    return text.select(*cols).unionByName(t)


def _page_runs() -> Column:
    """Array of (heading, text) runs of one page from its lines and heading positions."""
    lines, cuts = F.col("lines"), F.col("cuts")
    starts = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(F.size(lines) + 1))
    heads = F.transform(
        cuts, lambda i: F.struct((i * 2).alias("o"), F.lit(True).alias("heading"), heading_title(F.get(lines, i - 1)).alias("text"))
    )
    bodies = F.zip_with(
        starts, ends,
        lambda a, b: F.struct(
            (a * 2 + 1).alias("o"), F.lit(False).alias("heading"),
            strip(F.array_join(F.slice(lines, a + 1, F.greatest(b - a - 1, F.lit(0))), "\n")).alias("text"),
        ),
    )
    return F.array_sort(F.concat(heads, F.filter(bodies, lambda r: r["text"] != "")))


def tables_from_cells(cells: DataFrame) -> DataFrame:
    """Loose cells (row_idx, col_idx, text) placed on a full grid; the first row is the header.

    Rows are rebuilt from the cells of each row, so the grid is never materialised as pairs.
    """
    keys = ["doc_id", "table_idx", "page"]
    size = cells.groupBy(*keys).agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols")
    )
    per_row = cells.groupBy(*keys, "row_idx").agg(
        F.map_from_entries(
            F.collect_list(F.struct("col_idx", strip("text").alias("t")))
        ).alias("by_col")
    )
    full = per_row.join(size, keys).withColumn(
        "row", F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.col("by_col")[c], F.lit("")))
    )
    tab = full.groupBy(*keys, "n_rows", "n_cols").agg(
        F.map_from_entries(F.collect_list(F.struct("row_idx", "row"))).alias("by_row")
    )
    blank = F.array_repeat(F.lit(""), F.col("n_cols"))
    grid = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.coalesce(F.col("by_row")[r], blank))
    return tab.select(
        *keys, F.get(grid, F.lit(0)).alias("headers"), F.slice(grid, F.lit(2), F.col("n_rows")).alias("rows")
    )


def pages_from_paragraphs(paras: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Page rows from paragraphs (page_number, para_seq, role, text) in reading order."""
    text = strip("text")
    filled = (
        paras.where(text != "")
        .groupBy("doc_id", "page_number")
        .agg(strip(ordered_join(F.collect_list(F.struct("para_seq", text.alias("text"))), "\n")).alias("text"))
    )
    # every page up to the last one exists, blank where it has no paragraph
    every = paras.groupBy("doc_id").agg(F.max("page_number").alias("n")).select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_number")
    )
    return every.join(filled, ["doc_id", "page_number"], "left").select(
        "doc_id", "page_number", F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("quality", page_quality("text", cfg))


def blocks_from_paragraphs(paras: DataFrame) -> DataFrame:
    heading = F.col("role").isin("title", "sectionHeading")
    text = strip("text")
    return paras.where(text != "").select(
        "doc_id", "page_number", "para_seq",
        F.when(heading, "heading").otherwise("paragraph").alias("type"), text.alias("text"),
        F.when(strip("role") != "", strip("role")).otherwise("body").alias("role"),
        polygon_bbox("polygon").alias("bbox"),
    )
