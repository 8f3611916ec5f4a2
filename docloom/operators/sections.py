"""Sections from page lines, typed blocks or role-tagged paragraphs, and their hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.headings import heading_title, is_heading, is_heading_stripped, section_level
from docloom.functions.text import lines_of, strip
from docloom.plans.scans import exclusive_scan, once
from docloom.plans.stage import cut


def _flags(rows: DataFrame, lines: Column) -> DataFrame:
    """Lines, their stripped form and heading flags, each computed once per row."""
    rows = once(rows, "lines", lines)
    rows = once(rows, "bare", F.transform("lines", strip))
    return once(rows, "flags", F.transform("bare", is_heading_stripped))


def _opening_text(flags, bare) -> Column:
    """True when text stands before the first heading of the row."""
    first = F.array_position(flags, F.lit(True)).cast("int")
    upto = F.when(first > 0, first - 1).otherwise(F.size(bare))
    return F.exists(F.slice(bare, F.lit(1), upto), lambda l: l != "")


def _counts(flagged: DataFrame) -> DataFrame:
    """The small row of a page that runs through the scan."""
    n = F.size(F.filter("flags", lambda f: f)).cast("bigint")
    page = F.col("page_number")
    return flagged.select("doc_id", "page_number", n.alias("n_on_page"), _opening_text("flags", "bare").alias("t0")).select(
        "doc_id", page.cast("bigint").alias("page_number"), "n_on_page",
        F.when(F.col("n_on_page") > 0, page).alias("head_page"), F.when(F.col("t0"), page).alias("text_page"),
    )


def _pieces(flagged: DataFrame) -> DataFrame:
    """Pages cut at their headings: piece 0 continues the open section, piece j starts heading j."""
    n = F.size("lines")
    rows = once(flagged, "cuts", F.filter(F.sequence(F.lit(1), n), lambda i: F.get("flags", i - 1)))
    starts = F.concat(F.array(F.lit(0)), "cuts")
    ends = F.concat("cuts", F.array(n + 1))
    made = F.zip_with(
        starts, ends,
        lambda a, b: F.struct(
            F.when(a > 0, heading_title(F.get("bare", a - 1))).alias("title"),
            (b - a - 1).alias("n_lines"),
            F.array_join(F.slice("lines", a + 1, F.greatest(b - a - 1, F.lit(0))), "\n").alias("body"),
        ),
    )
    return once(rows, "pieces", made).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), F.size("cuts").cast("bigint").alias("n_on_page"), "pieces"
    )


def _assemble(pieces: DataFrame, counts: DataFrame, keep_empty_first: bool) -> DataFrame:
    """Sections from pages cut into pieces.

    Pages carry the number of headings before them, so `before + j` numbers a section and no
    window over a document is needed: the end page comes from the page that closes a section.
    The text is shuffled twice, once into page blocks and once into sections.
    """
    page = F.col("page_number")
    # the scan reads the small rows again and again, and each time would search the headings of all pages
    numbered = exclusive_scan(
        pieces, ["doc_id"], "page_number", {"before": ("sum", "n_on_page")},
        whole={"first_head": ("min", "head_page"), "first_text": ("min", "text_page")}, slim=cut(counts),
    )
    has_preamble = F.lit(True) if keep_empty_first else F.coalesce(
        F.col("first_text") <= F.coalesce("first_head", F.lit(2**31 - 1)), F.lit(False)
    )
    rows = numbered.select(
        "doc_id", "page_number", "before", "n_on_page", has_preamble.alias("has_preamble"),
        F.posexplode("pieces").alias("j", "p"),
    ).select(
        "doc_id", "page_number", "n_on_page", "has_preamble", "j", (F.col("before") + F.col("j")).alias("sec"),
        "p.title", "p.n_lines", "p.body",
    )
    grouped = (
        rows.where((F.col("sec") > 0) | F.col("has_preamble"))
        .groupBy("doc_id", "sec")
        .agg(
            F.bool_or("has_preamble").alias("has_preamble"),
            F.max("title").alias("title"),
            strip(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.when(F.col("n_lines") > 0, F.struct("page_number", "body")))),
                        lambda s: s["body"],
                    ),
                    "\n",
                )
            ).alias("content"),
            F.min(F.when(F.col("title").isNotNull(), page)).alias("heading_page"),
            F.min(F.when(F.col("n_lines") > 0, page)).alias("first_line_page"),
            F.max(F.when(F.col("j") < F.col("n_on_page"), page)).alias("closing_page"),
        )
    )
    first_reset = (F.col("sec") == 0) | ((F.col("sec") == 1) & ~F.col("has_preamble"))
    start = F.when(first_reset, F.coalesce("first_line_page", "heading_page", F.lit(1))).otherwise(F.col("heading_page"))
    return grouped.select(
        "doc_id",
        (F.col("sec") - F.when(F.col("has_preamble"), 0).otherwise(1)).cast("int").alias("section_order"),
        F.coalesce("title", F.lit("Preamble")).alias("title"),
        "content", start.cast("int").alias("page_start"), F.col("closing_page").cast("int").alias("page_end"),
    )


def _close(sections: DataFrame, last_page: DataFrame, fallback: bool) -> DataFrame:
    """The last section ends on the last page; a document of blank lines becomes one empty section."""
    rows = last_page.join(sections, "doc_id", "left" if fallback else "inner")
    missing = F.col("section_order").isNull()
    return rows.select(
        "doc_id", F.coalesce("section_order", F.lit(0)).alias("section_order"),
        F.when(missing, "Document").otherwise(F.col("title")).alias("title"),
        F.when(missing, "").otherwise(F.col("content")).alias("content"),
        F.when(missing, 1).otherwise(F.col("page_start")).alias("page_start"),
        F.coalesce("page_end", F.col("last_page").cast("int")).alias("page_end"),
    )


def detect_sections(pages: DataFrame) -> DataFrame:
    """Sections of every document from its page text; blank pages only move the end page on."""
    live = pages.where(strip("text") != "").select("doc_id", "page_number", "text")
    flagged = _flags(live, lines_of("text"))
    last_page = pages.groupBy("doc_id").agg(F.max("page_number").alias("last_page"))
    return _close(_assemble(_pieces(flagged), _counts(flagged), False), last_page, True)


def sections_from_roles(paras: DataFrame) -> DataFrame:
    """Sections from paragraphs (page_number, para_seq, role, text) in reading order.

    A title or section heading role starts a section; without a role the line test decides.
    """
    text, role = strip("text"), strip(F.coalesce("role", F.lit("")))
    heading = role.isin("title", "sectionHeading") | ((role == "") & is_heading("text"))
    per_page = paras.where(text != "").groupBy("doc_id", "page_number").agg(
        F.array_sort(F.collect_list(F.struct("para_seq", text.alias("line"), heading.alias("h")))).alias("ps")
    )
    flagged = per_page.select(
        "doc_id", "page_number", F.transform("ps", lambda p: p["line"]).alias("lines"),
        F.transform("ps", lambda p: p["line"]).alias("bare"), F.transform("ps", lambda p: p["h"]).alias("flags"),
    )
    last_page = paras.groupBy("doc_id").agg(F.max("page_number").alias("last_page"))
    # a document that opens with a heading keeps its empty preamble: page 1 reads nothing into it
    return _close(_assemble(_pieces(flagged), _counts(flagged), True), last_page, False)


def sections_from_blocks(blocks: DataFrame) -> DataFrame:
    """Sections from typed blocks (block_seq, kind, text, level) with explicit heading levels.

    The text before the first heading is kept even when empty; later sections without text
    are dropped, and the level of a dropped heading is overwritten by the next one.
    """
    heading = F.col("kind") == "heading"
    seq = F.col("block_seq").cast("bigint")
    numbered = exclusive_scan(
        blocks.select("doc_id", seq.alias("block_seq"), "kind", "text", "level", heading.cast("bigint").alias("h")),
        ["doc_id"], "block_seq", {"before": ("sum", "h")},
    ).withColumn("sec", F.col("before") + F.col("h"))
    grouped = numbered.groupBy("doc_id", "sec").agg(
        F.max(F.when(heading, F.col("text"))).alias("title"),
        F.max(F.when(heading, F.col("level"))).alias("level"),
        F.coalesce(
            strip(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.when(~heading, F.struct("block_seq", "text")))), lambda s: s["text"]
                    ),
                    "\n",
                )
            ),
            F.lit(""),
        ).alias("content"),
    )
    # a document that opens with a heading still gets its empty preamble
    opened = grouped.groupBy("doc_id").agg(F.min("sec").alias("m")).where(F.col("m") > 0).select(
        "doc_id", F.lit(0).cast("bigint").alias("sec"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("int").alias("level"), F.lit("").alias("content"),
    )
    all_rows = grouped.unionByName(opened).withColumn(
        "kept", ((F.col("sec") == 0) | (F.col("content") != "")).cast("bigint")
    )
    ordered = exclusive_scan(all_rows, ["doc_id"], "sec", {"rank": ("sum", "kept")})
    # headings without level leave an earlier level of the same slot in place
    slot = ordered.groupBy("doc_id", "rank").agg(
        F.max(F.when(F.col("level").isNotNull(), F.struct("sec", "level")))["level"].alias("slot_level")
    )
    return ordered.where(F.col("kept") == 1).join(slot, ["doc_id", "rank"]).select(
        "doc_id", F.col("rank").cast("int").alias("section_order"),
        F.coalesce("title", F.lit("Preamble")).alias("title"), "content",
        F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        F.col("slot_level").cast("int").alias("explicit_level"),
    )


def sections_from_elements(elements: DataFrame) -> DataFrame:
    """Sections from labelled elements (seq, label, text, page, depth); level is depth + 1."""
    text = strip(F.coalesce("text", F.lit("")))
    heading = F.col("label").isin("section_header", "title") & (text != "")
    rows = elements.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), text.alias("text"), "page", "depth",
        heading.alias("is_h"), heading.cast("bigint").alias("h"),
    )
    numbered = exclusive_scan(rows, ["doc_id"], "seq", {"before": ("sum", "h")}).withColumn(
        "sec", F.col("before") + F.col("h")
    )
    grouped = numbered.groupBy("doc_id", "sec").agg(
        F.max(F.when(F.col("is_h"), F.col("text"))).alias("title"),
        F.max(F.when(F.col("is_h"), F.greatest(F.lit(1), F.coalesce("depth", F.lit(0)) + 1))).alias("level"),
        F.max(F.when(F.col("is_h"), F.col("page"))).alias("page_start"),
        F.max(F.struct("seq", "page"))["page"].alias("last_seen"),
        strip(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(~F.col("is_h") & (F.col("text") != ""), F.struct("seq", "text")))),
                    lambda s: s["text"],
                ),
                "\n",
            )
        ).alias("content"),
    )
    closing = numbered.where("is_h").select("doc_id", (F.col("sec") - 1).alias("sec"), F.col("page").alias("closing"))
    rows = grouped.join(closing, ["doc_id", "sec"], "left").where((F.col("content") != "") | F.col("title").isNotNull())
    has0 = rows.groupBy("doc_id").agg(F.min("sec").alias("first_sec"))
    return rows.join(has0, "doc_id").select(
        "doc_id", (F.col("sec") - F.col("first_sec")).cast("int").alias("section_order"),
        F.coalesce("title", F.lit("Preamble")).alias("title"), "content",
        F.coalesce("page_start", F.lit(1)).alias("page_start"),
        F.coalesce("closing", "last_seen").alias("page_end"),
        F.coalesce("level", F.lit(1)).alias("level"),
    )


SCANNED_LEVELS = 8


def _open_ancestors(rows: DataFrame) -> DataFrame:
    """Per section the latest earlier section of every smaller level, ordered by level.

    For the usual levels a blocked scan carries the latest section of each level; rarer deep
    sections are resolved by a join that touches only them.
    """
    ref = F.struct("section_order", "title")
    slim = rows.select(
        "doc_id", "section_order", "level",
        *[F.when(F.col("level") == l, ref).alias("l%d" % l) for l in range(1, SCANNED_LEVELS + 1)],
    )
    scanned = exclusive_scan(
        slim, ["doc_id"], "section_order",
        {"p%d" % l: ("max", "l%d" % l) for l in range(1, SCANNED_LEVELS + 1)},
    )
    near = F.array_compact(F.array(*[
        F.when(
            (F.col("level") > l) & F.col("p%d" % l).isNotNull(),
            F.struct(F.lit(l).alias("level"), F.col("p%d.section_order" % l).alias("section_order"), F.col("p%d.title" % l).alias("title")),
        )
        for l in range(1, SCANNED_LEVELS + 1)
    ]))
    deep = rows.where(F.col("level") > SCANNED_LEVELS + 1).select("doc_id", "section_order", "level")
    other = rows.where(F.col("level") > SCANNED_LEVELS).select(
        "doc_id", F.col("section_order").alias("o"), F.col("level").alias("ol"), ref.alias("oref")
    )
    far = (
        deep.join(other, "doc_id")
        .where((F.col("o") < F.col("section_order")) & (F.col("ol") < F.col("level")))
        .groupBy("doc_id", "section_order", "ol").agg(F.max("oref").alias("r"))
        .groupBy("doc_id", "section_order")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("ol").alias("level"), F.col("r.section_order").alias("section_order"), F.col("r.title").alias("title")
        ))).alias("far"))
    )
    joined = scanned.select("doc_id", "section_order", near.alias("near")).join(far, ["doc_id", "section_order"], "left")
    return joined.select(
        "doc_id", "section_order",
        F.when(F.col("far").isNull(), F.col("near")).otherwise(F.concat("near", "far")).alias("latest"),
    )


def section_hierarchy(sections: DataFrame, full_path: bool = False) -> DataFrame:
    """Level, parent and path of every section.

    The parent is the nearest earlier section with a smaller level. The usual path names the
    parent and the section; `full_path` names every ancestor and adds the depth.
    """
    explicit = "explicit_level" if "explicit_level" in sections.columns else None
    rows = sections.withColumn("level", section_level("title", explicit).cast("int")).withColumn(
        "section_order", F.col("section_order").cast("bigint")
    )
    # an entry is an open ancestor when nothing of a smaller level came after it
    still_open = F.filter(
        "latest",
        lambda e: ~F.exists("latest", lambda m: (m["level"] < e["level"]) & (m["section_order"] > e["section_order"])),
    )
    chain = _open_ancestors(rows).select("doc_id", "section_order", still_open.alias("chain"))
    keep = [c for c in rows.columns if c != "explicit_level"]
    parent = F.get("chain", F.size("chain") - 1)
    joined = rows.select(*keep).join(chain, ["doc_id", "section_order"]).withColumn("parent", parent)
    path = F.when(F.col("parent").isNotNull(), F.concat(F.col("parent.title"), F.lit(" > "), F.col("title"))).otherwise(F.col("title"))
    if full_path:
        path = F.array_join(F.concat(F.transform("chain", lambda e: e["title"]), F.array("title")), " > ")
    out = [*keep, F.col("parent.section_order").alias("parent_section_order"), path.alias("section_path")]
    if full_path:
        out.append((F.size("chain") + 1).alias("depth"))
    return joined.select(*out)


def section_tree(sections: DataFrame) -> DataFrame:
    """Adjacency form of the nested tree: depth, full path and number of children."""
    rows = section_hierarchy(sections, full_path=True)
    kids = rows.where(F.col("parent_section_order").isNotNull()).groupBy(
        "doc_id", F.col("parent_section_order").alias("section_order")
    ).agg(F.count("*").alias("child_count"))
    return rows.join(kids, ["doc_id", "section_order"], "left").fillna(0, ["child_count"]).select(
        "doc_id", "section_order", "title", "level", "parent_section_order", "depth", "section_path", "child_count",
    )
