"""Pages and passages that answer a group of fields, and character ranges of quotes on a page.

Texts are read once: every page gives one row of small features, and what is chosen for a group is decided on the
features of a document alone. Budgets are arguments; what falls outside one is returned with its flag.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import bound, count_contained, strip
from docloom.operators.feedback import _text
from docloom.plans.scans import once
from docloom.plans.stage import cut

# Weights of a page and of a section, and the patterns they read.
HIT, NEIGHBOUR, OPENING, OPENING_PAGES, PAGE_COST = 10, 1, 5, 5, 20
AHEAD, TOC_AHEAD, PROSE_AHEAD, PROSE, SENTENCE = 800, 300, 500, 50, 20
TOC_ENTRY = r"(?Umd)^\s*\d+\.\s+\w"
PROSE_WORD = r"(?Ui)\b(?:the|shall|contractor|vendor|county|office|design|build)\b"
CONTENTS_AHEAD, CONTENTS = 2000, r"(?Ui)\btable\s+of\s+contents\b"
OVERVIEW = "Background and Overview of Desired Services"
SCOPE_HEADING = (
    r"(?imd)^[ \t]*(?:SECTION\s+[A-Z0-9]+\s*[:.\-–]?\s*|[A-Z0-9]+(?:\.\d+)*[:.)]\s+)?"
    r"(?:Scope of Work|Project Description|Description of Work|Statement of Work|Introduction)\b"
)
WEAK, BEFORE, AFTER, USUAL_FIRST, USUAL_LAST = 80, 1, 4, 15, 21
SECTION_NEEDLES = [
    OVERVIEW, "Technical Services Specifications", "Detailed Scope of Services", "Scope of Work", "Project Description",
    "ADVERTISEMENT FOR PREQUALIFICATION", "PREQUALIFICATION PROPOSALS", "Description of Work", "Work to be Performed", "Statement of Work",
]
COVER_PAGES, IDENTITY_PAGES, BODY_LAST = 5, 8, 25
# group of fields -> how its pages are found; a group not named here goes by its keywords
PLANS = {"dates": "cover", "project_description": "description", "project_identity": "head"}
NOTES = "dates_notes"  # the keywords of the dates group
LOCATION = "location_and_size"

_START, _STOP = "\x01", "\x02"


def section_quality(after: Column) -> Column:
    """Score of a section by what follows its title: real prose beats the entries of a table of contents."""

    def score(a: Column) -> Column:
        prose = F.regexp_count(F.substring(a, 1, PROSE_AHEAD), F.lit(PROSE_WORD))
        entries = F.regexp_count(F.substring(a, 1, TOC_AHEAD), F.lit(TOC_ENTRY))
        full = F.length(a) + prose * PROSE + F.regexp_count(F.substring(a, 1, AHEAD), F.lit(r"[.!?]")) * SENTENCE
        listed = (entries >= 2) & (prose < 2)
        return F.when(a == "", 0).when(listed, F.greatest(F.lit(1), F.floor(full / 10))).otherwise(full).cast("bigint")

    return bound(strip(after), score)


def _ahead(pieces: Column, i: Column, between: str, least: int) -> Column:
    """What follows occurrence i of a text split at its occurrences, AHEAD characters of it; `least` is the shortest occurrence."""
    return F.substring(F.array_join(F.slice(pieces, i + 2, AHEAD // least + 2), between), 1, AHEAD)


def section_anchors(text, needles: list[str], slice_len: int | None = None) -> Column:
    """(needle_no, hit_no, start, score) of every place of every needle, in order; each text is split once per needle."""
    t = _text(text)

    def places(no: int, needle: str) -> Column:
        def listed(pieces: Column) -> Column:
            sizes = F.transform(pieces, F.length)
            seen = F.when(F.lit(slice_len is None), AHEAD).otherwise(F.lit(max(0, (slice_len or 0) - len(needle))))
            return F.transform(
                F.sequence(F.lit(0), F.size(pieces) - 2),
                lambda i: F.struct(
                    F.lit(no).alias("needle_no"), i.alias("hit_no"),
                    (F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, x: s + x) + i * len(needle) + 1).cast("bigint").alias("start"),
                    section_quality(F.substring(_ahead(pieces, i, needle, len(needle)), F.lit(1), seen)).alias("score"),
                ),
            )

        pieces = F.split(t, re.sub(r"([^\w ])", r"\\\1", needle), -1)
        empty = F.array().cast("array<struct<needle_no:int,hit_no:int,start:bigint,score:bigint>>")
        return bound(pieces, lambda p: F.when(F.size(p) > 1, listed(p)).otherwise(empty))

    return F.flatten(F.array(*[places(k, n) for k, n in enumerate(needles)]))


def best_section_slice(texts: DataFrame, needles: list[str] | None = None, slice_len: int | None = None) -> DataFrame:
    """doc_id, start, score and section: the text from the best place of any needle on, whole or `slice_len` characters.

    The first place of the highest score wins, needles in their order; documents without a scoring place have no row.
    """
    rows = once(texts.select("doc_id", "text"), "places", section_anchors("text", needles or SECTION_NEEDLES, slice_len))
    first = F.array_min(F.transform(F.filter("places", lambda p: p["score"] > 0), lambda p: F.struct((-p["score"]).alias("o"), p["needle_no"], p["hit_no"], p["start"], p["score"])))
    rows = rows.select("doc_id", "text", first.alias("b")).where(F.col("b").isNotNull())
    size = F.length("text") if slice_len is None else F.lit(slice_len)
    return rows.select("doc_id", F.col("b.start").alias("start"), F.col("b.score").alias("score"), F.substring(F.col("text"), F.col("b.start").cast("int"), size).alias("section"))


def description_score(text) -> Column:
    """How well a page anchors the description of the work; pages with a table of contents never do."""
    t = _text(text)
    marked = F.split(F.regexp_replace(t, SCOPE_HEADING, _START + "$0" + _STOP), _START, -1)

    def headings(pieces: Column) -> Column:
        # a piece after the first holds a heading, the mark behind it, and what follows
        def after(i: Column) -> Column:
            tail = F.array_join(F.slice(pieces, i + 2, AHEAD // 12 + 2), "")
            return bound(tail, lambda s: F.substring(F.translate(F.substr(s, F.locate(_STOP, s) + 1), _STOP, ""), 1, AHEAD))

        return F.when(F.size(pieces) > 1, F.array_max(F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: section_quality(after(i))))).otherwise(F.lit(0).cast("bigint"))

    at = F.locate(OVERVIEW, t)
    overview = section_quality(F.substring(F.substr(t, at + len(OVERVIEW)), 1, AHEAD)) * 2
    contents = F.substring(t, 1, CONTENTS_AHEAD).rlike(CONTENTS)
    return F.when(contents, 0).when(at > 0, overview).otherwise(bound(marked, headings)).cast("bigint")


def page_features(pages: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """doc_id and `pages`: per page in order its number, length, distinct keywords of each group, and description score.

    The one pass over the texts. A page is a few numbers, so a document of a million pages is some tens of MB.
    """
    lowered = once(pages.select("doc_id", "page_number", "text"), "low", F.lower(_text("text")))
    hits = F.array(*[count_contained(F.col("low"), words).cast("int") for words in groups.values()])
    rows = lowered.select("doc_id", F.struct("page_number", F.length(strip(_text("text"))).alias("length"), hits.alias("hits"), description_score("text").alias("description")).alias("p"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))


def _scored(group_no: int, opening: bool) -> Column:
    """Pages with the score of one group: ten for each keyword, one for each neighbour with any, five for the first pages of some."""
    pages = F.col("pages")

    def beside(i: Column, page: Column, step: int) -> Column:
        other = F.get(pages, i + step)
        return F.coalesce((other["page_number"] == page["page_number"] + step) & (F.get(other["hits"], F.lit(group_no)) > 0), F.lit(False)).cast("int") * NEIGHBOUR

    def score(page: Column, i: Column) -> Column:
        own = F.get(page["hits"], F.lit(group_no)) * HIT + beside(i, page, -1) + beside(i, page, 1)
        return own + F.when(F.lit(opening) & (i < OPENING_PAGES), OPENING).otherwise(0)

    return F.transform(pages, lambda p, i: F.struct((-score(p, i)).alias("order"), p["page_number"].alias("page_number"), p["length"].alias("length")))


def _chosen(group_no: int, opening: bool, budget: int) -> Column:
    """(page_number, score, selected) of the scoring pages: the best first as long as they fit the budget, passing over those that don't."""
    ranked = F.array_sort(F.filter(_scored(group_no, opening), lambda p: (p["order"] < 0) & (p["length"] > 0)))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, p: Column) -> Column:
        cost = p["length"] + PAGE_COST
        fits = state["used"] + cost <= budget
        return F.struct((state["used"] + F.when(fits, cost).otherwise(0)).alias("used"), F.when(fits, F.concat(state["taken"], F.array(p["page_number"]))).otherwise(state["taken"]).alias("taken"))

    def flagged(pages: Column) -> Column:
        return bound(F.aggregate(pages, start, step)["taken"], lambda taken: F.transform(
            pages, lambda p: F.struct(p["page_number"].alias("page_number"), (-p["order"]).cast("bigint").alias("score"), F.array_contains(taken, p["page_number"]).alias("selected"))))

    return bound(ranked, flagged)


def page_slice(pages: DataFrame, groups: dict[str, list[str]], budget: int) -> DataFrame:
    """doc_id, group_id, page_number, score and selected: every page that scores for a group, chosen within `budget` characters or not."""
    features = page_features(pages, groups)
    picks = F.array(*[F.struct(F.lit(g).alias("group_id"), _chosen(k, g == LOCATION, budget).alias("picks")) for k, g in enumerate(groups)])
    each = features.select("doc_id", F.explode(picks).alias("g")).select("doc_id", "g.group_id", F.explode("g.picks").alias("p"))
    return each.select("doc_id", "group_id", "p.page_number", "p.score", "p.selected")


def _described() -> Column:
    """(anchor page or null, first, last) of the pages around the best description."""
    best = F.array_min(F.transform(F.filter("pages", lambda p: p["description"] >= WEAK), lambda p: F.struct((-p["description"]).alias("o"), p["page_number"])))
    return bound(best["page_number"], lambda a: F.struct(
        a.alias("anchor"), F.when(a.isNull(), USUAL_FIRST).otherwise(F.greatest(F.lit(1), a - BEFORE)).alias("first"), F.when(a.isNull(), USUAL_LAST).otherwise(a + AFTER).alias("last")))


def description_pages(pages: DataFrame, budget: int) -> DataFrame:
    """doc_id, page_number, anchor_page, start and inside: the pages around the best description of the work in order.

    `start` is where a page begins in the joined text, and `inside` whether that is within `budget` characters; without
    a page that scores enough the usual middle pages stand in and `anchor_page` is null.
    """
    rows = page_features(pages, {}).withColumn("d", _described())
    fits = F.filter("pages", lambda p: p["page_number"].between(F.col("d.first"), F.col("d.last")) & (p["length"] > 0))
    rows = once(rows.select("doc_id", "d.anchor", fits.alias("f")), "kept", F.col("f"))
    header = lambda p: F.length(F.concat(F.lit("--- Page "), p["page_number"].cast("string"), F.lit(" ---\n")))
    start = lambda i: F.aggregate(F.slice("kept", 1, i), F.lit(0), lambda s, p: s + p["length"] + header(p) + 2)
    each = rows.select("doc_id", "anchor", F.explode(F.transform("kept", lambda p, i: F.struct(p["page_number"], start(i).alias("start")))).alias("k"))
    return each.select("doc_id", F.col("k.page_number").alias("page_number"), F.col("anchor").alias("anchor_page"), F.col("k.start").alias("start"), (F.col("k.start") < budget).alias("inside"))


def group_context(pages: DataFrame, groups: dict[str, list[str]], budget: int) -> DataFrame:
    """doc_id, group_id, source, page_number, position and selected: the pages that each group of fields is read from.

    One pass over the pages: the plan of every group (PLANS) is an expression on the features of its document. Dates
    take the cover and what their note keywords choose elsewhere; the description its anchored pages, else body pages;
    the identity the first pages; every other group its keywords, and the whole document where none is found.
    """
    words = groups | ({NOTES: groups[NOTES]} if NOTES in groups else {NOTES: []})
    number = {g: k for k, g in enumerate(words)}
    empty = F.array().cast("array<struct<source:string,page_number:int,selected:boolean>>")

    def tagged(array: Column, source: str) -> Column:
        return F.transform(array, lambda p: F.struct(F.lit(source).alias("source"), p["page_number"].cast("int").alias("page_number"), F.lit(True).alias("selected")))

    def filled(last: int, first: int = 1) -> Column:
        return F.filter(F.slice("pages", first, last - first + 1), lambda p: p["length"] > 0)

    def keyworded(group: str) -> Column:
        picks = _chosen(number[group], group == LOCATION, budget)
        return F.array_sort(F.transform(picks, lambda p: F.struct(F.lit("keyword").alias("source"), p["page_number"].cast("int").alias("page_number"), p["selected"].alias("selected"))))

    def usable(array: Column) -> Column:
        return F.exists(array, lambda p: p["selected"])

    whole = tagged(F.filter("pages", lambda p: p["length"] > 0), "document")

    def plan(group: str) -> Column:
        kind = PLANS.get(group)
        if kind == "cover":
            cover = tagged(filled(COVER_PAGES), "cover")
            opening = F.transform(F.slice("pages", 1, COVER_PAGES), lambda p: p["page_number"].cast("int"))
            extra = F.filter(keyworded(NOTES), lambda p: ~F.array_contains(opening, p["page_number"]))
            both = F.concat(cover, extra)
            return F.when(usable(both), both).otherwise(whole)
        if kind == "description":
            near = bound(_described(), lambda d: tagged(F.filter("pages", lambda p: p["page_number"].between(d["first"], d["last"]) & (p["length"] > 0)), "description"))
            body = tagged(filled(BODY_LAST, 2), "body")
            return F.when(usable(near), near).when(usable(body), body).otherwise(whole)
        if kind == "head":
            opening = tagged(filled(IDENTITY_PAGES), "head")
            return F.when(usable(opening), opening).otherwise(whole)
        return bound(keyworded(group), lambda k: F.when(usable(k), k).otherwise(whole))

    asked = [g for g in dict.fromkeys([*PLANS, *groups]) if g != NOTES]
    rows = page_features(pages, words)
    plans = F.array(*[F.struct(F.lit(g).alias("group_id"), F.coalesce(plan(g), empty).alias("parts")) for g in asked])
    each = rows.select("doc_id", F.explode(plans).alias("g")).select("doc_id", "g.group_id", F.posexplode("g.parts").alias("position", "p"))
    return each.select("doc_id", "group_id", "p.source", "p.page_number", "position", "p.selected")


def context_text(context: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, group_id and text: the selected pages of every group in their order, under their page headers."""
    body = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), strip(_text("text")))
    rows = context.where("selected").join(pages.select("doc_id", "page_number", "text"), ["doc_id", "page_number"])
    parts = F.array_sort(F.collect_list(F.struct("position", body.alias("text"))))
    return rows.groupBy("doc_id", "group_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


# ---- ranges of quotes

# What a viewer's text search leaves out or evens out, in this order; lengths of the slices it tries.
_STEPS = [
    (re.compile("­"), ""), (re.compile(r"-\s*\n\s*"), ""), (re.compile(r"\s+"), " "), (re.compile('["„]'), '"'), (re.compile("['‚]"), "'"),
    (re.compile("�"), ""), (re.compile(r"[^A-Za-z0-9_\s\"'.,;:$%()/\-]"), " "), (re.compile(r"\s+"), " "),
]
SLICES = [48, 32, 24, 20]
ANCHOR_WORDS, ANCHOR_CHARS, ANCHOR_MORE = 3, 12, 40


def evened(text: str | None) -> tuple[str, np.ndarray]:
    """A text as the search sees it, and for every character of it the place it stands at in the text."""
    lowered = [c.lower() for c in text or ""]
    at = np.repeat(np.arange(len(lowered)), [len(c) for c in lowered]) if lowered else np.empty(0, np.int64)
    out = "".join(lowered)
    for pattern, new in _STEPS:
        keep, parts, last = np.ones(len(out), bool), [], 0
        for m in pattern.finditer(out):
            keep[m.start() + len(new) : m.end()] = False
            parts += [out[last : m.start()], new]
            last = m.end()
        if parts:
            out, at = "".join(parts) + out[last:], at[keep]
    left = len(out) - len(out.lstrip())
    out = out.strip()
    return out, at[left : left + len(out)]


@F.pandas_udf(T.StructType([T.StructField("norm", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
def evened_text(texts: pd.Series) -> pd.DataFrame:
    rows = [evened(t) for t in texts]
    return pd.DataFrame({"norm": [r[0] for r in rows], "at": [r[1].astype(np.int32) for r in rows]})


def _wanted(norm: Column) -> Column:
    """(tier, text, size) of what may stand for a quote, in the order it is tried."""

    def listed(words: Column) -> Column:
        n = F.size(words)
        least = F.least(F.lit(6), F.greatest(F.lit(3), F.ceil(n * 0.4).cast("int")))
        runs = F.when(n >= least, F.sequence(n, least, F.lit(-1))).otherwise(F.array().cast("array<int>"))
        item = lambda tier, text, size=None: F.struct(F.lit(tier).alias("tier"), text.alias("text"), (F.length(text) if size is None else size).alias("size"))
        anchor = F.array_join(F.slice(words, 1, ANCHOR_WORDS), " ")
        whole = F.array(item("full", norm))
        prefixes = F.transform(runs, lambda w: item("prefix", F.array_join(F.slice(words, F.lit(1), w), " ")))
        suffixes = F.transform(runs, lambda w: item("suffix", F.array_join(F.slice(words, n - w + 1, w), " ")))
        slices = F.array_compact(F.array(*[F.when(F.length(norm) >= k, item("slice", F.substring(norm, 1, k))) for k in SLICES]))
        start = F.when((n >= ANCHOR_WORDS) & (F.length(anchor) >= ANCHOR_CHARS), F.array(item("anchor", anchor, F.least(F.length(norm), F.length(anchor) + ANCHOR_MORE))))
        return F.concat(whole, prefixes, suffixes, slices, F.coalesce(start, F.filter(whole, lambda _: F.lit(False))))

    return bound(F.filter(F.split(norm, " "), lambda w: w != ""), listed)


def locate_quote(quotes: DataFrame, pages: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, item_id, page_number, tier, start and end: where a quote (source_text, page hint) stands near its page.

    Pages are tried by distance from the hint, later ones first; on a page the whole quote is tried, then its longest
    beginning and ending by words, fixed slices, and its first words. `start` and `end` count characters of the page
    as it is; `norm_start` and `norm_length` those of its evened form. Quotes found nowhere have no row.
    """
    index = once(pages.select("doc_id", "page_number", "text"), "e", evened_text(_text("text"))).select("doc_id", "page_number", "e.norm", "e.at", F.length(_text("text")).alias("chars"))
    index = cut(index)
    wanted = once(quotes.select("doc_id", "item_id", "source_text", F.col("page").alias("hint")), "q", evened_text(_text("source_text"))["norm"]).where(F.col("q") != "")
    wanted = once(wanted, "tries", _wanted(F.col("q")))
    near = wanted.select("doc_id", "item_id", "hint", "tries", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("off"))
    near = near.withColumn("page_number", (F.col("hint") + F.col("off")).cast(index.schema["page_number"].dataType))
    met = near.join(index.select("doc_id", "page_number", "norm"), ["doc_id", "page_number"])
    met = once(met, "hit", F.get(F.filter("tries", lambda t: F.col("norm").contains(t["text"])), F.lit(0))).where(F.col("hit").isNotNull())
    order = F.struct(F.abs("off").alias("far"), (-F.col("off")).alias("o"), "page_number", F.col("hit.tier").alias("tier"), F.col("hit.size").alias("size"), F.expr("instr(norm, hit.text)").alias("at1"))
    best = met.groupBy("doc_id", "item_id").agg(F.min(order).alias("b")).select("doc_id", "item_id", "b.page_number", "b.tier", "b.size", "b.at1")
    found = best.join(index.select("doc_id", "page_number", "at", "chars"), ["doc_id", "page_number"])
    last = F.least(F.col("at1") + F.col("size") - 1, F.size("at"))
    return found.select(
        "doc_id", "item_id", "page_number", "tier", F.element_at("at", F.col("at1")).cast("bigint").alias("start"), (F.element_at("at", last) + 1).cast("bigint").alias("end"),
        (F.col("at1") - 1).cast("bigint").alias("norm_start"), F.col("size").cast("bigint").alias("norm_length"),
    )
