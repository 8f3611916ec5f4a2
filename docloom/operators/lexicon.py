"""Cover classification, term mining and the learned vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, UNCUT, Config, Limits
from docloom.fixed import FOCUSED_TYPES
from docloom.functions.text import WS, bound, col, collapse, contains_any, first, head, literal_array, norm_ws, ordered_join, strip, within
from docloom.plans.scans import once

# Class markers with the tie order of the classes.
SOLICITATION_MARKERS = {
    "prequalification": [
        "prequalification", "pre-qualification", "prequalify", "statement of qualifications", "soq", "aia document",
        "qualification questionnaire", "qualifications questionnaire",
    ],
    "federal_rfq": [
        "request for quotation", "request for quote", "rfq", "sf-1449", "sf 1449", "sf-18", "sf-33", "standard form",
        "naics", "combined synopsis", "federal acquisition regulation", "far ", "dpas", "solicitation number",
    ],
    "state_ifb": [
        "invitation for bid", "invitation for bids", "invitation to bid", "ifb", "itb", "sealed bid", "sealed bids",
        "competitive sealed", "lowest responsible bidder", "bidders", "bidder's", "bidders/offerors",
        "bidders certification",
    ],
    "rfp": ["request for proposal", "request for proposals", "rfp"],
}
DOMAIN_MARKERS = {
    "it_network": [
        "structured cabling", "cabling", "network switch", "switches", "switch", "wireless", "wi-fi", "wifi",
        "access point", "fiber", "voip", "telecommunication", "telecommunications", "e-rate", "erate", "category 6",
        "cat6", "cat 6", "ethernet", "lan", "wan", "data network", "patch panel",
    ],
    "construction": [
        "demolition", "hvac", "square feet", "square footage", "architect", "renovation", "masonry", "roofing",
        "sitework", "general contractor", "concrete", "plumbing", "mechanical", "earthwork", "building construction",
    ],
}
# Stopwords and patterns of term mining, in their order of use.
STOPWORDS = (
    "a an the and or but if in on at to for of is are was were be been being by with from as this that these those it "
    "its they them their we you your shall will may must not all any each per via into out up down over under section "
    "page table contents herein thereof hereof hereby hereunder"
).split()
ID_TERM = (
    r"(?iU)\b(?:IFB|RFP|RFQ|ITB|Bid|Project|Contract|Solicitation|Spec|Tender|Job|File)\s*(?:No\.?|Number|#|:)\s*[\w\-/.]+"
)
DATE_TERM = (
    r"(?iU)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},?\s+\d{4}\b"
)
LABEL_TERM = r"(?mU)(?:^|\n)\s*([A-Za-z][A-Za-z0-9\s/\-()]{2,48}?)\s*:\s"
PROPER_TERM = r"(?U)\b[A-Z][A-Za-z0-9\-]*(?:\s+(?:[A-Z][A-Za-z0-9\-]*|of|and|&|No\.)){0,5}\b"
# Substrings that route a term to extraction types.
HOOKS = {
    "eligibility_criteria": [
        "owner", "engineer", "architect", "solicitation", "bid no", "project no", "ifb", "rfp", "contractor", "bidder",
        "qualif",
    ],
    "submission_deadlines": [
        "deadline", "due", "closing", "conference", "meeting", "opening", "date", "pre-bid", "prebid", "walkthrough",
        "municipal", "council",
    ],
    "technical_requirements": [
        "square", "sq ft", "location", "address", "site", "completion", "duration", "start", "area", "campus",
    ],
    "scope_of_work": ["scope", "description", "work", "project", "improvement", "construction", "services", "overview"],
    "payment_terms": ["value", "budget", "cost", "amount", "price", "payment", "$", "estimate"],
    "penalties_and_risks": ["bond", "surety", "penalty", "security", "guarantee", "check", "forfeit"],
    "mandatory_documents": [
        "form", "obtain", "download", "submit", "proposal", "document", "annex", "appendix", "instructions",
    ],
    "set_asides": [
        "mbe", "wbe", "dbe", "dvbe", "hub", "sbe", "minority", "women", "disadvantaged", "small business", "set-aside",
        "set aside", "diversity", "participation goal",
    ],
}
# Search queries per type and their additions per document class.
STATIC_QUERIES = {
    "eligibility_criteria": [
        "project name owner solicitation number tender reference invitation to bid",
        "project engineer architect consultant design professional firm name",
        "bidder eligibility qualification experience prequalification requirements",
    ],
    "submission_deadlines": [
        "bid closing date submission deadline proposal due date time",
        "pre-bid conference proposer conference mandatory meeting",
        "site visit walkthrough mandatory site inspection date",
        "questions deadline clarification due bid opening municipal meeting council award",
    ],
    "technical_requirements": [
        "project location site address facility campus municipality county",
        "technical specifications equipment installation requirements materials quantity",
        "contractor furnish labor materials equipment supplies required work",
        "sealed proposals prequalified contractors received owner location address",
    ],
    "scope_of_work": [
        "project description scope of work overview summary",
        "work to be performed deliverables services specifications",
        "statement of work demolition removal utility services contractor required",
    ],
    "payment_terms": [
        "estimated project value budget contract amount cost range dollar",
        "payment terms invoice milestone retention commercial pricing",
        "project value threshold notice newspaper publication general circulation requirement",
    ],
    "penalties_and_risks": [
        "bid bond performance bond payment bond surety guarantee SF-24",
        "certified check cashier check bid security bond amount percentage",
        "liquidated damages penalty termination default forfeit",
    ],
    "mandatory_documents": [
        "mandatory forms annexures appendices required documents submission",
        "how to obtain bid documents download acquire solicitation package",
        "proposal submission instructions bid submission requirements",
    ],
    "set_asides": [
        "MBE WBE DBE DVBE HUB SBE minority women disadvantaged small business goal percentage",
        "set-aside subcontracting goal diversity participation requirement",
    ],
}
OVERRIDES = [
    ("domain", "it_network", "scope_of_work", "network cabling switches wireless wifi equipment installation configuration system design"),
    ("domain", "it_network", "technical_requirements", "structured cabling category 6 fiber patch panel access point switch port specifications"),
    ("solicitation_type", "federal_rfq", "penalties_and_risks", "bid guarantee bid bond SF-24 performance payment bond SF-25 surety"),
    ("solicitation_type", "federal_rfq", "mandatory_documents", "standard form SF-1449 representations certifications offeror fill-in"),
    ("solicitation_type", "state_ifb", "penalties_and_risks", "bid security certified check cashier check percentage of bid bond"),
]


def cover_text(pages: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT, limits: Limits = UNCUT) -> DataFrame:
    """Text of the first pages of each document, or of its first chunks when those are blank."""
    # page numbers start at one, so the first pages need no ranking of the document
    opening = pages.where(F.col("page_number") <= cfg.cover_max_pages)
    part = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), strip("text"))
    p = opening.groupBy("doc_id").agg(
        ordered_join(F.collect_list(F.when(strip("text") != "", F.struct("page_number", part.alias("text")))), "\n\n").alias("p")
    )
    piece = F.concat(
        F.lit("--- Pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(" | "),
        F.col("section_title"), F.lit(" ---\n"), strip("chunk_text"),
    )
    c = chunks.where(within("chunk_order", limits.cover_chunks)).groupBy("doc_id").agg(
        ordered_join(F.collect_list(F.struct("chunk_order", piece.alias("text"))), "\n\n").alias("c")
    )
    text = F.when(F.coalesce("p", F.lit("")) != "", F.col("p")).otherwise(F.coalesce("c", F.lit("")))
    return p.join(c, "doc_id", "full_outer").select("doc_id", head(strip(text), limits.cover_chars).alias("cover"))


def _score(low: Column, markers: list[str]) -> Column:
    out = F.lit(0)
    for m in markers:
        # a text without the literal is not searched for its word boundaries
        out = out + (low.contains(m) & low.rlike(r"(?U)\b" + re.escape(m) + r"\b")).cast("int")
    return out


def _best_class(low: Column, table: dict[str, list[str]], default: str) -> Column:
    # ties go to the class listed first: a smaller index makes a larger struct
    options = F.array(*[
        F.struct(_score(low, words).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("n"))
        for i, (name, words) in enumerate(table.items())
    ])
    return bound(F.array_max(options), lambda best: F.when(best["s"] > 0, best["n"]).otherwise(default))


def classify_documents(cover: DataFrame) -> DataFrame:
    # the text is lower-cased once, not once for each marker
    rows = once(cover, "__low", F.lower(F.coalesce("cover", F.lit(""))))
    low = F.col("__low")
    return rows.select(
        "doc_id", _best_class(low, SOLICITATION_MARKERS, "unknown").alias("solicitation_type"),
        _best_class(low, DOMAIN_MARKERS, "general").alias("domain"),
    )


def _placed(expr: Column) -> Column:
    """Elements sorted by their lower-case form and place, so that repeats stand side by side."""
    return F.sort_array(F.transform(expr, lambda t, i: F.struct(F.lower(strip(t)).alias("l"), i.alias("i"), t.alias("t"))))


def _firsts(k: Column) -> Column:
    """The first of each run of repeats, back at their places."""
    firsts = F.filter(k, lambda x, j: x["l"].isNotNull() & ((j == 0) | ~x["l"].eqNullSafe(F.get(k, j - 1)["l"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))), lambda x: x["t"])


def _distinct_ci(df: DataFrame, name: str, expr: Column, limit: int | None = None) -> DataFrame:
    """Add an array without case-insensitive repeats, first spelling kept. Each step is computed once per row."""
    kept = _firsts(F.col("__k"))
    return once(df, "__k", _placed(expr)).withColumn(name, kept if limit is None else F.slice(kept, 1, limit)).drop("__k")


def with_mined(df: DataFrame, text, limit: int | None = None, name: str = "mined") -> DataFrame:
    """Add the document-specific phrases of a text in pattern order."""
    t = F.coalesce(col(text), F.lit(""))

    def found(pattern, group=0):
        return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))

    phrases = F.filter(found(PROPER_TERM), lambda p: strip(p).rlike(WS))
    raw = F.transform(F.concat(found(ID_TERM), found(DATE_TERM), found(LABEL_TERM, 1), phrases), collapse)
    stop = literal_array(STOPWORDS)

    def useful(p):
        words = F.split(F.lower(p), " ")
        common = F.size(F.filter(words, lambda w: F.array_contains(stop, w)))
        return F.length(p).between(3, 80) & (common < F.size(words) - 1)

    return _distinct_ci(once(df, "__raw", raw), name, F.filter("__raw", useful), limit).drop("__raw")


def mined_terms(docs: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return with_mined(docs, text, limit).select("doc_id", F.posexplode("mined").alias("term_seq", "term"))


def term_types(term) -> Column:
    """Extraction types of a term; a term without a hook belongs to all of them."""
    def hooked(low):
        return F.array_compact(F.array(*[F.when(contains_any(low, HOOKS[t]), t) for t in FOCUSED_TYPES]))

    return bound(bound(F.lower(col(term)), hooked), lambda hit: F.when(F.size(hit) > 0, hit).otherwise(literal_array(FOCUSED_TYPES)))


def route_terms(terms: DataFrame) -> DataFrame:
    return terms.select("*", F.explode(term_types("term")).alias("extraction_type"))


def load_lexicon(lexicon: DataFrame, limit: int | None = None) -> DataFrame:
    w = Window.partitionBy("extraction_type", "entry_kind").orderBy(F.desc("hit_count"), "term_display", "term_normalized")
    return lexicon.where("is_active").withColumn("rank", F.row_number().over(w)).where(within("rank", limit))


def document_lexicon(mined: DataFrame, loaded: DataFrame) -> DataFrame:
    """Terms and queries per document and type: learned ones first, then those of the document.

    The learned vocabulary is limited per type, so it travels as one small array per type.
    """
    learned = loaded.groupBy("extraction_type", "entry_kind").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term_display"))), lambda s: s["term_display"]).alias("ts")
    )
    per_type = learned.groupBy("extraction_type").agg(
        F.max(F.when(F.col("entry_kind") == "term", F.col("ts"))).alias("lt"),
        F.max(F.when(F.col("entry_kind") == "query", F.col("ts"))).alias("lq"),
    )
    # learned queries are the same for all documents
    per_type = _distinct_ci(per_type, "queries", F.filter(F.transform("lq", strip), lambda t: F.length(t) >= 8)).drop("lq")
    # every term is routed once; the types are spread afterwards
    own = mined.withColumn("types", term_types("term")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("term_seq", "term", "types"))).alias("m")
    )
    empty = F.array().cast("array<string>")
    glob = _distinct_ci(own, "global_terms", F.filter(F.transform("m", lambda s: strip(s["term"])), lambda t: F.length(t) >= 3))
    rows = glob.select("doc_id", "m", "global_terms", F.explode(literal_array(FOCUSED_TYPES)).alias("extraction_type")).join(
        per_type, "extraction_type", "left"
    )
    routed = F.transform(F.filter("m", lambda s: F.array_contains(s["types"], F.col("extraction_type"))), lambda s: s["term"])
    parts = F.concat(F.coalesce("lt", empty), routed)
    # an expression of its own, so that a reader who can do without it does not pay for it
    typed = bound(_placed(F.filter(F.transform(parts, strip), lambda t: F.length(t) >= 3)), _firsts)
    return rows.select("doc_id", "extraction_type", "global_terms", typed.alias("typed_terms"), F.coalesce("queries", empty).alias("queries"))


def cache_sufficient(lexicon: DataFrame, types: list[str] | None = None, minimum: int = DEFAULT.lexicon_min_terms) -> DataFrame:
    types = types or FOCUSED_TYPES
    active = F.col("is_active") & (F.col("entry_kind") == "term")
    counts = [F.count_if(active & (F.col("extraction_type") == t)) >= minimum for t in types]
    ok = counts[0]
    for c in counts[1:]:
        ok = ok & c
    return lexicon.agg(ok.alias("sufficient"))


def novel_terms(mined: DataFrame, loaded: DataFrame, limit: int | None = None) -> DataFrame:
    known = loaded.where(F.col("entry_kind") == "term").select(F.col("term_normalized").alias("norm")).distinct()
    return mined.where(within(F.col("term_seq") + 1, limit)).withColumn("norm", norm_ws("term")).join(known, "norm", "left_anti")


def skip_vocabulary_pass(covers: DataFrame, mined: DataFrame, lexicon: DataFrame, loaded: DataFrame, limit: int | None = None) -> DataFrame:
    """True where the learned vocabulary is large enough and the cover brings nothing new."""
    novel = novel_terms(mined, loaded, limit).select("doc_id").distinct().withColumn("__novel", F.lit(True))
    enough = cache_sufficient(lexicon).select("sufficient").scalar()
    return covers.select("doc_id").join(novel, "doc_id", "left").select(
        "doc_id", (enough & F.col("__novel").isNull()).alias("skip")
    )


def record_terms(lexicon: DataFrame, new: DataFrame, kind: str, known: DataFrame | None = None, limits: Limits = UNCUT) -> DataFrame:
    """Lexicon after recording (extraction_type, term, source, seen_at): counters add up per use."""
    minimum = 8 if kind == "query" else 3
    display = strip(F.coalesce("term", F.lit("")))
    # documents share most of their terms: each spelling is counted first and looked at once
    spelled = new.groupBy("extraction_type", "term", "source", "seen_at").agg(F.count("*").alias("n"))
    looked = once(spelled, "__x", F.struct(display.alias("display"), norm_ws("term").alias("term_normalized")))
    rows = looked.select("extraction_type", "__x.display", "__x.term_normalized", "source", "seen_at", "n").where(
        (F.length("display") >= minimum) & (F.col("term_normalized") != "")
    )
    if known is not None:
        rows = rows.join(known.select("term_normalized").distinct(), "term_normalized", "left_anti")
    last = F.max(F.struct("seen_at", "display"))
    uses = rows.groupBy("extraction_type", "term_normalized").agg(
        F.sum("n").alias("uses"), head(last["display"], limits.display_chars).alias("new_display"), last["seen_at"].alias("new_seen"),
        F.min(F.struct("seen_at", "source"))["source"].alias("new_source"),
    ).withColumn("entry_kind", F.lit(kind))
    j = lexicon.join(uses, ["extraction_type", "entry_kind", "term_normalized"], "full_outer")
    fresh = F.col("term_display").isNull()
    return j.select(
        "extraction_type", "entry_kind", "term_normalized",
        F.coalesce("new_display", "term_display").alias("term_display"),
        F.when(fresh, F.col("new_source")).otherwise(F.col("source")).alias("source"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("uses", F.lit(0))).alias("hit_count"),
        F.coalesce("document_count", F.lit(1)).alias("document_count"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.coalesce("new_seen", "last_seen_at").alias("last_seen_at"),
    )


def persist_lexicon(lexicon: DataFrame, doc_lexicon: DataFrame, seen_at, limits: Limits = UNCUT) -> DataFrame:
    """Store the terms and queries of document lexicons that are not known yet."""
    loaded = load_lexicon(lexicon, limits.lexicon_terms)
    at = F.lit(seen_at).cast("timestamp")
    out = lexicon
    for kind, column, source in (("term", "typed_terms", "heuristic"), ("query", "queries", "llm")):
        rows = doc_lexicon.select("extraction_type", F.explode(column).alias("term"), F.lit(source).alias("source"), at.alias("seen_at"))
        out = record_terms(out, rows, kind, loaded.where(F.col("entry_kind") == kind), limits)
    return out


def enrich_from_hits(hits: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT, limits: Limits = UNCUT) -> DataFrame:
    """Terms of the best-scoring chunks per document and type."""
    w = Window.partitionBy("doc_id", "extraction_type").orderBy(F.desc("score"), "chunk_id")
    top = hits.withColumn("rn", F.row_number().over(w)).where(within("rn", limits.top_hits) & (F.col("score") >= cfg.feedback_min_score))
    text = F.concat("section_title", F.lit("\n"), "chunk_text")
    # a chunk is mined once however many types it scored for
    wanted = chunks.join(top.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi")
    found = with_mined(wanted.select("doc_id", "chunk_id", text.alias("t")), "t", limits.hit_terms).drop("t")
    return top.select("doc_id", "chunk_id", "extraction_type", "rn").join(found, ["doc_id", "chunk_id"]).select(
        "doc_id", "extraction_type", "rn", F.posexplode("mined").alias("term_seq", "term")
    ).groupBy("doc_id", "extraction_type", F.lower("term").alias("term_key")).agg(
        F.min(F.struct("rn", "term_seq", "term"))["term"].alias("term")
    )


def route_queries(classes: DataFrame, routing: bool = True) -> DataFrame:
    """Extra queries per document from its class, or all of them when routing is off."""
    options = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(axis).alias("axis"), F.lit(v).alias("v"), F.lit(t).alias("extraction_type"), F.lit(q).alias("query"))
        for i, (axis, v, t, q) in enumerate(OVERRIDES)
    ])
    rows = classes.select("doc_id", "domain", "solicitation_type", F.explode(options).alias("o"))
    mine = F.when(F.col("o.axis") == "domain", F.col("domain") == F.col("o.v")).otherwise(F.col("solicitation_type") == F.col("o.v"))
    if routing:
        rows = rows.where(mine)
    return rows.groupBy("doc_id", F.col("o.extraction_type").alias("extraction_type"), F.col("o.query").alias("query")).agg(F.min("o.seq").alias("seq"))


def queries_for_types(doc_lexicon: DataFrame, limits: Limits = UNCUT) -> DataFrame:
    """Static queries, learned queries and one query of the first terms, distinct in order."""
    statics = F.create_map(*[x for t, qs in STATIC_QUERIES.items() for x in (F.lit(t), literal_array(qs))])
    n, terms = limits.query_terms, F.concat("global_terms", "typed_terms")
    if n is not None:
        # where the first terms are different ones, the others are not looked at
        plain = F.array_distinct(F.array_compact(F.transform(F.slice("global_terms", 1, n), lambda t: F.lower(strip(t)))))
        terms = F.when(F.size(plain) == n, F.slice("global_terms", 1, n)).otherwise(terms)
    rows = _distinct_ci(doc_lexicon.select("doc_id", "extraction_type", "queries", terms.alias("__all")), "__terms", F.col("__all"))
    term_query = F.array_join(first("__terms", n), " ")
    merged = F.concat(statics[F.col("extraction_type")], "queries", F.array(term_query))
    rows = _distinct_ci(rows, "__queries", F.filter(F.transform(merged, strip), lambda q: q != ""))
    return rows.select("doc_id", "extraction_type", F.posexplode("__queries").alias("query_seq", "query"))


def unknown_labels(items: DataFrame, labels: list[str]) -> DataFrame:
    lab = F.lower(strip(F.coalesce("label", F.lit(""))))
    return items.where((lab != "") & ~lab.isin(labels)).groupBy(lab.alias("label")).agg(F.count("*").alias("n"))
