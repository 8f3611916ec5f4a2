"""Ranking of chunks: vectors, BM25, rank fusion, keyword selection and context building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.fixed import FOCUSED_TYPES
from docloom.functions.text import WS, col, contains_any, count_contained, head, literal_array, ordered_join, strip, within
from docloom.operators.chunks import SECTION_TAGS
from docloom.plans.scans import BLOCK
from docloom.plans.stage import cut
from docloom.sources.snapshots import replace_documents

# Query expansion, timeline markers and operational markers.
EXPANSION_KEYS = ["pre-bid", "prebid", "pre bid"]
EXPANSIONS = [
    "proposer conference pre-proposal conference timeline schedule",
    "issue date advertisement schedule conference due date time",
]
TIMELINE_MARKERS = ["pre-bid", "prebid", "pre bid", "deadline", "due date", "conference", "timeline", "submission date"]
OPERATIONAL_MARKERS = [
    "scope of work", "security personnel", "approximately 275", "275 security", "transport escort", "transport security",
    "standby manpower", "guarding", "escort guard", "bangalore", "chennai", "headcount", "deployment", "women associate",
    "24/7", "24x7", "supplier information",
]
# Type limits and boosts of the keyword score.
PIN_TYPES = ["scope_of_work", "technical_requirements"]
BROAD_TYPES = [t for t in FOCUSED_TYPES if t != "submission_deadlines"]
BROAD_MAX, DEFAULT_MAX, BROAD_MIN, DEFAULT_MIN = 14, 10, 8, 4
LISTED_ROWS = 1 << 19  # scores of chunks and types that one task lists
FAST_TYPES = ["technical_requirements", "set_asides"]
BOOSTS = {
    "eligibility_criteria": {"cover_metadata": 8, "general_section": 1},
    "submission_deadlines": {"schedule_table": 10, "cover_metadata": 6},
    "penalties_and_risks": {"bond_clause": 10},
    "mandatory_documents": {"form_annex": 6, "cover_metadata": 3},
    "payment_terms": {"general_section": 1},
}
# The section tags that stand for each extraction type. The keyword table is a parameter of
# every selection; this rule gives a compact one when the caller brings none.
TYPE_TAGS = {
    "eligibility_criteria": ["eligibility"], "submission_deadlines": ["deadline"],
    "technical_requirements": ["technical", "support"], "scope_of_work": ["scope"], "payment_terms": ["payment"],
    "penalties_and_risks": ["risk"], "mandatory_documents": ["documents"], "set_asides": [],
}


# Wording of goals for kinds of businesses, which no section tag stands for.
SET_ASIDE_WORDS = [
    "mbe", "wbe", "dbe", "dvbe", "sbe", "hub", "minority", "women-owned", "women owned", "disadvantaged business", "veteran", "set-aside", "set aside",
    "small business", "diversity", "participation goal",
]


def default_keywords() -> dict[str, list[str]]:
    return {t: [w for tag in tags for w in SECTION_TAGS[tag]] for t, tags in TYPE_TAGS.items()} | {"set_asides": SET_ASIDE_WORDS}


def cosine(a, b) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    x, y = col(a), col(b)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def _with_norm(df: DataFrame, vector: str, norm: str) -> DataFrame:
    sq = F.aggregate(col(vector), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return df.withColumn(norm, F.sqrt(sq))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, min_score: float) -> DataFrame:
    """Best chunks of a query's own document by cosine similarity.

    Norms are computed once per vector; the rank limit runs before the shuffle, so each task
    passes on at most k rows per query.
    """
    q = _with_norm(queries.select("query_id", "doc_id", F.col("embedding").alias("q_vec")), "q_vec", "qn")
    v = _with_norm(vectors.select("doc_id", "chunk_id", "chunk_order", F.col("embedding").alias("v_vec")), "v_vec", "vn")
    dot = F.aggregate(
        F.zip_with("q_vec", "v_vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    scored = q.join(v, "doc_id").select(
        "query_id", "doc_id", "chunk_id", "chunk_order", F.greatest(F.lit(0.0), dot / (F.col("qn") * F.col("vn"))).alias("raw")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), "chunk_order", "chunk_id")
    top = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    kept = top.withColumn("best", best).where((F.col("raw") >= min_score) | (F.col("best") < min_score))
    return kept.select("query_id", "doc_id", "chunk_id", "chunk_order", F.round("raw", 4).alias("score"))


def merge_query_hits(hits: DataFrame, k: int, keys=("query_id", "doc_id")) -> DataFrame:
    """Highest score per chunk over several searches, best k per request."""
    m = hits.groupBy(*keys, "chunk_id").agg(F.max("score").alias("score"), F.min("chunk_order").alias("chunk_order"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_order", "chunk_id")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_queries(queries: DataFrame) -> DataFrame:
    q = strip("query")
    extra = F.when(contains_any(F.lower(q), EXPANSION_KEYS), literal_array(EXPANSIONS)).otherwise(F.array().cast("array<string>"))
    return queries.where(q != "").select(
        *[c for c in queries.columns if c != "query"], F.posexplode(F.concat(F.array(q), extra)).alias("variant", "query")
    )


def timeline_pins(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Schedule and cover chunks up to the first schedule, for queries about dates."""
    text = F.lower("chunk_text")
    schedule = F.col("chunk_type") == "schedule_table"
    cover = (F.col("chunk_type") == "cover_metadata") & (F.col("page_start") <= 3)
    legacy = (F.col("page_start") == 1) & (text.contains("issue date") | text.contains("bid period"))
    stop = chunks.where(schedule).groupBy("doc_id").agg(F.min("chunk_order").alias("stop"))
    pins = chunks.where(schedule | cover | legacy).join(stop, "doc_id", "left").where(
        F.col("stop").isNull() | (F.col("chunk_order") <= F.col("stop"))
    ).select("doc_id", "chunk_id", "chunk_order")
    asked = queries.where(contains_any(F.lower("query"), TIMELINE_MARKERS)).select("query_id", "doc_id").distinct()
    return asked.join(pins, "doc_id").select("query_id", "doc_id", "chunk_id", "chunk_order", F.lit(0.5).alias("score"))


def merge_pins(hits: DataFrame, pins: DataFrame, mode: str = "override") -> DataFrame:
    """Add pins to hits: they may raise a score, or only fill in below all hits."""
    h = hits.select("query_id", "doc_id", "chunk_id", F.col("chunk_order").alias("ho"), F.col("score").alias("hs"))
    p = pins.select("query_id", "doc_id", "chunk_id", F.col("chunk_order").alias("po"), F.col("score").alias("ps"))
    j = h.join(p, ["query_id", "doc_id", "chunk_id"], "full_outer")
    if mode == "override":
        score = F.when(F.col("hs").isNull() | (F.col("ps") >= F.col("hs")), F.coalesce("ps", "hs")).otherwise(F.col("hs"))
    else:
        low = hits.groupBy("query_id").agg(F.min("score").alias("low"))
        j = j.join(low, "query_id", "left")
        filler = F.when(F.coalesce("low", F.lit(0.0)) > 0, F.col("low") * 0.5).otherwise(1e-6)
        score = F.coalesce("hs", filler)
    return j.select("query_id", "doc_id", "chunk_id", F.coalesce("ho", "po").alias("chunk_order"), score.alias("score"))


def retrieve(queries: DataFrame, variants: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, min_score: float) -> DataFrame:
    """Search of all query variants with embeddings, merged and pinned; weak queries fall back.

    `variants` holds (query_id, variant, doc_id, embedding) of the expanded queries.
    """
    v = variants.withColumn("vid", F.struct("query_id", "variant"))
    raw = dense_topk(v.select(F.col("vid").alias("query_id"), "doc_id", "embedding"), vectors, k, 0.0).withColumn(
        "query_id", F.col("query_id.query_id")
    )
    strong = merge_pins(raw.where(F.col("score") >= min_score), timeline_pins(queries, chunks))
    weak = merge_pins(raw, timeline_pins(queries, chunks))
    found = strong.select("query_id").distinct()
    small = max(1, min(3, k))
    first = merge_query_hits(strong, k)
    rest = merge_query_hits(weak.join(found, "query_id", "left_anti"), small)
    return first.unionByName(rest)


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, chunk_order, dl, term, tf) of chunks, and for each chunk a row of the empty term with its length.

    The one pass over the texts: chunk counts, lengths, document frequencies and term frequencies all come from it. With
    `asked` (term) only those terms are kept; they are picked before any shuffle of tokens. Without, chunks are brought
    together before they are cut to tokens: a text is a fraction of its postings, and those come out chunk by chunk.
    """
    body = F.concat_ws(" ", "chunk_text", "section_title", "tags")
    if asked is None:
        chunks = chunks.select("doc_id", "chunk_id", "chunk_order", "chunk_text", "section_title", "tags").repartition("doc_id", "chunk_id")
    tok = chunks.select("doc_id", "chunk_id", "chunk_order", tokens(body).alias("toks")).withColumn("dl", F.size("toks").cast("bigint"))
    each = tok.select("doc_id", "chunk_id", "chunk_order", "dl", F.explode(F.concat(F.array(F.lit("")), F.col("toks"))).alias("term"))
    if asked is not None:
        each = each.join(asked.select("term").union(chunks.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
    keys = ["doc_id", "chunk_id", "chunk_order", "dl", "term"]
    return each.groupBy(*keys).agg(F.count("*").alias("tf"))


def index_chunks(chunks: DataFrame, path: str, documents: DataFrame | None = None, buckets: int = DEFAULT.doc_buckets) -> int:
    """Put chunks into a stored index: the documents of the batch, or those named, have these postings and no others.

    The index is a table of versions and document buckets, so a batch rewrites the buckets of its documents only, and
    searches go on with the last committed version meanwhile.
    """
    return replace_documents(postings(chunks), path, documents if documents is not None else chunks.select("doc_id"), buckets)


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "doc_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))


def bm25_search(queries: DataFrame, index: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """BM25 of the chunks of a query's document; statistics come from the whole index, as `postings` or `read_snapshot` give it."""
    q = _query_terms(queries)
    stats = index.where(F.col("term") == "").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = index.join(q.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (cfg.bm25_k1 + 1) / (
        F.col("tf") + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * F.col("dl") / avgdl)
    )
    return (
        q.join(df, "term").join(tf, ["doc_id", "term"])
        .groupBy("query_id", "doc_id", "chunk_id", "chunk_order")
        .agg(F.round(F.sum(weight), 6).alias("score"))
    )


def bm25(queries: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """BM25 of the chunks of a query's document without a stored index: the postings of the asked terms are written once."""
    return bm25_search(queries, cut(postings(chunks, _query_terms(queries))), cfg)


def ranked(hits: DataFrame, k: int | None = None, keys=("query_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_order", "chunk_id")
    out = hits.withColumn("rank", F.row_number().over(w) - 1)
    return out if k is None else out.where(F.col("rank") < k)


def rrf(lists: DataFrame, keys=("query_id", "chunk_id"), k: int = DEFAULT.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of rows with a zero-based rank and an optional weight."""
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    return lists.groupBy(*keys).agg(F.sum(weight / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """BM25 and vector ranks of a query's document fused; queries carry text and embedding."""
    k = k or cfg.hybrid_top_k
    words = ranked(bm25(queries, chunks, cfg), k)
    dense = ranked(dense_topk(queries, vectors, k, 0.0), k)
    cols = ["query_id", "doc_id", "chunk_id", "chunk_order", "rank"]
    fused = rrf(words.select(*cols).unionByName(dense.select(*cols)), ("query_id", "doc_id", "chunk_id", "chunk_order"), cfg.rrf_k)
    return ranked(fused.withColumn("score", F.round("score", 6)), k)


def prefer_rerank(hits: DataFrame) -> DataFrame:
    return ranked(hits.withColumn("score", F.coalesce("rerank_score", "score")))


# ---- keyword selection

def max_chunks(ctype) -> Column:
    return F.when(col(ctype).isin(BROAD_TYPES), BROAD_MAX).otherwise(DEFAULT_MAX)


def is_operational(title, text) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", title, text)), OPERATIONAL_MARKERS)


def keyword_scores(chunks: DataFrame, keywords: dict[str, list[str]], terms: DataFrame | None = None, term_weight: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """Score of every chunk for every extraction type, in one pass over the chunks.

    `terms` may add per document and type an array of document terms. With `keep` the scores of a chunk stay
    together in one row, beside these columns.
    """
    text = F.lower(F.concat(F.col("section_title"), F.lit(" "), F.col("chunk_text")))
    rows = chunks.withColumn("__text", text)
    if terms is not None:
        packed = terms.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("extraction_type", "terms"))).alias("__terms"))
        rows = rows.join(packed, "doc_id", "left")
    per_type = []
    for t in FOCUSED_TYPES:
        words = keywords.get(t, [])
        n = count_contained(F.col("__text"), words)
        in_text = n > 0
        tag_hits = F.size(F.filter("tags", lambda g: in_text | contains_any(F.lower(g), words))) * 2
        score = n + tag_hits
        if terms is not None:
            mine = F.transform(F.coalesce(F.col("__terms")[t], F.array().cast("array<string>")), F.lower)
            m = F.size(F.filter(mine, lambda w: F.col("__text").contains(w)))
            tag_terms = F.size(F.filter("tags", lambda g: (m > 0) | F.exists(mine, lambda w: F.lower(g).contains(w))))
            score = score + m * term_weight + tag_terms
        boost = F.lit(0)
        for ctype, b in BOOSTS.get(t, {}).items():
            boost = boost + F.when(F.col("chunk_type") == ctype, b).otherwise(0)
        per_type.append(F.struct(F.lit(t).alias("t"), (score + boost).cast("double").alias("s")))
    if keep is not None:
        return rows.select("doc_id", "chunk_id", "chunk_order", *keep, F.array(*per_type).alias("scores"))
    return rows.select("doc_id", "chunk_id", "chunk_order", F.explode(F.array(*per_type)).alias("e")).select(
        "doc_id", "chunk_id", "chunk_order", F.col("e.t").alias("extraction_type"), F.col("e.s").alias("score")
    )


def keyword_select(scores: DataFrame) -> DataFrame:
    """Best chunks per document and type among those with a positive score."""
    w = Window.partitionBy("doc_id", "extraction_type").orderBy(F.desc("score"), "chunk_order")
    top = scores.where(F.col("score") > 0).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= BROAD_MAX)
    return top.where(F.col("rn") <= max_chunks("extraction_type"))


def _needed(etype) -> Column:
    return F.when(col(etype).isin(BROAD_TYPES), BROAD_MIN).otherwise(DEFAULT_MIN)


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt to so many tasks by their keys, and no part of a broadcast.

    Rows this narrow are small in files and shuffles; by those bytes one task, or every task by a broadcast, would hold nearly all of them.
    """
    return (rows if parts is None else rows.repartition(parts, *keys)).hint("merge")


def stratified_fill(selected: DataFrame, counts: DataFrame, factor: int = 1, parts: int | None = None) -> DataFrame:
    """Evenly spaced extra chunks where too few were selected.

    Chunk orders run from 1 to n without gaps, so the i-th unselected chunk follows from the
    few selected orders by arithmetic and the rest of the document is never listed.
    """
    keys = ["doc_id", "extraction_type"]
    have = _dealt(selected, parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("chunk_order")).alias("have"))
    base = _dealt(counts.select("doc_id", "n", F.explode(literal_array(FOCUSED_TYPES)).alias("extraction_type")), parts, *keys).join(
        have.hint("merge"), keys, "left"
    ).withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
    want = _needed("extraction_type") * factor - F.size("have")
    pool = F.col("n") - F.size("have")
    rows = base.withColumn("want", want).withColumn("pool", pool).where((F.col("want") > 0) & (F.col("pool") > 0))
    picks = F.transform(
        F.sequence(F.lit(0), F.least("pool", "want").cast("int") - 1),
        lambda i: F.when(F.col("pool") <= F.col("want"), i).otherwise(F.floor(i * (F.col("pool") / F.col("want"))).cast("int")),
    )
    order = lambda i: F.aggregate("have", (i + 1).cast("int"), lambda o, s: F.when(s <= o, o + 1).otherwise(o))
    return rows.select("doc_id", "extraction_type", F.posexplode(F.transform(picks, order)).alias("fill_seq", "chunk_order"))


def _listed(selected: DataFrame, op: DataFrame, parts: int | None = None) -> DataFrame:
    """Final order of (doc_id, extraction_type, chunk_order, pos) rows, operational chunks `op` first where pinned.

    What is selected for a document and type is a short list in one row; `parts` deals the rows to so many tasks.
    """
    if parts is None:
        first = op
    else:
        block = F.floor(F.col("chunk_order") / BLOCK)
        inside = Window.partitionBy("doc_id", "block").orderBy("chunk_order")
        first = op.withColumn("block", block).repartition(parts, "doc_id", "block").withColumn("pos", F.row_number().over(inside)).where(F.col("pos") <= BROAD_MAX).repartition(parts, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("chunk_order")
    pins = first.select("doc_id", "chunk_order", F.row_number().over(w).alias("pos")).where(F.col("pos") <= BROAD_MAX)
    pinned = pins.select("doc_id", F.explode(literal_array(PIN_TYPES)).alias("extraction_type"), "chunk_order", (F.col("pos") - 1000).alias("pos"))
    # operational chunks among the selection keep their mark even beyond the pinned ones
    place = ["doc_id", "chunk_order"]
    marked = _dealt(selected, parts, *place).join(_dealt(op.withColumn("op", F.lit(True)), parts, *place), place, "left").withColumn("op", F.coalesce("op", F.lit(False)))
    rows = marked.select("doc_id", "extraction_type", "chunk_order", "pos", "op").unionByName(pinned.withColumn("op", F.lit(True)))
    keys = ["doc_id", "extraction_type"]
    if parts is not None:
        rows = rows.repartition(parts, *keys)
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_order", "pos", "op"))).alias("l"))
    # the mark is one of the chunk, so the first of a chunk's entries has its smallest position and its mark
    once = F.filter("l", lambda x, i: (i == 0) | (F.get("l", i - 1)["chunk_order"] != x["chunk_order"]))
    best = F.slice(F.sort_array(F.transform(once, lambda x: F.struct(x["pos"], x["chunk_order"], x["op"]))), F.lit(1), max_chunks("extraction_type"))
    group = lambda x: F.when(F.col("extraction_type").isin(PIN_TYPES) & x["op"], 0).otherwise(1)
    final = F.sort_array(F.transform(best, lambda x: F.struct(group(x).alias("group"), x["chunk_order"].alias("chunk_order"))))
    return lists.select(*keys, F.posexplode(final).alias("i", "x")).select(*keys, F.col("x.chunk_order").alias("chunk_order"), (F.col("i") + 1).alias("position"))


def _operational(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_operational("section_title", "chunk_text")).select("doc_id", "chunk_order")


def pin_operational(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    return _listed(selected, _operational(chunks))


def _signals(chunks: DataFrame, keywords: dict[str, list[str]], terms: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Scores, operational chunks, chunk counts and tasks to list them by, from one pass over the texts, kept at a stage boundary."""
    marked = chunks.withColumn("__op", is_operational("section_title", "chunk_text"))
    rows = cut(keyword_scores(marked, keywords, terms, keep=["__op"]))
    scores = rows.select("doc_id", "chunk_id", "chunk_order", F.explode("scores").alias("e")).select("doc_id", "chunk_id", "chunk_order", F.col("e.t").alias("extraction_type"), F.col("e.s").alias("score"))
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * len(FOCUSED_TYPES) // LISTED_ROWS))
    counts = rows.select("doc_id").repartition(parts, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    return scores, rows.where("__op").select("doc_id", "chunk_order"), counts, parts


def _keyword_list(scores: DataFrame, op: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    top = keyword_select(scores).select("doc_id", "extraction_type", "chunk_order", F.col("rn").alias("pos"))
    fill = stratified_fill(top, counts, parts=parts).select("doc_id", "extraction_type", "chunk_order", (F.col("fill_seq") + 100).alias("pos"))
    return _listed(top.unionByName(fill), op, parts)


def keyword_chunks(chunks: DataFrame, keywords: dict[str, list[str]], terms: DataFrame | None = None) -> DataFrame:
    """Keyword selection with stratified fill and operational pins, in final order."""
    return _keyword_list(*_signals(chunks, keywords, terms))


def fuse_selections(keyword: DataFrame, hybrid: DataFrame, kw_weight: float = 1.0, hy_weight: float = 1.0, k: int = DEFAULT.rrf_k) -> DataFrame:
    """Rank fusion of the keyword list (position) and hybrid scores; best ones in document order.

    Documents and types without hybrid scores keep their keyword list.
    """
    keys = ("doc_id", "extraction_type", "chunk_order")
    kw = keyword.select(*keys, (F.col("position") - 1).alias("rank"), F.lit(kw_weight).alias("weight"))
    w = Window.partitionBy("doc_id", "extraction_type").orderBy(F.desc("score"), "chunk_order")
    hy = hybrid.withColumn("rank", F.row_number().over(w) - 1).select(*keys, "rank", F.lit(hy_weight).alias("weight"))
    fused = rrf(kw.unionByName(hy), keys, k)
    best = Window.partitionBy("doc_id", "extraction_type").orderBy(F.desc(F.round("score", 12)), "chunk_order")
    cut = fused.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= max_chunks("extraction_type"))
    order = Window.partitionBy("doc_id", "extraction_type").orderBy("chunk_order")
    out = cut.withColumn("position", F.row_number().over(order))
    plain = keyword.join(hybrid.select("doc_id", "extraction_type").distinct(), ["doc_id", "extraction_type"], "left_anti")
    with_hits = out.join(hybrid.select("doc_id", "extraction_type").distinct(), ["doc_id", "extraction_type"], "left_semi")
    return with_hits.select(*keys, "pos", "position").unionByName(
        plain.where(F.col("position") <= max_chunks("extraction_type")).select(*keys, F.col("position").alias("pos"), "position")
    )


def select_chunks(chunks: DataFrame, keywords: dict[str, list[str]], hits: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Chunks sent to extraction for every document and type."""
    scores, op, counts, parts = _signals(chunks, keywords, terms)
    kw = _keyword_list(scores, op, counts, parts)
    if hits is None:
        return kw
    fused = fuse_selections(cut(kw), hits)
    return _listed(fused.select("doc_id", "extraction_type", "chunk_order", F.col("position").alias("pos")), op, parts)


def wider_selection(chunks: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Retry selection: twice the keyword limit, filled up to it."""
    w = Window.partitionBy("doc_id", "extraction_type").orderBy(F.desc("score"), "chunk_order")
    scores = keyword_scores(chunks, keywords).where(F.col("score") > 0)
    top = scores.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 2 * BROAD_MAX)
    top = top.where(F.col("pos") <= 2 * max_chunks("extraction_type")).select("doc_id", "extraction_type", "chunk_order", "pos")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    fill = stratified_fill(top, counts, 2).select("doc_id", "extraction_type", "chunk_order", (F.col("fill_seq") + 1000).alias("pos"))
    return top.unionByName(fill)


def context_text(parent, text) -> Column:
    return F.when(F.length(parent) > F.length(text), col(parent)).otherwise(col(text))


def trim_paragraphs(text, keywords: list[str], max_chars: int) -> Column:
    """Paragraphs with a keyword first, then the others, up to the first that does not fit."""
    t = col(text)
    paras = F.filter(F.transform(F.split(t, r"\n[\s\x0b\p{Z}]*\n"), strip), lambda p: p != "")
    hit = lambda p: contains_any(F.lower(p), keywords)
    ordered = F.concat(F.filter(paras, hit), F.filter(paras, lambda p: ~hit(p)))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("parts"))

    def step(s, p):
        fits = ~s["stop"] & (s["n"] + F.length(p) + 2 <= max_chars)
        return F.struct(
            F.when(fits, s["n"] + F.length(p) + 2).otherwise(s["n"]).alias("n"),
            (~fits).alias("stop"),
            F.when(fits, F.concat(s["parts"], F.array(p))).otherwise(s["parts"]).alias("parts"),
        )

    kept = F.aggregate(ordered, start, step)["parts"]
    cut = F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(head(t, max_chars))
    return F.when(F.length(t) <= max_chars, t).otherwise(cut if keywords else head(t, max_chars))


def trim_middle(text, max_chars: int, marker: str = "\n\n[... middle of document omitted ...]\n\n") -> Column:
    t = col(text)
    first = int(max_chars * 0.65)
    tail = max_chars - first - len(marker)
    cut = head(t, max_chars) if tail < 2000 else F.concat(head(t, first), F.lit(marker), F.substr(t, F.length(t) - tail + 1))
    return F.when(F.length(t) <= max_chars, t).otherwise(cut)


def batch_requests(selected: DataFrame, chunks: DataFrame, identity: DataFrame | None = None, finetuned: dict[str, str] | None = None, size: int = 3) -> DataFrame:
    """Groups of consecutive selected chunks as one request text per document and type."""
    body = F.concat(
        F.lit("=== Section: "), "section_title", F.lit(" (pages "), F.col("page_start").cast("string"), F.lit("-"),
        F.col("page_end").cast("string"), F.lit(") ===\n"), F.col("chunk_text"),
    )
    # a text goes to its document once, with the list of its places, not once for every type; a selection is short by definition
    asked = selected.groupBy("doc_id", "chunk_order").agg(F.collect_list(F.struct("extraction_type", "position")).alias("asks"))
    met = asked.join(chunks.select("doc_id", "chunk_order", "chunk_id", "page_start", "page_end", "section_title", body.alias("text")), ["doc_id", "chunk_order"])
    rows = met.repartition("doc_id").select("*", F.explode("asks").alias("ask")).select(
        "doc_id", "chunk_id", "page_start", "page_end", "section_title", "text", "ask.extraction_type", "ask.position"
    )
    g = rows.groupBy("doc_id", "extraction_type", F.floor((F.col("position") - 1) / size).cast("int").alias("batch_no")).agg(
        ordered_join(F.collect_list(F.struct("position", "text")), "\n\n").alias("prompt"),
        ordered_join(F.collect_list(F.struct("position", F.col("chunk_id").alias("text"))), ",").alias("chunk_ids"),
        F.min(F.struct("position", "section_title"))["section_title"].alias("first_title"), F.count("*").alias("n_chunks"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
    )
    label = F.when(F.col("n_chunks") == 1, F.col("first_title")).otherwise(
        F.concat("first_title", F.lit(" (+"), (F.col("n_chunks") - 1).cast("string"), F.lit(" more)"))
    )
    g = g.withColumn("section_label", label)
    if identity is not None:
        g = g.join(identity.select("doc_id", "known_context"), "doc_id", "left").withColumn(
            "prompt", F.when(F.col("known_context").isNotNull(), F.concat("known_context", F.lit("\n\n"), "prompt")).otherwise(F.col("prompt"))
        ).drop("known_context")
    tier = F.when(F.col("extraction_type").isin(FAST_TYPES), "fast").otherwise("strong")
    for t, v in (finetuned or {}).items():
        tier = F.when(F.col("extraction_type") == t, v).otherwise(tier)
    return g.withColumn("model", tier)


def keyword_search(pages: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """Case-insensitive occurrences of literal terms with snippets, in page order.

    Positions come from splitting the page at the matches; the limit per document is applied
    on rows that carry short snippets only.
    """
    import re

    pattern = "(?iU)(" + "|".join(re.escape(t) for t in terms) + ")"
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("pos"))
    walked = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))),
        start,
        lambda s, x: F.struct(
            (s["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"),
            F.concat(s["pos"], F.array(s["at"] + F.length(x["g"]))).alias("pos"),
        ),
    )["pos"]
    rows = pages.select("doc_id", "page_number", "text", F.posexplode(F.arrays_zip(walked.alias("pos"), hits.alias("hit"))).alias("seq", "m"))
    at, n = F.col("m.pos"), F.length("m.hit")
    lo45, lo15 = F.greatest(at - 45, F.lit(0)), F.greatest(at - 15, F.lit(0))
    squeeze = lambda c: strip(F.regexp_replace(c, WS + "+", " "))
    found = rows.select(
        "doc_id", "page_number", "seq", F.col("m.hit").alias("term"),
        squeeze(F.substr("text", lo45 + 1, at - lo45 + n + 45)).alias("snippet"),
        squeeze(F.substr("text", lo15 + 1, at - lo15 + n + 15)).alias("anchor"),
    )
    w = Window.partitionBy("doc_id").orderBy("page_number", "seq")
    return found.withColumn("rn", F.row_number().over(w)).where(within("rn", limit))


def keyword_map(users: DataFrame, defaults: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Keyword map of every user: their own cleaned entries, else the defaults."""
    base = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(l).alias("label"), literal_array(k).alias("keywords")) for i, l, k in defaults])
    clean = F.filter(
        F.transform(
            "keyword_map",
            lambda e: F.struct(
                strip(F.coalesce(e["id"], F.lit(""))).alias("id"), strip(F.coalesce(e["label"], F.lit(""))).alias("label"),
                F.filter(F.transform(F.coalesce(e["keywords"], F.array().cast("array<string>")), strip), lambda k: k != "").alias("keywords"),
            ),
        ),
        lambda e: (e["id"] != "") & (e["label"] != ""),
    )
    own = F.coalesce(F.size(clean), F.lit(0)) > 0
    return users.select("user_id", F.when(own, clean).otherwise(base).alias("keyword_map"), own.alias("customised"))


def sync_vector_index(index: DataFrame, stored: DataFrame, chunks: DataFrame, backend: str) -> dict[str, DataFrame]:
    """Plan of an index refresh: rows to write, stale rows to drop, new index records.

    Documents whose record matches are left alone. A document indexed for the first time is
    cleared before its chunks are written, never after.
    """
    want = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    have = stored.select("doc_id").distinct().withColumn("has_vectors", F.lit(True))
    rec = index.select("doc_id", F.col("chunk_count").alias("old_count"), F.col("backend").alias("old_backend"))
    j = want.join(rec, "doc_id", "left").join(have, "doc_id", "left")
    fresh = (F.col("old_count") == F.col("chunk_count")) & (F.col("old_backend") == backend) & F.col("has_vectors")
    work = j.where(~F.coalesce(fresh, F.lit(False))).select("doc_id", "chunk_count")
    upsert = chunks.join(work, "doc_id", "left_semi")
    stale = stored.join(work, "doc_id", "left_semi").join(chunks.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
    records = index.join(work, "doc_id", "left_anti").select("doc_id", "chunk_count", "backend").unionByName(
        work.select("doc_id", "chunk_count", F.lit(backend).alias("backend"))
    )
    return {"upsert": upsert, "delete": stale, "records": records}


def index_status(docs: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    ok = index.join(vectors.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct().withColumn("__i", F.lit(True))
    return docs.select("doc_id").join(ok, "doc_id", "left").select("doc_id", F.coalesce("__i", F.lit(False)).alias("indexed"))


def plan_index_work(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """What each document still needs: vectors, contextual prefixes, or nothing."""
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("prefix", F.lit("")) == "").alias("missing_prefix"))
    v = vectors.groupBy("doc_id").agg(F.count("*").alias("vectors"))
    j = docs.select("doc_id").join(c, "doc_id", "left").join(v, "doc_id", "left").fillna(0, ["chunks", "missing_prefix", "vectors"])
    return j.select(
        "doc_id", "chunks", "vectors", "missing_prefix",
        ((F.col("chunks") > 0) & (F.col("vectors") == 0)).alias("needs_index"),
        (F.col("chunks") != F.col("vectors")).alias("post_check_failed"),
    )


