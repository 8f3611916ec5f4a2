"""Quality metrics of extraction and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import col, first, norm_cite, strip
from docloom.operators.feedback import _text


def golden_values(spec: DataFrame) -> DataFrame:
    """Values per document and field in row order: the date, else the text."""
    v = F.when(strip(_text("date")) != "", strip("date")).otherwise(strip(_text("text")))
    return spec.groupBy("doc_id", "field_key").agg(
        F.transform(F.array_sort(F.collect_list(F.when(v != "", F.struct("row_seq", v.alias("v"))))), lambda s: s["v"]).alias("values")
    )


def label_match(values, kind: str, needles) -> Column:
    """Whether any value satisfies contains_any, contains_all or regex; no needles accept any value."""
    vs = F.transform(col(values), lambda v: F.lower(v))
    ns = F.transform(col(needles), lambda n: F.lower(n))
    none = F.size(ns) == 0
    if kind == "contains_any":
        hit = F.exists(vs, lambda v: F.exists(ns, lambda n: v.contains(n)))
    elif kind == "contains_all":
        hit = F.exists(vs, lambda v: F.forall(ns, lambda n: v.contains(n)))
    else:
        hit = F.exists(col(values), lambda v: F.exists(col(needles), lambda n: F.regexp_like(v, n)))
    return F.when(none, F.size(vs) > 0).otherwise(hit)


def field_metrics(scores: DataFrame) -> DataFrame:
    """Precision, recall and F1 per field and their mean (`*`).

    Scores carry expected, found and correct; a wrong value counts as false positive and as
    false negative.
    """
    tp, fp = F.col("found") & F.col("correct"), F.col("found") & ~F.col("correct")
    per = scores.groupBy("field_key").agg(
        F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(~tp & F.col("expected")).alias("fn")
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    per = per.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    )
    macro = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    out = per.unionByName(macro.withColumn("field_key", F.lit("*")))
    return out.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def gate(metrics: DataFrame, passing_docs: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Checks against thresholds: min_passing, macro_recall, macro_f1 and `recall:<field>`."""
    macro = F.col("field_key") == "*"
    rows = [F.struct(F.lit("min_passing").alias("check"), passing_docs.agg(F.count_if("passed")).scalar().cast("double").alias("value"))]
    for key in thresholds:
        if key == "macro_recall":
            v = F.max(F.when(macro, F.col("recall")))
        elif key == "macro_f1":
            v = F.max(F.when(macro, F.col("f1")))
        elif key.startswith("recall:"):
            v = F.max(F.when(F.col("field_key") == key[7:], F.col("recall")))
        else:
            continue
        rows.append(F.struct(F.lit(key).alias("check"), v.cast("double").alias("value")))
    need = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
    e = metrics.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("e")).select("e.check", F.coalesce("e.value", F.lit(0.0)).alias("value"))
    e = e.withColumn("threshold", F.try_element_at(need, F.col("check"))).where(F.col("threshold").isNotNull())
    return e.withColumn("passed", F.col("value") >= F.col("threshold"))


def retrieval_truth(items: DataFrame, excluded: str = "evaluation_criteria") -> DataFrame:
    """Distinct verified quotes per document and type."""
    rows = items.where(F.col("citation_verified") & (F.col("extraction_type") != excluded) & (strip(_text("source_text")) != ""))
    return rows.groupBy("doc_id", "extraction_type", norm_cite("source_text").alias("passage")).agg(
        F.min(F.struct("item_seq", "source_text"))["source_text"].alias("source_text")
    )


def passage_hit(source, passage, hay) -> Column:
    """Long passages must be contained; short ones need 80 % of their words."""
    words = F.array_distinct(F.split(col(passage), " "))
    share = F.size(F.array_intersect(words, F.split(col(hay), " "))) / F.size(words)
    return F.when(F.length(source) >= 40, col(hay).contains(col(passage))).otherwise((col(passage) != "") & (share >= 0.8))


def passage_ranks(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """First rank of every passage among the retrieved chunks of its document and type.

    A chunk is retrieved for several types; hits may bring its text in citation normal form (`hay`), made once per chunk.
    """
    h = hits.select("doc_id", "extraction_type", "rank", F.col("hay") if "hay" in hits.columns else norm_cite("chunk_text").alias("hay"))
    found = truth.join(h, ["doc_id", "extraction_type"]).where(passage_hit("source_text", "passage", "hay"))
    return found.groupBy("doc_id", "extraction_type", "passage").agg(F.min("rank").alias("rank"))


def misses(truth: DataFrame, hits: DataFrame, k: int = 8) -> DataFrame:
    near = passage_ranks(truth, hits.where(F.col("rank") <= k))
    return truth.join(near, ["doc_id", "extraction_type", "passage"], "left_anti")


def retrieval_metrics(truth: DataFrame, hits: DataFrame, indexed: DataFrame) -> DataFrame:
    """Recall at 1, 3 and 8, MRR, citation recall and hit rate, per type and overall (`*`)."""
    g = truth.groupBy("doc_id", "extraction_type").agg(F.count("*").alias("passages"))
    r = passage_ranks(truth, hits).groupBy("doc_id", "extraction_type").agg(F.min("rank").alias("first"), F.count("*").alias("matched"))
    j = g.join(indexed.select("doc_id").distinct().withColumn("ix", F.lit(True)), "doc_id", "left").join(r, ["doc_id", "extraction_type"], "left")
    live = F.coalesce("ix", F.lit(False))
    mean = lambda c: F.round(F.avg(F.when(live, F.when(c, 1.0).otherwise(0.0))), 4)
    at = lambda k: F.coalesce(F.col("first") <= k, F.lit(False))
    rr = F.when(at(8), 1.0 / F.col("first")).otherwise(0.0)
    out = j.rollup("extraction_type").agg(
        F.grouping("extraction_type").alias("g"), F.count_if(live).alias("groups"), F.count_if(~live).alias("skipped"),
        mean(at(1)).alias("recall_at_1"), mean(at(3)).alias("recall_at_3"), mean(at(8)).alias("recall_at_8"),
        F.round(F.avg(F.when(live, rr)), 4).alias("mrr_at_8"),
        F.round(F.sum(F.when(live, F.coalesce("matched", F.lit(0)))) / F.sum(F.when(live, F.col("passages"))), 4).alias("citation_recall"),
        mean(F.col("first").isNotNull()).alias("hit_rate"),
    )
    return out.withColumn("extraction_type", F.when(F.col("g") == 1, "*").otherwise(F.col("extraction_type"))).drop("g")


def latency_percentiles(times: DataFrame, value: str, cells: int = 1024) -> DataFrame:
    """Nearest-index p50 and p95.

    A histogram of `cells` ranges tells which range holds each wanted rank; only the values of those ranges are
    then ordered, so no task sees all of them.
    """
    lo, hi, n = (times.agg(f).scalar() for f in (F.min(value), F.max(value), F.count("*")))
    share = (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0))
    ranged = times.select(F.col(value).alias("v"), F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1)).cast("int").alias("cell"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over at most `cells` rows
    hist = ranged.groupBy("cell").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    wanted = hist.select("cell", "c", "before", F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("p")).withColumn("rank", F.bround(F.col("p") * (n - 1), 0) - F.col("before"))
    picks = wanted.where((F.col("rank") >= 0) & (F.col("rank") < F.col("c"))).select("cell", "p", "rank")
    counted = ranged.join(picks, "cell").groupBy("p", "rank", "v").agg(F.count("*").alias("c"))
    inside = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when((F.col("p") == p) & (F.col("upto") > F.col("rank")), F.col("v")))
    return inside.agg(F.round(at(0.5), 2).alias("p50"), F.round(at(0.95), 2).alias("p95"))


def verified_low(spec: DataFrame, limit: int = 90) -> DataFrame:
    return spec.where(F.col("citation_verified") & (F.col("confidence") < limit)).select("doc_id", "row_seq", "field_key", "confidence")


def compare_selections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap and additions of two chunk selections per document and type."""
    keys = ["doc_id", "extraction_type", "chunk_order"]
    j = a.select(*keys).withColumn("a", F.lit(1)).join(b.select(*keys).withColumn("b", F.lit(1)), keys, "full_outer")
    return j.groupBy("doc_id", "extraction_type").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
        F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"),
    )


def confidence_completeness(spec: DataFrame) -> DataFrame:
    """Rows without confidence per document and overall (NULL document)."""
    out = spec.rollup("doc_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("confidence").isNull()).alias("missing"),
        F.count_distinct(F.when(F.col("confidence").isNull(), F.col("field_key"))).alias("fields_missing"),
    )
    return out.withColumn("passed", F.col("missing") == 0)


def chunk_profile(sections: DataFrame, logical: DataFrame, chunks: DataFrame) -> DataFrame:
    s = sections.groupBy("doc_id").agg(F.count("*").alias("raw_sections"))
    l = logical.groupBy("doc_id").agg(F.count("*").alias("logical_sections"))
    n = F.length("chunk_text")
    c = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.min(n).alias("min_chars"), F.floor(F.avg(n)).alias("avg_chars"), F.max(n).alias("max_chars"),
        F.count_distinct("chunk_type").alias("chunk_types"),
    )
    return s.join(l, "doc_id", "left").join(c, "doc_id", "left").fillna(0, ["logical_sections", "chunks"])


def deadline_audit(spec: DataFrame, values: int | None = None) -> DataFrame:
    """Documents by number of bid deadlines, with the first values."""
    due = (F.col("field_key") == "bid_deadline_date_time") & (_text("date") != "")
    w = spec.groupBy("doc_id").agg(
        F.count_if(due).alias("deadlines"),
        F.array_join(F.transform(first(F.array_sort(F.collect_list(F.when(due, F.struct("row_seq", "date")))), values), lambda s: s["date"]), " | ").alias("first_values"),
    )
    return w.withColumn("state", F.when(F.col("deadlines") == 0, "missing").when(F.col("deadlines") > 1, "multiple").otherwise("ok"))


