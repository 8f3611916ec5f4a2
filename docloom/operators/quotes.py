"""Finding quotes on pages, and the most similar of two sets of short texts, without meeting all pairs.

Every stretch of GRAM + WINDOW - 1 characters of a text holds at least one of its fingerprints: the smallest hash of
each WINDOW neighbouring GRAM-grams. A quote that stands on a page therefore shares all its fingerprints with it, and
quotes and pages meet by equality of (document, fingerprint). Page fingerprints that no quote asks for are dropped
before the shuffle by a filter of checked size; pages of one document are split in blocks, so a fingerprint that
stands on every page of a long document is no single key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import norm_cite
from docloom.plans.scans import once
from docloom.plans.stage import cut

GRAM, WINDOW = 8, 5
LEAST = GRAM + WINDOW - 1  # shorter texts have no fingerprint
PROBES = 4
BLOCK = 256
BUCKETS = 32
FILTER_LEAST, FILTER_MOST = 1 << 16, 1 << 28  # bits; the largest filter is 32 MB


def fingerprints(text: str) -> np.ndarray:
    """Winnowed hashes of a text as signed 64-bit numbers, in rising order."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = h[: n - WINDOW + 1]
    for k in range(1, WINDOW):
        low = np.minimum(low, h[k : k + len(low)])
    return np.unique(low.view(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def probes_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: fingerprints(t or "")[:PROBES])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def profile_of(texts: pd.Series) -> pd.Series:
    """How often characters of each bucket occur."""
    return texts.map(lambda t: np.bincount(np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) % BUCKETS, minlength=BUCKETS).astype(np.int32))


def most_alike(a: str, b: str, na: str, nb: str) -> Column:
    """No similarity of two texts is above this: twice the common characters by their profiles over both lengths."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 2.0 * common / F.greatest(F.col(na) + F.col(nb), F.lit(1))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of two short texts as twice the matched share; NULL stays NULL."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def page_index(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, hay): pages in citation normal form, written once. An index stays as it is."""
    if "hay" in pages.columns:
        return pages
    return cut(once(pages.select("doc_id", "page_number", "text"), "hay", norm_cite("text")).select("doc_id", "page_number", "hay"))


def _slots(doc: np.ndarray, prints: np.ndarray, bits: int) -> np.ndarray:
    mixed = (doc.view(np.uint64) ^ prints.view(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _print_filter(probes: DataFrame, needles: int) -> tuple[np.ndarray, int]:
    """A bit for every (document, fingerprint) asked for, 16 bits for each as long as that stays under FILTER_MOST."""
    bits = int(min(FILTER_MOST, max(FILTER_LEAST, 1 << (16 * PROBES * max(1, needles) - 1).bit_length()))).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(_slots(batch.column("d").to_numpy(), batch.column("fp").to_numpy(), bits))
            word, inverse = np.unique(slots >> 6, return_inverse=True)
            value = np.zeros(len(word), np.int64)
            np.bitwise_or.at(value.view(np.uint64), inverse, np.uint64(1) << (slots & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], ["word", "value"])

    words = probes.select("d", "fp").mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[words.column("word").to_numpy()] = words.column("value").to_numpy()
    return filled.view(np.uint8), bits


def standing(needles: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, needle, page_number): the pages of its document that each needle of (doc_id, needle) stands on.

    Needles are normalised texts of at least LEAST characters; shorter, empty and null ones stand nowhere.
    """
    index = page_index(pages)
    own = needles.select("doc_id", "needle").where(F.length("needle") >= LEAST).distinct()
    own = cut(own.withColumn("prints", probes_of("needle")).withColumn("key", F.xxhash64("doc_id", "needle")))
    asked = own.select("doc_id", F.xxhash64("doc_id").alias("d"), "key", F.size("prints").alias("wanted"), F.explode("prints").alias("fp"))
    shared = index.sparkSession.sparkContext.broadcast(_print_filter(asked, own.count()))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, bits = shared.value
        for batch in batches:
            rows, prints = [], []
            for row, (doc, hay) in enumerate(zip(batch.column("d").to_pylist(), batch.column("hay").to_pylist())):
                own_prints = fingerprints(hay or "")
                at = _slots(np.full(len(own_prints), doc, np.int64), own_prints, bits)
                hit = own_prints[(filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                rows.append(np.full(len(hit), row))
                prints.append(hit)
            if rows:
                taken = batch.select(["doc_id", "page_number"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(prints))], ["doc_id", "page_number", "fp"])

    kept = T.StructType([index.schema["doc_id"], index.schema["page_number"], T.StructField("fp", T.LongType())])
    found = index.select("doc_id", "page_number", F.xxhash64("doc_id").alias("d"), "hay").mapInArrow(filtered, kept)
    block = F.floor(F.coalesce(F.col("page_number"), F.lit(0)) / BLOCK).cast("bigint")
    blocks = index.groupBy("doc_id").agg(F.min(block).alias("low"), F.max(block).alias("high"))
    asked = asked.join(blocks, "doc_id").withColumn("block", F.explode(F.sequence("low", "high")))
    met = found.withColumn("block", block).join(asked.select("doc_id", "fp", "block", "key", "wanted"), ["doc_id", "fp", "block"])
    whole = met.groupBy("doc_id", "key", "page_number", "wanted").agg(F.count("*").alias("n")).where(F.col("n") == F.col("wanted"))
    pairs = whole.join(own.select("doc_id", "key", "needle"), ["doc_id", "key"])
    return pairs.join(index, ["doc_id", "page_number"]).where(F.col("hay").contains(F.col("needle"))).select("doc_id", "needle", "page_number")


def compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, ratio): every distinct pair of texts once."""
    return pairs.select(a, b).distinct().withColumn("ratio", sequence_ratio(a, b))
