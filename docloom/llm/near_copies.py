"""Near copies by SimHash, checked by the similarity of five-word shingle sets.

Two documents are linked if the Jaccard similarity of their sets of distinct shingles (words as in `simhash`) is at least
0.8; near copies are the components of these links. The fingerprints of the sets are linked by `simhash` first, and each of
its links is checked against the sets. What similar sets it leaves apart, since their fingerprints are further apart than its
radius, comes from prefixes: in any order of all shingles, two
sets that similar share one among the first n - ceil(0.8 n) + 1 of each, so nothing is lost before the sets themselves are
compared. The order puts common shingles last, which keeps the groups of documents with equal shingles small.

Pairs of a group are discarded where their sizes or sketches rule the similarity out. A sketch holds the parity of the
number of shingles in each of BITS buckets; every bit in which two differ takes a shingle that only one of the sets has. Of sizes a and b, similar sets have at least c = ceil(4 (a + b) / 9) shingles in common, and the first
c - ceil(0.8 max(a, b)) + 1 of those stand in both prefixes; pairs with fewer equal shingles there are discarded as well.

A group first compares its members with PIVOTS of them that are in other components, which joins large groups of copies by
a number of pairs in line with their size; then all its pairs that are in different components by then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import pieces, salted_join, utf8
from docloom.llm.simhash import components, majority, shingle_hashes
from docloom.plans.stage import cut

WORDS = 5
PIVOTS = 4
# the order of shingles decides on cost only: those in so many texts of one in SHARE stand last, the most common COMMON of them
SHARE = 8
OFTEN = 8
COMMON = 200_000
PAIRS = 1 << 16
BITS = 512
FEW = 500_000


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, WORDS))


def sketch(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The part of a set of which two sets with similarity 0.8 share at least one element. `common` is sorted."""
    size = len(own) - -(-4 * len(own) // 5) + 1 if len(own) else 0
    if len(common):
        at = np.searchsorted(common, own)
        late = common[np.minimum(at, len(common) - 1)] == own
        own = np.concatenate((own[~late], own[late]))
    return own[:size]


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """common / (one + two - common) >= 4 / 5"""
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 9 * common >= 4 * (len(one) + len(two))


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sketch, fp): the id, the sketch and the fingerprint of the set of each document."""

    def run(batches):
        for batch in pieces(batches):
            found = [shingle_set(x) for x in utf8(batch, "text")]
            fps = np.array([majority(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_id(x) for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary()), pa.array(fps)], ["doc_id", "node", "sketch", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, node bigint, sketch binary, fp bigint")


def fingerprint_pairs(own: DataFrame) -> DataFrame:
    """(a, b), a < b: sets linked by their fingerprints; those of one fingerprint by the first of them."""
    nodes = own.groupBy("node").agg(F.min("fp").alias("fp"))
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = salted_join(nodes, first, ["fp"], "n", ["node"], own.count()).select(F.col("first").alias("one"), F.col("node").alias("two"))
    sides = [first.select(F.col("fp").alias(k), F.col("first").alias(name)) for k, name in (("a", "one"), ("b", "two"))]
    near = simhash.links(first.select("fp")).join(sides[0], "a").join(sides[1], "b").select("one", "two")
    return same.unionByName(near).where("one <> two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(shingle, node, size) of the prefix of every distinct set; copies in other tasks repeat it."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set[int] = set()
        for batch in pieces(batches, 64):
            firsts, nodes, sizes, counts = [], [], [], []
            for text in utf8(batch, "text"):
                own = shingle_set(text)
                if len(own) and (node := set_id(own)) not in seen:
                    seen.add(node)
                    firsts.append(prefix(own, shared.value))
                    nodes.append(node)
                    sizes.append(len(own))
                    counts.append(len(firsts[-1]))
            if firsts:
                arrays = [np.concatenate(firsts).view(np.int64), np.repeat(np.array(nodes, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["shingle", "node", "size"])

    return docs.select("text").mapInArrow(run, "shingle bigint, node bigint, size int")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many texts, sorted. Any set will do, so it is taken from a share of the texts and has a largest size."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)
    counts = prefixes(part, np.empty(0, np.uint64)).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def grouped(run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
    """Whole groups of equal shingles out of rows that come sorted by it, as a table and the starts of its groups."""

    def told(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = table.column("shingle").to_numpy()
        if len(keys):
            yield from run(table, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))))

    def outer(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("shingle").to_numpy()
            at = int(np.searchsorted(keys, keys[-1]))
            if held and at == 0 and held[-1].column("shingle")[-1].as_py() == keys[-1]:
                held.append(batch)
                continue
            yield from told([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        if held:
            yield from told(held)

    return outer


def _groups(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Groups of at least two sets, each set once."""
    keys, nodes = table.column("shingle").to_numpy(), table.column("node").to_numpy()
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])
    group = np.searchsorted(starts, np.arange(len(keys)), side="right") - 1
    real = np.bincount(group, ~again, len(starts))
    keep = ~again & (real[group] > 1)
    if keep.any():
        yield from table.filter(pa.array(keep)).select(["shingle", "node", "size"]).to_batches()


def _to_pivots(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every row with the first PIVOTS rows of its group, if those are in another component."""
    nodes, sizes, sketches = _columns(table)
    roots = table.column("root").to_numpy()
    first = starts[np.searchsorted(starts, np.arange(len(nodes)), side="right") - 1]
    for p in range(PIVOTS):
        two = np.flatnonzero(first + p < np.arange(len(nodes)))
        two = two[roots[first[two] + p] != roots[two]]
        yield from _pairs(nodes, sizes, sketches, first[two] + p, two)


def _apart(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every row with the rows of its group that are in another component. Rows come sorted by component."""
    nodes, sizes, sketches = _columns(table)
    roots = table.column("root").to_numpy()
    first = starts[np.searchsorted(starts, np.arange(len(nodes)), side="right") - 1]
    new = np.concatenate(([True], roots[1:] != roots[:-1]))
    new[starts] = True
    run = np.maximum.accumulate(np.where(new, np.arange(len(nodes)), 0))
    before = run - first  # rows of the group in components before the own one
    ends = np.cumsum(before)
    lo = 0
    while lo < len(nodes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        two = np.repeat(np.arange(lo, hi), before[lo:hi])
        if len(two):
            step = np.arange(len(two)) - np.repeat(np.cumsum(before[lo:hi]) - before[lo:hi], before[lo:hi])
            yield from _pairs(nodes, sizes, sketches, first[two] + step, two)
        lo = hi


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(table), -1)
    return table.column("node").to_numpy(), table.column("size").to_numpy().astype(np.int64), sketches


def _pairs(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, ones: np.ndarray, twos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b, need) of rows whose sizes and sketches allow the similarity: at most a ninth of both sets is in one of them only."""
    for lo in range(0, len(ones), PAIRS):
        one, two = ones[lo : lo + PAIRS], twos[lo : lo + PAIRS]
        fit = 5 * np.minimum(sizes[one], sizes[two]) >= 4 * np.maximum(sizes[one], sizes[two])
        one, two = one[fit], two[fit]
        fit = 9 * np.bitwise_count(sketches[one] ^ sketches[two]).sum(1, dtype=np.int64) <= sizes[one] + sizes[two]
        one, two = one[fit], two[fit]
        a, b = nodes[one], nodes[two]
        # the first `need` common shingles stand in both prefixes
        need = -(-4 * (sizes[one] + sizes[two]) // 9) + 1 + (-4 * np.maximum(sizes[one], sizes[two]) // 5)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], ["a", "b", "need"])


def hashes_of(docs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the sets named, from one document of each; documents without id are all looked through."""

    def run(batches):
        for batch in pieces(batches, 64):
            found = [shingle_set(x) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "hashes"])

    ids = cut(own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW else ids
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = slim.join(ids, "doc_id", "left_semi").unionByName(slim.where("doc_id is null")).select("text")
    return texts.mapInArrow(run, "node bigint, hashes binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    nodes = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    hashes = cut(hashes_of(docs, own, nodes))

    def run(batches):
        for batch in pieces(batches):
            own = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("one", "two")]
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(*own, strict=True)], pa.bool_()))

    sides = [hashes.select(F.col("node").alias(k), F.col("hashes").alias(n)) for k, n in (("a", "one"), ("b", "two"))]
    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "one", "two").mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): links between distinct sets that connect all that are similar."""
    pair = "a bigint, b bigint, need bigint"
    rows = prefixes(docs, common_shingles(docs)).repartition("shingle").sortWithinPartitions("shingle", "node")
    groups = rows.mapInArrow(grouped(_groups), "shingle bigint, node bigint, size int")
    told = cut(fingerprint_pairs(own))
    first = cut(verified(told, docs, own))
    sketches = own.groupBy("node").agg(F.min("sketch").alias("sketch")).join(components(first), "node", "left")
    groups = cut(groups.join(sketches, "node").select("shingle", "node", "size", "sketch", F.coalesce("root", "node").alias("root")))
    near = groups.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(grouped(_to_pivots), pair)
    # a large group tells a pair only where it holds a pivot, so less will do here; this round may leave out any pair
    near = near.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("2 * n >= need").select("a", "b")
    near = cut(near.join(told, ["a", "b"], "left_anti"))
    linked = cut(first.unionByName(verified(near, docs, own)))
    roots = components(linked).withColumnRenamed("node", "n")
    apart = groups.drop("root").join(roots, F.col("node") == F.col("n"), "left").select("shingle", "node", "size", "sketch", F.coalesce("root", "node").alias("root"))
    rest = apart.repartition("shingle").sortWithinPartitions("shingle", "root", "node").mapInArrow(grouped(_apart), pair)
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "b")
    rest = cut(rest.join(near.unionByName(told), ["a", "b"], "left_anti"))
    return linked.unionByName(verified(rest, docs, own))


def near_copies(docs: DataFrame) -> DataFrame:
    """(node, least, root): the least doc_id of every distinct set, and the component that the set is in."""
    own = cut(sets(docs))
    groups = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    return groups.join(components(links(docs, own)), "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, one row of it where the id repeats; rows without id stay.

    Documents without words are copies of each other. Rows without id link others like any.
    """
    found = cut(near_copies(docs).groupBy("root").agg(F.min("least").alias("doc_id")).where("doc_id is not null").select("doc_id"))
    kept = docs.join(found, "doc_id", "left_semi").select(*docs.columns)
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
