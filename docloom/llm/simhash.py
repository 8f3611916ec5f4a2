"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table row: its Hamming distances to reference fingerprints, block by
block. Hamming distance is a metric on any set of bits, so two fingerprints at most `radius` apart differ
by at most `radius` in every coordinate, over all bits and inside any block. With `blocks` blocks at
least `blocks - radius` of them hold no difference at all, where all coordinates are equal. Rows with
equal coordinates in such a choice of blocks are brought together by an equality shuffle, pairs are
discarded by their largest coordinate difference, and the survivors are verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pieces, salted_join, utf8
from docloom.plans.stage import cut

RADIUS = 3
BLOCKS = 5
REFERENCES = 32
SHINGLE = 3
SPACE = b" \t\n\x0b\x0c\r"
HEAVY = 2048
HEAVY_KEYS = 10_000
_TABLE = bytes(32 if b in SPACE else b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `size` words joined by a space; of the whole sequence where it is shorter."""
    words = text.translate(_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -size]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits; bit i is set where more than half of the shingle hashes have it. No words: 0."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per document; null texts have no words."""

    def run(batches):
        for batch in pieces(batches):
            fps = np.array([fingerprint(x, size) for x in utf8(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def popcount(x: np.ndarray) -> np.ndarray:
    return sum(_COUNT[(x >> np.uint64(s)) & np.uint64(0xFFFF)].astype(np.int16) for s in (0, 16, 32, 48))


def references(count: int = REFERENCES) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, count, np.uint64, endpoint=False)


def block_masks(blocks: int, bits: np.ndarray | None = None) -> np.ndarray:
    """Masks that divide the bits (all 64, or those given) into blocks of nearly equal size."""
    parts = np.array_split(np.arange(64) if bits is None else bits, blocks)
    return np.array([sum(1 << int(b) for b in part) for part in parts], np.uint64)


def distance_table(fps: np.ndarray, masks: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Coordinates [fingerprint, block, reference]."""
    out = np.empty((len(fps), len(masks), len(refs)), np.uint8)
    for j, ref in enumerate(refs):
        apart = fps ^ ref
        for b, mask in enumerate(masks):
            out[:, b, j] = popcount(apart & mask)
    return out


def _keys(table: np.ndarray, salt: bytes) -> np.ndarray:
    """A 64-bit key per row of coordinates; equal keys of unequal rows only cost a comparison."""
    flat = np.ascontiguousarray(table.reshape(len(table), -1))
    return np.array([xxhash.xxh3_64_intdigest(salt + row.tobytes()) for row in flat], np.uint64).view(np.int64)


def close_pairs(fps: np.ndarray, coords: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep all components of the pairs at most `radius` apart among rows of equal, sorted keys."""
    at = np.arange(len(fps))
    root = np.arange(len(fps))
    step = 1
    idx = at[:-1]
    while len(idx):
        idx = idx[idx + step < len(fps)]
        idx = idx[keys[idx] == keys[idx + step]]
        for lo in range(0, len(idx), 1 << 16):
            one = idx[lo : lo + (1 << 16)]
            two = one + step
            apart = np.abs(coords[one].astype(np.int16) - coords[two]).max(1)
            one = one[apart <= radius]
            two = one + step
            real = popcount(fps[one] ^ fps[two]) <= radius
            _union(root, one[real], two[real])
        step += 1
    return at[root != at], root[root != at]


def _union(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Minimum labels of two linked sides, until nothing changes."""
    while len(one):
        a, b = root[one], root[two]
        differ = a != b
        if not differ.any():
            return
        one, two, a, b = one[differ], two[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, count: int = REFERENCES) -> DataFrame:
    """(a, b) with a > b: links between distinct fingerprints that connect all that are within `radius`.

    `blocks` trades copies of the table (one for each choice of blocks - radius blocks) for smaller
    groups: 4, 5 and 6 blocks give 4, 10 and 20 copies with 16, 25 and 32 bits that must agree. A group
    of over HEAVY rows is divided again by the same argument over its other bits.
    """
    refs = references(count)
    masks = block_masks(blocks)
    choices = list(combinations(range(blocks), blocks - radius))
    row = "key bigint, sub int, fp bigint, coords binary"

    def tabled(batches):
        for batch in pieces(batches, 4096):
            own = batch.column("fp").to_numpy().view(np.uint64)
            table = distance_table(own, masks, refs)
            whole = table.sum(1, dtype=np.uint8)
            coords = pa.array([x.tobytes() for x in whole], pa.binary())
            for n, choice in enumerate(choices):
                keys = _keys(table[:, list(choice)], b"%d" % n)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(own), n, np.int32)), batch.column("fp"), coords], ["key", "sub", "fp", "coords"])

    def divided(batches):
        """A heavy group by the blocks of the bits that its key leaves open: one of them agrees as well."""
        for batch in pieces(batches, 4096):
            own, keys, subs = batch.column("fp").to_numpy().view(np.uint64), batch.column("key").to_numpy(), batch.column("sub").to_numpy()
            for n in np.unique(subs).tolist():
                here = np.flatnonzero(subs == n)
                shut = sum(int(masks[b]) for b in choices[n])
                inner = block_masks(radius + 1, np.array([b for b in range(64) if not shut >> b & 1]))
                table = distance_table(own[here], inner, refs)
                for b in range(radius + 1):
                    made = _keys(table[:, b], b"s%d" % b) ^ keys[here]
                    yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(np.full(len(here), n, np.int32)), batch.column("fp").take(pa.array(here)), batch.column("coords").take(pa.array(here))], ["key", "sub", "fp", "coords"])

    def linked(batches):
        """Rows come sorted by key; the group that a batch ends with waits for the next batch."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if last is not None and keys[-1] == last:
                held.append(batch)
                continue
            cut_at = int(np.searchsorted(keys, keys[-1]))
            yield from pairs([*held, batch.slice(0, cut_at)])
            held, last = [batch.slice(cut_at)], keys[-1]
        yield from pairs(held)

    def pairs(batches):
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        keys = table.column("key").to_numpy()
        alone = np.ones(len(keys), bool)
        if len(keys) > 1:
            same = keys[1:] == keys[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        rest = np.flatnonzero(~alone)
        if not len(rest):
            return
        table = table.take(pa.array(rest))
        own = table.column("fp").to_numpy().view(np.uint64)
        coords = np.frombuffer(b"".join(table.column("coords").to_pylist()), np.uint8).reshape(len(own), -1)
        one, two = close_pairs(own, coords, keys[rest], radius)
        a, b = own[one].view(np.int64), own[two].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    rows = cut(fps.select("fp").distinct().mapInArrow(tabled, row))
    heavy = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("key"))
    few = heavy.count()
    heavy = F.broadcast(heavy) if few <= HEAVY_KEYS else heavy
    if few:
        rows = rows.join(heavy, "key", "left_anti").unionByName(rows.join(heavy, "key", "left_semi").mapInArrow(divided, row))
    grouped = rows.select("key", "fp", "coords").repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(linked, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for nodes that have an edge.

    Alternates between pointing the larger neighbours of each node at its smallest one, and the smaller
    neighbours at the smallest of them, until the edges are stars. Each round is written to the shared
    folder, and no neighbourhood is ever gathered: only minima are.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        pairs = cut(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
    raise RuntimeError("components did not settle in %d rounds" % rounds)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of `docs`.

    Null and empty texts have fingerprint zero and are linked by it like any other. Rows without doc_id
    are returned and link others, but give no component id; their own is the smallest id they reach.
    """
    own = cut(fingerprints(docs, size))
    groups = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(groups, radius, blocks))
    known = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = cut(known)
    best = known.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(known.join(best, "root").select("fp", "component_id", "n"))
    joined = salted_join(own, table, ["fp"], "n", ["doc_id"], own.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The document with the smallest id of each component, one row of it where the id repeats; rows without id stay."""
    found = near_duplicates(docs, radius, blocks).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").select(*docs.columns)
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
