"""Reversible line deduplication.

Exact reference counts say in how many documents a line stands and which of them is the largest.
Sharded cuckoo filters hold the same lines in a few bytes each: a new batch asks them first, and only
lines that may be known are merged with the exact table. Deletions lower the counts, take lines that
reach zero out of the filters, and find the next largest document from the stored postings.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh, pieces, salted_join, utf8
from docloom.plans.stage import stage_root

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 200_000


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit digest of a line stripped and lower-cased (ASCII), or None where it is too short to count."""
    line = line.strip(SPACE)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode(errors="replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id) for every distinct countable line of every document."""

    def run(batches):
        for batch in pieces(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                found = {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k}
                keys.extend(found)
                ids.extend([doc] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "key binary, doc_id bigint")


class CuckooFilter:
    """Partial-key cuckoo filter of 16-bit fingerprints in buckets of four, with insertion and deletion."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """At most 80 % full with `keys` keys; a power of two, so that both buckets of a key find each other."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * cls.SLOTS))))))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of 64-bit key halves; the bits that chose the shard take no part."""
        mark = ((keys >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((np.asarray(mark, np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False where the filter is too full; the caller then builds a larger one from the exact table."""
        rng = np.random.default_rng(7)
        for mark, one, two in zip(*self._places(keys), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = two
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    mark, self.table[bucket, slot] = self.table[bucket, slot], mark
                    bucket = int(self._other(bucket, mark))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for mark, one, two in zip(*self._places(keys), strict=True):
            for bucket in (one, two):
                here = np.flatnonzero(self.table[bucket] == mark)
                if len(here):
                    self.table[bucket, here[0]] = 0
                    break


def _halves(keys: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)


def _shard(shards: int):
    """The shard comes from the second half of the key, the place in the filter from the first."""
    return F.pmod(F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


@dataclass
class _State:
    refs: DataFrame
    filters: DataFrame
    postings: DataFrame


class LineIndex:
    """Lines of a growing and shrinking corpus, kept in the shared folder.

    Tables: postings (key, doc_id), refs (shard, key, n_docs, keeper) and filters (shard, filter). Every
    change writes new tables and leaves the old ones, so a lost executor only repeats its tasks.
    Null texts hold no lines; documents without doc_id are not indexed and never lose lines. A doc_id
    that comes again adds only lines it did not have, so repeated rows count once.
    """

    def __init__(self, spark: SparkSession, shards: int, min_chars: int = MIN_CHARS, root: str | None = None):
        self.spark, self.shards, self.min_chars = spark, shards, min_chars
        self.root = (root or f"{stage_root(spark)}/lines-{uuid.uuid4().hex}").rstrip("/")
        self.state: _State | None = None

    @staticmethod
    def shards_for(lines: int) -> int:
        return max(16, -(-lines // KEYS_PER_SHARD))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _counted(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy(_shard(self.shards).alias("shard"), "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def insert(self, docs: DataFrame) -> None:
        found = line_postings(docs.where(F.col("doc_id").isNotNull()), self.min_chars).distinct()
        if self.state:
            found = found.join(self.state.postings, ["key", "doc_id"], "left_anti")
        found = self._keep(found, "postings")
        delta = self._counted(found)
        if not self.state:
            refs = self._keep(delta, "refs")
            self.state = _State(refs, self._keep(self._built(refs), "filters"), found)
            return
        probed = self._keep(self._probe(delta), "probed")
        maybe, new = probed.where("seen").drop("seen"), probed.where(~F.col("seen")).drop("seen")
        refs = self.state.refs
        merged = refs.join(maybe.withColumnsRenamed({"n_docs": "_n", "keeper": "_k"}), ["shard", "key"], "full_outer").select(
            "shard", "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "_k").alias("keeper")
        )
        refs = self._keep(merged.unionByName(new), "refs")
        added = new.select("shard", "key").unionByName(maybe.join(self.state.refs, ["shard", "key"], "left_anti").select("shard", "key"))
        filters = self._keep(self._changed(added, refs, True), "filters")
        self.state = _State(refs, filters, self.state.postings.unionByName(found))

    def delete(self, doc_ids: DataFrame) -> None:
        """Undo the insertion of documents."""
        if not self.state:
            return
        gone = doc_ids.select(F.col("doc_id").cast("bigint")).distinct()
        taken = self._keep(self.state.postings.join(gone, "doc_id", "left_semi").select("key", "doc_id"), "taken")
        left = self._keep(self.state.postings.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "postings")
        delta = self._counted(taken).withColumnsRenamed({"n_docs": "_n", "keeper": "_k"})
        refs = self.state.refs.join(delta, ["shard", "key"], "left")
        orphans = refs.where((F.col("keeper") == F.col("_k")) & (F.col("n_docs") > F.col("_n"))).select("key")
        heirs = left.join(orphans, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("_heir"))
        refs = refs.withColumn("n_docs", F.col("n_docs") - F.coalesce("_n", F.lit(0))).join(heirs, "key", "left")
        refs = self._keep(refs.select("shard", "key", "n_docs", F.coalesce("_heir", "keeper").alias("keeper")), "refs")
        zero = refs.where("n_docs = 0").select("shard", "key")
        refs = refs.where("n_docs > 0")
        self.state = _State(refs, self._keep(self._changed(zero, refs, False), "filters"), left)

    def _built(self, refs: DataFrame) -> DataFrame:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"][:1], "filter": [_filled(_halves(pdf["key"])).dump()]})

        return refs.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, filter binary")

    def _probe(self, delta: DataFrame) -> DataFrame:
        """Mark keys that the filter of their shard may hold. Keys are distinct, so shards are even."""

        def probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            seen = CuckooFilter.load(filters["filter"].iloc[0]).contains(_halves(keys["key"])) if len(filters) and len(keys) else False
            return keys.assign(seen=seen)

        grouped = delta.groupBy("shard").cogroup(self.state.filters.groupBy("shard"))
        return grouped.applyInPandas(probe, "shard int, key binary, n_docs bigint, keeper bigint, seen boolean")

    def _changed(self, keys: DataFrame, refs: DataFrame, add: bool) -> DataFrame:
        """Filters after insertions or deletions; a shard that overflows is built anew, larger, from the exact table."""

        def change(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            shard, keys = (new if len(new) else old)["shard"].iloc[0], _halves(new["key"])
            made = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(2 * len(keys))
            if not add:
                made.delete(keys)
                full = False
            else:
                full = not made.insert(keys)
            return pd.DataFrame({"shard": [shard], "filter": [None if full else made.dump()]})

        changed = keys.groupBy("shard").cogroup(self.state.filters.groupBy("shard")).applyInPandas(change, "shard int, filter binary")
        changed = self._keep(changed, "changed")
        over = changed.where("filter is null").select("shard")
        return changed.where("filter is not null").unionByName(self._built(refs.join(over, "shard", "left_semi")))

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """Distinct (key) rows with `seen`: false means that no document of the index has the line."""
        return self._probe(keys.select(_shard(self.shards).alias("shard"), "key", F.lit(0).cast("bigint").alias("n_docs"), F.lit(None).cast("bigint").alias("keeper"))).select("key", "seen")

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, keys): repeated lines that a document loses, its own list only."""
        often = self.state.refs.where(F.col("n_docs") >= min_docs).select("key", "n_docs", "keeper")
        rows = self.state.postings.count()
        hits = salted_join(self.state.postings, often, ["key"], "n_docs", ["doc_id"], rows)
        return hits.where(F.col("keeper") != F.col("doc_id")).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, min_docs: int = MIN_DOCS, keep: list[str] | None = None, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
        """Documents without their repeated lines: columns `keep`, then line counts and text under `names`.

        A null or empty text is one empty line. One shuffle carries the texts to their lists of lines.
        """
        keep = ["doc_id"] if keep is None else keep
        min_chars = self.min_chars
        fields = [docs.schema[c] for c in keep]
        own_id, own_text, own_keys = fresh(keep, "_id", "_text", "_keys")
        slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").cast("bigint").alias(own_id), F.col("text").alias(own_text))
        joined = slim.join(self.drops(min_docs).withColumnsRenamed({"doc_id": own_id, "keys": own_keys}), own_id, "left")
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "`%s` bigint, `%s` bigint, `%s` string" % names

        def run(batches):
            for batch in pieces(batches):
                lines, dropped, kept = [], [], []
                for text, keys in zip(utf8(batch, own_text), batch.column(own_keys).to_pylist(), strict=True):
                    parts = text.split(b"\n")
                    if keys:
                        keys = set(keys)
                        rest = [x for x in parts if line_key(x, min_chars) not in keys]
                    else:
                        rest = parts
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(rest))
                    kept.append(b"\n".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name) for f in fields], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    [*[f.name for f in fields], *names],
                )

        return joined.mapInArrow(run, schema)


def _filled(keys: np.ndarray) -> CuckooFilter:
    size = max(16, 2 * len(keys))
    while not (made := CuckooFilter.sized(size)).insert(keys):
        size *= 2
    return made


def index_documents(docs: DataFrame, batches: int = 2, min_chars: int = MIN_CHARS) -> LineIndex:
    """An index of all documents, which arrive in `batches` parts by the hash of their id."""
    spark = docs.sparkSession
    index = LineIndex(spark, LineIndex.shards_for(docs.count() * 8), min_chars)
    for part in range(batches):
        index.insert(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == part))
    return index


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    cleaned = index_documents(docs, min_chars=min_chars).apply(docs, min_docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def sha256_of_lines(lines: list[bytes]) -> str:
    """Digest of the kept lines of one document, for checks."""
    return hashlib.sha256(b"\n".join(lines)).hexdigest()
