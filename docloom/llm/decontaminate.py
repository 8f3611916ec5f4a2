"""Benchmark decontamination by item-sized windows.

A document is contaminated by an item if a window of the item's number of words has a weighted five-word
shingle similarity (sum of minima over sum of maxima of the shingle counts) of at least 0.8 with it.
Windows are taken at every word offset that can reach that similarity, found through an index of the items' shingles
in place of a multi-index of their fingerprints, and verified by the exact similarity. The differing bits of SimHash
fingerprints are told with each result and decide nothing: a window at 0.8 may differ in any number of bits.

A window that shares no shingle with an item has similarity zero, and one at 0.8 shares 8/9 of them, so
offsets are enumerated only around places where that many of an item's shingles stand. Nothing that
could be verified is left out by this.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pieces, utf8

WORDS = 5
SIMILARITY = 0.8
ITEMS_PER_BLOCK = 5_000
BYTES_PER_BLOCK = 16 << 20
CHUNK = 1 << 20
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_PLACE = _RNG.integers(0, 1 << 64, 4096, np.uint64, endpoint=False) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: bytes) -> bytes:
    """Lower case, everything but letters, digits and non-ASCII characters as spaces."""
    return text.decode(errors="replace").lower().encode().translate(_TABLE)


def _word_hashes(buf: bytes) -> np.ndarray:
    arr = np.frombuffer(buf, np.uint8)
    inside = np.zeros(len(arr) + 2, bool)
    inside[1:-1] = arr != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    letters = arr[inside[1:-1]]
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, lens)
    h = np.add.reduceat(_BYTE[letters] * _PLACE[place & 4095], first) + lens.astype(np.uint64)
    h ^= h >> np.uint64(29)
    return h * _MUL


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash per word of a normalised text; long texts in pieces that end between words."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        end = text.rfind(b" ", at, at + CHUNK)
        end = end if end > at else (text.find(b" ", at + CHUNK) if text.find(b" ", at + CHUNK) > 0 else len(text))
        out.append(_word_hashes(text[at:end]))
        at = end
    out.append(_word_hashes(text[at:]))
    return np.concatenate(out) if len(out) > 1 else out[0]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
        h ^= h >> np.uint64(32)
    return h * _MUL


def _votes(hashes: np.ndarray) -> np.ndarray:
    return 2 * np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int32) - 1


def _pack(ones: np.ndarray) -> np.ndarray:
    return np.packbits(ones, axis=-1, bitorder="little").view(np.uint64).reshape(-1)


class Items:
    """A block of benchmark items: their shingles, where those stand, and their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, size: int = WORDS):
        self.similarity = similarity
        exact = Fraction(str(similarity))
        self.share = exact / (1 + exact)
        self.ids, self.words, self.sizes, self.hashes, self.counts, self.fps = [], [], [], [], [], []
        where: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = word_hashes(normalise((text or "").encode()))
            if not len(words):
                continue
            k = min(size, len(words))
            own = shingles(words, k)
            n = len(self.ids)
            self.ids.append(item_id)
            self.words.append(len(words))
            self.sizes.append(k)
            self.hashes.append(own)
            self.counts.append(Counter(own.tolist()))
            self.fps.append(int(_pack(_votes(own).sum(0) > 0)[0]))
            for h in set(own.tolist()):
                where[k][h].append(n)
        self.where = {k: dict(v) for k, v in where.items()}
        self.known = {k: np.sort(np.array(list(v), np.uint64)) for k, v in self.where.items()}
        self.maps = {}
        for k, known in self.known.items():
            seen = np.zeros(1 << 20, bool)
            seen[known >> np.uint64(44)] = True
            self.maps[k] = seen

    def _places(self, own: np.ndarray, k: int) -> np.ndarray:
        """Positions of shingles that some item has."""
        known = self.known[k]
        at = np.flatnonzero(self.maps[k][own >> np.uint64(44)])
        if len(at):
            found = np.searchsorted(known, own[at])
            found[found == len(known)] = 0
            at = at[known[found] == own[at]]
        return at

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, differing bits, similarity) of the best window of every item found."""
        out = []
        for k in self.known:
            own = shingles(words, k)
            at = self._places(own, k)
            if not len(at):
                continue
            by_item: dict[int, list[int]] = defaultdict(list)
            for p, h in zip(at.tolist(), own[at].tolist(), strict=True):
                for n in self.where[k][h]:
                    by_item[n].append(p)
            for n, hits in sorted(by_item.items()):
                best = self._best(n, own, np.array(hits), k)
                if best:
                    out.append((self.ids[n], *best))
        return out

    def _best(self, n: int, own: np.ndarray, hits: np.ndarray, k: int) -> tuple[int, int, int, float] | None:
        size = min(len(self.hashes[n]), len(own))
        need = math.ceil(self.share * (len(self.hashes[n]) + size))
        starts = self._starts(hits, size, len(own), need)
        if not len(starts):
            return None
        best = None
        goal, known = self.counts[n], len(self.hashes[n])
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            first = int(run[0])
            here = Counter(own[first : first + size].tolist())
            common = sum((here & goal).values())
            for s in run.tolist():
                if s > first:  # one shingle leaves the window and one comes in
                    gone, new = int(own[s - 1]), int(own[s + size - 1])
                    common -= here[gone] <= goal[gone]
                    here[gone] -= 1
                    here[new] += 1
                    common += here[new] <= goal[new]
                score = common / (known + size - common)
                if score >= self.similarity and (best is None or score > best[1]):
                    best = (s, score)
        if best is None:
            return None
        bits = int(_pack(_votes(own[best[0] : best[0] + size]).sum(0) > 0)[0]) ^ self.fps[n]
        return best[0], size + k - 1, bits.bit_count(), best[1]

    @staticmethod
    def _starts(hits: np.ndarray, size: int, total: int, need: int) -> np.ndarray:
        """Window offsets that hold at least `need` of the hits."""
        if len(hits) < need:
            return np.empty(0, np.int64)
        low = max(0, int(hits[0]) - size + 1)
        high = min(total - size, int(hits[-1]))
        starts = np.arange(low, high + 1)
        inside = np.searchsorted(hits, starts + size) - np.searchsorted(hits, starts)
        return starts[inside >= need]


def item_blocks(benchmark: DataFrame) -> list:
    """The items as broadcasts of bounded size each: at most about ITEMS_PER_BLOCK rows and BYTES_PER_BLOCK bytes."""
    rows, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // ITEMS_PER_BLOCK), -(-size // BYTES_PER_BLOCK))
    spark = benchmark.sparkSession
    slim = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    out = []
    for b in range(blocks):
        part = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if part:
            out.append(spark.sparkContext.broadcast([(r.item_id, r.text) for r in part]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, bits and similarity of the best window of each pair at or over the similarity.

    Null or empty texts and items match nothing. An item of under five words is one shingle of all its
    words. A document shorter than an item is compared as one window. Of equal windows the first counts.
    """
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, bits int, similarity double"
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for items in item_blocks(benchmark):

        def run(batches, items=items):
            known = Items(items.value, similarity)
            for batch in pieces(batches):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                    rows += [(doc, *m) for m in known.matches(word_hashes(normalise(text)))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "bits", "similarity"])

        found = slim.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that no item contaminates, in one pass for each block of items."""
    fields = docs.schema
    for items in item_blocks(benchmark):

        def run(batches, items=items):
            known = Items(items.value, similarity)
            for batch in pieces(batches):
                kept = [not known.matches(word_hashes(normalise(x))) for x in utf8(batch, "text")]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, fields)
    return docs


#: The best windows of `documents` for items of at least WORDS words, in SQL, for checks.
WINDOWS_SQL = rf"""
WITH i AS (SELECT item_id, ws, len(ws) - {WORDS - 1} AS m FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x80-\x{{10FFFF}}]+') AS ws FROM benchmark)),
ig AS (SELECT item_id, m, array_to_string(ws[j:j + {WORDS - 1}], ' ') AS gram, count(*) AS ci FROM (SELECT item_id, ws, m, unnest(range(1, m + 1)) AS j FROM i WHERE m > 0) GROUP BY ALL),
d AS (SELECT doc_id, ws, len(ws) - {WORDS - 1} AS n FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x80-\x{{10FFFF}}]+') AS ws FROM documents)),
dg AS (SELECT doc_id, n, p - 1 AS p, array_to_string(ws[p:p + {WORDS - 1}], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, n + 1)) AS p FROM d WHERE n > 0)),
h AS (SELECT doc_id, item_id, p, gram, ci, m, n, least(m, n) AS size FROM dg JOIN ig USING (gram)),
s AS (SELECT DISTINCT doc_id, item_id, size, m, unnest(range(greatest(0, p - size + 1), least(p, n - size) + 1)) AS s FROM h),
c AS (SELECT s.doc_id, s.item_id, s.s, s.size, s.m, h.gram, least(count(*), any_value(h.ci)) AS shared FROM s JOIN h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.p BETWEEN s.s AND s.s + s.size - 1 GROUP BY ALL),
w AS (SELECT doc_id, item_id, s, size, sum(shared) / (m + size - sum(shared)) AS score FROM c GROUP BY doc_id, item_id, s, size, m)
SELECT doc_id, item_id, s AS start_word, size + {WORDS - 1} AS n_words, round(score, 9) AS similarity FROM w WHERE score >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, s) = 1
"""
