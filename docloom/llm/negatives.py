"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves. A codebook for each half, fitted on a bounded sample, gives every row of the table a
cell (i, j). For a query, a cell holds no score above q1 . c_i + |q1| r_i + q2 . d_j + |q2| s_j, with r and s the
largest distances of its rows from their codewords. Cells lie together in shards. In a shard, a multi-sequence heap
over both sorted lists of half bounds yields the cells by falling bound, until the next bound certifies that no
window can still change. A query goes first to the shard of its highest bound; what it finds there decides which
other shards can matter, and only those are sent the query. Vectors are never copied.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import streamed
from docloom.llm.topk import EXACT, LIMIT, exact_scores
from docloom.plans.stage import cut

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
RELABEL = 7
SAMPLE = 8_192  # rows that the codebooks are fitted on: the smallest hashes of vec_id
CELL = 128  # rows of a cell aimed at
WORDS = 64  # codewords of a half at most
SHARD = 16_384
TOGETHER = 1_024  # rows that are scored at a time
NONE = -(1 << 63)


def labelled_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x). Rows with a null id, label or vector, or a null or non-finite
    component, are left out; of rows with one vec_id the one of smallest vector, then label, counts."""
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("double"))
    good = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))
    return good.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("row")).select("vec_id", "row.label", "row.v")


def _padded(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros, which change no product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    out[np.arange(width) < _lengths(column)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lengths(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy().astype(np.int64)


def codebook(points: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Codewords by Lloyd's rounds from evenly spaced starts; the same points give the same words."""
    points = np.unique(points, axis=0)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[np.linspace(0, len(points) - 1, min(words, len(points))).astype(int)]
    for _ in range(rounds):
        home = nearest(points, centres)[0]
        centres = np.stack([points[home == k].mean(0) if (home == k).any() else centres[k] for k in range(len(centres))])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of every point and the distance to it."""
    home = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
    return home, np.sqrt(((points - centres[home]) ** 2).sum(1))


class Index:
    """What every task knows: two codebooks, and for each cell its rows, radii and first shard. At most WORDS * WORDS cells."""

    def __init__(self, width: int, books: tuple[np.ndarray, np.ndarray], cells: list[tuple[int, int, int, float, float]], shard: int):
        self.width, self.books = width, books
        self.cells = sorted(cells)
        self.i, self.j = (np.array([c[k] for c in self.cells], np.int64) for k in (0, 1))
        self.r, self.s = (np.array([c[k] for c in self.cells]) for k in (3, 4))
        self.first, self.parts, at, held = [], [], 0, 0
        for _, _, n, _, _ in self.cells:
            parts = -(-n // shard)
            if parts > 1 or held + n > shard:
                at, held = at + (held > 0), 0
            self.first.append(at)
            self.parts.append(parts)
            at, held = (at + parts, 0) if parts > 1 else (at, held + n)
        self.shards = at + (held > 0)
        self.place = {(c[0], c[1]): (f, p) for c, f, p in zip(self.cells, self.first, self.parts)}

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Products with the codewords and norms of both halves of every query."""
        half = self.width // 2
        a, b = q[:, :half], q[:, half:]
        return a @ self.books[0].T, np.sqrt((a * a).sum(1)), b @ self.books[1].T, np.sqrt((b * b).sum(1))

    def shard_bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query the highest cell bound in every shard; all parts of a split cell have its bound."""
        pa_, na, pb, nb = self.halves(q)
        up = slack(pa_[:, self.i] + na[:, None] * self.r + pb[:, self.j] + nb[:, None] * self.s, np.hypot(na, nb)[:, None], self.reach())
        out = np.full((len(q), self.shards), -math.inf)
        for k, (first, parts) in enumerate(zip(self.first, self.parts)):
            out[:, first : first + parts] = np.maximum(out[:, first : first + parts], up[:, k : k + 1])
        return out

    def reach(self) -> float:
        """No row's norm is above this."""
        far = [np.sqrt((b * b).sum(1)).max(initial=0.0) + r.max(initial=0.0) for b, r in zip(self.books, (self.r, self.s))]
        return float(np.hypot(*far))


def slack(bound, norm, reach):
    """A bound raised by what rounding may have taken from it."""
    return bound + 1e-9 * (np.abs(bound) + norm * reach) + 1e-6


def build(own: DataFrame, sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL, words: int = WORDS) -> tuple[DataFrame, Index]:
    """Every row with its cell and shard, and the index of the cells."""
    total, width = own.select(F.count("*"), F.max(F.size("v"))).first()
    width = max(2, width or 0)
    half = width // 2
    size = min(words, max(1, math.ceil(math.sqrt(total / cell))))
    drawn = own.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).toArrow()
    points = _padded(drawn.column("v"), width)
    books = codebook(points[:, :half], size), codebook(points[:, half:], size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column("v"), width)
            (i, r), (j, s) = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            columns = [batch.column(c) for c in ("vec_id", "label", "v")] + [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(r), pa.array(s)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "i", "j", "r", "s"])

    filed = cut(own.mapInArrow(assign, "vec_id bigint, label bigint, v array<double>, i int, j int, r double, s double"))
    cells = filed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).collect()  # at most words * words
    index = Index(width, books, [tuple(c) for c in cells], shard)
    places = [(i, j, first, parts) for (i, j), (first, parts) in index.place.items()]
    table = own.sparkSession.createDataFrame(places, "i int, j int, first int, parts int")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    placed = filed.join(F.broadcast(table), ["i", "j"]).select("vec_id", "label", "v", "i", "j", (F.col("first") + part).alias("shard"))
    return cut(placed), index


class Shard:
    """The rows of one shard by cell."""

    def __init__(self, rows: pa.Table, index: Index):
        self.index = index
        i, j, ids, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "vec_id", "label"))
        order = np.lexsort((ids, j, i))
        self.ids, self.labels = ids[order], labels[order]
        self.rows = _padded(rows.column("v"), index.width)[order]
        self.dims = _lengths(rows.column("v"))[order]
        self.largest = np.abs(self.rows).max(initial=0)
        key = list(zip(i[order].tolist(), j[order].tolist()))
        edges = [0] + [k for k in range(1, len(key)) if key[k] != key[k - 1]] + [len(key)]
        self.cells = {key[a]: (a, b) for a, b in zip(edges, edges[1:]) if a < b}
        known = {(c[0], c[1]): (c[3], c[4]) for c in index.cells}
        self.left, self.right = (sorted({c[k] for c in self.cells}) for k in (0, 1))
        self.r = np.array([max(known[c][0] for c in self.cells if c[0] == k) for k in self.left])
        self.s = np.array([max(known[c][1] for c in self.cells if c[1] == k) for k in self.right])

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, from, to) of the cells by falling bound: a heap over both lists of half bounds."""
        pa_, na, pb, nb = (x[0] for x in self.index.halves(q[None, :]))
        norm, reach = float(np.hypot(na, nb)), self.index.reach()
        a, b = pa_[self.left] + na * self.r, pb[self.right] + nb * self.s
        down_a, down_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[down_a].tolist(), b[down_b].tolist()
        todo = [(-(a[0] + b[0]), 0, 0)]
        while todo:
            up, x, y = heapq.heappop(todo)
            cell = self.cells.get((self.left[down_a[x]], self.right[down_b[y]]))
            if cell:
                yield float(slack(-up, norm, reach)), *cell
            if y + 1 < len(b):
                heapq.heappush(todo, (-(a[x] + b[y + 1]), x, y + 1))
            if y == 0 and x + 1 < len(a):
                heapq.heappush(todo, (-(a[x + 1] + b[0]), x + 1, 0))

    def search(self, anchor: int, label: int, dim: int, q: np.ndarray, windows: list[tuple[int, int, int]], k: int, same: bool) -> list[list[tuple[int, int]]]:
        """For each window (lowest score, highest score, floor known from elsewhere), the first k (score, id) in it.

        Cells are scored together, about TOGETHER rows at a time. What is read beyond the bound changes no window.
        """
        fit = ((self.labels == label) == same) & (self.ids != anchor) & (self.dims == dim)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        need = [max(lo, floor) for lo, _, floor in windows]
        spans: list[np.ndarray] = []
        held = 0

        def meet() -> None:
            at = np.concatenate(spans)
            at = at[fit[at]]
            ids, scores = self.ids[at], self.scores(at, q)
            for w, (_, hi, _) in enumerate(windows):
                good = np.flatnonzero((scores >= need[w]) & (scores <= hi))
                if len(good):
                    s, i = np.append(best[w][0], scores[good]), np.append(best[w][1], ids[good])
                    first = np.lexsort((~i, s))[::-1][:k]  # falling scores, ties by rising ids
                    best[w] = s[first], i[first]
                    if len(first) == k:
                        need[w] = max(need[w], int(s[first[-1]]))

        for bound, a, b in self.visit(q):
            if bound < min(need, default=math.inf):
                break
            spans.append(np.arange(a, b))
            held += b - a
            if held >= TOGETHER:
                meet()
                spans, held = [], 0
        if spans:
            meet()
        return [list(zip(s.tolist(), i.tolist())) for s, i in best]

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.largest * np.abs(q).max(initial=0) * len(q) < EXACT:
            return (self.rows[at] @ q).astype(np.int64)
        return np.array(exact_scores(self.rows[at], q), np.int64)


QUERY = "anchor bigint, label bigint, v array<double>, positives array<bigint>, low array<bigint>, high array<bigint>, floor array<bigint>"
FOUND = "anchor bigint, slot int, vec_id bigint, score bigint"


def _routed(asked: DataFrame, index: Index, home: bool) -> DataFrame:
    """Queries with the shards they go to: the one of highest bound, or all others that can still matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                take, shards = [], []
                low, floor = part.column("low").to_pylist(), part.column("floor").to_pylist()
                for row, bounds in enumerate(index.shard_bounds(_padded(part.column("v"), index.width))):
                    first = int(bounds.argmax())
                    need = min((max(lo, f) for lo, f in zip(low[row], floor[row])), default=math.inf)
                    go = [first] if home else [s for s in np.flatnonzero(bounds >= need).tolist() if s != first]
                    take += [row] * len(go)
                    shards += go
                sent = part.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(shards, pa.int32())], [*sent.schema.names, "shard"])

    return asked.mapInArrow(run, QUERY + ", shard int")


def _searched(asked: DataFrame, placed: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """The best rows in each window of each query, from the shards that the queries are sent to."""
    none = {c: F.lit(None).cast(t) for c, t in (("positives", "array<bigint>"), ("low", "array<bigint>"), ("high", "array<bigint>"), ("floor", "array<bigint>"))}
    rows = placed.select("shard", F.lit(0).alias("role"), "vec_id", "label", "v", "i", "j", *[x.alias(c) for c, x in none.items()])
    visits = asked.select("shard", F.lit(1).alias("role"), F.col("anchor").alias("vec_id"), "label", "v", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), *none)

    def meet(shard: Shard, batch: pa.Table) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        names = ("vec_id", "label", "v", "low", "high", "floor")
        for anchor, label, v, low, high, floor in zip(*(batch.column(c).to_pylist() for c in names)):
            q = np.zeros(index.width)
            q[: len(v)] = v
            for slot, hits in enumerate(shard.search(anchor, label, len(v), q, list(zip(low, high, floor)), k, same)):
                out += [(anchor, slot, i, s) for s, i in hits]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["anchor", "slot", "vec_id", "score"])

    return cut(streamed(rows.unionByName(visits), "shard", "role", index.shards, lambda t: Shard(t, index), meet, FOUND))


def _first(found: DataFrame, k: int) -> DataFrame:
    """anchor, slot and hits: the k best (vec_id, score) by falling score, ties to the smaller id.

    Every shard gives at most k rows of a window, and every task passes on k of what it has.
    """
    key = F.struct((-F.col("score").cast("decimal(20,0)")).alias("order"), "vec_id", "score")
    ranked = found.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(key)).alias("all"))
    return ranked.select("anchor", "slot", F.slice("all", 1, k).alias("hits"))


def _windows(asked: DataFrame, placed: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """Two waves: the home shard of every query, then the shards that the floors found there leave open."""
    home = _searched(_routed(asked, index, True), placed, index, k, same)
    floors = _first(home, k).where(F.size("hits") == k).select("anchor", "slot", F.element_at("hits", -1)["score"].alias("floor"))
    floors = floors.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("known"))
    raised = F.expr("transform(low, (x, k) -> coalesce(element_at(known, cast(k as int)), floor[k]))")
    onward = asked.join(floors, "anchor", "left").withColumn("floor", F.when(F.col("known").isNull(), F.col("floor")).otherwise(raised)).drop("known")
    rest = _searched(_routed(onward, index, False), placed, index, k, same)
    return _first(home.unionByName(rest), k)


def hard_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY,
    scale: int = SCALE, relabel: int = RELABEL, sample: int = SAMPLE, shard: int = SHARD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; their positives are the best rows of their label, and
    the negatives of a positive the best rows of other labels that score between `low` and `high` per cent of it.
    Labels of rows whose vec_id is divisible by `relabel` are first moved on by one, modulo 10. Anchors without
    positives and positives without negatives give no rows. Only vectors of one length are compared.
    """
    own = labelled_vectors(rows, scale)
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = cut(own.select("vec_id", moved.alias("label"), "v"))
    placed, index = build(own, sample, shard)
    anchors = own.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor"), "label", "v")
    one = lambda x: F.array(F.lit(x).cast("bigint"))
    asked = anchors.withColumns({"positives": one(None), "low": one(NONE), "high": one(LIMIT), "floor": one(NONE)})
    near = _windows(asked, placed, index, positives, True).select("anchor", "hits")
    # the bounds in whole numbers: low * p <= 100 * n <= high * p
    p = F.col("hits.score")
    up = F.transform(p, lambda s: F.ceil(s.cast("decimal(30,0)") * low / F.lit(100)).cast("bigint"))
    down = F.transform(p, lambda s: F.floor(s.cast("decimal(30,0)") * high / F.lit(100)).cast("bigint"))
    with_windows = near.select("anchor", F.col("hits.vec_id").alias("positives"), p.alias("scores"), up.alias("low"), down.alias("high"))
    with_windows = cut(with_windows.join(anchors, "anchor"))
    asked = with_windows.select("anchor", "label", "v", "positives", "low", "high", F.transform("low", lambda x: F.lit(NONE).cast("bigint")).alias("floor"))
    found = _windows(asked, placed, index, negatives, False)
    named = found.join(with_windows.select("anchor", "positives", "scores"), "anchor")
    ranked = named.select("anchor", F.expr("positives[slot]").alias("positive_id"), F.expr("scores[slot]").alias("positive_score"), F.posexplode("hits").alias("at", "hit"))
    return ranked.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("negative_id"),
        "positive_score", F.col("hit.score").alias("negative_score"),
    )


NEGATIVES_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS at FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.at <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
