"""Exact inner-product search with ball trees.

The vectors are divided into shards of bounded size, each with one ball tree. A query visits the nodes of a
shard by their upper bound, q . centre + |q| * radius, and stops below the k-th score known so far. Queries
come in blocks; every block first searches one shard, and the scores it finds there are shared with all other
shards as the bound to start from.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.stage import cut

K = 10
SCALE = 1024
EVERY = 100
SHARD = 16_384
BLOCK = 512
LEAF = 128
EXACT = float(1 << 53)
LIMIT = (1 << 63) - 1


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): components floor(scale * x). Vectors that are null or hold null or non-finite components,
    and rows without vec_id, are left out; of rows with one vec_id the smallest vector counts."""
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("double"))
    good = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return good.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Integer products; floats hold them as long as no partial sum can pass 2**53. Scores saturate at 64 bits."""
    if not rows.shape[1]:
        return [0] * len(rows)
    if np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * rows.shape[1] < EXACT:
        return (rows @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [max(-LIMIT - 1, min(LIMIT, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for r in rows]


class BallTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.nodes: list[tuple[np.ndarray, float, int, int, np.ndarray | None]] = []
        self._build(np.arange(len(ids)), leaf)

    def _build(self, members: np.ndarray, leaf: int) -> int:
        pts = self.rows[members]
        centre = pts.mean(0)
        radius = float(np.sqrt(((pts - centre) ** 2).sum(1)).max(initial=0.0))
        at = len(self.nodes)
        self.nodes.append((centre, radius, -1, -1, members))
        if len(members) > leaf and radius > 0:
            far = pts[((pts - centre) ** 2).sum(1).argmax()]
            other = pts[((pts - far) ** 2).sum(1).argmax()]
            side = (pts @ (other - far)).argsort(kind="stable")
            half = len(side) // 2
            left = self._build(members[np.sort(side[:half])], leaf)
            right = self._build(members[np.sort(side[half:])], leaf)
            self.nodes[at] = (centre, radius, left, right, None)
        return at

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best (score, id), none under `floor`, without the query's own row; ties go to the smaller id."""
        norm = float(np.sqrt((query * query).sum()))

        def bound(n: int) -> float:
            centre, radius, *_ = self.nodes[n]
            up = float(query @ centre) + norm * radius
            return up + 1e-9 * (abs(up) + norm * radius + norm * float(np.sqrt((centre * centre).sum()))) + 1e-6

        best: list[tuple[int, int]] = []
        todo = [(-bound(0), 0)]
        while todo:
            up, n = heapq.heappop(todo)
            least = max(best[0][0] if len(best) == k else -LIMIT - 1, floor if floor is not None else -LIMIT - 1)
            if -up < least:
                break
            _, _, left, right, members = self.nodes[n]
            if members is None:
                heapq.heappush(todo, (-bound(left), left))
                heapq.heappush(todo, (-bound(right), right))
                continue
            for i, score in zip(self.ids[members].tolist(), exact_scores(self.rows[members], query), strict=True):
                if i == query_id or (floor is not None and score < floor):
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: for each vec_id divisible by `every`, its k highest inner products.

    A task holds one shard and one block of queries, at most about `shard` and `block` rows. Only vectors of
    the same length are compared.
    """
    own = cut(integer_vectors(rows, scale))
    total = own.count()
    shards = max(1, -(-total // shard))
    sharded = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = own.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    everywhere = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    copies = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = "block int, query_id bigint, vec_id bigint, score bigint"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim, asked in left.groupby("dim"):
            here = right[right["dim"] == dim]
            if not len(here):
                continue
            tree = BallTree(here["vec_id"].to_numpy(), _matrix(here["v"]))
            for row, query in zip(asked.itertuples(), _matrix(asked["v"]), strict=True):
                floor = int(row.floor) if isinstance(row.floor, str) else None
                found += [(row.block, row.vec_id, i, s) for s, i in tree.search(row.vec_id, query, k, floor)]
        return pd.DataFrame(found, columns=["block", "query_id", "vec_id", "score"])

    def searched(asked: DataFrame, there: DataFrame) -> DataFrame:
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own beside those of the shards
        return cut(asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInPandas(run, out))

    first = searched(queries.withColumns({"shard": home, "floor": F.lit(None).cast("string")}), copies.where(F.col("shard") == home))
    found = first
    if shards > 1:
        floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
        asked = everywhere.join(floors.select(F.col("query_id").alias("vec_id"), F.col("floor").cast("string").alias("floor")), "vec_id", "left")
        found = first.unionByName(searched(asked, copies.where(F.col("shard") != home)))
    ordered = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "score"))).alias("all"))
    ranked = ordered.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
