"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.stage import safe_unions

# a key is hot when it alone holds this share of all rows; at most 1 / share keys can be
HOT_SHARE = 1e-4
HOT_LEAST = 1000
SALTS = 64


ARROW_ROWS = 1_000
ARROW_BYTES = 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds what one Arrow batch holds: tables of long texts otherwise reach tens of MB a batch, several times per task."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    safe_unions(spark)
    return spark


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short slices, so that few texts exist as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like those given that no column has yet; Spark compares names without case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def salted_join(left: DataFrame, right: DataFrame, on: list[str], count: str, spread: list[str], rows: int) -> DataFrame:
    """Left join on a key of which `right` has one row, with the number `count` of left rows it meets.

    A key with at least HOT_SHARE of the `rows` rows is split over SALTS parts by the hash of the
    `spread` columns. There are at most 1 / HOT_SHARE such keys, which bounds what is broadcast.
    """
    least = max(HOT_LEAST, int(rows * HOT_SHARE))
    hot = right.where(F.col(count) >= least).select(*on, F.lit(SALTS).alias("_salts"))
    marked = left.join(F.broadcast(hot), on, "left")
    salt = F.pmod(F.xxhash64(*spread), F.col("_salts"))
    marked = marked.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("bigint"))).drop("_salts")
    parts = F.when(F.col(count) >= least, F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))
    copies = right.withColumn("_salt", F.explode(parts))
    return marked.join(copies, [*on, "_salt"], "left").drop("_salt")


def streamed(
    rows: DataFrame, shard: str, role: str, shards: int, hold: Callable[[pa.Table], object],
    meet: Callable[[object, pa.Table], Iterator[pa.RecordBatch]], schema: str, gather: int = 1,
) -> DataFrame:
    """Stream the rows of role 1 of every shard past what `hold` makes of its rows of role 0.

    A task holds the role 0 rows of one shard at a time, which its maker bounds, and about `gather` rows of the
    others; no row is copied for the sake of the meeting. Shards without rows of role 0 give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, held, met = None, [], None, []

        def meeting() -> Iterator[pa.RecordBatch]:
            nonlocal kept, held, met
            if met and (kept or held is not None):
                if held is None:
                    held, kept = hold(pa.Table.from_batches(kept)), []
                yield from meet(held, pa.Table.from_batches(met))
            met = []

        for batch in batches:
            marks = list(zip(batch.column(shard).to_pylist(), batch.column(role).to_pylist(), strict=True))
            at = 0
            while at < len(marks):
                to = at
                while to < len(marks) and marks[to] == marks[at]:
                    to += 1
                if marks[at][0] != current:
                    yield from meeting()
                    current, kept, held = marks[at][0], [], None
                (met if marks[at][1] else kept).append(batch.slice(at, to - at))
                if sum(b.num_rows for b in met) >= gather:
                    yield from meeting()
                at = to
        yield from meeting()

    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 4)
    return rows.repartition(parts, shard).sortWithinPartitions(shard, role).mapInArrow(run, schema)
