"""Ordered scans over groups of any size.

A window partitioned by document alone puts a whole document into one task. These helpers
split each group into blocks of bounded length, scan inside the block, and carry one small
row per block (and per block of blocks) across, so no task ever sees more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
_FUNCS = {"sum": F.sum, "max": F.max, "min": F.min}


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    Projections that follow each other are merged and their expressions repeated at every
    use; a generator of one element keeps the value of an expensive expression.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def _merge(f: str, x: Column, y: Column) -> Column:
    if f == "sum":
        return F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    first = x >= y if f == "max" else x <= y
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.when(first, x).otherwise(y))


def exclusive_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggs: dict[str, tuple[str, str]],
    whole: dict[str, tuple[str, str]] | None = None,
    slim: DataFrame | None = None,
    block: int = BLOCK,
    depth: int = 1,
) -> DataFrame:
    """Add `out = f(source)` over the strictly earlier rows of the same key.

    `order` must be a non-negative integer column, unique in the key. `aggs` maps the new
    column to (sum | max | min, source column); `whole` adds aggregates of the complete key.
    When the rows carry wide payload, pass `slim` with just keys, order and sources, so the
    block totals never touch the payload.
    """
    whole = whole or {}
    b = "__block%d" % depth
    sources = sorted({src for _, src in [*aggs.values(), *whole.values()]})
    rows = df.withColumn(b, F.floor(F.col(order) / block))
    local = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *[_FUNCS[f](src).over(local).alias("__in_" + out) for out, (f, src) in aggs.items()])

    base = (slim if slim is not None else df).select(*keys, F.floor(F.col(order) / block).alias(b), *sources)
    totals = base.groupBy(*keys, b).agg(
        *[_FUNCS[f](src).alias("__t_" + out) for out, (f, src) in aggs.items()],
        *[_FUNCS[f](src).alias("__w_" + out) for out, (f, src) in whole.items()],
    )
    up = {out: (f, "__t_" + out) for out, (f, _) in aggs.items()}
    if depth == 0:
        over = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*keys, b, *[_FUNCS[f](src).over(over).alias("__c_" + out) for out, (f, src) in up.items()])
    else:
        carried = exclusive_scan(totals.select(*keys, b, *[s for _, s in up.values()]), keys, b, up, block=block, depth=depth - 1).select(
            *keys, b, *[F.col(out).alias("__c_" + out) for out in aggs]
        )
    if whole:
        grand = totals.groupBy(*keys).agg(*[_FUNCS[f]("__w_" + out).alias(out) for out, (f, _) in whole.items()])
        carried = carried.join(grand, keys)
    merged = [_merge(f, F.col("__in_" + out), F.col("__c_" + out)).alias(out) for out, (f, _) in aggs.items()]
    return inside.join(carried, [*keys, b]).select(*df.columns, *merged, *whole)


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str = "rn") -> DataFrame:
    """row_number() over (keys order by bucket, order) without one task per key.

    `bucket` is a non-negative integer column that rises with the order, such as a day number;
    rows are ranked inside their bucket and shifted by the rows of earlier buckets.
    """
    inside = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("__n"))
    before = exclusive_scan(sizes, keys, bucket, {"__before": ("sum", "__n")}, depth=0).drop("__n")
    return inside.join(before, [*keys, bucket]).withColumn(name, F.col("__rn") + F.col("__before")).drop("__rn", "__before")


def latest(df: DataFrame, keys: list[str], order: list[str], ascending: bool = False) -> DataFrame:
    """One row per key with the highest (or lowest) order, combined on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.struct(*order, *rest)
    agg = F.min(pick) if ascending else F.max(pick)
    out = df.groupBy(*keys).agg(agg.alias("__p"))
    return out.select(*[F.col(c) if c in keys else F.col("__p." + c).alias(c) for c in df.columns])
