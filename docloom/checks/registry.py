"""Registry that ties one query of the engine to its SQL restatement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.stage import safe_unions

# session key: number of partitions that these tables are dealt to, for single-file inputs on one machine
DEALT = ("documents", "pages", "lineitem", "orders")
INPUT_PARTITIONS = "docloom.input.partitions"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables of one scale folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        parts = self.spark.conf.get(INPUT_PARTITIONS, None)
        return df.repartition(int(parts)) if parts and name in DEALT else df


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and fractions as DOUBLE, so both sides compare alike."""
    out = []
    for f in df.schema.fields:
        c = F.col("`%s`" % f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            safe_unions(spark)
            return _plain(fn(Tables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError("duplicate query " + name)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return wrap
