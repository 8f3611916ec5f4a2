"""Tables of document buckets with atomic versions.

A version is a set of bucket files and a commit that says for every bucket which version wrote it. A commit counts from
the moment its success mark is there, which Spark writes last; readers go by the newest commit, so a write that dies
halfway changes nothing they see. Buckets that a version does not touch are carried over by name, not rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.plans.stage import cut, exists

PACKED = "zstd"  # rows of a table are many and alike
TASK_ROWS = 1 << 18  # about so many rows of a bucket are written by one task


def with_bucket(df: DataFrame, buckets: int = DEFAULT.doc_buckets) -> DataFrame:
    return df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions in order."""
    target, files = _files(spark, f"{path}/_commits")
    if not files.exists(target):
        return []
    found = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(int(n[1:]) for n in found if n.startswith("v") and exists(spark, f"{path}/_commits/{n}/_SUCCESS"))


def _written(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """bucket -> version that wrote it: one row per bucket."""
    return {r.doc_bucket: r.written for r in spark.read.parquet(f"{path}/_commits/v{version}").collect()}


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The table as of a version, the newest by default; of the given buckets only, if any are given."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    if not known:
        return None
    written = _written(spark, path, known[-1] if version is None else version)
    folders = sorted({f"{path}/data/v{v}/doc_bucket={b}" for b, v in written.items() if buckets is None or b in buckets})
    schema = spark.read.parquet(f"{path}/_schema").schema
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows


def replace_documents(df: DataFrame, path: str, documents: DataFrame | None = None, buckets: int = DEFAULT.doc_buckets) -> int:
    """Commit a version in which the given documents have the rows of `df` and no others; returns the version.

    `documents` (doc_id) names the documents that are replaced, by default those of `df`; one that is named and has no
    row is deleted. Only their buckets are read and written. One writer at a time: a commit that another writer made in
    the meantime is an error, and nothing is changed.
    """
    spark = df.sparkSession
    known = versions(spark, path)
    next_version = (known[-1] + 1) if known else 0
    new = cut(with_bucket(df, buckets), PACKED)
    named = (documents if documents is not None else df).select("doc_id").distinct()
    named = cut(with_bucket(named.unionByName(new.select("doc_id").distinct()).distinct(), buckets))
    touched = {r.doc_bucket for r in named.select("doc_bucket").distinct().collect()}  # at most `buckets`
    out, written = new, {}
    if known:
        written = _written(spark, path, known[-1])
        old = read_snapshot(spark, path, known[-1], touched)
        keep = with_bucket(old, buckets).join(named.select("doc_id"), "doc_id", "left_anti")
        out = keep.select(*new.columns).unionByName(new)
    data = f"{path}/data/v{next_version}"
    _dealt(out, len(touched)).write.mode("overwrite").partitionBy("doc_bucket").parquet(data, compression=PACKED)
    filled = {int(s.getPath().getName().split("=")[1]) for s in _children(spark, data) if s.getPath().getName().startswith("doc_bucket=")}
    written = {b: v for b, v in written.items() if b not in touched} | dict.fromkeys(filled, next_version)
    if next_version in versions(spark, path):
        raise RuntimeError(f"version {next_version} of {path} was committed by another writer")
    if not known:
        df.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")
    commit(spark, path, next_version, written)
    return next_version


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows brought together by bucket; a bucket of more than TASK_ROWS rows is written by several tasks, by the hash of its rows."""
    n = rows.count()
    parts = -(-n // (TASK_ROWS * max(1, buckets)))
    if parts <= 1:
        return rows.repartition("doc_bucket")
    kinds = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    return rows.repartition(n // TASK_ROWS + buckets, "doc_bucket", F.pmod(F.xxhash64(*kinds), F.lit(2 * parts)))


def _children(spark: SparkSession, path: str):
    target, files = _files(spark, path)
    return list(files.listStatus(target))


def commit(spark: SparkSession, path: str, version: int, written: dict[int, int]) -> None:
    """The last step of a version: its bucket list, then the success mark."""
    rows = spark.createDataFrame(sorted(written.items()), "doc_bucket int, written int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/_commits/v{version}")


def fold(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Forget all but the newest `keep` versions and delete the files that none of those needs; returns the deleted folders."""
    known = versions(spark, path)
    kept, gone = known[-keep:], known[:-keep]
    needed = {(b, v) for k in kept for b, v in _written(spark, path, k).items()}
    deleted = []
    for v in gone:
        target, files = _files(spark, f"{path}/_commits/v{v}/_SUCCESS")
        files.delete(target, False)
    for s in _children(spark, f"{path}/data"):
        v = int(s.getPath().getName()[1:])
        if v > known[-1]:
            continue  # a version that is being written
        for b in _children(spark, s.getPath().toString()):
            name = b.getPath().getName()
            if name.startswith("doc_bucket=") and (int(name.split("=")[1]), v) not in needed:
                target, files = _files(spark, b.getPath().toString())
                files.delete(target, True)
                deleted.append(b.getPath().toString())
    return deleted
