"""The corpus pipeline: from raw documents to training tokens.

Each stage takes the table its predecessor kept and returns what it keeps; run() writes every stage to the shared
folder and reads it back, so a lost executor repeats tasks of one stage only. Rows with null texts pass as empty
documents, a table without rows passes through all stages, and columns beside those of `documents` are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, line_dedup, near_copies, quality
from docloom.llm.common import fresh, prepared
from docloom.plans.stage import stage_root


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good and not toxic."""
    prepared(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across five or more of them."""
    prepared(spark)
    names = fresh(docs.columns, "_lines", "_dropped", "_kept")
    cleaned = line_dedup.index_documents(docs).apply(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")], names=tuple(names))
    made = {"text": F.col(names[2]), "n_chars": F.length(names[2]).cast("bigint")}
    return cleaned.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked by SimHash, checked by five-word shingle similarity of 0.8, and what similar ones it leaves apart."""
    prepared(spark)
    return near_copies.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    prepared(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, tokens and n_tokens of every document."""
    prepared(spark)
    encoded = bpe.encode_documents(docs, keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", "tokens", F.size("tokens").cast("bigint").alias("n_tokens"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

# trained models, XXH64 fingerprints and BPE are beyond SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{stage_root(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
