"""Readers and writers: upload folders, page and result files, replace, upsert and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULT
from docloom.functions.text import col
from docloom.sources import folder
from docloom.sources.snapshots import replace_documents, with_bucket

# Accepted upload types and the size limit.
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
PAGE_SCHEMA = "doc_id bigint, page_number int, text string, method string, ocr_used boolean, quality double"
SPEC_ROW = (
    "struct<field_key:string,text:string,date:string,confidence:int,"
    "sources:array<struct<page:int,section:string,source_text:string,citation_verified:boolean>>>"
)
TOKENS = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
RESULT_SCHEMA = (
    "doc_id string, filename string, pipeline_status string, summary_status string, elapsed_seconds double, "
    "data struct<parsed:struct<parsing_quality_score:double,total_pages:int,ocr_pages:int,tables_count:int>,"
    f"insights:array<struct<extraction_type:string,token_usage:{TOKENS},payload:struct<items:array<string>>>>,"
    f"summary:struct<summary_json:struct<spec_check_fields:map<string,array<{SPEC_ROW}>>,"
    f"_meta:struct<model:string,prompt_version:string,token_usage:{TOKENS},missing_extraction_types:array<string>>>>>"
)
MANIFEST_SCHEMA = (
    "documents array<struct<id:string,enabled:boolean,expect:struct<required_field_keys:array<string>,min_row_count:int,"
    "min_avg_confidence:double,max_singleton_duplicates:int,labeled_fields:map<string,struct<match:string,values:array<string>>>>>>, thresholds map<string,double>"
)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def upload_verdict(path, size) -> Column:
    return (
        F.when(~extension(path).isin(list(MIME_TYPES)), "invalid_file_type").when(col(size) == 0, "empty_file")
        .when(col(size) > MAX_UPLOAD_BYTES, "file_too_large").otherwise("ok")
    )


def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of an upload folder with a verdict, empty and unreadable ones too; `head` holds the first bytes."""
    folder.register(spark)
    files = spark.read.format(folder.FORMAT).load(path)
    verdict = F.when(F.col("head").isNull() & (F.col("length") > 0), "unreadable_file").otherwise(upload_verdict("path", "length"))
    return files.select("path", "modificationTime", "length", "head", verdict.alias("verdict"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """The files with their whole content; the content is read only if selected, and empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length", "content", upload_verdict("path", "length").alias("verdict"))


def validate_mime(files: DataFrame) -> DataFrame:
    """Compares the extension with the first bytes of the content."""
    magic = F.substring("head" if "head" in files.columns else "content", 1, 4)
    kind = F.when(magic == F.lit(b"%PDF"), "pdf").when(magic == F.lit(b"PK\x03\x04"), "docx")
    mime = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return files.withColumns({
        "mime_type": F.try_element_at(mime, kind),
        "mime_verdict": F.when(kind.isNull(), "invalid_mime_type").when(kind != extension("path"), "mime_extension_mismatch").otherwise("ok"),
    })


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("pathGlobFilter", "doc_*.json").json(folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return m.select(F.explode("documents").alias("d"), "thresholds").select("d.*", "thresholds")


def result_insights(results: DataFrame) -> DataFrame:
    """(doc_id, extraction_type, n_items, prompt_tokens, completion_tokens) of stored result documents."""
    i = results.select("doc_id", F.explode("data.insights").alias("i"))
    return i.select(
        "doc_id", "i.extraction_type", F.when(F.col("i.payload.items").isNull(), 0).otherwise(F.size("i.payload.items")).alias("n_items"),
        "i.token_usage.prompt_tokens", "i.token_usage.completion_tokens",
    )


def replace_by_doc(df: DataFrame, path: str, buckets: int = DEFAULT.doc_buckets, documents: DataFrame | None = None) -> int:
    """Replace the rows of documents in a table of versions and document buckets, all at once or not at all; see `snapshots`."""
    return replace_documents(df, path, documents, buckets)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], counters: list[str] | None = None) -> DataFrame:
    """Target with updates applied by key; counter columns add up instead of being replaced."""
    if not counters:
        return target.join(updates, keys, "left_anti").unionByName(updates.select(*target.columns))
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias("t_" + c) for c in rest])
    u = updates.select(*keys, *[F.col(c).alias("u_" + c) for c in rest])
    j = t.join(u, keys, "full_outer")
    merged = [
        (F.coalesce("t_" + c, F.lit(0)) + F.coalesce("u_" + c, F.lit(0))).alias(c) if c in counters else F.coalesce("u_" + c, "t_" + c).alias(c)
        for c in rest
    ]
    return j.select(*keys, *merged)


def write_jsonl(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_export(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


def to_summary_json(spec: DataFrame, warnings: DataFrame) -> DataFrame:
    """Summary JSON of every document: rows per bucket in order, and its warnings."""
    row = F.struct("field_key", "text", "date", "confidence", "note", "page", "section", "source_text", "citation_verified")
    per_bucket = spec.groupBy("doc_id", "bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_seq", row.alias("r")))), lambda s: s["r"]).alias("rows")
    )
    fields = per_bucket.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "rows")))).alias("spec_check_fields"))
    w = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "field_key", "level", "message"))).alias("field_warnings"))
    return fields.join(w, "doc_id", "left").select("doc_id", F.to_json(F.struct("spec_check_fields", "field_warnings")).alias("summary_json"))


def write_results(results: DataFrame, path: str, buckets: int = DEFAULT.doc_buckets) -> None:
    with_bucket(results, buckets).write.mode("overwrite").partitionBy("doc_bucket").json(path)
