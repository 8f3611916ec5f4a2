"""Corpus intake: duplicates, tenders, versions, access, listings and restart planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed import ACTIVE_STAGES, INTEL_STAGES
from docloom.functions.text import WS, col, head, strip
from docloom.plans.scans import bucketed_row_number, latest


def sanitize_filename(c, limit: int | None = None) -> Column:
    base = F.element_at(F.split(col(c), r"[/\\]"), -1)
    clean = head(F.regexp_replace(base, r"[^A-Za-z0-9_.\-]", "_"), limit)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("document"))


def with_checksum(df: DataFrame, content: str, name: str = "checksum") -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(content), 256))


def flag_exact_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Verdict per upload (upload_id, checksum) against stored rows (doc_id, checksum, created_at).

    Both sides shrink to one row per checksum before they meet the uploads, so a content
    that was copied very often costs one row.
    """
    stored = existing.groupBy("checksum").agg(F.max(F.struct("created_at", "doc_id"))["doc_id"].alias("stored_id"))
    first = new.groupBy("checksum").agg(F.min("upload_id").alias("first_id"))
    known = first.join(stored, "checksum", "left")
    return new.join(known, "checksum").select(
        "upload_id", "checksum",
        F.when(F.col("stored_id").isNotNull(), "duplicate_of_stored")
        .when(F.col("first_id") < F.col("upload_id"), "duplicate_in_batch").otherwise("new").alias("verdict"),
        F.when(F.col("stored_id").isNotNull(), F.col("stored_id"))
        .when(F.col("first_id") < F.col("upload_id"), F.col("first_id")).alias("duplicate_of"),
    )


def normalize_reference(c, limit: int | None = None) -> Column:
    return head(F.regexp_replace(F.upper(strip(c)), WS + "+", "-"), limit)


def resolve_tenders(uploads: DataFrame, tenders: DataFrame, reference_chars: int | None = None) -> DataFrame:
    """Tender of every upload (upload_id, reference, title); unseen references become new tenders.

    Identifiers of new tenders derive from the reference, so a retried job finds the same ones.
    """
    auto = F.concat(F.lit("AUTO-"), F.upper(F.substring(F.sha2(F.col("upload_id").cast("string"), 256), 1, 10)))
    ref = F.when(strip(F.coalesce("reference", F.lit(""))) == "", auto).otherwise(normalize_reference("reference", reference_chars))
    u = uploads.select("upload_id", ref.alias("reference_code"), F.nullif(F.coalesce("title", F.lit("")), F.lit("")).alias("title"))
    t = tenders.select("reference_code", F.col("tender_id").alias("known_id"), F.col("title").alias("known_title"))
    # the title of a new tender is that of its first upload, else the reference itself
    firsts = u.groupBy("reference_code").agg(F.min(F.struct("upload_id", "title"))["title"].alias("first_title"))
    made = firsts.join(t, "reference_code", "left").select(
        "reference_code",
        F.coalesce("known_id", F.substring(F.sha2("reference_code", 256), 1, 16)).alias("tender_id"),
        F.when(F.col("known_id").isNotNull(), F.col("known_title"))
        .otherwise(F.coalesce("first_title", "reference_code")).alias("tender_title"),
        F.col("known_id").isNull().alias("created"),
    )
    return u.select("upload_id", "reference_code").join(made, "reference_code")


def version_label(vtype, seq) -> Column:
    t, s = col(vtype), col(seq)
    letter = F.when(s <= 26, F.chr(s + 64)).otherwise(s.cast("string"))
    word = (
        F.when(t == "original", "Version").when(t == "revision", "Revision").when(t == "corrigendum", "Corrigendum")
        .when(t == "addendum", "Addendum").when(t == "clarification", "Clarification").when(t == "annexure", "Annexure")
        .otherwise("Document")
    )
    return F.concat(word, F.lit(" "), F.when(t == "corrigendum", letter).otherwise(s.cast("string")))


def attach_versions(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """All versions after attaching uploads (tender_id, doc_id, version_type, label, arrived_at)."""
    top = versions.groupBy("tender_id").agg(F.max("version_sequence").alias("top"))
    day = F.datediff(F.col("arrived_at"), F.lit("1970-01-01")).cast("bigint")
    ranked = bucketed_row_number(
        uploads.withColumn("__day", day), ["tender_id"], "__day", [F.col("arrived_at"), F.col("doc_id")]
    )
    size = uploads.groupBy("tender_id").agg(F.count("*").alias("n"))
    seq = (F.coalesce("top", F.lit(0)) + F.col("rn")).cast("int")
    added = ranked.join(size, "tender_id").join(top, "tender_id", "left").select(
        "tender_id", "doc_id", "version_type", seq.alias("version_sequence"),
        F.coalesce(F.nullif(F.col("label"), F.lit("")), version_label("version_type", seq)).alias("version_label"),
        (F.col("rn") == F.col("n")).alias("is_current"),
    )
    kept = versions.join(size, "tender_id", "left").select(
        "tender_id", "doc_id", "version_type", "version_sequence", "version_label",
        (F.col("is_current") & F.col("n").isNull()).alias("is_current"),
    )
    return kept.unionByName(added)


def tender_summary(tenders: DataFrame, versions: DataFrame) -> DataFrame:
    agg = versions.groupBy("tender_id").agg(
        F.count("*").alias("version_count"),
        F.max(F.when(F.col("is_current"), F.struct("version_sequence", "version_label")))["version_label"].alias("current_version"),
    )
    return tenders.select("tender_id").join(agg, "tender_id", "left").select(
        "tender_id", F.coalesce("version_count", F.lit(0)).alias("version_count"), "current_version"
    )


def delete_documents(ids: DataFrame, tables: dict[str, DataFrame], tenders: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the given documents, and tenders without orphaned ones."""
    gone = ids.select("doc_id").distinct()
    out = {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}
    kept = versions.join(gone, "doc_id", "left_anti")
    touched = versions.join(gone, "doc_id", "left_semi").select("tender_id")
    orphan = touched.join(kept, "tender_id", "left_anti").distinct()
    out["versions"] = kept
    out["tenders"] = tenders.join(orphan, "tender_id", "left_anti")
    return out


def resolve_roles(users: DataFrame, admin_email: str) -> DataFrame:
    return users.withColumn(
        "resolved_role",
        F.when(F.lower(strip("email")) == admin_email.strip().lower(), "admin")
        .otherwise(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("user"))),
    )


def visible_documents(docs: DataFrame, user_id, is_management: bool) -> DataFrame:
    return docs if is_management else docs.where(F.col("uploaded_by") == F.lit(user_id))


def visible_tenders(tenders: DataFrame, versions: DataFrame, docs: DataFrame, user_id, is_management: bool) -> DataFrame:
    if is_management:
        return tenders
    own = versions.join(visible_documents(docs, user_id, False), "doc_id", "left_semi")
    return tenders.join(own, "tender_id", "left_semi")


def backfill_owner(docs: DataFrame, admin_id) -> DataFrame:
    return docs.withColumn("uploaded_by", F.coalesce("uploaded_by", F.lit(admin_id)))


def status_group(status) -> Column:
    s = col(status)
    return (
        F.when(s == "completed", "ready").when(s == "failed", "failed")
        .when((s == "queued") | s.isin(ACTIVE_STAGES), "processing").otherwise("other")
    )


def list_documents(docs: DataFrame, status: str = "all", query: str = "", page: int = 1, size: int = 25) -> DataFrame:
    """One page of documents, newest first, filtered by status group and a search text."""
    rows = docs if status == "all" else docs.where(status_group("status") == status)
    q = query.strip().lower()
    if q:
        fields = ["filename", "tender_title", "tender_reference", "version_label"]
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.lower(F.coalesce(f, F.lit(""))).contains(q)
        rows = rows.where(hit)
    return rows.orderBy(F.desc("created_at"), F.desc("doc_id")).offset((page - 1) * size).limit(size)


def dashboard_stats(docs: DataFrame) -> DataFrame:
    g = status_group("status")
    ref = F.nullif(F.col("tender_reference"), F.lit(""))
    return docs.agg(
        F.count("*").alias("total"), F.count_if(g == "ready").alias("completed"),
        F.count_if(g == "processing").alias("processing"), F.count_if(g == "failed").alias("failed"),
        F.count_distinct(ref).alias("tenders"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def progress_phase(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """User-facing phase and progress stage from document and current summary status."""
    current = latest(summaries.where("is_current").select("doc_id", "version", F.col("status").alias("summary_status")), ["doc_id"], ["version"])
    j = docs.select("doc_id", "status").join(current.select("doc_id", "summary_status"), "doc_id", "left")
    d, s = F.col("status"), F.col("summary_status")
    done = d == "completed"
    return j.select(
        "doc_id", "status", "summary_status",
        F.when((d == "failed") | (s == "failed"), "failed").when(done & (s == "completed"), "ready")
        .when((s == "processing") | done, "analyzing").otherwise("reading").alias("phase"),
        F.when(d.isin(INTEL_STAGES), d).when(done & (s == "completed"), "completed")
        .when(done, "parsing_completed").otherwise(d).alias("progress_stage"),
    )


def next_summary_version(summaries: DataFrame) -> DataFrame:
    """Rows after a regenerate request for every document: old ones retired, one new per document."""
    new = summaries.groupBy("doc_id").agg((F.max("version") + 1).cast("int").alias("version")).select(
        "doc_id", "version", F.lit("processing").alias("status"), F.lit(True).alias("is_current")
    )
    return summaries.select("doc_id", "version", "status", F.lit(False).alias("is_current")).unionByName(new)


def current_insights(insights: DataFrame, summaries: DataFrame) -> DataFrame:
    cur = summaries.where("is_current").select("doc_id", F.col("version").alias("summary_version"))
    return insights.join(cur, ["doc_id", "summary_version"], "left_semi")


def latest_job(jobs: DataFrame) -> DataFrame:
    return latest(jobs, ["doc_id"], ["created_at", "job_id"])


def plan_restart(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Where a document restarts: failed ones from chunking when parsed, waiting ones start."""
    ok = parsed.where(F.col("parsing_status") == "completed").select("doc_id").distinct().withColumn("parsed", F.lit(True))
    d = F.col("status")
    return docs.select("doc_id", "status").join(ok, "doc_id", "left").select(
        "doc_id", "status",
        F.when((d == "failed") & F.coalesce("parsed", F.lit(False)), "restart").when(d == "failed", "restart")
        .when(d.isin("queued", "uploaded"), "start").otherwise("reject").alias("action"),
        F.when((d == "failed") & F.coalesce("parsed", F.lit(False)), "chunking").when(d == "failed", "intake")
        .when(d.isin("queued", "uploaded"), "intake").alias("restart_stage"),
    )
