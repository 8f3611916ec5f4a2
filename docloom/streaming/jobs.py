"""Job events: batch views and Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.config import DEFAULT, Config
from docloom.functions.text import col, head
from docloom.plans.stage import exists

TERMINAL = ["completed", "failed"]
WAITING = ["queued", "uploaded"]


def stage_stem(stage) -> Column:
    """Stage name without its state, so starts and completions of a stage meet."""
    return F.regexp_replace(col(stage), "_(processing|completed)$", "")


def stage_durations(events: DataFrame, literal: bool = False) -> DataFrame:
    """Pairs starts with the completion or failure that closes the latest open one.

    Events carry job_id, event_id, stage, state (started, completed, failed) and ts. A job has
    few stages, so the window per job and stage is small.
    """
    stage = F.col("stage") if literal else stage_stem("stage")
    rows = events.withColumn("stem", stage)
    w = Window.partitionBy("job_id", "stem").orderBy("ts", "event_id")
    start = F.col("state") == "started"
    # a close takes the start right before it; starts followed by another start stay open
    prev_state, prev_ts = F.lag("state").over(w), F.lag("ts").over(w)
    next_state = F.lead("state").over(w)
    marked = rows.select("*", prev_state.alias("prev_state"), prev_ts.alias("prev_ts"), next_state.alias("next_state"))
    closed = marked.where(~start).select(
        "job_id", F.col("stem").alias("stage"), F.when(F.col("prev_state") == "started", F.col("prev_ts")).alias("started_at"),
        F.col("ts").alias("ended_at"), "state",
    )
    still_open = marked.where(start & (F.col("next_state").isNull() | (F.col("next_state") == "started"))).select(
        "job_id", F.col("stem").alias("stage"), F.col("ts").alias("started_at"), F.lit(None).cast(dict(events.dtypes)["ts"]).alias("ended_at"), F.lit("open").alias("state"),
    )
    out = closed.unionByName(still_open)
    span = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000
    return out.withColumn("seconds", span)


def job_state(events: DataFrame) -> DataFrame:
    """Current stage and distinct completed stages in the order of their first completion."""
    done = events.where(F.col("state") == "completed").groupBy("job_id", stage_stem("stage").alias("stem")).agg(F.min(F.struct("ts", "event_id")).alias("o"))
    listed = done.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "stem"))), lambda s: s["stem"]).alias("completed_stages"))
    now = events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "stage"))["stage"].alias("current_stage"))
    return now.join(listed, "job_id", "left")


def sweep_stale(docs: DataFrame, jobs: DataFrame, now, cfg: Config = DEFAULT, minutes: int | None = None) -> DataFrame:
    """Documents without progress: requeued once while waiting, failed otherwise."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes or cfg.stale_minutes))
    last = jobs.groupBy("doc_id").agg(F.max(F.struct("created_at", "job_id", "requeued"))["requeued"].alias("requeued"))
    stale = docs.where(~F.col("status").isin(TERMINAL) & (F.col("updated_at").cast("timestamp") < cutoff)).join(last, "doc_id", "left")
    waiting = F.col("status").isin(WAITING)
    again = waiting & ~F.coalesce("requeued", F.lit(False))
    reason = F.when(waiting, "queued job never picked up (re-enqueue already attempted)").otherwise(F.concat(F.lit("processing died mid-stage ("), "status", F.lit(")")))
    return stale.select("doc_id", "status", F.when(again, "requeue").otherwise("fail").alias("action"), F.when(~again, reason).alias("reason"))


def failure_events(errors: DataFrame, cfg: Config = DEFAULT, message_chars: int | None = None) -> DataFrame:
    """Retry or fail decision with a structured error per failed attempt (stage, retry_count, message)."""
    stage = F.col("stage")
    kind = (
        F.when(stage == "embedding_processing", "embedding_failure").when(stage == "chunking_processing", "chunking_failure")
        .when(stage == "parsing_processing", "parsing_failure").otherwise("intake_failure")
    )
    ok = F.col("retry_count") < cfg.max_retries
    return errors.select("job_id", F.when(ok, "retry").otherwise("fail").alias("action"), F.struct(
        kind.alias("error_type"), stage.alias("stage"), ok.alias("recoverable"), F.col("retry_count").alias("retry_count"), head("message", message_chars).alias("message")
    ).alias("error"))


def drop_cancelled(work: DataFrame, jobs: DataFrame) -> DataFrame:
    """Work whose job was cancelled stops at the stage boundary; `work` may be a stream."""
    gone = jobs.where(F.col("current_stage") == "cancelled").select("doc_id").distinct()
    return work.join(gone, "doc_id", "left_anti") if not work.isStreaming else work.join(
        gone.withColumn("__gone", F.lit(True)), "doc_id", "left").where(F.col("__gone").isNull()).drop("__gone")


def dedup_uploads(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First upload of every checksum inside the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["checksum"])


def activity_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily counts as tumbling windows; rows later than the watermark are left out."""
    w = F.window("ts", "1 day")
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(w).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "signup").alias("uploads"),
        F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"),
    ).select(F.col("window.start").alias("day"), "events", "uploads", "completed", "failed")


def threshold_stream(feedback: DataFrame, threshold: int = DEFAULT.finetune_threshold) -> DataFrame:
    """Running count of usable corrections per type with the alert flag; counts combine before the shuffle."""
    usable = feedback.where((F.col("rating") == "down") & (F.coalesce("correct_value", F.lit("")) != ""))
    return usable.groupBy("extraction_type").agg(F.count("*").alias("corrections")).withColumn("alert", F.col("corrections") >= threshold)


def threshold_alerts(feedback: DataFrame, threshold: int = DEFAULT.finetune_threshold) -> DataFrame:
    """One alert per type, at the correction that reaches the threshold; the count is kept as state of the type."""
    usable = feedback.where((F.col("rating") == "down") & (F.coalesce("correct_value", F.lit("")) != "") & F.col("extraction_type").isNotNull())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(b) for b in batches)
        state.update((now,))
        if before < threshold <= now:
            yield pd.DataFrame({"extraction_type": [key[0]], "corrections": [now]})

    return usable.select("extraction_type").groupBy("extraction_type").applyInPandasWithState(
        step, "extraction_type string, corrections bigint", "n bigint", "append", GroupStateTimeout.NoTimeout
    )


def stale_stream(events: DataFrame, delay: str = "5 minutes", cfg: Config = DEFAULT, minutes: int | None = None) -> DataFrame:
    """Documents that show no event (doc_id, status, ts) for some minutes of event time after one that did not end them.

    A document has its last status and whether it was requeued as state, and one timer. A waiting document is requeued
    at the first silence and its timer starts again; at the next silence it fails, whatever else came between. Others
    fail at once. An end forgets the document.
    """
    wait = (minutes or cfg.stale_minutes) * 60_000
    columns = ["doc_id", "status", "last_seen", "action", "reason"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at, requeued = state.get
            seen = pd.Timestamp(at, unit="ms")
            if status in WAITING and not requeued:
                state.update((status, at, True))
                state.setTimeoutTimestamp(max(at + 2 * wait, state.getCurrentWatermarkMs() + 1))
                yield pd.DataFrame([[key[0], status, seen, "requeue", None]], columns=columns)
            else:
                state.remove()
                reason = "queued job never picked up (re-enqueue already attempted)" if status in WAITING else f"processing died mid-stage ({status})"
                yield pd.DataFrame([[key[0], status, seen, "fail", reason]], columns=columns)
            return
        status, at, requeued = state.get if state.exists else (None, -1, False)
        for b in batches:
            last = b.sort_values("ts").iloc[-1]
            ms = int(last["ts"].timestamp() * 1000)
            if ms >= at:
                status, at = last["status"], ms
        if status in TERMINAL:
            if state.exists:
                state.remove()
            return
        state.update((status, at, requeued))
        state.setTimeoutTimestamp(max(at + wait, state.getCurrentWatermarkMs() + 1))

    watched = events.select("doc_id", "status", "ts").withWatermark("ts", delay)
    return watched.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id bigint, status string, last_seen timestamp, action string, reason string", "status string, at bigint, requeued boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


class StageLog(StatefulProcessor):
    """Open starts of one (job, stage): events wait until the watermark has passed them and are then taken in order."""

    def __init__(self, open_after: int):
        self.open_after = open_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, event_id bigint, state string")
        self.last = handle.getValueState("last", "ts bigint, state string, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(t.timestamp() * 1_000_000), int(e), s) for b in rows for t, e, s in zip(b["ts"], b["event_id"], b["state"])]
        self.waiting.appendList(new)
        for ts in {ts for ts, _, _ in new}:
            self.handle.registerTimer(ts // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else []:
            (ready if row[0] // 1000 < now else later).append(tuple(row))
        self.waiting.put(later) if later else self.waiting.clear()
        ts, state, told = self.last.get() if self.last.exists() else (None, None, False)
        out = []
        for at, _, new in sorted(ready, key=lambda r: r[:2]):
            if new == "started":
                if state == "started" and not told:
                    out.append((ts, None, "open"))
            else:
                out.append((ts if state == "started" else None, at, new))
            ts, state, told = at, new, False
        if state == "started" and not told:
            if ts // 1000 + self.open_after < now:
                out.append((ts, None, "open"))
                told = True
            else:
                self.handle.registerTimer(ts // 1000 + self.open_after + 1)
        if state is not None:
            self.last.update((ts, state, told))
        if out:
            moments = lambda k: pd.Series([None if r[k] is None else pd.Timestamp(r[k], unit="us") for r in out], dtype="datetime64[us]")
            started, ended = moments(0), moments(1)
            seconds = (ended - started).dt.total_seconds()
            yield pd.DataFrame({"job_id": key[0], "stage": key[1], "started_at": started, "ended_at": ended, "state": [r[2] for r in out], "seconds": seconds})

    def close(self) -> None:
        pass


def stage_durations_stream(events: DataFrame, delay: str = "10 minutes", open_after: str = "1 day", literal: bool = False) -> DataFrame:
    """`stage_durations` of a stream of events: each row as soon as the watermark has passed it, in whatever order they came.

    A start with no successor is told as open once, `open_after` later; if its end comes after that, the closed row
    with the same start replaces it. State is one open start per (job, stage) and the events the watermark has not
    passed. Needs the RocksDB state store, which this sets for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    days = pd.Timedelta(open_after)
    stage = F.col("stage") if literal else stage_stem("stage")
    rows = events.select("job_id", stage.alias("stage"), "event_id", "state", "ts").withWatermark("ts", delay)
    schema = f"job_id {dict(events.dtypes)['job_id']}, stage string, started_at timestamp, ended_at timestamp, state string, seconds double"
    return rows.groupBy("job_id", "stage").transformWithStateInPandas(StageLog(int(days.total_seconds() * 1000)), schema, "append", "EventTime")


def fold_versions(spark: SparkSession, path: str) -> DataFrame:
    """A table of versions and buckets as one snapshot row set: what `latest_table` reads, written under one version after all
    others, so that the older ones can go. Returns the versions that are no longer needed."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("version")).first()[0]
    merged = latest_table(spark, path)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={newest + 1}")
    return rows.where(F.col("version") <= newest).select("version").distinct()


def latest_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of a bucketed table as of a version: every bucket as its newest version wrote it."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"], "left_semi").drop("version")


def foreach_upsert(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str, buckets: int = 64):
    """Streaming upsert into a table of versions and buckets of the key.

    A micro-batch reads and rewrites only the buckets it touches, under a version of its own. The first batch of a new
    checkpoint continues after the versions that are there; the number it starts from is stored beside the checkpoint, so
    a replayed batch writes the same version from the same input again.
    """
    spark = stream.sparkSession
    marker = f"{checkpoint.rstrip('/')}-first-version"
    if not exists(spark, marker):
        last = spark.read.parquet(path).agg(F.max("version")).scalar() if exists(spark, path) else None
        first = spark.range(1).select(F.coalesce(last.cast("bigint") if last is not None else F.lit(None).cast("bigint"), F.lit(-1)).alias("v"))
        first.select((F.col("v") + 1).alias("v")).write.parquet(marker)
    first = spark.read.parquet(marker).first().v

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = first + batch_id
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        old = latest_table(batch.sparkSession, path, version)
        if old is not None:
            old = old.join(new.select("bucket").distinct(), "bucket", "left_semi").select(*batch.columns)
        out = merge(old, batch).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
