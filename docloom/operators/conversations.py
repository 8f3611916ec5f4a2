"""Chat history, context blocks, request tables and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import UNCUT, Limits
from docloom.functions.text import col, first, head, ordered_join, strip, within
from docloom.operators.feedback import _text

NOT_FOUND = "This information was not found in the document."
MAX_MESSAGE = 8000


def history(messages: DataFrame, turns: int = 6) -> DataFrame:
    """Latest messages of each session without the current one, as one text block."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= turns * 2)
    said = recent.where((F.col("rn") > 1) & F.col("role").isin("user", "assistant"))
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    return said.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), ordered_join(F.collect_list(F.struct("turn", line.alias("text"))), "\n").alias("history")
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    page = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(
        F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string"))
    )
    block = F.concat(
        F.lit("[CHUNK_ID="), F.col("chunk_id"), F.lit(" | "), F.col("section_title"), F.lit(" | p."), page, F.lit(" | score="),
        F.col("score").cast("string"), F.lit("]\n"), F.col("chunk_text"),
    )
    return hits.groupBy("query_id").agg(ordered_join(F.collect_list(F.struct("rank", block.alias("text"))), "\n\n---\n\n").alias("context"))


def chat_requests(questions: DataFrame, contexts: DataFrame, histories: DataFrame) -> DataFrame:
    """Prompt per question (query_id, conv_id, text); unusable or unsupported questions say why."""
    q = strip(_text("text"))
    j = questions.join(contexts, "query_id", "left").join(histories.select("conv_id", "history"), "conv_id", "left")
    status = F.when(q == "", "empty_message").when(F.length(q) > MAX_MESSAGE, "message_too_long").when(F.col("context").isNull(), "refused").otherwise("ready")
    prior = F.when(_text("history") != "", F.concat(F.lit("PRIOR CONVERSATION:\n"), "history", F.lit("\n\n"))).otherwise("")
    prompt = F.concat(prior, F.lit("CONTEXT (document excerpts only):\n"), F.col("context"), F.lit("\n\nUSER QUESTION:\n"), q)
    return j.select("query_id", "conv_id", status.alias("status"), F.when(status == "ready", prompt).alias("prompt"),
                    F.when(status == "refused", NOT_FOUND).alias("answer"))


def finalize_answers(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """Answers without text or grounded citation are refused."""
    n = cites.groupBy("query_id").agg(F.count("*").alias("n_citations"))
    j = answers.join(n, "query_id", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    refused = F.coalesce("refused", F.lit(False)) | (strip(_text("answer")) == "") | (F.col("n_citations") == 0)
    return j.select("query_id", refused.alias("refused"), F.when(refused, NOT_FOUND).otherwise(strip("answer")).alias("answer"), "n_citations")


def clean_followups(questions, asked, limits: Limits = UNCUT) -> Column:
    """Usable follow-up questions: new and distinct, short and few where limits are given."""
    kept = F.filter(
        F.transform(col(questions), strip), lambda q: (q != "") & within(F.length(q), limits.followup_chars) & (F.lower(q) != F.lower(strip(col(asked))))
    )
    lows = F.transform(kept, F.lower)
    return first(F.filter(kept, lambda q, i: F.array_position(lows, F.lower(q)) == i + 1), limits.followups)


def latest_followups(messages: DataFrame) -> DataFrame:
    rows = messages.where(F.col("role") == "assistant")
    return rows.groupBy("conv_id").agg(F.max(F.struct("turn", "follow_ups"))["follow_ups"].alias("follow_ups"))


def session_titles(messages: DataFrame, limits: Limits = UNCUT) -> DataFrame:
    """Title from the first user message, with the time-order key of the session."""
    first = messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("t"))
    t = strip("t")
    return first.select("conv_id", F.concat(head(t, limits.session_title_chars), F.when(~within(F.length(t), limits.session_title_chars), "…").otherwise("")).alias("title"))
