"""Search documents, summary inputs and embedding tasks of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import EMBED_BASIS, EMBED_DIMENSIONS, EMBED_MODEL, PIPELINE_VERSION, PROMPT_VERSION
from threadloom.functions.text import estimated_tokens, filled, is_bot, names_of, squash, truncated


def human_comments(comments: DataFrame, keep_empty: bool) -> DataFrame:
    """``(thread_id, lines)``: what people wrote, in order; one list per thread."""
    human = comments.where(~is_bot(F.col("author_login"), F.col("author_type"), F.col("is_bot")))
    author = F.coalesce(F.concat(F.lit("@"), filled(F.col("author_login"))), F.lit("unknown"))
    text = squash(F.col("body"))
    if not keep_empty:
        human = human.where(text != "")
    line = F.struct(F.coalesce("created_at_gh", "updated_at_gh").alias("at"), "id", F.concat(author, F.lit(": "), text).alias("line"))
    return human.select("thread_id", line.alias("c")).groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["line"]).alias("lines"))


def canonical_documents(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """``(thread_id, title, body, raw_text, dedupe_text, content_hash)`` of every thread."""
    none = F.array().cast("array<string>")
    rows = threads.select(F.col("id").alias("thread_id"), squash(F.col("title")).alias("title"), squash(F.col("body")).alias("body"), F.array_join(names_of(F.col("labels_json"), "name"), ", ").alias("labels"))
    rows = rows.join(human_comments(comments, True), "thread_id", "left").withColumn("lines", F.coalesce("lines", none))
    labels = F.concat(F.lit("labels: "), filled(F.col("labels")))
    raw = F.concat_ws("\n\n", filled(F.col("title")), filled(F.col("body")), labels, F.col("lines"))
    talk = F.when(F.size("lines") > 0, F.concat(F.lit("discussion: "), F.array_join("lines", "\n")))
    dedupe = F.concat_ws("\n\n", F.concat(F.lit("title: "), "title"), F.concat(F.lit("body: "), filled(F.col("body"))), labels, talk)
    out = rows.select("thread_id", "title", "body", raw.alias("raw_text"), dedupe.alias("dedupe_text"))
    return out.withColumn("content_hash", F.sha2(F.concat("raw_text", F.lit("\n---\n"), "dedupe_text"), 256))


def summary_sources(threads: DataFrame, comments: DataFrame, with_comments: bool) -> DataFrame:
    """``(thread_id, summary_input, content_hash)``; comments that are empty are left out."""
    rows = threads.select(F.col("id").alias("thread_id"), squash(F.col("title")).alias("title"), squash(F.col("body")).alias("body"), F.array_join(names_of(F.col("labels_json"), "name"), ", ").alias("labels"))
    parts = [F.concat(F.lit("title: "), "title"), F.concat(F.lit("body: "), filled(F.col("body"))), F.concat(F.lit("labels: "), filled(F.col("labels")))]
    if with_comments:
        rows = rows.join(human_comments(comments, False), "thread_id", "left")
        parts.append(F.concat(F.lit("discussion:\n"), F.array_join("lines", "\n")))
    out = rows.select("thread_id", F.concat_ws("\n\n", *parts).alias("summary_input"))
    prefix = f"summary:{PROMPT_VERSION}:{'with-comments' if with_comments else 'metadata-only'}\n"
    return out.withColumn("content_hash", F.sha2(F.concat(F.lit(prefix), "summary_input"), 256))


def vector_tasks(threads: DataFrame, model: str = EMBED_MODEL, dimensions: int = EMBED_DIMENSIONS, basis: str = EMBED_BASIS) -> DataFrame:
    """``(thread_id, text, estimated_tokens, was_truncated, content_hash)``: what is to be embedded for each thread.

    The basis ``title_original`` takes title and body; ``title_summary`` takes the title and the column ``summary``, and
    leaves out threads whose summary is null or blank.
    """
    if basis not in ("title_original", "title_summary"):
        raise ValueError(f"no basis {basis}")
    title = F.concat(F.lit("title: "), squash(F.col("title")))
    if basis == "title_summary":
        threads = threads.where(squash(F.col("summary")) != "")
        second = F.concat(F.lit("summary: "), squash(F.col("summary")))
    else:
        second = F.concat(F.lit("body: "), filled(squash(F.col("body"))))
    rows = threads.select(F.col("id").alias("thread_id"), F.concat_ws("\n\n", title, second).alias("whole")).withColumn("text", truncated(F.col("whole")))
    prefix = f"embedding:{PIPELINE_VERSION}:{basis}:{model}:{dimensions}\n"
    return rows.select("thread_id", "text", estimated_tokens(F.col("text")).alias("estimated_tokens"), (F.col("text") != F.col("whole")).alias("was_truncated"), F.sha2(F.concat(F.lit(prefix), "text"), 256).alias("content_hash"))


def source_tasks(threads: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(thread_id, source_kind, text, content_hash)``: title, body and dedupe summary of each thread as texts of their own; empty ones are left out."""
    text = summaries.select(F.col("thread_id").alias("id"), "summary_text")
    rows = threads.select("id", "title", "body").join(text, "id", "left")
    parts = F.array(*(F.struct(F.lit(k).alias("source_kind"), squash(F.col(c)).alias("text")) for k, c in (("title", "title"), ("body", "body"), ("dedupe_summary", "summary_text"))))
    out = rows.select(F.col("id").alias("thread_id"), F.explode(parts).alias("p")).select("thread_id", "p.*").where("text <> ''").withColumn("text", truncated(F.col("text")))
    return out.withColumn("content_hash", F.sha2(F.concat(F.lit("embedding:"), "source_kind", F.lit("\n"), "text"), 256))


def pending(tasks: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Tasks without a stored row of the same content hash."""
    known = stored.select(*key, F.col("content_hash").alias("stored_hash"))
    return tasks.join(known, key, "left").where(~F.col("content_hash").eqNullSafe(F.col("stored_hash")))
