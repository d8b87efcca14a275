"""What is still to be summarised and embedded, and whether what is stored was made as it would be made now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import EMBED_BASIS, EMBED_DIMENSIONS, EMBED_MODEL, PIPELINE_VERSION, PROMPT_VERSION
from threadloom.functions.text import squash
from threadloom.operators.documents import vector_tasks

STAMPS = ("summary_model", "summary_prompt_version", "embedding_basis", "embed_model", "embed_dimensions", "embed_pipeline_version", "vector_backend")


def pending_summaries(sources: DataFrame, stored: DataFrame, prompt: str = PROMPT_VERSION) -> DataFrame:
    """``sources`` ``(thread_id, summary_input, content_hash)`` whose stored summary ``(thread_id, content_hash, prompt_version)`` is
    missing, or was made of other content or by another prompt."""
    known = stored.select("thread_id", F.col("content_hash").alias("__hash"), F.col("prompt_version").alias("__prompt"))
    same = F.col("content_hash").eqNullSafe(F.col("__hash")) & F.col("__prompt").eqNullSafe(F.lit(prompt))
    return sources.join(known, "thread_id", "left").where(~F.coalesce(same, F.lit(False))).select(*sources.columns)


def workset(threads: DataFrame, summaries: DataFrame | None, stored: DataFrame, basis: str = EMBED_BASIS, current: bool = True, model: str = EMBED_MODEL, dimensions: int = EMBED_DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(tasks, missing): what is to be embedded of the open ``threads``, and ``(thread_id, number)`` of those that have no summary to embed.

    ``summaries``: ``(thread_id, summary_text)``, needed by the basis ``title_summary``; one that is blank counts as missing.
    ``stored``: ``(thread_id, content_hash)``; unless the state is ``current``, everything is embedded again.
    """
    missing = threads.select(F.col("id").alias("thread_id"), "number").limit(0)
    rows = threads
    if basis == "title_summary":
        if summaries is None:
            raise ValueError("the basis title_summary needs summaries")
        text = summaries.select(F.col("thread_id").alias("id"), squash(F.col("summary_text")).alias("summary")).where("summary <> ''")
        rows = threads.join(text, "id", "left")
        missing = rows.where("summary is null").select(F.col("id").alias("thread_id"), "number")
        rows = rows.where("summary is not null")
    tasks = vector_tasks(rows, model, dimensions, basis)
    if current:
        known = stored.select("thread_id", F.col("content_hash").alias("__hash"))
        tasks = tasks.join(known, "thread_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("__hash"))).drop("__hash")
    return tasks, missing


def require_summaries(missing: DataFrame) -> None:
    """Raise if a thread has no summary; the message names the first ten numbers."""
    first = [str(r["number"]) for r in missing.select("number").orderBy("number").limit(11).collect()]
    if first:
        raise ValueError(f"threads without a summary: {', '.join(first[:10])}{'…' if len(first) > 10 else ''}")


def active_vectors(vectors: DataFrame, open_threads: DataFrame) -> DataFrame:
    """Vectors of open threads; the others are dropped from the store."""
    return vectors.join(open_threads.select(F.col("id").alias("thread_id")), "thread_id", "left_semi").select(*vectors.columns)


def without_repository(vectors: DataFrame, threads: DataFrame, repo_id: int) -> DataFrame:
    """All vectors but those of one repository's threads, for a reset."""
    mine = threads.where(F.col("repo_id") == repo_id).select(F.col("id").alias("thread_id"))
    return vectors.join(mine, "thread_id", "left_anti").select(*vectors.columns)


def desired_stamps(summary_model: str = "", basis: str = EMBED_BASIS, backend: str = "exact", model: str = EMBED_MODEL, dimensions: int = EMBED_DIMENSIONS) -> dict[str, str | int]:
    return dict(zip(STAMPS, (summary_model, PROMPT_VERSION, basis, model, dimensions, PIPELINE_VERSION, backend)))


def currency(state: DataFrame, stamps: dict[str, str | int]) -> DataFrame:
    """``(repo_id, vectors_current, clusters_current)``: marked as current, and made with the seven ``stamps`` that are wanted now."""
    same = F.lit(True)
    for name in STAMPS:
        same = same & F.col(name).eqNullSafe(F.lit(stamps[name]))
    vectors = same & F.col("vectors_current_at").isNotNull()
    return state.select("repo_id", vectors.alias("vectors_current"), (vectors & F.col("clusters_current_at").isNotNull()).alias("clusters_current"))
