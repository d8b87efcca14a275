"""The current state of the corpus tables, from their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import CLUSTER_MIN_SCORE
from threadloom.operators.edges import canonical
from threadloom.operators.latest import latest
from threadloom.operators.vectors import usable_rows
from threadloom.sources.tables import table

MODEL = "trellis-embed-l"


def threads(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "threads").drop("raw_json"), ["id"], "updated_at", "content_hash")


def comments(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "comments").drop("raw_json"), ["id"], "updated_at_gh", "body")


def repositories(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "repositories"), ["id"], "updated_at", "raw_json")


def is_open() -> Column:
    return (F.col("state") == "open") & F.col("closed_at_local").isNull()


def is_closed() -> Column:
    return (F.col("state") != "open") | F.col("closed_at_local").isNotNull()


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """``(id, vec)``: the active vector of every thread that has a usable one."""
    stored = table(spark, root, "thread_vectors").where(F.col("model") == MODEL)
    rows = usable_rows(stored, ["thread_id", "updated_at"], "vector_json", "dimensions")
    return latest(rows, ["thread_id"], "updated_at", "vec").select(F.col("thread_id").alias("id"), "vec")


def source_vectors(spark: SparkSession, root: str) -> DataFrame:
    """``(source, id, vec)`` of the three kinds of source texts."""
    stored = table(spark, root, "document_embeddings").where(F.col("model") == MODEL)
    rows = usable_rows(stored, ["source_kind", "thread_id", "updated_at"], "embedding_json", "dimensions")
    return latest(rows, ["source_kind", "thread_id"], "updated_at", "vec").select(F.col("source_kind").alias("source"), F.col("thread_id").alias("id"), "vec")


def scoped(vecs: DataFrame, ts: DataFrame, *parts: str) -> DataFrame:
    """Vectors of open threads with their scope: the repository, and the source where there are several."""
    open_ = ts.where(is_open()).select("id", F.col("repo_id").cast("string").alias("repo"))
    return vecs.join(open_, "id").select(F.concat_ws("/", "repo", *parts).alias("scope"), "id", "vec")


def latest_runs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "similarity_edges").where("repo_id is not null").groupBy("repo_id").agg(F.max("cluster_run_id").alias("cluster_run_id"))


def stored_edges(spark: SparkSession, root: str, latest_only: bool = True) -> DataFrame:
    """``(repo_id, left_id, right_id, score)`` of the edges that count, of each repository's latest run or of all runs."""
    rows = table(spark, root, "similarity_edges").where((F.col("score") >= CLUSTER_MIN_SCORE) & (F.col("score") <= 1) & (F.col("left_thread_id") != F.col("right_thread_id")))
    if latest_only:
        rows = rows.join(latest_runs(spark, root), ["repo_id", "cluster_run_id"], "left_semi")
    return canonical(rows.where("repo_id is not null").select("repo_id", F.col("left_thread_id").alias("left_id"), F.col("right_thread_id").alias("right_id"), "score"), "repo_id")
