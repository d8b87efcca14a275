"""Readers of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "repositories", "threads", "comments", "documents", "thread_vectors", "document_embeddings", "similarity_edges", "clusters",
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the folder ``root``; columns and filters are pushed into the Parquet scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
