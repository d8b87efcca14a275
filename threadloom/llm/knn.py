"""The most similar vectors of every vector, by a hierarchical k-means tree with best-bin-first visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.vectors import Index, bin_rows, build_index, nearest_edges, search
from threadloom.session import Scratch

EDGE = "vset string, left_id long, right_id long, cos double"


def hot_copies(vectors: DataFrame, k: int) -> DataFrame:
    """``(vset, id, first)`` of rows beyond the k+1 smallest ids of a group of equal vectors, with the group's k smallest.

    Such a row's k nearest are those (cosine 1, ties to the smaller id), so it needs no search and nobody needs it.
    """
    narrow = vectors.select("vset", "id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(3), "vec").alias("h2"))
    group = ["vset", "h1", "h2"]
    big = narrow.groupBy(*group).count().where(F.col("count") > k + 1).drop("count")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
    some = narrow.join(big, group).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    first = some.groupBy(*group).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("first"), F.max("id").alias("last"))
    return narrow.join(first, group).where(F.col("id") > F.col("last")).select("vset", "id", "first")


def nearest(vectors: DataFrame, k: int, floor: float, scratch: Scratch, target: float = 0.995) -> tuple[DataFrame, Index]:
    """``(vset, left_id, right_id, cos)``: for each row its k nearest rows of cosine ``floor`` or more, ties to the
    smaller id; and the index with the recall measured.

    ``vectors`` is written first, as several passes read it. Fewer than k rows come out where fewer reach the floor; an
    empty table gives no rows.
    """
    vectors = scratch.save(vectors, "vectors")
    extra = scratch.save(hot_copies(vectors, k), "copies")
    searched = vectors
    if not extra.isEmpty():
        searched = scratch.save(vectors.join(extra, ["vset", "id"], "left_anti"), "distinct")
    index = build_index(searched, k, floor, target)
    found = search(bin_rows(searched, index), index.tasks, nearest_edges(k, floor), EDGE)
    once = found.repartition("vset", "left_id").groupBy("vset", "left_id", "right_id").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("vset", "left_id").orderBy(F.col("cos").desc(), "right_id"))
    best = once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    copies = extra.select("vset", F.col("id").alias("left_id"), F.explode("first").alias("right_id"), F.lit(1.0).alias("cos"))
    return best.unionByName(copies), index


def similar_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of which one is among the other's nearest, smaller id first."""
    ends = edges.select("vset", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "cos")
    return ends.groupBy("vset", "left_id", "right_id").agg(F.max("cos").alias("cos"))
