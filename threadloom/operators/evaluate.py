"""Evaluation: synthetic vectors with known clusters, comparison of clusterings, aggregation of judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def synthetic_vectors(spark: SparkSession, clusters: int, members: int, width: int = 4, noise: int = 32, sources: tuple[str, ...] = ("title", "body", "dedupe_summary")) -> DataFrame:
    """``(source, id, cluster, vec)`` with one block of dimensions per cluster, one slot per source, and small noise.

    Fixed values: the weights inside a block, the source's slot, and the constants of the noise.
    """
    rows = spark.range(clusters * members * len(sources)).select(
        (F.col("id") % len(sources)).cast("int").alias("s"), F.floor(F.col("id") / len(sources)).alias("t"), F.floor(F.col("id") / (len(sources) * members)).cast("int").alias("c"),
    ).withColumn("o", (F.col("t") % members).cast("int"))
    sb, mb = (F.col("s") + 1) * 0.02, (F.col("o") % 5 + 1) * 0.01
    inside = {0: F.lit(1.0), 1: 0.72 + sb, 2: 0.48 + mb, 3: 0.28 + sb + mb}
    base, slot = F.col("c") * width, clusters * width + F.col("s")

    def at(i):
        place = i - base
        value = F.when(i == slot, 0.12 + sb).otherwise(0.0)
        for k, v in inside.items():
            value = F.when(place == k, v).otherwise(value)
        seed = F.col("c") * 10000 + F.col("o") * 100 + F.col("s") * 10 + (i - clusters * width - len(sources))
        jitter = (((seed * 1664525) % 2**32 + 1013904223) % 2**32 / 4294967295.0 - 0.5) * 0.025
        return F.when(i >= clusters * width + len(sources), jitter).otherwise(value)

    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(clusters * width + len(sources) + noise - 1).cast("long")), at)
    return rows.select(F.element_at(F.array(*map(F.lit, sources)), F.col("s") + 1).alias("source"), (F.col("t") + 1).alias("id"), F.col("c").alias("cluster"), vec.alias("vec"))


def compare_sizes(a: DataFrame, b: DataFrame, overflow: int = 0) -> DataFrame:
    """``(size, left_clusters, right_clusters, delta)`` of two clusterings ``(component, size)``; sizes from ``overflow`` on together."""
    size = F.least(F.col("size"), F.lit(overflow)) if overflow else F.col("size")
    count = lambda d, name: d.groupBy(size.alias("size")).agg(F.count("*").alias(name))
    both = count(a, "left_clusters").join(count(b, "right_clusters"), "size", "full")
    left, right = F.coalesce("left_clusters", F.lit(0)), F.coalesce("right_clusters", F.lit(0))
    return both.select("size", left.alias("left_clusters"), right.alias("right_clusters"), (right - left).alias("delta"))


def display_sample(members: DataFrame, group: str, order: str, first: int = 10, middle: int = 10, last: int = 5, most: int = 25) -> DataFrame:
    """All members of groups up to ``most``; of larger ones the first, some at even steps between, and the last."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    size = F.count("*").over(Window.partitionBy(group))
    ranked = members.withColumn("place", place).withColumn("group_size", size)
    step = F.greatest(F.lit(1), F.floor((F.col("group_size") - first - last) / middle))
    even = (F.col("place") >= first) & (F.col("place") < first + step * middle) & ((F.col("place") - first) % step == 0)
    return ranked.where((F.col("group_size") <= most) | (F.col("place") < first) | (F.col("place") >= F.col("group_size") - last) | even)


def judged(judgements: DataFrame) -> DataFrame:
    """Per bucket and over all: clusters, mean coherence, topics, outliers of the members. ``(bucket, coherence, topic, members, outliers)``."""
    return judgements.groupingSets([["bucket"], []], "bucket").agg(
        F.count("*").alias("clusters"), F.avg("coherence").alias("coherence"), F.countDistinct("topic").alias("topics"), (F.sum("outliers") / F.sum("members")).alias("outlier_rate")
    )


def regression(timings: DataFrame, baseline_ms: float) -> DataFrame:
    """Median of the samples' ``ms`` and its change against a baseline in percent."""
    return timings.agg(F.median("ms").alias("median_ms")).withColumn("change_pct", F.round((F.col("median_ms") / baseline_ms - 1) * 100, 2))


def projected(ms: float, threads: int, target: int) -> float:
    """The time of ``target`` threads at the rate measured."""
    return round(ms / threads * target, 1) if threads else 0.0
