"""Experiments over clusterings: one configuration, a matrix of them, scores of judged outputs, exact against approximate edges."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import CLUSTER_MIN_SCORE, MAX_CLUSTER_SIZE, REFINE_STEP, Fusion
from threadloom.operators import clustering, edges
from threadloom.session import Scratch


@dataclass(frozen=True)
class Config:
    """A clustering to try: its sources, how they are fused, and how large clusters are taken apart (basic, bounded, refined)."""

    name: str
    sources: tuple[str, ...]
    fusion: str = "max"
    mode: str = "bounded"
    most: int = MAX_CLUSTER_SIZE
    step: float = REFINE_STEP


_SOURCES = ("title", "body", "dedupe_summary")
CONFIGS = (
    *(Config(f"all-{f}", _SOURCES, f) for f in ("max", "mean", "weighted", "min-of-2", "boost")),
    *(Config(s, (s,)) for s in _SOURCES),
    Config("all-basic", _SOURCES, "max", "basic"),
    Config("all-refined", _SOURCES, "max", "refined"),
)

#: Configurations that are worked on at once, as a large group is one task.
AT_ONCE = 3


def source_edges(vectors: DataFrame, k: int, floor: float = CLUSTER_MIN_SCORE) -> DataFrame:
    """``(source, left_id, right_id, score)``: exact neighbours inside each source of ``(source, thread_id, vec)``, whatever configuration reads them."""
    near = edges.nearest_neighbors(vectors.select(F.col("source").alias("scope"), F.col("thread_id").alias("id"), "vec"), k, floor)
    return edges.canonical(near, "scope").withColumnRenamed("scope", "source")


def joined(rows: DataFrame, per: DataFrame, config: Config, scratch: Scratch, floor: float = CLUSTER_MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(components, edges) of the ``(source, thread_id)`` and the source edges by a configuration's sources and fusion, before any are taken apart."""
    mine = F.col("source").isin(*config.sources)
    fused = scratch.save(edges.fuse(per.where(mine), floor, Fusion(config.fusion)), f"{config.name}-edges")
    nodes = rows.where(mine).select(F.col("thread_id").alias("id")).distinct()
    return scratch.save(clustering.connected_components(nodes, fused, scratch), f"{config.name}-components"), fused


def matrix(vectors: DataFrame, scratch: Scratch, configs: tuple[Config, ...] = CONFIGS, k: int = 6, floor: float = CLUSTER_MIN_SCORE) -> DataFrame:
    """One row a configuration: ``name, mode, fusion, n_edges`` and the measures of its clusters.

    The neighbours of a source are searched once for all configurations, and those with the same sources and fusion have their edges and components in common.
    Names of configurations differ.
    """
    vectors = scratch.save(vectors, "vectors")
    per, rows = scratch.save(source_edges(vectors, k, floor), "source-edges"), vectors.select("source", "thread_id")
    shared = {(c.sources, c.fusion): c for c in reversed(configs)}
    work = inheritable_thread_target(vectors.sparkSession)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        made = dict(zip(shared, pool.map(work(lambda c: joined(rows, per, c, scratch, floor)), shared.values())))

        def taken_apart(c: Config) -> DataFrame:
            comp, fused = made[c.sources, c.fusion]
            return comp if c.mode == "basic" else scratch.save(clustering.resize(comp, fused, c.mode, c.most, c.step), f"{c.name}-clusters")

        clusters = list(pool.map(work(taken_apart), configs))
    out = None
    for c, comp in zip(configs, clusters):
        fused = made[c.sources, c.fusion][1]
        row = clustering.quality(comp).join(F.broadcast(fused.agg(F.count("*").alias("n_edges"))))
        row = row.select(F.lit(c.name).alias("name"), F.lit(c.mode).alias("mode"), F.lit(c.fusion).alias("fusion"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def timed(work, *args) -> tuple[float, DataFrame]:
    """(seconds, result): how long an action over all rows takes."""
    start = time.perf_counter()
    found = work(*args)
    found.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, found


def compared(exact: DataFrame, approximate: DataFrame, exact_s: float, approximate_s: float) -> DataFrame:
    """Edges ``(left_id, right_id)`` of two backends: counts, recall, change in percent, and the speedup of their times."""
    key = ["left_id", "right_id"]
    both = exact.select(*key).distinct().withColumn("e", F.lit(1)).join(approximate.select(*key).distinct().withColumn("a", F.lit(1)), key, "full")
    n = both.agg(F.count("e").alias("exact_edges"), F.count("a").alias("approximate_edges"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("shared"))
    delta = F.round((F.col("approximate_edges") / F.nullif(F.col("exact_edges"), F.lit(0)) - 1) * 100, 2)
    return n.select("*", F.round(F.col("shared") / F.nullif(F.col("exact_edges"), F.lit(0)), 4).alias("recall"), delta.alias("change_pct"), F.lit(round(exact_s / approximate_s, 2) if approximate_s else None).cast("double").alias("speedup"))


def prompt_scores(judged: DataFrame) -> DataFrame:
    """``(variant, n, mean_score, boilerplate_pct, correct_pct)`` of judged outputs ``(variant, score, boilerplate, correct)``, the best first."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 2)
    return judged.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), share("boilerplate").alias("boilerplate_pct"), share("correct").alias("correct_pct")).orderBy(F.col("mean_score").desc(), "variant")
