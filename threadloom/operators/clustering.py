"""Clusters of a similarity graph: components, bounded and refined variants, representatives, measures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.merge import numbered
from threadloom.session import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


#: Edges that one task takes at once.
LOCAL = 1_000_000


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's group."""
    up = np.arange(n)
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not ((two := up[up]) == up).all():
            up = two
    return up


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, roots) of the vertices that are not the smallest of their group."""
    vertex, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = _roots(len(vertex), code[: len(u)], code[len(u) :])
    low = np.flatnonzero(up != np.arange(len(up)))
    return vertex[low], vertex[up[low]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges, at most ``LOCAL`` at a time, as edges from each vertex to the smallest of its group."""
    us, vs, n = [], [], 0

    def flush() -> pa.RecordBatch:
        u, v = _joined(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        us.append(np.asarray(batch.column(0)))
        vs.append(np.asarray(batch.column(1)))
        n += batch.num_rows
        if n >= LOCAL:
            yield flush()
            us, vs, n = [], [], 0
    if n:
        yield flush()


def connected_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of every node, the component named by its smallest id; a node without edges is alone.

    Each partition first joins its own edges, which leaves one edge a vertex. If what is left fits a task, that is
    all; else alternating large-star and small-star rounds follow: every round is an aggregation and a join on the edge list, so a hub's
    links are never gathered, and the number of rounds grows with the logarithm of the graph. ``edges``: ``(left_id, right_id)``.
    Graphs may share ``scratch``, also at the same time: each call's tables have names of their own.
    """
    name = f"star-{uuid.uuid4().hex[:8]}"
    ends = edges.where("left_id <> right_id").select(F.greatest("left_id", "right_id").cast("long").alias("u"), F.least("left_id", "right_id").cast("long").alias("v"))
    now, left = scratch.counted(ends.mapInArrow(_local, "u long, v long"), f"{name}-0")
    if left <= LOCAL:
        now = now.coalesce(1).mapInArrow(_local, "u long, v long")
    else:
        before, step = None, 0
        while (state := _state(now)) != before:
            before = state
            both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            step += 1
            now = scratch.save(small.where("u <> v").distinct(), f"{name}-{step}")
            if step > 1:
                scratch.drop(f"{name}-{step - 2}")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


#: Edges that are looked at one by one before those that can no longer merge anything are dropped.
PORTION = 1 << 16


def _bounded(n: int, score: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The smallest place of each place's group; strongest edges first, two groups merge only if together they stay within ``most``.

    Groups only grow, so an edge inside a group or between two that are too large together is of no use any more.
    """
    order = np.lexsort((b, a, -score))
    a, b = a[order], b[order]
    parent, size, up = list(range(n)), [1] * n, np.arange(n)
    for start in range(0, len(a), PORTION):
        x, y = up[a[start : start + PORTION]], up[b[start : start + PORTION]]
        sizes = np.array(size)
        use = (x != y) & (sizes[x] + sizes[y] <= most)
        for i, j in zip(x[use].tolist(), y[use].tolist()):
            i, j = _find(parent, i), _find(parent, j)
            if i != j and size[i] + size[j] <= most:
                i, j = min(i, j), max(i, j)
                parent[j] = i
                size[i] += size[j]
        up = np.array(parent)
        while not ((two := up[up]) == up).all():
            up = two
    return up


def _refined(n: int, score: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, step: float) -> np.ndarray:
    """The smallest place of each place's group; groups above ``most`` are taken apart at thresholds that rise by ``step``, all of a level at once."""
    out, open_, level = np.arange(n), np.ones(n, bool), 0.0
    while open_.any() and level < 1.0:
        up = _roots(n, a, b)
        small = np.bincount(up[open_], minlength=n)[up] <= most
        out[open_ & small] = up[open_ & small]
        open_ &= ~small
        level += step
        kept = open_[a] & (up[a] == up[b]) & (score >= level)
        score, a, b = score[kept], a[kept], b[kept]
    return out


def _places(nodes: list[int], edges: list[tuple[float, int, int]]) -> tuple[np.ndarray, ...]:
    ids = np.unique(np.array(nodes, np.int64))
    score, a, b = (np.array([e[i] for e in edges], t) for i, t in enumerate((np.float64, np.int64, np.int64)))
    return ids, score, np.searchsorted(ids, a), np.searchsorted(ids, b)


def bounded(nodes: list[int], edges: list[tuple[float, int, int]], most: int) -> dict[int, int]:
    """Strongest edges first; two groups merge only if together they stay within ``most``."""
    ids, score, a, b = _places(nodes, edges)
    return dict(zip(ids.tolist(), ids[_bounded(len(ids), score, a, b, most)].tolist()))


def refined(nodes: list[int], edges: list[tuple[float, int, int]], most: int, step: float) -> dict[int, int]:
    """Groups above ``most`` are taken apart at thresholds that rise by ``step``; at 1 only single nodes are left."""
    ids, score, a, b = _places(nodes, edges)
    return dict(zip(ids.tolist(), ids[_refined(len(ids), score, a, b, most, step)].tolist()))


def resize(components: DataFrame, edges: DataFrame, mode: str, most: int, step: float) -> DataFrame:
    """``(id, component)`` with components above ``most`` taken apart by ``bounded`` or ``refined`` rules.

    The rules are sequential in one component, so only oversized ones go to Python, one component a group; their edges are
    linear in their members, as each has at most k neighbours. An edge takes 16 bytes there besides what its order takes; a
    member comes as an edge to itself.
    """
    sized = components.withColumn("n", F.count("*").over(Window.partitionBy("component")))
    big = sized.where(F.col("n") > most).select(F.col("component").alias("part"), F.col("id").alias("member"))
    links = edges.join(big, F.col("left_id") == F.col("member")).select("part", "left_id", "right_id", F.col("score").cast("double").alias("score"))
    rows = links.unionByName(big.select("part", F.col("member").alias("left_id"), F.col("member").alias("right_id"), F.lit(0.0).alias("score")))
    schema = "id long, component long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, lefts, rights, scores = [], [], [], []
        for batch in batches:
            a, b, score = (np.asarray(batch.column(c)) for c in ("left_id", "right_id", "score"))
            link = a != b
            for part, kept in ((members, a[~link]), (lefts, a[link]), (rights, b[link]), (scores, score[link])):
                part.append(kept)

        def whole(parts: list[np.ndarray]) -> np.ndarray:
            out = np.concatenate(parts)
            parts.clear()
            return out

        ids = np.unique(whole(members))
        score, a, b = whole(scores), np.searchsorted(ids, whole(lefts)).astype(np.int32), np.searchsorted(ids, whole(rights)).astype(np.int32)
        label = _bounded(len(ids), score, a, b, most) if mode == "bounded" else _refined(len(ids), score, a, b, most, step)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])

    large = rows.groupBy("part").applyInArrow(run, schema)
    return sized.where(F.col("n") <= most).select("id", "component").unionByName(large)


def representatives(components: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(component, representative_id, size)``: the member with most edges inside its component, ties to the smaller number.

    ``nodes``: ``(id, number)``.
    """
    a, b = components.select(F.col("id").alias("left_id"), "component"), components.select(F.col("id").alias("right_id"), F.col("component").alias("c2"))
    inner = edges.join(a, "left_id").join(b, "right_id").where(F.col("component") == F.col("c2"))
    degree = inner.select(F.explode(F.array("left_id", "right_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = components.join(degree, "id", "left").join(nodes, "id")
    return ranked.groupBy("component").agg(F.min_by("id", F.struct(-F.coalesce("degree", F.lit(0)), "number", "id")).alias("representative_id"), F.count("*").alias("size"))


def member_scores(components: DataFrame, reps: DataFrame, edges: DataFrame) -> DataFrame:
    """``(component, id, score_to_representative)``; null for the representative and without a direct edge."""
    m = components.join(reps.select("component", "representative_id"), "component")
    direct = edges.groupBy("left_id", "right_id").agg(F.max("score").alias("score_to_representative"))
    m = m.withColumn("left_id", F.least("id", "representative_id")).withColumn("right_id", F.greatest("id", "representative_id"))
    return m.join(direct, ["left_id", "right_id"], "left").select("component", "id", "score_to_representative")


def sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def quality(components: DataFrame) -> DataFrame:
    """Share of records in shared clusters, share of single clusters, mean and greatest size, and whether that is degenerate."""
    s = sizes(components)
    solo, multi = F.count_if(F.col("size") == 1), F.count_if(F.col("size") > 1)
    total = s.agg(F.sum("size").alias("threads"), F.count("*").alias("clusters"), solo.alias("solo"), multi.alias("multi"), F.max("size").alias("max_size"), F.avg(F.when(F.col("size") > 1, F.col("size"))).alias("avg_multi"))
    share = lambda a, b: F.round(F.col(a) * 100 / F.col(b), 2)
    solo_pct = F.col("solo") * 100 / F.col("clusters")
    return total.select(
        "threads", "clusters", "solo", "multi", "max_size", F.round((F.col("threads") - F.col("solo")) * 100 / F.col("threads"), 2).alias("multi_member_pct"), share("solo", "clusters").alias("solo_pct"),
        F.round("avg_multi", 2).alias("avg_multi_size"), ((solo_pct >= 95) | (F.col("max_size") > 500) | (F.col("multi") < 5)).alias("degenerate"),
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each cluster of ``a`` with the cluster of ``b`` that shares most of its members, ties to the larger, then the smaller id."""
    joined = a.select("id", F.col("component").alias("a")).join(b.select("id", F.col("component").alias("b")), "id").groupBy("a", "b").agg(F.count("*").alias("shared"))
    size = sizes(b).select(F.col("component").alias("b"), F.col("size").alias("b_size"))
    best = joined.join(size, "b").groupBy("a").agg(F.max_by(F.struct("b", "shared", "b_size"), F.struct("shared", "b_size", -F.col("b"))).alias("best"))
    return best.join(sizes(a).select(F.col("component").alias("a"), F.col("size").alias("a_size")), "a").select("a", "a_size", "best.*")


def stratified(s: DataFrame, each: int, seed: int) -> DataFrame:
    """``(stratum, component, size)``: the ``each`` largest clusters, and of the others as many from the middle (30 to 70 percent of
    the clusters by size) and as many small ones (3 or fewer), drawn by a seeded hash.

    What share of the clusters is larger is taken from the counts of the sizes, so no task orders all clusters.
    """
    histogram = s.groupBy("size").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1))  # one row for each size
    shares = histogram.withColumn("above", F.coalesce(above, F.lit(0))).join(F.broadcast(s.agg(F.count("*").alias("total"))))
    shares = shares.select("size", (F.col("above") / F.greatest(F.lit(1), F.col("total") - 1)).alias("share"))
    largest = s.orderBy(F.col("size").desc(), "component").limit(each)
    rest = s.join(largest.select("component"), "component", "left_anti").join(shares, "size")
    stratum = F.when(F.col("size") <= 3, "small").when(F.col("share").between(0.3, 0.7), "middle")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("component").cast("string")))
    chosen = F.row_number().over(Window.partitionBy("stratum").orderBy(draw, "component"))
    drawn = rest.withColumn("stratum", stratum).where("stratum is not null").withColumn("pick", chosen).where(F.col("pick") <= each)
    return largest.select(F.lit("large").alias("stratum"), "component", "size").unionByName(drawn.select("stratum", "component", "size"))


def ordered(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(component, size, place)``: clusters by size, ties to the one that has the smallest ``number``, then id; places from 1.
    """
    per = components.join(nodes.select("id", "number"), "id").groupBy("component").agg(F.count("*").alias("size"), F.min("number").alias("first"))
    return numbered(per, "place", 0, F.col("size").desc(), F.col("first"), F.col("component")).select("component", "size", "place")


def refine_one(components: DataFrame, vectors: DataFrame, nodes: DataFrame, rank: int, k: int, floor: float, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of the cluster at place ``rank`` by size, clustered again by its own neighbour graph. ``vectors``: ``(id, vec)``."""
    from threadloom.operators.edges import knn_edges

    chosen = scratch.save(components.join(ordered(components, nodes).where(F.col("place") == rank), "component", "left_semi"), "chosen")
    scoped = vectors.join(chosen.select("id"), "id", "left_semi").select(F.lit("refined").alias("scope"), "id", "vec")
    return connected_components(chosen, scratch.save(knn_edges(scoped, k, floor), "refined-edges"), scratch)
