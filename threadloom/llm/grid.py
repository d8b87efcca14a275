"""Groups of directly or indirectly linked records, on a two-dimensional grid of edge partitions.

Vertices are hashed into ``side`` blocks and an edge belongs to the cell of its two blocks, so that even a vertex that has a third of
all edges spreads them over a whole row of cells. In a round each cell runs a local union-find and reports for each of its
vertices the lowest vertex of its local group; a vertex takes the lowest report of its row and column as parent, and
its other reports become the (far fewer) edges of the next round, between parents. When a round leaves no edges, the
parents are stable, and each vertex follows them to its root.

What is low is decided by a hash that changes with the round: by their ids, the vertices of a chain could pass a parent on
by one place in a round, while of randomly ranked ones a constant share goes in each. The grid has at least ``LEAST_SIDE`` blocks a side in
the first round and gets smaller with the edges.

Defined results: the group is named by its smallest vertex; edges with a null end and edges of a vertex with itself link
nothing; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

#: Edges that a cell should hold, about, and blocks of a side in the first round, at least.
CELL, LEAST_SIDE = 400_000, 4
#: Records beyond which a group's new label is broadcast, not joined; so at most one in so many records makes a label to broadcast.
HUB = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, roots): every vertex of the edges with the smallest vertex of its group.

    All edges hook the larger root under the smaller one together, then all paths are halved, until nothing moves.
    """
    vertex, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    parent = np.arange(len(vertex))
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return vertex, vertex[parent]


def _ranks(ids: np.ndarray, step: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)  # a bijection, so there are no ties


def _cell(step: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = np.asarray(table.column("a")), np.asarray(table.column("b"))
        vertex, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        rank = _ranks(vertex, step)
        order = np.argsort(rank)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        _, root = union_find(place[code[: len(a)]], place[code[len(a) :]])
        return pa.table({"vertex": vertex[order], "root": vertex[order[root]], "rank": rank[order[root]]})

    return run


def _round(edges: DataFrame, side: int, step: int) -> DataFrame:
    """``(vertex, parent, roots)`` after every cell has reported."""
    block = lambda c: F.pmod(F.xxhash64(F.lit(step), c), F.lit(side)).cast("int")
    x, y = block("a"), block("b")
    cells = edges.select(F.least(x, y).alias("row"), F.greatest(x, y).alias("col"), "a", "b")
    reports = cells.groupBy("row", "col").applyInArrow(_cell(step), "vertex long, root long, rank long")
    # a vertex has at most one report from each cell of its row and column, so the set is bounded by the grid's side
    return reports.groupBy("vertex").agg(F.min_by("root", "rank").alias("parent"), F.collect_set("root").alias("roots"))


def _relabelled(labels: DataFrame, names: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(vertex, parent)`` with each parent replaced by its own in ``names``, where it has one.

    The records of a group may be a third of all, so the labels of such groups are broadcast, and their records don't take part in the join.
    """
    large = labels.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("parent")
    new = names.select(F.col("vertex").alias("old"), F.col("parent").alias("new"))
    hot = F.broadcast(large.join(new, F.col("parent") == F.col("old"), "left").select(F.col("parent").alias("hub"), F.coalesce("new", "parent").alias("hot")))
    known = labels.join(hot, F.col("parent") == F.col("hub"), "left").drop("hub")
    key = known.withColumn("cold", F.col("hot").isNull()).withColumn("key", F.when(F.col("cold"), F.col("parent")).otherwise(F.col("vertex")))
    found = key.join(new.withColumn("cold", F.lit(True)).withColumnRenamed("old", "key"), ["key", "cold"], "left")
    return scratch.save(found.select("vertex", F.coalesce("hot", "new", "parent").alias("parent")), name)


def groups(edges: DataFrame, left: str, right: str, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """``(group_id, member_id)``, one row for each linked vertex; ids must be whole numbers."""
    tag = uuid.uuid4().hex[:8]
    ends = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now, n = scratch.counted(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges-{tag}-0")
    rounds: list[DataFrame] = []
    while n:
        step = len(rounds)
        side = int(max(LEAST_SIDE if not step else 1, np.ceil(np.sqrt(2 * n / cell))))
        found = scratch.save(_round(now, side, step), f"parents-{tag}-{step}")
        rounds.append(found.select("vertex", "parent"))
        links = found.where(F.size("roots") > 1).select(F.col("parent").alias("a"), F.explode("roots").alias("b")).where("a <> b")
        now, n = scratch.counted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges-{tag}-{step + 1}")
        scratch.drop(f"edges-{tag}-{step}")
    if not rounds:
        return now.select(F.col("a").alias("group_id"), F.col("b").alias("member_id"))
    labels = rounds.pop()
    while rounds:  # from the few parents of the last round to all vertices
        labels = _relabelled(rounds.pop(), labels, scratch, f"labels-{tag}-{len(rounds)}")
    least = labels.groupBy("parent").agg(F.min("vertex").alias("least")).select(F.col("parent").alias("vertex"), F.col("least").alias("parent"))
    return _relabelled(labels, least, scratch, f"named-{tag}").select(F.col("parent").alias("group_id"), F.col("vertex").alias("member_id"))
