"""Clusters of mutually similar vectors by parallel pivot correlation clustering.

The similarity graph comes from the tree search. Every vertex has a hash rank; in a round each vertex whose rank is smallest
among its active neighbours is a pivot and absorbs them, an absorbed vertex going to its closest pivot; the rest goes on to
the next round. Then members move to the closest pivot that they are similar to at all, and each cluster's medoid is
computed anew. The search may miss a pair of a row and a pivot; where an edge leads from the row into the pivot's cluster, the
two are compared, and pivots found to be similar to each other make way by the same rule.

The graph stays linear in dense regions: a row that has more than ``DENSE`` similar rows in a meeting of the search keeps
its neighbour of smallest rank, which decides about pivots, and its ``DENSE`` nearest. Rows that lost a pair that way are
searched again in each round, for their smallest active neighbour and for pivots similar to them, and at the end for their
closest pivot; so the outcome is that of all pairs that meet. Equal vectors are one vertex with a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.arrow import binary, groups, matrix
from threadloom.llm import grid
from threadloom.llm.vectors import bin_rows, build_index, search
from threadloom.session import Scratch

DENSE = 64
#: Members of a group that one task holds, at most.
HELD = 4096
#: ``lost``: 1 if the left row has pairs of the meeting left out, 2 if the right one, 3 if both.
EDGE = "vset string, left_id long, right_id long, cos double, lost byte"
LINK = "u long, v long, cos double"
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rank(ids: np.ndarray) -> np.ndarray:
    """``xxhash64(5, id)`` as Spark computes it, so that the search and the rounds order vertices alike."""
    p1, p2, p3, p4, p5 = _PRIMES

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    five = np.full(1, 5, np.uint64)
    seed = mixed(turned((np.full(1, 42, np.uint64) + p5 + np.uint64(4)) ^ (five * p1), 23) * p2 + p3)
    key = turned(np.asarray(ids, np.int64).view(np.uint64) * p2, 31) * p1
    return mixed(turned((seed + p5 + np.uint64(8)) ^ key, 27) * p1 + p4).view(np.int64)


def _rank_column(c: str):
    """A vertex's rank in the pivot rounds: a hash, ties to the smaller id."""
    return F.struct(F.xxhash64(F.lit(5), F.col(c)).alias("rank"), F.col(c).alias("id"))


def _bridges(a: np.ndarray, b: np.ndarray, keep: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``out``, fewer than 4 for each row, that link all which it links beyond the pairs of ``keep``."""
    vertex, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = code[: len(a)], code[len(a) :]
    i, j = np.nonzero(keep)
    label = np.arange(len(vertex))

    def link(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal label
        at, root = grid.union_find(u, v)
        up = np.arange(len(vertex))
        up[at] = root
        label = up[label]

    link(ca[i], cb[j])
    i, j = np.nonzero(out & (label[ca][:, None] != label[cb][None, :]))
    rows, cols = [], []
    while len(i):
        la, lb = label[ca[i]], label[cb[j]]
        at = np.unique(np.concatenate([np.unique(la, return_index=True)[1], np.unique(lb, return_index=True)[1]]))
        rows.append(i[at])
        cols.append(j[at])
        link(la[at], lb[at])
        open_ = label[ca[i]] != label[cb[j]]
        i, j = i[open_], j[open_]
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (i, j)


def similar_edges(floor: float, dense: int = DENSE):
    """Emitter of the similar pairs of a meeting, linear in its rows: about ``dense`` for each, and what else it takes that
    the pairs kept link the same rows, directly or through others, as all pairs do.

    A pair is left out only if both rows have more than ``dense``; a row with such pairs is marked in each pair that it keeps.
    """

    def thinned(hit: np.ndarray, s: np.ndarray, rank: np.ndarray) -> np.ndarray:
        keep = hit
        for i in np.flatnonzero(hit.sum(1) > dense):
            if keep is hit:
                keep = hit.copy()
            at = np.flatnonzero(hit[i])
            keep[i] = False
            keep[i, at[np.argpartition(-s[i, at], dense - 1)[:dense]]] = True
            keep[i, at[np.argmin(rank[at])]] = True
        return keep

    def emit(vset, a, b, s, same):
        hit = s >= floor
        hit &= a[:, None] != b[None, :]
        if not hit.any():
            return None
        keep = thinned(hit, s, _rank(b))
        if not same:
            keep = keep | thinned(hit.T, s.T, _rank(a)).T
        out = hit & ~keep
        if out.any():
            i, j = _bridges(a, b, keep, out)
            keep[i, j] = True
            out[i, j] = False
        i, j = np.nonzero(keep)
        lost_a = out.any(1)[i]
        lost_b = np.zeros(len(j), bool) if same else out.any(0)[j]  # of the members, each is a row of its own once
        first = a[i] < b[j]
        left, right = np.where(first, a[i], b[j]), np.where(first, b[j], a[i])
        lost = np.where(first, lost_a, lost_b) + 2 * np.where(first, lost_b, lost_a)
        return [pa.array([vset] * len(i), pa.string()), pa.array(left), pa.array(right), pa.array(s[i, j].astype(np.float64)), pa.array(lost.astype(np.int8))]

    return emit


def _linked(floor: float, pick):
    """Emitter of one pair at most for each row of a meeting: ``pick(hit, s, p, q)`` gives rows and partners. Rows are (id, tag)."""

    def emit(vset, a, b, s, same):
        hit = s >= floor
        hit &= a[:, :1] != b[None, :, 0]
        if not hit.any():
            return None
        u, v, cos = [], [], []
        for h, m, p, q in [(hit, s, a, b)] + ([] if same else [(hit.T, s.T, b, a)]):
            i, j = pick(h, m, p, q)
            u.append(p[i, 0])
            v.append(q[j, 0])
            cos.append(m[i, j].astype(np.float64))
        return [pa.array(np.concatenate(c)) for c in (u, v, cos)]

    return emit


def _smallest(hit, s, p, q):
    """Each row's partner of smallest rank."""
    order = np.argsort(_rank(np.ascontiguousarray(q[:, 0])))
    i = np.flatnonzero(hit.any(1))
    return i, order[np.argmax(hit[i][:, order], axis=1)] if len(i) else i


def _closest(hit, s, p, q):
    """The closest pivot (tag 1) of each other row."""
    rows, cols = np.flatnonzero(p[:, 1] == 0), np.flatnonzero(q[:, 1] == 1)
    if not len(rows) or not len(cols):
        return rows[:0], cols[:0]
    cos = np.where(hit[np.ix_(rows, cols)], s[np.ix_(rows, cols)], np.float32(-2))
    best = np.argmax(cos, axis=1)
    ok = cos[np.arange(len(rows)), best] > -2
    return rows[ok], cols[best[ok]]


def copies_of(vectors: DataFrame) -> DataFrame:
    """``(id, member)`` of the groups of equal vectors: the smallest id and each of the others."""
    narrow = vectors.select("vset", "id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(3), "vec").alias("h2"))
    least = narrow.groupBy("vset", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return narrow.join(least, ["vset", "h1", "h2"]).where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("member"))


def _both(edges: DataFrame) -> DataFrame:
    """``(u, v, cos)``: each edge from either end."""
    ends = F.array(F.struct(F.col("left_id").alias("u"), F.col("right_id").alias("v"), "cos"), F.struct(F.col("right_id").alias("u"), F.col("left_id").alias("v"), "cos"))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _tagged(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    return rows.join(pivots, F.col("id") == F.col("p"), "left").select("vset", "id", "vec", F.col("p").isNotNull().cast("long").alias("tag"))


def pivot_rounds(every: DataFrame, scratch: Scratch, name: str, lossy: DataFrame | None = None, again: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``(p)``, the pivots of the graph ``every``: ``(u, v)``, each edge from either end, a written table.

    ``lossy``: ``(vset, id, vec)`` of the vertices of which edges are missing; all that is missing links two of them.
    ``again(rows, pick)`` searches among such rows with a tag and gives ``(u, v, cos)``: each row's active neighbour of
    smallest rank (``smallest``), or its closest pivot (``closest``).
    """
    now, pivots, step, active = every.select("u", "v"), None, 0, lossy
    while True:
        ahead = now
        if active is not None and step:  # at first all are active, and the edges hold the smallest neighbour
            ahead = ahead.unionAll(again(active.withColumn("tag", F.lit(0).cast("long")), "smallest").select("u", "v"))
        low = ahead.groupBy("u").agg(F.min(_rank_column("v")).alias("low"))
        chosen, n = scratch.counted(low.where(_rank_column("u") < F.col("low")).select(F.col("u").alias("p")), f"{name}-pivots-{step}")
        pivots = chosen if pivots is None else pivots.unionAll(chosen)
        if not n:
            return pivots
        gone = now.join(chosen, F.col("v") == F.col("p"), "left_semi").select(F.col("u").alias("p")).unionAll(chosen)
        if active is not None:
            gone = gone.unionAll(again(_tagged(active, chosen), "closest").select(F.col("u").alias("p")))
        gone = scratch.save(gone.distinct(), f"{name}-gone-{step}")
        rest = now.join(gone, F.col("u") == F.col("p"), "left_anti").join(gone, F.col("v") == F.col("p"), "left_anti")
        now = scratch.save(rest, f"{name}-edges-{step + 1}")
        if active is not None:
            active, n = scratch.counted(active.join(gone, F.col("id") == F.col("p"), "left_anti"), f"{name}-active-{step + 1}")
            active = active if n else None
        scratch.drop(f"{name}-gone-{step}")
        if step:
            scratch.drop(f"{name}-edges-{step}")
        step += 1


def _joined(every: DataFrame, pivots: DataFrame, more: list[DataFrame]) -> DataFrame:
    """``(id, pivot)``: every vertex with the closest pivot that it has an edge to, by ``every`` or ``more``; one without any is alone."""
    pairs = every.select("u", "v", "cos")
    for extra in more:
        pairs = pairs.unionAll(extra)
    near = pairs.join(pivots, F.col("v") == F.col("p"), "left_semi").groupBy("u").agg(F.max_by("v", F.struct("cos", -F.col("v"))).alias("pivot"))
    own = pivots.select(F.col("p").alias("id"), F.col("p").alias("pivot"))
    moved = near.join(pivots, F.col("u") == F.col("p"), "left_anti").select(F.col("u").alias("id"), "pivot")
    assigned = own.unionAll(moved)
    return assigned.unionAll(every.select(F.col("u").alias("id")).distinct().join(assigned, "id", "left_anti").select("id", F.col("id").alias("pivot")))


def _cosines(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = (matrix(b.column(2), np.dtype("<f4")).astype(np.float64) * matrix(b.column(3), np.dtype("<f4"))).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos)], names=["u", "v", "cos"]).filter(pa.array(cos >= floor))

    return run


def compared(pairs: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """The ``pairs`` ``(u, v)`` whose exact cosine is ``floor`` or more, with it."""
    x, y = vectors.select(F.col("id").alias("u"), F.col("vec").alias("x")), vectors.select(F.col("id").alias("v"), F.col("vec").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_cosines(floor), LINK)


def missed_pivots(assigned: DataFrame, edges: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """``(u, v, cos)``: rows and pivots that are similar, of those that an edge between two clusters brings near: either end
    and the other's pivot, and both pivots, which the search may not have held against each other. Linear in such edges.
    """
    left, right = assigned.select(F.col("id").alias("left_id"), F.col("pivot").alias("a")), assigned.select(F.col("id").alias("right_id"), F.col("pivot").alias("b"))
    across = edges.select("left_id", "right_id").join(left, "left_id").join(right, "right_id").where("a <> b")
    ends = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("left_id", "b"), ("right_id", "a"), ("a", "b"))))
    return compared(across.select(F.explode(ends).alias("e")).select("e.*").distinct(), vectors, floor)


def _held_rows(floor: float):
    """Per group held whole: each member's mean cosine to the others, and whether all pairs reach ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), parts in groups(batches, 1):
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, w, x = np.asarray(table.column("id")), np.asarray(table.column("weight")).astype(float), matrix(table.column("vec"), np.dtype("<f4")).astype(np.float64)
            mean = (x @ (x * w[:, None]).sum(0) - 1) / max(1.0, w.sum() - 1)
            tight = all(float((x[s : s + 512] @ x.T).min()) >= floor for s in range(0, len(x), 512))
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(ids), pa.int64()), pa.array(ids), pa.array(w.astype(np.int64)), pa.array(mean), pa.array([tight] * len(ids))], names=["group_id", "id", "weight", "mean", "tight"])

    return run


_MEASURED = "group_id long, id long, weight long, mean double, tight boolean"


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sum of the vectors of each (group, salt)."""
    for (group, _), parts in groups(batches, 2):
        table = pa.Table.from_batches(parts).combine_chunks()
        w, x = np.asarray(table.column("weight")).astype(float), matrix(table.column("vec"), np.dtype("<f4")).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), binary((x * w[:, None]).sum(0)[None, :]), pa.array([w.sum()])], names=["group_id", "total", "w"])


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (group,), parts in groups(batches, 1):
        table = pa.Table.from_batches(parts).combine_chunks()
        total = matrix(table.column("total"), np.dtype("<f8")).sum(0)[None, :]
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), binary(total), pa.array([float(np.asarray(table.column("w")).sum())])], names=["group_id", "total", "w"])


def _mean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, total = matrix(b.column(3), np.dtype("<f4")).astype(np.float64), matrix(b.column(4), np.dtype("<f8"))
            mean = ((x * total).sum(1) - 1) / np.maximum(1.0, np.asarray(b.column(5)) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mean), b.column(3)], names=["group_id", "id", "weight", "mean", "vec"])


def _tight_cell(floor: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, side = matrix(table.column("vec"), np.dtype("<f4")), np.asarray(table.column("block"))
        row, col = np.asarray(table.column("row")), np.asarray(table.column("col"))
        a, b = x[side == row], x[side == col]
        low = min((float((a[s : s + 512] @ b.T).min()) for s in range(0, len(a), 512)), default=1.0) if len(b) else 1.0
        return pa.table({"group_id": pa.array([table.column("group_id")[0].as_py()], pa.int64()), "ok": pa.array([low >= floor])})

    return run


def measure(members: DataFrame, floor: float, scratch: Scratch, held: int = HELD) -> DataFrame:
    """``(group_id, id, weight, mean, tight)`` for members ``(group_id, id, weight, vec)`` of a written table.

    ``mean`` is the mean cosine to the other members; ``tight`` says that every pair of the group reaches ``floor``, checked
    on the exact vectors. Groups above ``held`` members are measured in salted parts, and their pairs in a grid of blocks, if
    the means leave it possible that they are tight at all.
    """
    large = scratch.save(members.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") > held), "large")
    cols = ["group_id", "id", "weight", "vec"]
    some_large = not large.isEmpty()
    small = members.join(large, "group_id", "left_anti") if some_large else members
    out = small.select(*cols).repartition("group_id").sortWithinPartitions("group_id").mapInArrow(_held_rows(floor), _MEASURED)
    if not some_large:
        return out
    blocks = F.ceil(F.col("n") / F.lit(held // 2)).cast("int")
    big = members.join(large, "group_id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    salted = big.select("group_id", "block", "weight", "vec").repartition("group_id", "block").sortWithinPartitions("group_id", "block")
    totals = salted.mapInArrow(_sum_rows, "group_id long, total binary, w double").repartition("group_id").sortWithinPartitions("group_id").mapInArrow(_total_rows, "group_id long, total binary, w double")
    means = scratch.save(big.join(totals, "group_id").select(*cols, "total", "w").mapInArrow(_mean_rows, "group_id long, id long, weight long, mean double, vec binary"), "means")
    may = means.groupBy("group_id").agg(F.min("mean").alias("low")).where(F.col("low") >= floor - 1e-5).select("group_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = big.join(may, "group_id", "left_semi").select("group_id", "block", "vec", other.alias("other"))
    cells = spread.select("group_id", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "vec")
    ok = cells.groupBy("group_id", "row", "col").applyInArrow(_tight_cell(floor), "group_id long, ok boolean").groupBy("group_id").agg(F.bool_and("ok").alias("ok"))
    return out.unionByName(means.join(ok, "group_id", "left").select("group_id", "id", "weight", "mean", F.coalesce("ok", F.lit(False)).alias("tight")))


def cluster(vectors: DataFrame, floor: float, scratch: Scratch, exact: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, edges, copies, distinct vectors): ``members`` ``(id, pivot)`` of every vertex that has a similar one.

    Without ``exact`` the pivots are those of the edges that are kept, which is enough where linked clusters are put together.
    """
    vectors = scratch.save(vectors, "vectors")
    copies, n = scratch.counted(copies_of(vectors), "copies")
    one = vectors
    if n:
        one = scratch.save(vectors.join(copies.select(F.col("member").alias("id")), "id", "left_anti").select("vset", "id", "vec"), "distinct")
    index = build_index(one, 8, floor)
    found = search(bin_rows(one, index), index.tasks, similar_edges(floor), EDGE)
    edges = scratch.save(found.groupBy("left_id", "right_id").agg(F.max("cos").alias("cos"), F.bit_or("lost").alias("lost")), "edges")
    alone = copies.select("id").distinct().select("id", F.col("id").alias("pivot"))  # equal vectors without another similar one
    lossy = None
    if exact and not edges.where("lost > 0").isEmpty():
        ends = F.explode(F.array(F.when(F.col("lost").bitwiseAND(1) > 0, F.col("left_id")), F.when(F.col("lost").bitwiseAND(2) > 0, F.col("right_id"))))
        marked = edges.where("lost > 0").select(ends.alias("id")).where("id is not null").distinct()
        lossy = scratch.save(one.join(marked, "id", "left_semi").select("vset", "id", "vec"), "lossy")
    picks = {"smallest": _smallest, "closest": _closest}

    def again(rows: DataFrame, pick: str) -> DataFrame:
        return search(bin_rows(rows, index), index.tasks, _linked(floor, picks[pick]), LINK)

    def joined(pivots: DataFrame, *more: DataFrame) -> DataFrame:
        return _joined(every, pivots, [*more, again(_tagged(lossy, pivots), "closest")] if lossy is not None else [*more])

    every = scratch.save(_both(edges), "both")
    pivots = pivot_rounds(every, scratch, "first", lossy, again)
    assigned = scratch.save(joined(pivots), "assigned")
    near, n = scratch.counted(missed_pivots(assigned, edges, one, floor), "missed")
    if n:
        twice = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
        rivals, n = scratch.counted(near.join(pivots, F.col("u") == F.col("p"), "left_semi").select(twice).select("e.*").distinct(), "rivals")
        more = [near]
        if n:  # pivots that turn out to be similar to another one make way by the same rule, and their rows are compared with those they make way for
            stay = pivot_rounds(rivals, scratch, "rivals")
            demoted = rivals.select("u").distinct().join(stay, F.col("u") == F.col("p"), "left_anti")
            pivots = scratch.save(pivots.join(demoted, F.col("p") == F.col("u"), "left_anti"), "pivots")
            heirs = rivals.join(demoted, "u", "left_semi").join(pivots, F.col("v") == F.col("p"), "left_semi").select(F.col("u").alias("pivot"), "v")
            more.append(scratch.save(compared(assigned.join(heirs, "pivot").select(F.col("id").alias("u"), "v"), one, floor), "heirs"))
        assigned = scratch.save(joined(pivots, *more), "assigned-2")
        # rows whose pivot made way and that no other pivot is similar to choose among themselves
        free = assigned.where("id = pivot").select("id").join(pivots, F.col("id") == F.col("p"), "left_anti")
        rest, n = scratch.counted(every.join(free.withColumnRenamed("id", "u"), "u", "left_semi").join(free.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v"), "rest")
        if n:
            assigned = scratch.save(joined(pivots.unionAll(pivot_rounds(rest, scratch, "rest")), *more), "assigned-3")
    assigned = assigned.unionAll(alone.join(assigned.select("id"), "id", "left_anti"))
    return scratch.save(assigned, "clusters"), edges, copies, one


def _weighed(assigned: DataFrame, copies: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(group_id, id, weight, vec)``; the weight of a vertex is the number of its equal vectors."""
    weight = copies.groupBy("id").agg((F.count("*") + 1).alias("weight"))
    return assigned.join(weight, "id", "left").join(vectors.select("id", "vec"), "id").select("group_id", "id", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), "vec")


def clusters(vectors: DataFrame, floor: float, scratch: Scratch, typical: int = 3) -> DataFrame:
    """``(representative_id, size, typical_ids, mean_cosine)`` of every cluster of two or more: its medoid, size and most typical members."""
    assigned, _, copies, one = cluster(vectors, floor, scratch)
    members = scratch.save(_weighed(assigned.withColumnRenamed("pivot", "group_id"), copies, one), "members")
    measured = measure(members, 2.0, scratch)
    best = F.struct((-F.col("mean")).alias("m"), "id")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.col("mean").desc(), "id"))
    top = measured.select("group_id", "id", "mean", place.alias("place")).where(F.col("place") <= typical)
    listed = top.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(best)), lambda x: x["id"]).alias("typical_ids"))
    sizes = measured.groupBy("group_id").agg(F.sum("weight").alias("size"), F.avg("mean").alias("mean_cosine"))
    return sizes.join(listed, "group_id").where("size > 1").select(F.col("typical_ids")[0].alias("representative_id"), "size", "typical_ids", "mean_cosine")


def isolated_clusters(vectors: DataFrame, floor: float, least: int, scratch: Scratch) -> DataFrame:
    """``(representative_id, id)`` of the pivots' clusters of ``least`` or more in which every pair reaches ``floor`` and that
    no found pair links to a row outside; the representative has the highest mean cosine, ties to the smaller id.

    The first pivot of such a set is its row of smallest rank, which absorbs all others. The edges kept link the same
    rows as all pairs found, so a cluster without an edge that leaves it has no found pair with a row outside. All pairs
    of what results are checked on the exact vectors.
    """
    assigned, edges, copies, one = cluster(vectors, floor, scratch, exact=False)
    left, right = assigned.select(F.col("id").alias("left_id"), F.col("pivot").alias("a")), assigned.select(F.col("id").alias("right_id"), F.col("pivot").alias("b"))
    leaving = edges.select("left_id", "right_id").join(left, "left_id").join(right, "right_id").where("a <> b").select(F.explode(F.array("a", "b")).alias("group_id")).distinct()
    weighed = _weighed(assigned.withColumnRenamed("pivot", "group_id").join(leaving, "group_id", "left_anti"), copies, one)
    members = scratch.save(weighed, "members")
    large = members.groupBy("group_id").agg(F.sum("weight").alias("size")).where(F.col("size") >= least).select("group_id")
    kept = scratch.save(members.join(large, "group_id", "left_semi"), "kept")
    measured = scratch.save(measure(kept, floor, scratch), "measured")
    best = measured.groupBy("group_id").agg(F.bool_and("tight").alias("tight"), F.max_by("id", F.struct(F.round("mean", 9), -F.col("id"))).alias("representative_id"))
    rows = measured.join(best.where("tight").select("group_id", "representative_id"), "group_id").select("representative_id", "id")
    return rows.unionAll(rows.join(copies, "id").select("representative_id", F.col("member").alias("id")))
