"""Usable vectors of a set, and the leaf-partitioned search that the operators on vectors share.

Rows of ``(vset, id, vec)``: ``vset`` names the collection and its number of dimensions, ``vec`` holds the unit vector as
float32 bytes. Nothing here gathers a group: a leaf is cut into blocks of at most ``BLOCK`` rows, queries stream past the
block, and what a block emits is linear in its rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from threadloom.arrow import binary, matrix, runs
from threadloom.llm.tree import Tree, best_bins, fit_tree
from threadloom.operators.latest import latest

#: Most rows of a leaf that are held against a query at once.
BLOCK = 4096
#: Rows of a set that the tree is fitted on: ``FIT`` a leaf, between ``SAMPLE`` and ``FIT_BYTES`` of vectors. Rows that recall is calibrated with.
SAMPLE, FIT, FIT_BYTES, PROBES = 32_768, 8, 1 << 26, 800
#: A tree travels with the tasks, so all its centres take at most this; beyond, leaves grow and are cut into blocks.
TREE_BYTES = 1 << 24
#: Sets (kinds of vectors) that get a tree, at most: the largest. Any other set is one leaf, whose blocks all meet.
MAX_SETS = 64
#: Pairs of a probe and a neighbour that calibration is based on, at least, if need be some below the floor.
LEAST_PAIRS = 100


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec, dims = batch.column(3), np.asarray(batch.column(4).fill_null(-1), np.int64)
        n = batch.num_rows
        offsets = np.asarray(vec.offsets)
        values = vec.values
        nulls = np.asarray(values.is_null()) if values.null_count else np.zeros(len(values), bool)
        flat = np.asarray(values.fill_null(np.nan) if values.null_count else values, np.float64)
        size = np.diff(offsets)
        finite = np.isfinite(flat) & ~nulls
        peak = np.where(finite, np.abs(flat), np.inf)
        ok = (size == dims) & (size > 0)
        if vec.null_count:
            ok &= ~np.asarray(vec.is_null())
        keep = np.flatnonzero(ok)
        for d in np.unique(dims[keep]):
            rows = keep[dims[keep] == d]
            at = offsets[rows][:, None] + np.arange(d)
            top = peak[at].max(axis=1)
            good = np.isfinite(top) & (top > 0)
            rows, x = rows[good], flat[at[good]] / top[good][:, None]
            x = (x / np.sqrt((x * x).sum(1))[:, None]).astype("<f4")
            take = pa.array(rows, pa.int64())
            kind = batch.column(0).take(take)
            vset = pc.binary_join_element_wise(kind, pa.array([str(d)] * len(rows), pa.string()), "#")
            yield pa.RecordBatch.from_arrays([vset, batch.column(1).take(take), batch.column(2).take(take), binary(x)], names=["vset", "id", "stamp", "vec"])


def usable_vectors(rows: DataFrame, kind: Column, ident: str, value: str, dimensions: str, stamp: str) -> DataFrame:
    """``(vset, id, vec)`` of each thread's latest usable row of a set.

    Usable is a JSON array of exactly ``dimensions`` finite numbers that are not all zero; text before or after the
    array makes it unusable. Null kinds and ids are left out. Of rows with the same time the one with the greater vector
    bytes counts.
    """
    text = F.trim(F.translate(F.col(value), "\t\n\r", "   "))
    whole = text.startswith("[") & (F.instr(text, "]") == F.length(text))
    parsed = rows.where(kind.isNotNull() & F.col(ident).isNotNull() & F.col(value).isNotNull() & whole).select(
        kind.alias("kind"), F.col(ident).cast("long").alias("id"), F.col(stamp).cast("string").alias("stamp"),
        F.from_json(F.col(value), "array<double>").alias("vec"), F.col(dimensions).cast("long").alias("dims"),
    )
    unit = parsed.mapInArrow(_normalised, "vset string, id long, stamp string, vec binary")
    kind_of = F.regexp_replace("vset", "#[0-9]+$", "")
    return latest(unit.withColumn("kind", kind_of), ["kind", "id"], "stamp", "vec").select("vset", "id", "vec")


@dataclass(frozen=True)
class Index:
    """Per set: the tree, the calibrated number of leaf visits, the blocks of each leaf, and the recall measured.

    A set without a tree is a single leaf; its recall is 1.
    """

    trees: dict[str, Tree]
    visits: dict[str, int]
    blocks: dict[str, np.ndarray]
    recall: dict[str, float]

    def leaves(self, vset: str, x: np.ndarray, visits: int) -> np.ndarray:
        return best_bins(self.trees[vset], x, visits) if vset in self.trees else np.zeros((len(x), 1), np.int32)

    @property
    def tasks(self) -> int:
        """Blocks of all leaves: about one for each task of the search."""
        return max(8, sum(int(b.sum()) for b in self.blocks.values()))

    def blocks_of(self, vset: str, leaf: np.ndarray) -> np.ndarray:
        return self.blocks[vset][leaf] if vset in self.blocks else np.ones(len(leaf), np.int64)


def _fit(counts: dict[str, int], leaf_rows: int):
    """The tree of one set, fitted where its sample lies, so that no vectors go to the driver."""

    def run(table: pa.Table) -> pa.Table:
        vset = table.column("vset")[0].as_py()
        x = matrix(table.column("vec"), np.dtype("<f4"))
        tree = fit_tree(x, _leaf_count(vset, counts[vset], leaf_rows))
        return pa.table({"vset": [vset], "tree": pa.array([pickle.dumps((tree.centers, tree.first_child, tree.n_children, tree.leaf_of))], pa.binary())})

    return run


def _leaf_count(vset: str, rows: int, leaf_rows: int) -> int:
    return max(1, min(rows // leaf_rows, TREE_BYTES // (4 * int(vset.rpartition("#")[2]))))


def _visits_needed(tree: Tree, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pair of rows, after how many visits of one of them it is in the other's first leaf."""
    need = np.zeros(len(q), np.int32)
    home_q, home_x = best_bins(tree, q, 1), best_bins(tree, x, 1)
    open_, reach = np.arange(len(q)), 8
    while len(open_):
        for rows, home in ((q, home_x), (x, home_q)):
            met = best_bins(tree, rows[open_], reach) == home[open_]
            at = np.where(met.any(1), met.argmax(1) + 1, np.iinfo(np.int32).max)
            need[open_] = np.where(need[open_] > 0, np.minimum(need[open_], at), at)
        open_ = open_[need[open_] == np.iinfo(np.int32).max]
        need[open_] = 0
        reach *= 8
    return need


def _probe(probes: dict[str, tuple[np.ndarray, np.ndarray]], trees: dict[str, Tree], k: int, floor: float):
    """Brute force of the probes against the rows of a task: the k nearest of each, and the visits that it takes to meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for (vset,), part in runs(batches, 1):
            if vset not in probes:
                continue
            own, q = probes[vset]
            ids, x = np.asarray(part.column(1)), matrix(part.column(2), np.dtype("<f4"))
            s = q @ x.T
            s[own[:, None] == ids[None, :]] = -2
            m = min(k, len(ids))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            new = np.take_along_axis(s, top, 1), ids[top], x[top]
            if vset in best:
                cos, near, vec = (np.concatenate([old, fresh], 1) for old, fresh in zip(best[vset], new))
                top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
                new = np.take_along_axis(cos, top, 1), np.take_along_axis(near, top, 1), np.take_along_axis(vec, top[:, :, None], 1)
            best[vset] = new
        for vset, (cos, near, vec) in best.items():
            i, j = np.nonzero(cos > -2)
            best_first = np.argsort(-cos[i, j], kind="stable")
            kept = best_first[: max(LEAST_PAIRS, int((cos[i, j] >= floor).sum()))]  # no other pair counts in calibration
            i, j = i[kept], j[kept]
            need = _visits_needed(trees[vset], probes[vset][1][i], vec[i, j])
            yield pa.RecordBatch.from_arrays([pa.array([vset] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(cos[i, j].astype(np.float64)), pa.array(near[i, j]), pa.array(need)], names=["vset", "probe", "cos", "id", "need"])

    return run


def build_index(vectors: DataFrame, k: int, floor: float, target: float = 0.995, leaf_rows: int = BLOCK) -> Index:
    """Fit a tree per set on a bounded sample and widen the leaf visits until the probes' recall reaches ``target``.

    Recall is measured against brute force over all rows: of the pairs of a probe and its ``k`` nearest rows at
    ``floor`` or more, the share in which one of the two visits the other's leaf. Where the probes have fewer than
    ``LEAST_PAIRS`` such pairs, their nearest pairs below the floor are taken as well. Trees are fitted and the probes' nearest rows found
    by tasks; the driver gets trees, probes, and counts of pairs by the visits that they take, none of which grows with the data but the trees, up to ``TREE_BYTES``. ``vectors`` must be a written table, as several passes read it. An empty table gives an empty index.
    """
    sizes = {r["vset"]: r["count"] for r in vectors.groupBy("vset").count().orderBy(F.col("count").desc(), "vset").limit(MAX_SETS).collect()}
    counts = {v: n for v, n in sizes.items() if n >= 2 * leaf_rows}
    trees: dict[str, Tree] = {}
    if counts:

        def drawn(most: Callable[[str], int], salt: int) -> DataFrame:
            draw = F.pmod(F.xxhash64(F.lit(salt), "vset", "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            share = F.lit(0.0)
            for vset, n in counts.items():
                share = F.when(F.col("vset") == vset, F.lit(min(1.0, most(vset) / n))).otherwise(share)
            return vectors.where(draw < share)

        def fitted_on(vset: str) -> int:
            return min(max(SAMPLE, FIT * _leaf_count(vset, counts[vset], leaf_rows)), FIT_BYTES // (4 * int(vset.rpartition("#")[2])))

        fitted = drawn(fitted_on, 11).select("vset", "vec").groupBy("vset").applyInArrow(_fit(counts, leaf_rows), "vset string, tree binary")
        trees = {r["vset"]: Tree(*pickle.loads(r["tree"])) for r in fitted.collect()}
        trees = {v: t for v, t in trees.items() if t.leaves > 1}
    visits, recall = {}, dict.fromkeys(sizes, 1.0)
    if trees:
        probes = {v: (np.array([r["id"] for r in part]), np.stack([np.frombuffer(r["vec"], "<f4") for r in part])) for v, part in _by_set(drawn(lambda _: PROBES, 23).where(F.col("vset").isin(list(trees)))).items()}
        near = vectors.where(F.col("vset").isin(list(trees))).mapInArrow(_probe(probes, trees, k, floor), "vset string, probe int, cos double, id long, need int")
        rank = F.row_number().over(Window.partitionBy("vset", "probe").orderBy(F.col("cos").desc(), "id"))
        met = near.withColumn("rank", rank).where(F.col("rank") <= k)
        place = F.row_number().over(Window.partitionBy("vset").orderBy(F.col("cos").desc(), "probe", "id"))  # k rows a probe
        met = met.withColumn("place", place).where((F.col("cos") >= floor) | (F.col("place") <= LEAST_PAIRS))
        found: dict[str, list[Row]] = _by_set(met.groupBy("vset", "need").agg(F.count("*").alias("n")).orderBy("need"))
        for vset in trees:
            visits[vset], total, hit = 1, sum(r["n"] for r in found.get(vset, [])), 0
            for r in found.get(vset, []):
                hit += r["n"]
                visits[vset], recall[vset] = r["need"], hit / total
                if hit >= target * total:
                    break
    index = Index(trees, visits, {v: np.ones(t.leaves, np.int64) for v, t in trees.items()}, recall)
    filled = vectors.mapInArrow(_first_leaves(index), "vset string, leaf int, n long").groupBy("vset", "leaf").agg(F.sum("n").alias("n"))
    for r in filled.where(F.col("n") > 2 * BLOCK).collect():  # at most one row a leaf
        index.blocks.setdefault(r["vset"], np.ones(1, np.int64))[r["leaf"]] = -(-r["n"] // BLOCK)
    return index


def _by_set(rows: DataFrame) -> dict[str, list[Row]]:
    """Rows by set, of a table whose size is bounded."""
    out: dict[str, list[Row]] = {}
    for r in rows.collect():
        out.setdefault(r["vset"], []).append(r)
    return out


def _first_leaves(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for (vset,), part in runs(batches, 1):
            leaf = index.leaves(vset, matrix(part.column(2), np.dtype("<f4")), 1)[:, 0]
            total[vset] = total.get(vset, 0) + np.bincount(leaf, minlength=index.trees[vset].leaves if vset in index.trees else 1)
        for vset, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([vset] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["vset", "leaf", "n"])

    return run


def _spread(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of each row inside its leaf."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)


def bin_rows(vectors: DataFrame, index: Index) -> DataFrame:
    """``(vset, leaf, block, role, id, q)``: each row once as member of its leaf (role 0), and as query (role 1) of the
    other leaves that it visits and of the further blocks of its own. ``q`` is the vector in 16-bit integers, whose
    cosines differ from the exact ones by less than 1e-4. A fourth column of the rows, ``tag long``, comes along as the last.
    """
    tagged = len(vectors.columns) > 3
    schema = "vset string, leaf int, block int, role byte, id long, q binary" + (", tag long" if tagged else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (vset,), part in runs(batches, 1):
            x, ids = matrix(part.column(2), np.dtype("<f4")), np.asarray(part.column(1))
            leaves = index.leaves(vset, x, index.visits.get(vset, 1))
            q = np.round(x * (32767 / np.abs(x).max(axis=1))[:, None]).astype("<i2")
            own = leaves[:, 0]
            nb = index.blocks_of(vset, own)
            home = _spread(ids, nb)
            rows, leaf, block, role = [np.arange(len(ids))], [own], [home], [np.zeros(len(ids), np.int8)]
            r, c = np.nonzero(leaves[:, 1:] >= 0)
            seen = [(r, leaves[r, c + 1], np.zeros(len(r), np.int64))]
            many = np.flatnonzero(nb > 1)
            seen.append((many, own[many], home[many] + 1))  # only later blocks: each pair of blocks meets once
            for rr, ll, start in seen:
                reps = index.blocks_of(vset, ll) - start
                rows.append(np.repeat(rr, reps))
                leaf.append(np.repeat(ll, reps))
                first = np.repeat(np.cumsum(reps) - reps, reps)
                block.append(np.arange(int(reps.sum())) - first + np.repeat(start, reps))
                role.append(np.ones(int(reps.sum()), np.int8))
            rows, leaf, block, role = (np.concatenate(v) for v in (rows, leaf, block, role))
            cols = [pa.array([vset] * len(rows), pa.string()), pa.array(leaf.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(role), pa.array(ids[rows]), binary(q[rows])]
            if tagged:
                cols.append(pa.array(np.asarray(part.column(3))[rows]))
            yield pa.RecordBatch.from_arrays(cols, names=["vset", "leaf", "block", "role", "id", "q", "tag"][: len(cols)])

    return vectors.mapInArrow(run, schema)


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.sqrt((x * x).sum(1))[:, None]


def search(binned: DataFrame, tasks: int, emit, schema: str) -> DataFrame:
    """Hold the members of each block against each other and against the queries that visit it.

    ``emit(vset, ids_a, ids_b, cosines, same)`` gives a list of columns for what is to come out of one meeting; ``same`` says
    that both sides are the members. Of tagged rows the ids are pairs (id, tag). A task holds one block at a time.
    """
    names = [part.split()[0] for part in schema.split(",")]
    keys = ["vset", "leaf", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, x = None, [], []
        members = (np.zeros(0, np.int64), None)

        def out(vset, a, b, s, same):
            cols = emit(vset, a, b, s, same)
            if cols is not None and len(cols[0]):
                yield pa.RecordBatch.from_arrays(cols, names=names)

        def close(vset):
            nonlocal members, ids, x
            if ids:
                members = (np.concatenate(ids), np.concatenate(x))
                ids, x = [], []
                a, m = members
                for s in range(0, len(a), 1024):
                    yield from out(vset, a[s : s + 1024], a, m[s : s + 1024] @ m.T, True)

        for key, part in runs(batches, 4):
            if key[:3] != at:
                if at is not None:
                    yield from close(at[0])
                at, members = key[:3], (np.zeros(0, np.int64), None)
            own, v = np.asarray(part.column(4)), _unit(matrix(part.column(5), np.dtype("<i2")))
            if part.num_columns > 6:
                own = np.stack([own, np.asarray(part.column(6))], axis=1)
            if key[3] == 0:
                ids.append(own)
                x.append(v)
                continue
            yield from close(at[0])
            if len(members[0]):
                for s in range(0, len(own), 1024):
                    yield from out(at[0], own[s : s + 1024], members[0], v[s : s + 1024] @ members[1].T, False)
        if at is not None:
            yield from close(at[0])

    return binned.repartition(tasks, *keys).sortWithinPartitions(*keys, "role").mapInArrow(run, schema)


def nearest_edges(k: int, floor: float):
    """Emitter of each row's ``k`` nearest at ``floor`` or more in a meeting, for either side: at most k rows each."""

    def emit(vset, a, b, s, same):
        if same:
            s = np.where(a[:, None] == b[None, :], np.float32(-2), s)
        left, right, cos = [], [], []
        for m, p, q in [(s, a, b)] + ([] if same else [(s.T, b, a)]):
            hot = np.flatnonzero((m >= floor).sum(1) > 0)
            if not len(hot):
                continue
            sub = m[hot]
            kk = min(k, sub.shape[1])
            top = np.argpartition(-sub, kk - 1, axis=1)[:, :kk]
            i, j = np.repeat(np.arange(len(hot)), kk), top.ravel()
            ok = sub[i, j] >= floor
            left.append(p[hot[i[ok]]])
            right.append(q[j[ok]])
            cos.append(sub[i[ok], j[ok]])
        if not left:
            return None
        left, right, cos = map(np.concatenate, (left, right, cos))
        keep = left != right
        return [pa.array([vset] * int(keep.sum()), pa.string()), pa.array(left[keep]), pa.array(right[keep]), pa.array(cos[keep].astype(np.float64))]

    return emit
