"""Similarity edges: exact nearest neighbours inside a partition of the corpus, and the fusion of several sources."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.config import CLUSTER_K, CLUSTER_MIN_SCORE, Fusion
from threadloom.functions.vectors import dot

#: Vectors of a block; two blocks meet in one task. Scores of a cell are made for so many rows at a time.
BLOCK, STRIP = 8192, 512
_SCHEMA = "scope string, left_id long, right_id long, score double"


def _matrix(vec: pa.ListArray, n: int, unit: bool = True) -> np.ndarray:
    x = np.asarray(vec.flatten(), np.float64)
    if len(x) % n or (np.asarray(vec.value_lengths()) != len(x) // n).any():
        raise ValueError("vectors of different lengths in one scope")
    x = x.reshape(n, -1)
    if not unit:
        return x
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size == 0, 1, size)[:, None]


def _best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int | None, floor: float, digits: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, score) of each row's ``k`` best others at ``floor`` or more, all if ``k`` is None; scores equal to ``digits`` go to the
    smaller id, so that ranks do not depend on the blocks. Only what reaches the k-th score of its row is sorted."""
    found = []
    for start in range(0, len(x), STRIP):
        mine = ids[start : start + STRIP]
        s = x[start : start + STRIP] @ y.T
        fit = (s >= floor) & (mine[:, None] != others[None, :])
        if k is not None and k < s.shape[1]:
            ranked = np.where(fit, s, -np.inf)
            least = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, -k]
            fit &= ranked >= (least - 2 * 10.0**-digits)[:, None]
        i, j = np.nonzero(fit)
        v = s[i, j]
        if k is not None:
            order = np.lexsort((others[j], -np.round(v, digits), i))
            i, j, v = i[order], j[order], v[order]
            first = np.searchsorted(i, np.arange(len(mine)))
            ok = np.arange(len(i)) - first[i] < k
            i, j, v = i[ok], j[ok], v[ok]
        found.append((mine[i], others[j], v))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def _table(scope: str, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    left, right, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))
    return pa.table({"scope": pa.array([scope] * len(left), pa.string()), "left_id": left, "right_id": right, "score": score})


def _meet(k: int | None, floor: float):
    """The best partners of every vector of a cell of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, block = np.asarray(table.column("id")), np.asarray(table.column("block"))
        row, col = np.asarray(table.column("row")), np.asarray(table.column("col"))
        x = _matrix(table.column("vec").combine_chunks(), len(ids))
        a, b = block == row, block == col
        sides = ((a, b),) if (row == col).all() else ((a, b), (b, a))
        return _table(table.column("scope")[0].as_py(), [_best(ids[p], x[p], ids[q], x[q], k, floor) for p, q in sides if p.any() and q.any()])

    return run


def _asked(k: int | None, floor: float, unit: bool = True, digits: int = 12):
    """The best partners of the queries of a cell among its rows, by cosine, or by inner product if not ``unit``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, asks = np.asarray(table.column("id")), np.asarray(table.column("asks"))
        x = _matrix(table.column("vec").combine_chunks(), len(ids), unit)
        p, q = asks == 1, asks == 0
        return _table(table.column("scope")[0].as_py(), [_best(ids[p], x[p], ids[q], x[q], k, floor, digits)] if p.any() and q.any() else [])

    return run


def _placed(vectors: DataFrame, block: int) -> DataFrame:
    """``(scope, n, id, vec, blocks, block)``: ``n`` is the length of the vector; vectors of different lengths are never compared."""
    rows = vectors.where(F.col("vec").isNotNull()).select("scope", F.size("vec").alias("n"), F.col("id").cast("long").alias("id"), "vec")
    counts = rows.groupBy("scope", "n").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    return rows.join(counts, ["scope", "n"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _ranked(found: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("scope", "left_id").orderBy(F.round("score", 12).desc(), "right_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_neighbors(vectors: DataFrame, k: int, floor: float, block: int = BLOCK) -> DataFrame:
    """``(scope, left_id, right_id, score, rank)``: each vector's k most similar ones of its scope and length, exactly.

    ``vectors``: ``(scope, id, vec array<double>)``; a scope is a repository, or one of its sources. A scope is
    cut into blocks by a hash, and every pair of blocks is one matrix product in one task, so nothing is broadcast and no
    task holds more than two blocks, while the work stays that of the exact backend: quadratic in the scope.
    Null vectors are left out; a vector of zeros has a cosine of 0 with all.
    """
    placed = _placed(vectors, block)
    spread = placed.select("scope", "n", "id", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select("scope", "n", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "id", "vec")
    return _ranked(cells.groupBy("scope", "n", "row", "col").applyInArrow(_meet(k, floor), _SCHEMA), k)


def neighbors_of(queries: DataFrame, vectors: DataFrame, k: int | None, floor: float, block: int = BLOCK) -> DataFrame:
    """``(scope, left_id, right_id, score)`` for the ``queries`` only: their k most similar vectors of the scope, or all at ``floor``.

    Both sides are ``(scope, id, vec)``. Every block of queries meets every block of vectors once, so the work is that of the queries times the vectors.
    """
    return _ranked(_cells(queries, vectors, block).groupBy("scope", "n", "row", "col").applyInArrow(_asked(k, floor), _SCHEMA), k)


def _cells(queries: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """Every block of queries beside every block of the vectors of its scope and length; ``asks`` tells them apart."""
    asked, stored = _placed(queries, block), _placed(vectors, block)
    n_asked = asked.groupBy("scope", "n").agg(F.max("blocks").alias("others"))
    n_stored = stored.groupBy("scope", "n").agg(F.max("blocks").alias("others"))

    def spread(rows: DataFrame, others: DataFrame, asks: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
        copies = rows.join(others, ["scope", "n"]).select("scope", "n", "id", "vec", "block", other.alias("other"))
        row, col = ("other", "block") if not asks else ("block", "other")
        return copies.select("scope", "n", F.col(row).alias("row"), F.col(col).alias("col"), F.lit(asks).alias("asks"), "id", "vec")

    return spread(asked, n_stored, 1).unionByName(spread(stored, n_asked, 0))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = dot, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(id, other_id, score)``: for each of the ``queries`` ``(id, vec)`` its ``k`` best ``vectors`` ``(id, vec)`` of the same length by any
    scorer, a function of two vector columns; ``keep`` filters scores. The queries are a stated set: the scorer sees each of them with every vector.
    Inner products of rows with whole-number ids are matrix products of blocks.
    """
    if scorer is dot and keep is None and all(df.schema["id"].dataType.typeName() in ("integer", "long") for df in (queries, vectors)):
        sides = (df.select(F.lit("").alias("scope"), "id", F.col("vec").cast("array<double>").alias("vec")).where(~F.exists("vec", lambda x: x.isNull())) for df in (queries, vectors))
        near = _cells(*sides, BLOCK).groupBy("scope", "n", "row", "col").applyInArrow(_asked(k, -np.inf, False, 9), _SCHEMA)
        kinds = (queries.schema["id"].dataType, vectors.schema["id"].dataType)
        rows = near.select(F.col("left_id").cast(kinds[0]).alias("id"), F.col("right_id").cast(kinds[1]).alias("other_id"), "score")
        return _first(rows, k)
    q = queries.select("id", F.col("vec").alias("q"), F.size("vec").alias("n"))
    v = vectors.select(F.col("id").alias("other_id"), F.col("vec").alias("v"), F.size("vec").alias("n"))
    rows = q.join(v, "n").where("id <> other_id").select("id", "other_id", scorer(F.col("q"), F.col("v")).alias("score"))
    return _first(rows.where(keep(F.col("score"))) if keep else rows.where("score is not null"), k)


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ``(id, other_id, score)`` of each id; ties go to the smaller one."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("score", 9).desc(), "other_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def canonical(edges: DataFrame, *by: str) -> DataFrame:
    """Unordered edges, smaller id first, each with its best score."""
    ends = edges.select(*by, F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "score")
    return ends.groupBy(*by, "left_id", "right_id").agg(F.max("score").alias("score"))


def knn_edges(vectors: DataFrame, k: int = CLUSTER_K, floor: float = CLUSTER_MIN_SCORE, policy: str = "union") -> DataFrame:
    """Edges of the neighbour graph: by ``union`` of both directions, or only those that the ``lower_id_owner`` ranks."""
    near = nearest_neighbors(vectors, k, floor)
    if policy == "lower_id_owner":
        near = near.where("left_id < right_id")
    return canonical(near, "scope")


def fuse(edges: DataFrame, floor: float, fusion: Fusion = Fusion()) -> DataFrame:
    """``(left_id, right_id, score, sources)`` from edges with a ``source``: one aggregation, whatever the mode."""
    per = edges.groupBy("left_id", "right_id", "source").agg(F.max("score").alias("score"))
    weight: Column = F.lit(fusion.other_weight)
    for source, w in fusion.weights.items():
        weight = F.when(F.col("source") == source, F.lit(w)).otherwise(weight)
    n, best = F.count("*"), F.max("score")
    score = {
        "max": best,
        "mean": F.avg("score"),
        "weighted": F.sum(F.col("score") * weight) / F.sum(weight),
        "min-of-2": F.when(n >= 2, best),
        "boost": F.least(F.lit(1.0), best + (n - 1) * F.lit(fusion.bonus)),
    }[fusion.mode]
    fused = per.groupBy("left_id", "right_id").agg(score.alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return fused.where(F.col("score") >= floor)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, as ``(id, other_id, score)``; one pass over the edges."""
    ends = F.array(F.struct(F.col("left_id").alias("id"), F.col("right_id").alias("other_id")), F.struct(F.col("right_id").alias("id"), F.col("left_id").alias("other_id")))
    return edges.select(F.explode(ends).alias("e"), "score").select("e.*", "score")
