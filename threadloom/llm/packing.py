"""Filling containers of a fixed capacity: bulk-synchronous best fit.

Sizes are whole numbers up to the capacity, so a range-sorted list of documents is described by at most ``capacity`` runs of
equal size, and the gaps of open containers likewise by runs of containers with equal gaps. A round sweeps the runs of
documents from large to small over the runs of gaps; each document takes the smallest gap that holds it (its successor);
where several documents want the same gaps, rank decides and the rest go on to the next successor; a gap takes one
document a round and is then updated. Documents without a successor open containers. The rounds repeat until no
document is left. The sweeps work on runs and never on documents, so their cost is bounded by the capacity and not by
the number of documents; the documents themselves are ranked inside their size and placed by one distributed join of
rank intervals.

Defined results: an item larger than the capacity is split into full containers and a rest that is placed like any other
item; an item of size 0 takes no room and goes to a container by its hash (container 0 if there is none); items with a
null id are left out, a null size counts as 0; repeated ids are separate items.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of one size whose ranks one task gives, about.
RANKED = 200_000


def place_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """([(size, first rank, items, first container)], containers) of best fit over runs.

    ``counts`` has the number of items by size, each from 1 to ``capacity``. Items of a size with ranks from ``first
    rank`` go to as many successive containers from ``first container``.
    """
    left = {s: n for s, n in counts.items() if n}
    ranked = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first container, containers)
    placed: list[tuple[int, int, int, int]] = []
    opened = 0
    while left:
        order = sorted(g for g in gaps if g)
        updated: list[tuple[int, int, int]] = []
        moved = False
        for size in sorted(left, reverse=True):
            at = bisect.bisect_left(order, size)
            while left.get(size) and at < len(order):
                runs = gaps[order[at]]
                while runs and left.get(size):
                    first, n = runs.pop()
                    take = min(n, left[size])
                    if take < n:
                        runs.append((first + take, n - take))
                    placed.append((size, ranked[size], take, first))
                    updated.append((order[at] - size, first, take))
                    ranked[size] += take
                    left[size] -= take
                    moved = True
                if runs:
                    break
                del gaps[order[at]]
                del order[at]
            if not left.get(size):
                left.pop(size, None)
        for gap, first, n in updated:
            gaps.setdefault(gap, []).append((first, n))
        if left and not moved:
            # no gap holds any of them: the largest size opens containers, each for as many as fit side by side
            size = max(left)
            each = max(1, capacity // size)
            n = -(-left[size] // each)
            for k in range(each):
                take = min(n, left[size])
                if not take:
                    gaps.setdefault(capacity - size * k, []).append((opened, n))
                    break
                placed.append((size, ranked[size], take, opened))
                ranked[size] += take
                left[size] -= take
                if take < n:  # the last layer is incomplete
                    gaps.setdefault(capacity - size * k, []).append((opened + take, n - take))
                    gaps.setdefault(capacity - size * (k + 1), []).append((opened, take))
                    break
                if k == each - 1 or not left[size]:
                    gaps.setdefault(capacity - size * (k + 1), []).append((opened, n))
                    break
            opened += n
            if not left[size]:
                del left[size]
    return placed, opened


def pack(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """``(ident, piece, container_id, first_unit, n_units)``: where each item, or each piece of an oversized one, lies.

    ``first_unit`` is the piece's offset inside its item. ``items`` should be a written table: it is read twice.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    base = items.where(F.col(ident).isNotNull()).select(F.col(ident).alias("item"), n.alias("n"))
    full, rest = F.floor(F.col("n") / capacity).cast("long"), (F.col("n") % capacity).cast("long")
    totals = base.select(full.alias("full"), rest.alias("rest")).groupBy("rest").agg(F.count("*").alias("items"), F.sum("full").alias("full")).collect()  # at most ``capacity`` rows
    whole = sum(r["full"] or 0 for r in totals)
    counts = {r["rest"]: r["items"] for r in totals if r["rest"]}
    plan, opened = place_runs(counts, capacity)
    containers = whole + opened

    # ranks: a bucket of a size is ranked by one task, and starts where the buckets before it end
    most = max([whole and max((r["items"] for r in totals), default=0), *counts.values()], default=0)
    buckets = max(1, -(-most // RANKED))
    split = base.select("item", "n", full.alias("full"), rest.alias("rest"), F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int").alias("bucket"))

    parts = split.where("rest > 0")
    sums = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("rest", "bucket").agg(F.count("*").alias("c")).select("rest", "bucket", F.coalesce(F.sum("c").over(sums), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("item"))
    if buckets == 1:
        ranked = parts.withColumn("rank", (local - 1).cast("long"))
    else:
        ranked = parts.join(starts, ["rest", "bucket"]).withColumn("rank", F.col("start") + local - 1)

    by_size: dict[int, list[tuple[int, int]]] = {}
    for s, first, _, container in sorted(plan):
        by_size.setdefault(s, []).append((first, container))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {s: (np.array([f for f, _ in v]), np.array([c for _, c in v])) for s, v in by_size.items()}
        for batch in batches:
            rest_, rank = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            box = np.zeros(len(rank), np.int64)
            for s in np.unique(rest_):
                rows = rest_ == s
                first, container = table[int(s)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                box[rows] = container[k] + rank[rows] - first[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(box + whole), batch.column(1), batch.column(2)], names=[ident, "piece", "container_id", "first_unit", "n_units"])

    kind = base.schema["item"].dataType.simpleString()
    schema = f"`{ident}` {kind}, piece long, container_id long, first_unit long, n_units long"
    rests = ranked.select("item", "full", "rest", "rank").mapInArrow(locate, schema).withColumn("first_unit", F.col("piece") * capacity)
    out = rests
    if whole:
        # full containers are numbered by the running sum of an item's full pieces, inside buckets as above
        big = split.where("full > 0")
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        from_ = big.groupBy("bucket").agg(F.sum("full").alias("c")).select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
        inside = F.coalesce(F.sum("full").over(Window.partitionBy("bucket").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = big.join(from_, "bucket").withColumn("at", F.col("start") + inside)
        fulls = numbered.select("item", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
        out = out.unionByName(fulls.select(F.col("item").alias(ident), "piece", (F.col("at") + F.col("piece")).alias("container_id"), (F.col("piece") * capacity).alias("first_unit"), F.lit(capacity).cast("long").alias("n_units")))
    empty = base.where("n = 0").select(
        F.col("item").alias(ident), F.lit(0).cast("long").alias("piece"), F.pmod(F.xxhash64("item"), F.lit(max(1, containers))).alias("container_id"),
        F.lit(0).cast("long").alias("first_unit"), F.lit(0).cast("long").alias("n_units"),
    )
    return out.unionByName(empty)
