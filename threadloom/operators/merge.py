"""Keyed merges, reconciliation and the snapshot store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], preserve: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """``base`` with the rows of ``incoming`` inserted, or written over the row of the same key.

    ``preserve`` columns keep the base's value where the key existed; ``fill`` columns take the incoming value only where it
    isn't null. Keys are compared null-safely; both sides must have one row per key. One shuffle of either side.
    """
    b, i = base.alias("b"), incoming.alias("i")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    there = b.select("*", F.lit(True).alias("__old")).alias("b")
    new = i.select("*", F.lit(True).alias("__new")).alias("i")
    old_row, new_row = F.col("b.__old").isNotNull(), F.col("i.__new").isNotNull()

    def value(c: str) -> Column:
        was, now = F.col(f"b.{c}"), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
        if c in keys:
            return F.coalesce(was, now)
        if c in preserve or c not in incoming.columns:
            return F.when(old_row, was).otherwise(now)
        if c in fill:
            return F.when(new_row & now.isNotNull(), now).otherwise(was)
        return F.when(new_row, now).otherwise(was)

    return there.join(new, on, "full").select(*(value(c).alias(c) for c in base.columns))


def replace_children(base: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that come in are replaced by the incoming ones; a parent may come in without any."""
    return base.join(incoming.select(parent).distinct(), parent, "left_anti").select(*base.columns).unionByName(incoming.select(*base.columns))


def numbered(rows: DataFrame, name: str, after: int, *order: Column | str) -> DataFrame:
    """``rows`` with a column ``name`` that counts them in order from ``after`` + 1; ``order`` must be total. Rows are counted inside
    ranges, and the ranges' counts, one row each, are added up, so that no task orders all rows."""
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    starts = F.broadcast(counts.select("__part", before.alias("__before")))
    return ranged.withColumn("__inside", inside).join(starts, "__part").withColumn(name, (F.lit(after) + F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__before", "__inside")


def overlap_since(reference: Column, crawl: Column) -> Column:
    """Start of an incremental scan: the crawl less the hours since the reference, rounded up, two at least."""
    hours = F.greatest(F.lit(2), F.ceil((F.unix_micros(crawl) - F.unix_micros(reference)) / F.lit(3_600_000_000)))
    return F.timestamp_micros(F.unix_micros(crawl) - hours * F.lit(3_600_000_000))


def stale_open(threads: DataFrame, crawl_start: str) -> DataFrame:
    """Open threads that the crawl has not seen."""
    open_ = (F.col("state") == "open") & F.col("closed_at_local").isNull()
    return threads.where(open_ & (F.col("last_pulled_at").isNull() | (F.col("last_pulled_at") < crawl_start)))


def newest_values(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the newest non-null value of each column."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c) for c in columns))


def batches(rows: DataFrame, group: str, order: str, tokens: str, most_items: int, most_tokens: int) -> DataFrame:
    """Number the request batches of each group: in order, closed by a count or by a sum of tokens.

    The rule is sequential, so it runs as a stream over the sorted group: a fold that holds one batch's state and not the group.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    schema = rows.select(group, order, tokens).withColumn("batch", F.lit(0).cast("int")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total, number = object(), 0, 0, -1
        for part in parts:
            out = []
            for g, t in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if g != at:
                    at, n, total, number = g, 0, 0, 0
                elif n >= most_items or (n and total + t > most_tokens):
                    n, total, number = 0, 0, number + 1
                n, total = n + 1, total + t
                out.append(number)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.int32())], names=[f.name for f in schema])

    return rows.select(group, order, tokens).repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


class SnapshotStore:
    """Tables as immutable versions with an atomically replaced pointer, on any file system that Spark can write to; one writer a table."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self, name: str) -> int | None:
        path = self._path(f"{name}/_CURRENT")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["version"]
        finally:
            stream.close()

    def _point(self, name: str, number: int) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        staged, current = self._path(f"{name}/_NEXT"), self._path(f"{name}/_CURRENT")
        files = staged.getFileSystem(conf)
        out = files.create(staged, True)
        out.write(bytearray(json.dumps({"version": number}), "utf-8"))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(staged), files.makeQualified(current), over)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={self.version(name)}")

    def write(self, name: str, df: DataFrame) -> int:
        """Stage a whole new version, then flip the pointer; readers keep the version that they resolved."""
        number = (self.version(name) or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={number}")
        self._point(name, number)
        return number

    def merge(self, name: str, incoming: DataFrame, keys: list[str], preserve: list[str] = (), fill: list[str] = ()) -> int:
        if self.version(name) is None:
            return self.write(name, incoming)
        return self.write(name, upsert(self.read(name), incoming, keys, preserve, fill))


def first_snapshot(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The oldest row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("content_hash",) if c in rows.columns)))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
