"""Session settings and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def tune(spark: SparkSession, batch_rows: int = 2000) -> SparkSession:
    """Settings that every query relies on; all of them may be set at run time."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows),
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (tests, one machine), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_OPEN: ContextVar[list[Scratch] | None] = ContextVar("open", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """What is written to scratch inside is dropped at the end, so a long-running service does not fill the disk."""
    mine: list[Scratch] = []
    token = _OPEN.set(mine)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for scratch in mine:
            scratch.clear()
            atexit.unregister(scratch.clear)


class Scratch:
    """Tables written into the shared folder, so that a lost executor costs no recomputation of what came before.

    The tables are dropped by name, at the end of the ``scope`` around them unless they are to be kept, or all together
    when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, keep: bool = False) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/threadloom-{uuid.uuid4().hex}"
        atexit.register(self.clear)
        if not keep and (mine := _OPEN.get()) is not None:
            mine.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Write ``df``; the written table and its rows, counted by the writing job itself."""
        seen = Observation()
        saved = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        n = seen.get.get("n")  # missing if the plan turned out to be empty
        return saved, saved.count() if n is None else n

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # the session is gone, and its folder with it
            pass
