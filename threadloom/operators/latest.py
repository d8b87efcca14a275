"""The current row of each record among its snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``, then the greatest ``ties``.

    Rows with a null key are no records and are left out; a null ``order`` is older than any value. The row filter runs
    before the shuffle as well (window group limit), so a hot key costs one row per input partition.
    """
    taken = "__latest"
    while taken in df.columns:
        taken += "_"
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in ties)))
    return df.withColumn(taken, rank).where(F.col(taken) == 1).drop(taken)
