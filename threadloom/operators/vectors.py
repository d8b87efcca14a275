"""Usable vectors from their JSON text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec, dims = batch.column(batch.num_columns - 2), np.asarray(batch.column(batch.num_columns - 1).fill_null(-1), np.int64)
        offsets, values = np.asarray(vec.offsets), vec.values
        good = np.isfinite(np.asarray(values.fill_null(np.nan) if values.null_count else values, np.float64))
        some = np.asarray(values.fill_null(0.0) if values.null_count else values, np.float64) != 0
        count = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
        size = np.diff(offsets)
        ok = (size == dims) & (size > 0) & (count(good) == size) & (count(some) > 0)
        if vec.null_count:
            ok &= ~np.asarray(vec.is_null())
        kept = batch.filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=batch.schema.names[:-1])


def usable_rows(rows: DataFrame, keep: list[str], value: str, dimensions: str) -> DataFrame:
    """The ``keep`` columns of the rows whose JSON is an array of exactly ``dimensions`` finite numbers, not all zero, and
    those numbers as ``vec``. The text is parsed once per row; the checks run over whole batches.
    """
    text = F.trim(F.translate(F.col(value), "\t\n\r", "   "))
    whole = text.startswith("[") & (F.instr(text, "]") == F.length(text))
    parsed = rows.where(whole).select(*keep, F.from_json(F.col(value), "array<double>").alias("vec"), F.col(dimensions).cast("long").alias("dims"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema.fields[:-2])
    return parsed.mapInArrow(_usable, f"{kinds}, vec array<double>")


def to_binary(rows: DataFrame, value: str) -> DataFrame:
    """``value``, an array of numbers, as little-endian float32 bytes, a quarter of its JSON text or less; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(value)
            packed = [None if v is None else np.asarray(v, "<f4").tobytes() for v in batch.column(at).to_pylist()]
            cols = [*batch.columns]
            cols[at] = pa.array(packed, pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if f.name == value else f.dataType.simpleString()}" for f in rows.schema.fields))


def from_binary(rows: DataFrame, value: str) -> DataFrame:
    """The reverse of ``to_binary``; bytes that are no whole number of float32 raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(value)
            cols = [*batch.columns]
            cols[at] = pa.array([None if v is None else np.frombuffer(v, "<f4") for v in batch.column(at).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {'array<float>' if f.name == value else f.dataType.simpleString()}" for f in rows.schema.fields))


def migrated(rows: DataFrame, keep: list[str], value: str, dimensions: str, files: int = 0) -> DataFrame:
    """Stored JSON vectors as bytes; unusable ones are left out. ``files`` is how many files the table is to be compacted to, 0 leaves it as it is."""
    out = to_binary(usable_rows(rows, keep, value, dimensions), "vec").withColumnRenamed("vec", value)
    return out.repartition(files) if files else out
