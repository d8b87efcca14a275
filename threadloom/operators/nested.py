"""Nested JSON records as flat node tables, linked by interval labels.

A depth-first traversal of each record gives every node its pre-order and post-order number. Node ``a`` holds node ``b``
exactly if ``a.pre < b.pre`` and ``a.post > b.post`` in the same record, whatever the depth between them, so the flat
tables need no path arithmetic to be joined.

Defined results: null, empty or invalid JSON, and JSON that holds no object, has no nodes. An object that is written as
JSON text inside a JSON string is unwrapped once. Of a field that is repeated in an object the last value counts. JSON
``null`` is a node of kind ``null``. Lone surrogates become U+FFFD. Nesting beyond the parser's depth (several thousand
levels) counts as invalid.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_table string, record_id long, pre int, post int, level int, parent_pre int, kind string, name string, "
    "position int, path string, shape string, value string"
)
_ARROW = pa.schema([
    ("record_table", pa.string()), ("record_id", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("level", pa.int32()),
    ("parent_pre", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("position", pa.int32()), ("path", pa.string()),
    ("shape", pa.string()), ("value", pa.string()),
])


def _reject(text: str) -> None:
    raise ValueError(text)


class _Long(str):
    """An integer with more digits than Python converts."""


_STRICT = json.JSONDecoder(parse_constant=_reject)
_LONG = json.JSONDecoder(parse_constant=_reject, parse_int=_Long)


def _load(text: str) -> object:
    try:
        return _STRICT.decode(text)
    except json.JSONDecodeError:
        return None
    except RecursionError:
        return None
    except ValueError:
        try:
            return _LONG.decode(text)
        except (ValueError, RecursionError):
            return None


def parse_object(text: str | None) -> dict | None:
    """The object that the text holds, directly or wrapped in a JSON string; otherwise None."""
    if not text:
        return None
    found = _load(text)
    if type(found) is str:
        found = _load(found)
    return found if type(found) is dict else None


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if type(value) is str:
        return "string"
    if type(value) is bool:
        return "boolean"
    if type(value) is dict:
        return "object"
    return "array" if type(value) is list else "number"


def label(record: dict) -> list[list]:
    """Nodes of a record in pre-order: [pre, post, level, parent_pre, kind, name, position, path, shape, value]."""
    root = [0, 0, 0, None, "object", None, None, "", "", None]
    out, post = [root], 0
    stack = [(root, iter(record.items()), False)]
    while stack:
        node, left, listed = stack[-1]
        for key, value in left:
            kind = _kind(value)
            if listed:
                path, shape = f"{node[7]}[{key}]", node[8] + "[]"
            else:
                path = f"{node[7]}.{key}" if node[3] is not None else key
                shape = f"{node[8]}.{key}" if node[3] is not None else key
            scalar = None
            if kind == "string":
                scalar = value
            elif kind == "number":
                scalar = str(value)
            elif kind == "boolean":
                scalar = "true" if value else "false"
            child = [len(out), 0, node[2] + 1, node[0], kind, None if listed else key, key if listed else None, path, shape, scalar]
            out.append(child)
            if kind == "object":
                stack.append((child, iter(value.items()), False))
                break
            if kind == "array":
                stack.append((child, enumerate(value), True))
                break
            child[1] = post
            post += 1
        else:
            node[1] = post
            post += 1
            stack.pop()
    return out


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        clean = (v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values)
        return pa.array(list(clean), pa.string())


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            cols: list[list] = [[] for _ in range(12)]
            for name, rid, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                record = parse_object(text)
                if record is None:
                    continue
                nodes = label(record)
                cols[0] += [name] * len(nodes)
                cols[1] += [rid] * len(nodes)
                for col, values in zip(cols[2:], zip(*nodes)):
                    col += values
            yield pa.RecordBatch.from_arrays([_strings(c) if t.type == pa.string() else pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)


def shred(records: DataFrame, record_table: str, record_id: Column | str, raw: Column | str) -> DataFrame:
    """Node table of one row per JSON value of every record; a narrow, shuffle-free pass over the records.

    ``path`` names the node with positions (``a.b[0]``), ``shape`` without them (``a.b[]``): nodes of one shape form one
    flat table. Other columns of ``records`` play no part, whatever their names.
    """
    pick = lambda c: F.col(c) if isinstance(c, str) else c
    return records.select(F.lit(record_table), pick(record_id).cast("long"), pick(raw)).mapInArrow(_label_batches, NODE_SCHEMA)


def elements(nodes: DataFrame) -> DataFrame:
    """The non-null elements of all arrays."""
    return nodes.where(F.col("position").isNotNull() & (F.col("kind") != "null"))


def of_shape(nodes: DataFrame, shape: str) -> DataFrame:
    """The flat table of one type of node."""
    return nodes.where(F.col("shape") == shape)


def held_by(outer: DataFrame, inner: DataFrame, prefix: str = "outer_") -> DataFrame:
    """``inner`` nodes with each ``outer`` node that contains them, by interval containment inside the record."""
    o = outer.select(*(F.col(c).alias(prefix + c) for c in ("record_table", "record_id", "pre", "post", "path", "value")))
    on = (
        (inner["record_table"] == o[prefix + "record_table"]) & (inner["record_id"] == o[prefix + "record_id"])
        & (o[prefix + "pre"] < inner["pre"]) & (o[prefix + "post"] > inner["post"])
    )
    return inner.join(o, on).drop(prefix + "record_table", prefix + "record_id")


def fields_of(nodes: DataFrame, shape: str, fields: list[str]) -> DataFrame:
    """One row per node of ``shape`` with the scalar fields directly below it as columns; a missing field is null."""
    items = of_shape(nodes, shape).select("record_table", "record_id", "pre", "post", "position", "path")
    below = nodes.where(F.col("name").isin(fields) & F.col("shape").isin([f"{shape}.{f}" if shape else f for f in fields]))
    wide = below.groupBy("record_table", "record_id", F.col("parent_pre").alias("pre")).agg(*(F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in fields))
    return items.join(wide, ["record_table", "record_id", "pre"], "left")
