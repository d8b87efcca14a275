"""Queries over the nested records of the corpus (problem 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.latest import latest
from threadloom.operators.nested import elements, fields_of, held_by, shred
from threadloom.session import tune
from threadloom.sources.tables import table

#: Record table -> the column that orders the snapshots of a record.
RECORDS = {"threads": "updated_at", "comments": "updated_at_gh", "repositories": "updated_at"}


def nodes(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """Node tables of the current record of every id."""
    tune(spark)
    parts = []
    for name in names or RECORDS:
        stamp = RECORDS[name]
        current = latest(table(spark, root, name).select("id", stamp, "raw_json"), ["id"], stamp, "raw_json")
        parts.append(shred(current, name, "id", "raw_json"))
    return reduce(DataFrame.unionAll, parts)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Every non-null array element of every record."""
    return elements(nodes(spark, root)).select("record_table", "record_id", F.col("path").alias("element_path"))


def p1_shapes(spark: SparkSession, root: str) -> DataFrame:
    """The flat tables that the records hold: for each shape its rows, records and deepest level."""
    return (
        nodes(spark, root).where(F.col("shape") != "").groupBy("record_table", "shape")
        .agg(F.count("*").alias("n_nodes"), F.countDistinct("record_id").alias("n_records"), F.max("level").alias("deepest"))
    )


def p1_labels(spark: SparkSession, root: str) -> DataFrame:
    """One row per label object of a thread, with its parent link."""
    wide = fields_of(nodes(spark, root, "threads"), "labels[]", ["name", "color"])
    return wide.select("record_id", "pre", "post", "position", F.col("path").alias("element_path"), "name", "color")


def p1_reply_depth(spark: SparkSession, root: str) -> DataFrame:
    """Replies by the number of replies that hold them, from interval containment."""
    found = nodes(spark, root, "comments").where((F.col("kind") == "object") & F.col("shape").rlike(r"(^|\.)replies\[\]$"))
    inside = held_by(found, found).groupBy("record_id", "pre").agg(F.count("*").alias("depth"))
    per = found.select("record_id", "pre").join(inside, ["record_id", "pre"], "left")
    return per.groupBy(F.coalesce("depth", F.lit(0)).alias("depth")).agg(F.count("*").alias("n_replies"))


QUERIES = {"p1_found": p1_found, "p1_shapes": p1_shapes, "p1_labels": p1_labels, "p1_reply_depth": p1_reply_depth}

_CURRENT = """
    SELECT 'threads' AS record_table, id, raw_json FROM threads WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, raw_json DESC NULLS LAST) = 1
    UNION ALL SELECT 'comments', id, raw_json FROM comments WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at_gh DESC NULLS LAST, raw_json DESC NULLS LAST) = 1
    UNION ALL SELECT 'repositories', id, raw_json FROM repositories WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, raw_json DESC NULLS LAST) = 1
"""
_TREE = f"""
    WITH cur AS ({_CURRENT}),
    valid AS (SELECT record_table, id, raw_json FROM cur WHERE raw_json IS NOT NULL AND json_valid(raw_json)),
    body AS (
        SELECT record_table, id, CASE WHEN json_type(raw_json) = 'VARCHAR' THEN json_extract_string(raw_json, '$') ELSE raw_json END AS doc
        FROM valid),
    obj AS (SELECT record_table, id, doc FROM body WHERE json_valid(doc) AND json_type(CASE WHEN json_valid(doc) THEN doc ELSE 'null' END) = 'OBJECT'),
    node AS (SELECT record_table, obj.id AS record_id, jt.* EXCLUDE (id), jt.id AS node_id FROM obj, json_tree(obj.doc) AS jt),
    tree AS (SELECT *, replace(substr(fullkey, 3), '"', '') AS p FROM node)
"""
ORACLES = {
    "p1_found": _TREE + r"""
    SELECT record_table, record_id, p AS element_path FROM tree WHERE p LIKE '%]' AND type <> 'NULL'""",
    "p1_shapes": _TREE + r"""
    , shaped AS (SELECT record_table, record_id, regexp_replace(p, '\[[0-9]+\]', '[]', 'g') AS shape,
        length(p) - length(replace(replace(p, '.', ''), '[', '')) + CASE WHEN p LIKE '[%' THEN 0 ELSE 1 END AS level FROM tree WHERE p <> '')
    SELECT record_table, shape, count(*) AS n_nodes, count(DISTINCT record_id) AS n_records, CAST(max(level) AS INTEGER) AS deepest
    FROM shaped GROUP BY ALL""",
    "p1_labels": _TREE + r"""
    , pn AS (SELECT *, row_number() OVER (PARTITION BY record_table, record_id ORDER BY node_id) - 1 AS pre FROM tree WHERE record_table = 'threads'),
    lb AS (SELECT * FROM pn WHERE regexp_matches(p, '^labels\[[0-9]+\]$')),
    inner_ AS (SELECT lb.record_id, lb.p, count(*) AS n FROM lb JOIN tree t ON t.record_table = 'threads' AND t.record_id = lb.record_id AND (starts_with(t.p, lb.p || '.') OR starts_with(t.p, lb.p || '[')) GROUP BY 1, 2)
    SELECT lb.record_id, CAST(pre AS INTEGER) AS pre, CAST(pre + coalesce(n, 0) - 2 AS INTEGER) AS post, CAST(regexp_extract(lb.p, '[0-9]+') AS INTEGER) AS position, lb.p AS element_path,
        json_extract_string(value, '$.name') AS name, json_extract_string(value, '$.color') AS color FROM lb LEFT JOIN inner_ USING (record_id, p)""",
    "p1_reply_depth": _TREE + r"""
    SELECT CAST(len(regexp_extract_all(p, 'replies\[[0-9]+\]')) - 1 AS BIGINT) AS depth, count(*) AS n_replies
    FROM tree WHERE record_table = 'comments' AND type = 'OBJECT' AND regexp_matches(p, '(^|\.)replies\[[0-9]+\]$') GROUP BY 1""",
}
