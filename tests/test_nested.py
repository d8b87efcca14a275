import json
import random

import pytest

from threadloom.operators.nested import elements, fields_of, held_by, label, parse_object, shred


def walk(value, path=""):
    """Plain recursion: paths of the non-null array elements."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if v is not None:
                yield f"{path}[{i}]"
            yield from walk(v, f"{path}[{i}]")


def made(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.4:
        return rng.choice([None, True, 3, 2.5, "x", ""])
    if kind < 0.7:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abcd"): made(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_elements_match_plain_recursion(spark):
    rng = random.Random(3)
    records = [{"a": made(rng), "b": made(rng)} for _ in range(60)]
    rows = [(i, json.dumps(r) if i % 3 else json.dumps(json.dumps(r))) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "id long, raw string")
    got = {(r.record_id, r.path) for r in elements(shred(df, "t", "id", "raw")).collect()}
    assert got == {(i, p) for i, r in enumerate(records) for p in walk(r)}


@pytest.mark.parametrize("text", [None, "", " ", "null", "[1]", "3", '"x"', "{", '{"a": NaN}', '{"a":1} x', '"\\"{}\\""', "{'a':1}", "[" * 100000])
def test_other_text_has_no_nodes(text):
    assert parse_object(text) is None


def test_odd_objects():
    assert parse_object(' {"a":[1,2]}\n') == {"a": [1, 2]}
    assert parse_object('{"a":[1],"a":[2,3]}') == {"a": [2, 3]}
    assert parse_object('{"n":' + "9" * 5000 + "}")["n"] == "9" * 5000
    assert parse_object('"{\\"a\\":[1]}"') == {"a": [1]}


def test_labels_are_intervals():
    nodes = label({"a": [{"b": 1}, [2, None]], "c": {}})
    for x in nodes:
        for y in nodes:
            inside = y[7].startswith(x[7]) and y is not x and (x[7] == "" or y[7][len(x[7])] in ".[")
            assert (x[0] < y[0] and x[1] > y[1]) == inside
    assert sorted(n[1] for n in nodes) == list(range(len(nodes)))


def test_surrogates_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, '{"a\\ud800":["\\udc00"]}', "x", 5)], "id long, raw string, path string, pre int")
    assert elements(shred(df, "t", "id", "raw")).count() == 1
    assert shred(df.limit(0), "t", "id", "raw").count() == 0


def test_flat_tables_and_containment(spark):
    df = spark.createDataFrame([(1, '{"r":[{"k":"a","r":[{"k":"b"},{"z":1}]},{"k":null}]}')], "id long, raw string")
    nodes = shred(df, "t", "id", "raw")
    rows = {r.path: r.k for r in fields_of(nodes, "r[]", ["k"]).collect()}
    assert rows == {"r[0]": "a", "r[1]": None}
    objects = nodes.where("kind = 'object' and shape like 'r%'")
    assert {(r.outer_path, r.path) for r in held_by(objects, objects).select("outer_path", "path").collect()} == {("r[0]", "r[0].r[0]"), ("r[0]", "r[0].r[1]")}
