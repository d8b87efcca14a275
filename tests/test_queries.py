"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
NAMES = sorted(n for n in entry.oracle_sql() if n in entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, tmp_path, name):
    entry.queries()[name](spark, ROOT).write.parquet(f"file://{tmp_path}/out")
    duck.execute(f"create or replace table want as {entry.oracle_sql()[name]}")
    duck.execute(f"create or replace view got as select * from '{tmp_path}/out/*.parquet'")
    columns = [sorted(r[0] for r in duck.execute(f"describe {t}").fetchall()) for t in ("want", "got")]
    assert columns[0] == columns[1]
    cols = ", ".join(columns[0])
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"select {cols} from {a} except all select {cols} from {b}").fetchall() == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
