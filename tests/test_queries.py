"""Every query with SQL against an independent engine, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from ridgeline import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in Path(FOLDER).iterdir():
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(names, found):
    return sorted(([plain(r[n]) for n in names] for r in found), key=repr)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, engine, name):
    df = plans.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    result = engine.execute(plans.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert rows(names, [r.asDict() for r in df.collect()]) == rows(names, [dict(zip(columns, r, strict=True)) for r in result.fetchall()])


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the tables")
@pytest.mark.parametrize("parts", ["2", "4", "200"])
def test_batches_do_not_depend_on_partitions_or_size(spark, parts):
    """Tables larger than a sample of bounds, cut in any number of parts."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = plans.QUERIES["location_batches"](spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    with duckdb.connect() as con:
        con.execute("CREATE VIEW customer AS SELECT * FROM '/root/testdata/sf0.01/customer.parquet'")
        wanted = con.execute(plans.ORACLES["location_batches"]).fetchall()
    assert sorted((r["batch"], r["locations"], r["points"]) for r in found) == sorted(wanted)
