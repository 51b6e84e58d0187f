"""Every registered query of the engine against its SQL in DuckDB."""

import math
import re

import duckdb
import pytest

import __spark_entry__
from tallyforge import registry


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{data}/events.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows
    if name not in registry.SQL:
        return
    found = con.sql(registry.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_time_filter_reaches_the_scan(spark, tmp_path):
    from tallyforge.operators.usage import usage
    from tallyforge.plans.ingest import read_events, write_events
    from tallyforge.schema import from_events

    path = str(tmp_path / "events")
    write_events(from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = usage(read_events(spark, path), since="20240105", until="20240106", where={"model": "click"}, provider="codex")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan ==") :]
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", scan)
    assert "provider" in filters[1] and "event_date" in filters[1] and "model" in filters[2] and "ts_ms" in filters[2]
    assert "session_id" not in re.search(r"ReadSchema: (\S+)", scan)[1]
