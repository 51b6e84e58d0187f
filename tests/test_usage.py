import pytest
from pyspark.sql import functions as F

from tallyforge.operators import dedup, lifecycle
from tallyforge.operators import usage as U
from tallyforge.schema import COUNTERS, complete


@pytest.fixture(scope="module")
def few(spark):
    rows = [
        ("claude_code", "a", 1000, "m1", "s1", "p1", "f1", 100, 50, 10, 20, 1, 0),
        ("claude_code", "b", 2000, "m1", "s1", None, "f1", 100, 50, 10, 20, 2, 0),
        ("codex", "c", 3000, None, "s2", "unknown", "f2", 7, 1, 0, 0, 1, 0),
    ]
    names = f"provider string, message_id string, ts_ms long, model string, session_id string, project string, source_file string, {', '.join(c + ' long' for c in COUNTERS)}, line_no long, ingest_seq long"
    return complete(spark.createDataFrame(rows, names))


def test_sums_and_ranges(few):
    row = U.usage_by_session(few).where("session_id = 's1'").first()
    assert (row.input_tokens, row.event_count) == (200, 2)
    assert U.scan(few, 1000, 2000).count() == 2
    assert [r.message_id for r in U.page_after(few, 1000, "a", 5).collect()] == ["b", "c"]
    assert tuple(U.data_range(few).first()) == (1000, 3000)
    assert {r.model for r in U.usage(few).collect()} == {"m1", None}


def test_edges_of_buckets_and_ranges(few):
    """The range includes its end, a bucket that starts at the end is left out."""
    assert U.usage(few, until=2000, bucket=1).agg(F.max("bucket_ms")).first()[0] == 1000
    assert U.usage(few, until=2000).where("model = 'm1'").first().event_count == 2
    assert U.usage(few, since=2000, until=3000, offset=1).agg(F.sum("event_count")).first()[0] == 2
    assert U.usage(few, offset=1).agg(F.sum("event_count")).first()[0] == 3


def test_folding(few, spark):
    assert [tuple(r) for r in U.usage(few, agg="avg", where={"model": "m1"}).collect()] == [("(avg/event)", 100, 50, 10, 20, 1)]
    assert U.usage(few, agg="count").first().event_count == 3
    assert U.usage(few, agg="sum", where={"model": "none"}).count() == 0
    prices = spark.createDataFrame([("m1", 1.0, 2.0, None, None)], "model string, input_cost_per_token double, output_cost_per_token double, cache_creation_input_token_cost double, cache_read_input_token_cost double")
    assert U.usage(few, agg="sum", pricing=prices).first().cost == 400.0
    assert U.usage(few, agg="avg", pricing=prices, where={"model": "m1"}).first().cost == 200.0
    assert U.usage(few, agg="count", pricing=prices).first().cost == 0.0
    assert {r.project: r.cost for r in U.usage(few, by=["project"], metric="cost", pricing=prices).collect()} == {"p1": 200.0, None: 200.0, "unknown": None}


def test_lists(few):
    assert [r.project for r in U.projects(few).collect()] == ["p1"]
    assert [r.session_id for r in U.sessions(few, prefix="s").collect()] == ["s1", "s2"]
    totals = U.with_totals(U.usage(few, where={"model": "m1"}), ["model"])
    assert totals.count() == 1 and U.with_totals(U.usage(few), ["model"]).where("is_total").first().input_tokens == 207
    assert U.sort_summary(U.usage(few)).first().event_count == 2


@pytest.mark.parametrize("wrong", [
    {"metric": "bogus"}, {"agg": "max"}, {"by": ["host"]}, {"by": ["model", "model"]}, {"bucket": 0}, {"bucket": 5, "calendar": "day"},
    {"metric": "cost"}, {"offset": -1}, {"where": {"since": "1"}}, {"where": {"type": "bogus"}}, {"since": "not-a-date"}, {"calendar": "quarter"},
])
def test_wrong_arguments(few, wrong):
    with pytest.raises(ValueError):
        U.usage(few, **wrong)


def test_latest_and_horizon(few):
    day = 24 * 3_600_000
    again = few.where("message_id = 'a'").withColumns({"ts_ms": F.col("ts_ms") + 2 * day, "line_no": F.lit(9).cast("long"), "input_tokens": F.lit(1).cast("long")})
    both = few.unionByName(again)
    assert {r.message_id: r.input_tokens for r in dedup.latest(both).collect()} == {"a": 1, "b": 100, "c": 7}
    assert dedup.latest(both, horizon_h=24).count() == 4
    older = few.where("message_id = 'a'").withColumns({"source_file": F.lit("z"), "ingest_seq": F.lit(-1).cast("long"), "ts_ms": F.lit(9999).cast("long")})
    assert dedup.latest(few.unionByName(older)).where("message_id = 'a'").first().ts_ms == 1000


def test_retention_and_export(few, spark):
    day = 86_400_000
    rows = spark.createDataFrame([(100 * day,), (10 * day,), (20 * day,)], "ts_ms long")
    assert sorted(r.ts_ms for r in lifecycle.retain(rows, 110 * day, 90).collect()) == [20 * day, 100 * day]
    assert lifecycle.retain(rows, 110 * day, 0).count() == 3
    page = lifecycle.export_after(few, 0, "", n=2)
    assert lifecycle.cursor(page) == (2000, "b") and lifecycle.cursor(page.where("false")) is None
    assert [r.usage_total for r in page.collect()] == [180, 180]
    with pytest.raises(ValueError):
        lifecycle.usage_from_rollup(lifecycle.build_rollup(few), 90)
    assert lifecycle.replicate(few, 4).select("message_id").distinct().count() == 12
    apart = lifecycle.replicate(few, 4, jitter_ms=0).groupBy(F.substring_index("message_id", "-", 1)).agg((F.max("ts_ms") - F.min("ts_ms")).alias("ms"))
    assert {r.ms for r in apart.collect()} == {3 * 30 * day}
