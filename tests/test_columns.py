import pytest
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions.arguments import time_ms

UUID = "0198aaaa-bbbb-4ccc-8ddd-eeeeffff0001"


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_iso(spark):
    texts = ["2026-03-08T12:00:00Z", "2026-03-08T12:00:00.123456789Z", "2025-01-01T09:00:00+09:00", "2026-03-08", "2026-03-08T12:00:00", "2026-13-08T12:00:00Z", "x", None, "1960-01-01T00:00:00+01:00", "1960-01-01T00:00:00Z"]
    assert values(spark, C.iso_to_ms(F.col("t")), texts) == [1772971200000, 1772971200123, 1735689600000, None, None, None, None, None, None, -315619200000]


def test_paths(spark):
    paths = [f"/h/.x/projects/-home-me/{UUID}.jsonl", f"/h/.x/projects/-home-me/{UUID}/subagents/agent-abcdef123456.jsonl", "/other/name.jsonl"]
    assert values(spark, C.session_id(F.col("t"), F.lit("claude_code")), paths) == [UUID, UUID, "name"]
    assert values(spark, C.project_of(F.col("t")), paths) == ["-home-me", "-home-me", "unknown"]
    assert values(spark, C.source_label(F.col("t")), paths) == [UUID[:8], f"{UUID[:8]}/abcdef12", "name"]
    rollout = [f"/h/sessions/2026/rollout-2026-03-12T00-35-10-{UUID}.jsonl", "/h/sessions/plain.jsonl"]
    assert values(spark, C.session_id(F.col("t"), F.lit("codex")), rollout) == [UUID, "plain"]


def test_keys_and_labels(spark):
    row = spark.range(1).select(
        C.message_id(C.event_key(F.lit("m1"), F.lit("2026-01-01T00:00:00Z"))).alias("id"),
        C.bucket_ms(F.lit(-1), 60).alias("before"), C.bucket_label(F.lit(0), 3600).alias("utc"),
        C.bucket_label(F.lit(0), 86_400, "America/New_York").alias("west"),
        C.group_key([]).alias("none"), C.fmt_int(F.lit(1234567)).alias("n"),
        *[C.fmt_cost(F.lit(x).cast("double")).alias(f"c{i}") for i, x in enumerate((1.5, 0.005, 0.0, None))],
        C.calendar_bucket(F.lit("2026-01-01 00:30:00").cast("timestamp"), "week", "UTC", 0).alias("week"),
    ).first()
    assert tuple(row) == ("m1", -60000, "1970-01-01T00:00:00", "1969-12-31T00:00:00", "total", "1,234,567", "$1.50", "$0.0050", "$0.0000", "-", "2025-W52")


def test_totals_and_masks(spark):
    from tallyforge.schema import COUNTERS

    row = spark.createDataFrame([(100, 200, 300, 400)], list(COUNTERS))
    assert C.provider_view(row, "claude_code").first().total_tokens == 1000
    view = C.provider_view(row.selectExpr("100L input_tokens", "200L output_tokens", "50L cache_creation_input_tokens", "400L cache_read_input_tokens"), "codex")
    assert tuple(view.first()) == (100, 200, 400, 50, 300) and view.columns[2:4] == ["cached_input_tokens", "reasoning_output_tokens"]
    assert tuple(C.mask_types(row, "input|cache_read").first()) == (100, 0, 0, 400)
    with pytest.raises(ValueError, match="unknown token type"):
        C.mask_types(row, "bogus")


def test_costs(spark):
    from tallyforge.operators.pricing import with_cost

    prices = spark.createDataFrame([("a", 3e-6, 1.5e-5, 3.75e-6, 3e-7), ("b", 3e-6, 1.5e-5, None, None)], ["model", *C.PRICES.values()])
    rows = spark.createDataFrame([("a", 1000, 500, 200, 3000), ("b", 1000, 500, 9, 9), ("c", 1, 1, 1, 1)], ["model", *C.PRICES])
    costs = {r.model: r.cost for r in with_cost(rows, prices).collect()}
    assert costs["a"] == pytest.approx(0.01215) and costs["b"] == pytest.approx(0.0105) and costs["c"] is None


TIMES = {
    "20260301": 1772323200000, "20260301120000": 1772366400000, "1735689600": 1735689600000, "1735689600000": 1735689600000,
    "2025-01-01T00:00:00Z": 1735689600000, "2025-01-01T09:00:00+09:00": 1735689600000, "2025-01-01T00:00:00": 1735689600000,
}


def test_times(spark):
    texts = [*TIMES, "not-a-date", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.ts_ms for r in C.normalize_times(frame, "t").collect()}
    assert found == TIMES | {"not-a-date": None, "": None, None: None}
    assert C.normalize_times(frame.where("t = '20260301'"), "t", is_until=True).first().ts_ms == 1772409599000
    assert {t: time_ms(t) for t in TIMES} == TIMES and time_ms("20260301", is_until=True) == 1772409599000
    assert time_ms("20260301", "Asia/Seoul") == 1772290800000 and time_ms(5) == 5 and time_ms(None) is None
    for bad in ("not-a-date", "", "2026-02-30", "20260230"):
        with pytest.raises(ValueError):
            time_ms(bad)
    with pytest.raises(ValueError, match="ambiguous"):
        time_ms("2026-11-01T01:30:00", "America/New_York")


def test_labels_and_days_do_not_depend_on_the_session_zone(spark):
    from tallyforge.functions.times import utc_date
    from tallyforge.operators.usage import between_ms

    hours = spark.range(0, 24 * 400, 7).select((F.col("id") * 3_600_000 + 1_700_000_000_123).alias("ts_ms"))
    ts = F.timestamp_millis("ts_ms")
    units = [C.calendar_bucket(ts, u, "America/New_York", 6).alias(u) for u in ("hour", "day", "week", "month", "year")]
    labels = [C.bucket_label(F.col("ts_ms"), 3_600).alias("label"), C.bucket_label(F.col("ts_ms"), 86_400, "Asia/Seoul").alias("date")]
    shown = hours.select("ts_ms", utc_date(F.col("ts_ms")).cast("string").alias("event_date"), C.local_time(ts, "Asia/Seoul").alias("local"), *units, *labels)
    expected, since = sorted(shown.collect()), 1_710_000_000_000
    later = between_ms(shown, since, None).count()
    first = expected[0]
    assert (first.event_date, first.local, first.hour, first.label, first.date) == ("2023-11-14", "2023-11-15T07:13:20", "2023-11-14T17:00", "2023-11-14T22:13:20", "2023-11-15T00:00:00")
    try:
        for zone in ("America/New_York", "Asia/Seoul"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(shown.collect()) == expected
            assert between_ms(shown, since, None).count() == later == sum(r.ts_ms >= since for r in expected)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_do_not_depend_on_the_session_zone(spark):
    texts = ["20240105", "20240105001640", "1704380400000", "2024-01-05T00:00:00+09:00", "2024-01-05T00:00:00", "20241399", "2024-01-05T25:00:00", ""]
    want = [1704380400000, 1704381400000, 1704380400000, 1704380400000, 1704380400000, None, None, None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for zone in ("UTC", "America/New_York", "Asia/Seoul"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.ts_ms for r in C.normalize_times(frame, "t", "Asia/Seoul").orderBy("i").collect()] == want, zone
            ends = C.normalize_times(frame.limit(1), "t", "Asia/Seoul", is_until=True).first()
            assert ends.ts_ms == 1704380400000 + 86_399_000
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
