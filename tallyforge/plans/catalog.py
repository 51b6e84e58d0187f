"""Registered queries of the usage engine over the driver's ``events`` table, each with the
DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions.times import DAY_MS
from tallyforge.operators import dedup, lifecycle, pricing, usage as U
from tallyforge.schema import COUNTERS, from_events
from tallyforge.scratch import new_path
from tallyforge.sinks import report_information, report_parts, to_ndjson, write_report
from tallyforge.sources import lines as L
from tallyforge.sources import logs, prometheus
from tallyforge.sources.pricing import parse_pricing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SINCE, UNTIL = "20240105", "20240120"
SINCE_MS, UNTIL_MS = 1_704_412_800_000, 1_705_795_199_000
SEOUL = "Asia/Seoul"  # nine hours ahead, without clock changes

#: The adapter of ``schema.from_events`` in SQL.
EVENTS_SQL = """u AS (SELECT event_id, user_id, CAST(event_id AS VARCHAR) AS message_id, epoch_us(ts) // 1000 AS ts_ms, event_type AS model,
 's' || user_id AS session_id, 'proj-' || (user_id % 7) AS project,
 CASE WHEN event_id % 3 = 0 THEN 'codex' ELSE 'claude_code' END AS provider,
 CAST(round(value * 100) AS BIGINT) AS input_tokens, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS output_tokens,
 event_id % 97 AS cache_creation_input_tokens, user_id * 3 AS cache_read_input_tokens FROM events)"""
COUNTERS_SQL = ", ".join(COUNTERS)
SUMS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)
ALL_SQL = f"{SUMS_SQL}, count(*) AS event_count"
RANGE_SQL = f"ts_ms BETWEEN {SINCE_MS} AND {UNTIL_MS}"
PRICES_SQL = """p AS (SELECT DISTINCT event_type AS model, length(event_type) * 1e-6 AS p_in, length(event_type) * 5e-6 AS p_out,
 CASE WHEN event_type = 'purchase' THEN NULL ELSE length(event_type) * 2e-6 END AS p_new,
 CASE WHEN event_type = 'purchase' THEN NULL ELSE length(event_type) * 1e-7 END AS p_old FROM events WHERE event_type <> 'error')"""
COST_SQL = "input_tokens * p_in + output_tokens * p_out + cache_creation_input_tokens * coalesce(p_new, 0.0) + cache_read_input_tokens * coalesce(p_old, 0.0)"


def with_sql(sql: str | None, prices: bool = False):
    """Register a query of usage events under its function's name, with its SQL."""

    def add(query: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))

        QUERIES[query.__name__] = run
        if sql is not None:
            SQL[query.__name__] = f"WITH {EVENTS_SQL}{', ' + PRICES_SQL if prices else ''} {sql if sql.startswith(',') else 'SELECT ' + sql}"
        return query

    return add


def _bucket_sql(step_s: int) -> str:
    return f"ts_ms // {step_s * 1000} * {step_s * 1000}"


def _period_sql(bucket: str) -> str:
    return f"strftime(epoch_ms({bucket}), '%Y-%m-%dT%H:%M:%S')"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.round("cost", 9))


# Aggregations and buckets


@with_sql(f"model, {ALL_SQL} FROM u GROUP BY model")
def usage_flat(u):
    return U.usage(u)


def _bucketed(name: str, step_s: int, by: tuple[str, ...], names: tuple[str, ...]) -> None:
    b = _bucket_sql(step_s)
    keys = ", ".join(names)
    QUERIES[name] = lambda spark, sf_dir: U.usage(from_events(spark.read.parquet(f"{sf_dir}/events.parquet")), bucket=step_s, by=by)
    SQL[name] = f"WITH {EVENTS_SQL} SELECT {b} AS bucket_ms, {_period_sql(b)} AS period, {keys}, {ALL_SQL} FROM u GROUP BY {b}, {keys}"


_bucketed("usage_bucket_6h", 21_600, (), ("model",))
_bucketed("usage_bucket_by_project", 21_600, ("project", "model"), ("project", "model"))
_bucketed("usage_bucket_90s", 90, ("provider",), ("provider",))
for cadence, seconds in U.CADENCES.items():
    _bucketed(f"report_{cadence}", seconds, (), ("model",))


@with_sql(f"model, {ALL_SQL} FROM u GROUP BY model")
def usage_by_model(u):
    return U.usage(u, by=["model"])


@with_sql(f"session_id, {ALL_SQL} FROM u GROUP BY session_id")
def usage_by_session(u):
    return U.usage(u, by=["session"])


@with_sql(f"project, {ALL_SQL} FROM u GROUP BY project")
def usage_by_project(u):
    return U.usage(u, by=["project"])


@with_sql(f"session_id, model, {ALL_SQL} FROM u GROUP BY session_id, model")
def session_model_report(u):
    return U.usage_by_session(u)


@with_sql(f"model, project, {ALL_SQL} FROM u GROUP BY model, project")
def usage_by_model_project(u):
    return U.usage(u, by=["model", "project"])


@with_sql(f"'(total)' AS model, {ALL_SQL} FROM u")
def agg_sum(u):
    return U.usage(u, agg="sum")


@with_sql(f"{_bucket_sql(86_400)} AS bucket_ms, {_period_sql(_bucket_sql(86_400))} AS period, '(total)' AS model, {ALL_SQL} FROM u GROUP BY {_bucket_sql(86_400)}")
def agg_sum_bucket(u):
    return U.usage(u, agg="sum", bucket=86_400)


_AVG = ", ".join(f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}" for c in COUNTERS)


@with_sql(f"'(avg/event)' AS model, {_AVG}, CAST(1 AS BIGINT) AS event_count FROM u")
def agg_avg(u):
    return U.usage(u, agg="avg")


@with_sql(f"project, {_AVG}, CAST(1 AS BIGINT) AS event_count FROM u GROUP BY project")
def agg_avg_by(u):
    return U.usage(u, agg="avg", by=["project"])


_ZERO = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in COUNTERS)


@with_sql(f"'(count)' AS model, {_ZERO}, count(*) AS event_count FROM u")
def agg_count(u):
    return U.usage(u, agg="count")


@with_sql(f"{_bucket_sql(86_400)} AS bucket_ms, {_period_sql(_bucket_sql(86_400))} AS period, project, {_ZERO}, count(*) AS event_count FROM u GROUP BY {_bucket_sql(86_400)}, project")
def events_count_bucket(u):
    return U.usage(u, metric="events", bucket=86_400, by=["project"])


# Filters


@with_sql(f"model, {ALL_SQL} FROM u WHERE model = 'click' GROUP BY model")
def filter_model(u):
    return U.usage(u, where={"model": "click"})


@with_sql(f"model, {ALL_SQL} FROM u WHERE model IN ('click', 'view') GROUP BY model")
def filter_model_regex(u):
    return U.usage(u, where={"model": U.re_("click|view")})


@with_sql(f"session_id, {ALL_SQL} FROM u WHERE starts_with(session_id, 's1') GROUP BY session_id")
def filter_session_prefix(u):
    return U.usage(u, where={"session": "s1"}, by=["session"])


@with_sql(f"project, {ALL_SQL} FROM u WHERE contains(project, 'j-3') GROUP BY project")
def filter_project_substr(u):
    return U.usage(u, where={"project": "j-3"}, by=["project"])


@with_sql(f"model, {ALL_SQL} FROM u WHERE provider = 'codex' GROUP BY model")
def filter_provider(u):
    return U.usage(u, provider="codex")


@with_sql(f"model, {SUMS_SQL.replace('sum(output_tokens)', '0').replace('sum(cache_creation_input_tokens)', '0')}, count(*) AS event_count FROM u GROUP BY model")
def filter_type_mask(u):
    return U.usage(u, where={"type": U.re_("input|cache_read")})


@with_sql(f"model, {ALL_SQL} FROM u WHERE {RANGE_SQL} GROUP BY model")
def time_range(u):
    return U.usage(u, since=SINCE, until=UNTIL)


_DAYS = _bucket_sql(86_400)


@with_sql(f"{_DAYS} AS bucket_ms, {_period_sql(_DAYS)} AS period, model, {ALL_SQL} FROM u WHERE {RANGE_SQL} AND {_DAYS} < {UNTIL_MS} GROUP BY {_DAYS}, model")
def time_range_bucket(u):
    return U.usage(u, since=SINCE, until=UNTIL, bucket=86_400)


@with_sql(f"model, {ALL_SQL} FROM u WHERE ts_ms BETWEEN {SINCE_MS - 7 * DAY_MS} AND {UNTIL_MS - 7 * DAY_MS} GROUP BY model")
def offset_7d(u):
    return U.usage(u, since=SINCE, until=UNTIL, offset=7 * 86_400)


# Lists, ranges, listings


@with_sql(f"DISTINCT session_id FROM u WHERE {RANGE_SQL}")
def sessions_list(u):
    return U.sessions(u, since=SINCE, until=UNTIL)


@with_sql("DISTINCT session_id FROM u WHERE starts_with(session_id, 's1') AND contains(project, '1')")
def sessions_by_project(u):
    return U.sessions(u, prefix="s1", project="1")


@with_sql("DISTINCT project FROM u WHERE provider = 'codex'")
def projects_list(u):
    return U.projects(u, provider="codex")


@with_sql("min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM u")
def data_range(u):
    return U.data_range(u)


@with_sql(f"model, {ALL_SQL}, grouping(model) = 1 AS is_total FROM u GROUP BY GROUPING SETS ((model), ())")
def totals_row(u):
    return U.with_totals(U.usage(u), ["model"])


@with_sql(f"model, {ALL_SQL} FROM u GROUP BY model")
def merge_summaries(u):
    return U.merge_summaries([U.usage(u, provider=p) for p in ("claude_code", "codex")])


_LIST = f"strftime(epoch_ms(ts_ms) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS local_time, ts_ms, message_id, model, session_id, project, {COUNTERS_SQL}"


@with_sql(f"{_LIST} FROM u WHERE project = 'proj-2' AND {RANGE_SQL.replace(str(SINCE_MS), str(SINCE_MS - 32_400_000)).replace(str(UNTIL_MS), str(UNTIL_MS - 32_400_000))}")
def raw_events(u):
    return U.events(u, where={"project": "proj-2"}, tz=SEOUL, since=SINCE, until=UNTIL)


@with_sql(
    f"{_LIST.replace('INTERVAL 9 HOUR', 'INTERVAL 0 HOUR')}, input_tokens + output_tokens + CASE WHEN provider = 'codex' THEN 0 ELSE cache_creation_input_tokens + cache_read_input_tokens END AS total_tokens, round({COST_SQL}, 9) AS cost FROM u LEFT JOIN p USING (model)",
    prices=True,
)
def raw_events_cost(u):
    return _rounded(U.events(u, pricing=price_list(u)))


@with_sql(f"ts_ms, message_id, model FROM u WHERE {RANGE_SQL} ORDER BY ts_ms, message_id LIMIT 500")
def scan_limit(u):
    return U.scan_limit(u, SINCE, UNTIL, 500).select("ts_ms", "message_id", "model")


@with_sql(f"ts_ms, message_id, model FROM u WHERE (ts_ms, message_id) > ({SINCE_MS}, '5') ORDER BY ts_ms, message_id LIMIT 250")
def keyset_page(u):
    return U.page_after(u, SINCE_MS, "5", 250).select("ts_ms", "message_id", "model")


# Prices and cost


def price_document(u: DataFrame) -> DataFrame:
    """A price list as one JSON document, with an entry per model of ``u``, entries that a
    prefix hides, and a vendor whose prices are not kept."""
    names = u.select(F.col("model")).distinct()
    n = F.length("model")
    vendor = F.when(F.col("model") == "error", "azure").otherwise("anthropic")
    cached = F.col("model") != "purchase"

    def entry(of: Column, scale: Column) -> Column:
        return F.struct(
            of.alias("litellm_provider"), (scale * 1e-6).alias("input_cost_per_token"), (scale * 5e-6).alias("output_cost_per_token"),
            F.when(cached, scale * 2e-6).alias("cache_creation_input_token_cost"), F.when(cached, scale * 1e-7).alias("cache_read_input_token_cost"),
        )

    both = F.array(
        F.struct(F.col("model").alias("key"), entry(vendor, n).alias("value")),
        F.struct(F.concat(F.lit("a/b/"), "model").alias("key"), entry(F.when(F.col("model") == "error", "azure").otherwise("openai"), n + 9).alias("value")),
    )
    # A price list has one row per model; it is one document by nature.
    entries = names.select(F.explode(both).alias("e")).agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return entries.select(F.to_json("m").alias("value"))


def price_list(u: DataFrame) -> DataFrame:
    return parse_pricing(price_document(u))


@with_sql("model, p_in AS input_cost_per_token, p_out AS output_cost_per_token, p_new AS cache_creation_input_token_cost, p_old AS cache_read_input_token_cost FROM p", prices=True)
def pricing_parse(u):
    return price_list(u)


_PER_MODEL = f", m AS (SELECT provider, project, model, {ALL_SQL} FROM u GROUP BY provider, project, model), c AS (SELECT m.*, {COST_SQL} AS cost FROM m LEFT JOIN p USING (model))"


@with_sql(f"{_PER_MODEL} SELECT model, round(sum(cost), 9) AS cost, CAST(sum(event_count) AS BIGINT) AS event_count FROM c GROUP BY model", prices=True)
def cost_by_model(u):
    return _rounded(U.usage(u, metric="cost", pricing=price_list(u)))


@with_sql(f"{_PER_MODEL} SELECT '(total)' AS model, {SUMS_SQL}, CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(cost), 9) AS cost FROM c", prices=True)
def cost_sum(u):
    return _rounded(U.usage(u, agg="sum", pricing=price_list(u)))


@with_sql(f"{_PER_MODEL} SELECT project, {SUMS_SQL}, CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(cost), 9) AS cost FROM c GROUP BY project", prices=True)
def cost_by_project(u):
    return _rounded(U.usage(u, by=["project"], pricing=price_list(u)))


@with_sql(f"message_id, round({COST_SQL}, 9) AS cost FROM u LEFT JOIN p USING (model)", prices=True)
def event_costs(u):
    return _rounded(pricing.with_cost(u, price_list(u)).select("message_id", "cost"))


# Calendar buckets and time formats


@with_sql(f"strftime(epoch_ms(ts_ms) + INTERVAL 9 HOUR, '%Y-%m-%d') AS period, model, {ALL_SQL} FROM u GROUP BY ALL")
def calendar_day_tz(u):
    return U.usage(u, calendar="day", tz=SEOUL)


@with_sql(f"strftime(epoch_ms(ts_ms) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:00') AS period, model, {ALL_SQL} FROM u GROUP BY ALL")
def calendar_hour_tz(u):
    return U.usage(u, calendar="hour", tz=SEOUL)


@with_sql(
    f", d AS (SELECT *, CAST(epoch_ms(ts_ms) + INTERVAL 9 HOUR AS DATE) AS day FROM u), f AS (SELECT *, day - CAST((isodow(day) - 1 - 1 + 7) % 7 AS INTEGER) AS first FROM d) "
    f"SELECT year(first) || '-W' || lpad(CAST((dayofyear(first) - 1) // 7 + 1 AS VARCHAR), 2, '0') AS period, model, {ALL_SQL} FROM f GROUP BY ALL"
)
def calendar_week_tue(u):
    return U.usage(u, calendar="week", tz=SEOUL, week_start=1)


@with_sql(f"strftime(epoch_ms(ts_ms), '%Y-%m') AS period, model, {ALL_SQL} FROM u GROUP BY ALL")
def calendar_month(u):
    return U.report(u, "monthly", calendar=True)


@with_sql(f"strftime(epoch_ms(ts_ms), '%Y') AS period, model, {ALL_SQL} FROM u GROUP BY ALL")
def calendar_year(u):
    return U.report(u, "yearly", calendar=True)


@with_sql(
    ", f AS (SELECT message_id, CASE event_id % 6 WHEN 0 THEN epoch_ms(date_trunc('day', epoch_ms(ts_ms))) - 32400000 WHEN 1 THEN ts_ms // 1000 * 1000 - 32400000 "
    "WHEN 2 THEN ts_ms // 1000 * 1000 WHEN 3 THEN ts_ms WHEN 4 THEN ts_ms // 1000 * 1000 - 32400000 END AS parsed_ms FROM u) SELECT * FROM f"
)
def mixed_time_formats(u):
    kind, ts = F.pmod(F.col("message_id").cast("long"), F.lit(6)), F.col("ts")
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyyMMdd")).when(kind == 1, F.date_format(ts, "yyyyMMddHHmmss"))
        .when(kind == 2, F.floor(F.col("ts_ms") / 1000).cast("string")).when(kind == 3, F.col("ts_ms").cast("string"))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+09:00'")).otherwise("not-a-date")
    )
    return C.normalize_times(u.select("message_id", text.alias("text")), "text", SEOUL, out="parsed_ms").select("message_id", "parsed_ms")


@with_sql(
    f", v AS (SELECT provider, message_id, {COUNTERS_SQL} FROM u) SELECT message_id, input_tokens, output_tokens, cache_read_input_tokens AS cached_input_tokens, "
    "cache_creation_input_tokens AS reasoning_output_tokens, input_tokens + output_tokens AS total_tokens FROM v WHERE provider = 'codex'"
)
def total_tokens_view(u):
    return C.provider_view(u.where("provider = 'codex'").select("message_id", *COUNTERS), "codex")


@with_sql(
    "message_id, strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, ts_ms AS parsed_ms, substr(session_id, 1, 8) AS source, "
    "CASE WHEN input_tokens < 1000 THEN '' || input_tokens ELSE (input_tokens // 1000) || ',' || lpad('' || input_tokens % 1000, 3, '0') END AS shown FROM u"
)
def display_columns(u):
    stamp = F.substring_index("event_key", ":", -3)
    return u.select("message_id", stamp.alias("stamp"), C.iso_to_ms(stamp).alias("parsed_ms"), C.source_label(F.col("source_file")).alias("source"), C.fmt_int(F.col("input_tokens")).alias("shown"))


# Deduplication, upserts, unions


def snapshots(u: DataFrame) -> DataFrame:
    """Every fourth event with two earlier versions, every tenth also in an older file, and every
    14th also in a file of the same ingest: further down there, but five seconds earlier."""
    number = F.col("message_id").cast("long")
    versions = u.withColumn("_v", F.explode(F.when(number % 4 == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(2)))))
    early = versions.withColumns(
        {"ts_ms": F.col("ts_ms") - (2 - F.col("_v")) * 1000, "line_no": number * 3 + F.col("_v"), "ingest_seq": F.lit(2).cast("long")}
        | {c: F.expr(f"{c} div (3 - _v)") for c in COUNTERS}
    ).drop("_v")
    old = u.where(number % 10 == 0).withColumns({"source_file": F.lit("/logs/old.jsonl"), "ingest_seq": F.lit(1).cast("long"), "input_tokens": F.lit(0).cast("long")})
    aside = u.where(number % 14 == 0).withColumns({
        "source_file": F.lit("/logs/aside.jsonl"), "ingest_seq": F.lit(2).cast("long"), "line_no": number * 3 + 1_000_000_000,
        "ts_ms": F.col("ts_ms") - 5000, "input_tokens": F.lit(1).cast("long"),
    })
    return early.unionByName(old).unionByName(aside)


_ROW = f"provider, message_id, ts_ms, model, session_id, project, {COUNTERS_SQL}"
_COLUMNS = ["provider", "message_id", "ts_ms", "model", "session_id", "project", *COUNTERS]


@with_sql(f"{_ROW} FROM u")
def dedup_latest(u):
    return dedup.latest(snapshots(u)).select(_COLUMNS)


@with_sql(f"{_ROW} FROM u")
def dedup_last_per_id(u):
    return dedup.last_per_id(snapshots(u)).select(_COLUMNS)


_FIRST_SQL = "CASE WHEN event_id % 4 = 0 THEN ts_ms - 2000 ELSE ts_ms END"


@with_sql(
    "message_id, ts_ms - 2000 AS ts_ms, ts_ms - 1000 AS replaced_by_ts_ms FROM u WHERE event_id % 4 = 0 UNION ALL SELECT message_id, ts_ms - 1000, ts_ms FROM u WHERE event_id % 4 = 0 "
    f"UNION ALL SELECT message_id, ts_ms, CASE WHEN event_id % 14 = 0 THEN ts_ms - 5000 ELSE {_FIRST_SQL} END FROM u WHERE event_id % 10 = 0 "
    f"UNION ALL SELECT message_id, ts_ms - 5000, {_FIRST_SQL} FROM u WHERE event_id % 14 = 0"
)
def superseded(u):
    return dedup.superseded(snapshots(u)).select("message_id", "ts_ms", "replaced_by_ts_ms")


@with_sql(f"provider, message_id, ts_ms, model, session_id, project, input_tokens + CASE WHEN event_id % 5 = 0 THEN 7 ELSE 0 END AS input_tokens, {', '.join(COUNTERS[1:])} FROM u")
def upsert_batch(u):
    number = F.col("message_id").cast("long")
    batch = u.where(number % 5 == 0).withColumns({"input_tokens": F.col("input_tokens") + 7, "ingest_seq": F.lit(1).cast("long")})
    return dedup.upsert(u, batch).select(_COLUMNS)


@with_sql("message_id, model FROM u WHERE event_id % 3 <> 1")
def only_new(u):
    return dedup.only_new(u, u.where("message_id % 3 = 1")).select("message_id", "model")


@with_sql(f"provider, model, {ALL_SQL} FROM u GROUP BY provider, model")
def provider_union(u):
    both = dedup.union_providers({p: u.where(F.col("provider") == p).drop("provider") for p in ("claude_code", "codex")})
    return U.usage(both, by=["provider", "model"])


@with_sql(f"CASE WHEN event_id % 3 > 0 THEN 'b' ELSE 'a' END AS device, {_ROW} FROM u")
def device_union(u):
    slices = {"a": u.where("message_id % 3 < 2"), "b": u.where("message_id % 3 > 0").withColumn("ingest_seq", F.lit(1).cast("long"))}
    return dedup.union_devices(slices).select("device", *_COLUMNS)


# Sources: lines made of events, then parsed


def claude_lines(u: DataFrame) -> DataFrame:
    """Assistant lines of the events, among other types, synthetic and torn lines."""
    use = F.struct(*[F.col(c) for c in COUNTERS])
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def line(kind: str, model: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.col("message_id").alias("id"), model.alias("model"), use.alias("usage")).alias("message"), stamp.alias("timestamp")))

    good = line("assistant", F.col("model"))
    number = F.col("message_id").cast("long")
    values = F.array(
        good, F.when(number % 5 == 0, line("user", F.col("model"))), F.when(number % 7 == 0, line("assistant", F.lit(logs.SYNTHETIC))),
        F.when(number % 11 == 0, F.substring(good, 1, 60)), F.when(number % 13 == 0, F.replace(good, F.lit('"input_tokens":'), F.lit('"input_tokens":-1'))),
    )
    file = F.concat(F.lit("/logs/projects/"), "project", F.lit("/"), "session_id", F.lit(".jsonl"))
    rows = u.select(F.explode(F.array_compact(values)).alias("value"), file.alias("source_file"), "line_no", "ingest_seq")
    return rows


@with_sql(f"message_id, message_id || ':' || strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS event_key, ts_ms, model, session_id, project, {COUNTERS_SQL} FROM u")
def parse_claude_roundtrip(u):
    return logs.parse_claude(claude_lines(u)).select("message_id", "event_key", "ts_ms", "model", "session_id", "project", *COUNTERS)


def codex_lines(u: DataFrame) -> DataFrame:
    """Per session file: its meta line, a context line at every fifth event, then the count."""
    number, stamp = F.col("message_id").cast("long"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    last = F.struct("input_tokens", "output_tokens", F.col("cache_read_input_tokens").alias("cached_input_tokens"), F.col("cache_creation_input_tokens").alias("reasoning_output_tokens"))

    def line(kind: str, payload: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), stamp.alias("timestamp"), payload.alias("payload")))

    values = F.array(
        line("session_meta", F.struct(F.col("session_id").alias("id"), F.col("project").alias("cwd"))),
        F.when(number % 5 == 0, line("turn_context", F.struct("model"))),
        line("event_msg", F.struct(F.lit("token_count").alias("type"), F.struct(last.alias("last_token_usage")).alias("info"))),
        F.when(number % 7 == 0, line("event_msg", F.struct(F.lit("token_count").alias("type"), F.lit(None).cast("string").alias("info")))),
    )
    file = F.concat(F.lit("/logs/sessions/rollout-"), "session_id", F.lit(".jsonl"))
    rows = u.select(F.posexplode(values).alias("_p", "value"), file.alias("source_file"), (number * 4).alias("_n"), "ingest_seq")
    return rows.where("value IS NOT NULL").select("value", "source_file", (F.col("_n") + F.col("_p")).alias("line_no"), "ingest_seq")


_CARRIED = "coalesce(last_value(CASE WHEN event_id % 5 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'unknown')"


@with_sql(f"session_id || ':' || strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS message_id, ts_ms, {_CARRIED} AS model, session_id, project, {COUNTERS_SQL} FROM u")
def parse_codex_roundtrip(u):
    return logs.parse_codex(codex_lines(u)).select("message_id", "ts_ms", "model", "session_id", "project", *COUNTERS)


@with_sql(f"message_id, session_id, {_CARRIED} AS model FROM u")
def carry_forward(u):
    number = F.col("message_id").cast("long")
    marked = u.withColumn("model", F.when(number % 5 == 0, F.col("model")))
    return L.carry_forward(marked, ["model"]).select("message_id", "session_id", F.coalesce("model", F.lit("unknown")).alias("model"))


@with_sql(f", t AS (SELECT CASE WHEN model = 'error' THEN '(total)' ELSE model END AS model, {SUMS_SQL}, count(*) AS n FROM u GROUP BY ALL) SELECT model, {COUNTERS_SQL}, n * CAST(0.5 AS DOUBLE) AS cost FROM t")
def prometheus_import(u):
    """A response body of per-model series in both forms, made of the events' sums."""
    sums = u.groupBy("model").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("n"))
    label = F.when(F.col("model") != "error", F.col("model"))
    types = ["input", *prometheus.TYPES]

    def series(kind: str | None, value: Column, ranged: bool) -> Column:
        pairs = [("model", label)] + ([("type", F.lit(kind))] if kind else [(prometheus.METRIC_LABEL, F.lit("cost"))])
        metric = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e.value.isNotNull()))
        sample = F.array(F.lit("1704067200"), value.cast("string"))
        old = F.array(F.lit("1704060000"), F.lit("1"))
        none = F.lit(None)
        return F.struct(
            metric.alias("metric"), (none.cast("array<string>") if ranged else sample).alias("value"),
            (F.array(old, sample) if ranged else none.cast("array<array<string>>")).alias("values"),
        )

    each = F.array(*[series(t, F.col(c), i % 2 == 0) for i, (t, c) in enumerate(zip(types, COUNTERS))], series(None, F.col("n") * 0.5, True))
    body = sums.select(F.explode(each).alias("s")).agg(F.collect_list("s").alias("result"))
    return prometheus.parse_prometheus(body.select(F.to_json(F.struct(F.struct("result").alias("data"))).alias("value")))


# Lifecycle and export

NOW_MS = 1_706_659_200_000  # 2024-01-31


@with_sql(f"message_id, ts_ms FROM u WHERE ts_ms >= {NOW_MS - 10 * DAY_MS}")
def retention(u):
    return lifecycle.retain(u, NOW_MS, 10).select("message_id", "ts_ms")


@with_sql(f"ts_ms // 3600000 * 3600000 AS hour_ms, provider, model, {ALL_SQL} FROM u GROUP BY ts_ms // 3600000 * 3600000, provider, model")
def rollup_hourly(u):
    return lifecycle.build_rollup(u)


@with_sql(f"ts_ms // 86400000 * 86400000 AS bucket_ms, model, {ALL_SQL} FROM u GROUP BY ts_ms // 86400000 * 86400000, model")
def usage_from_rollup(u):
    return lifecycle.usage_from_rollup(lifecycle.build_rollup(u), 86_400)


@with_sql(f"ts_ms // 3600000 * 3600000 AS hour_ms, model, {ALL_SQL} FROM u WHERE ts_ms // 3600000 * 3600000 >= {NOW_MS - 20 * DAY_MS} GROUP BY ALL")
def rollup_retention(u):
    kept = lifecycle.retain(lifecycle.build_rollup(u), NOW_MS, 20, time="hour_ms")
    return kept.groupBy("hour_ms", "model").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "event_count")])


@with_sql(
    f"ts_ms, message_id, array_to_string([{COUNTERS_SQL}], ',') AS tokens, '{','.join(COUNTERS)}' AS token_columns, CASE WHEN provider = 'codex' THEN input_tokens + output_tokens "
    f"ELSE {' + '.join(COUNTERS)} END AS usage_total FROM u WHERE (ts_ms, message_id) > ({SINCE_MS}, '') ORDER BY ts_ms, message_id LIMIT 1000"
)
def delta_export(u):
    page = lifecycle.export_after(u, SINCE_MS, "")
    return page.select("ts_ms", "message_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), F.array_join("token_columns", ",").alias("token_columns"), "usage_total")


@with_sql(
    ", d AS (SELECT 'model' AS dimension, model AS name FROM u UNION SELECT 'session_id', session_id FROM u UNION SELECT 'project', project FROM u UNION SELECT 'source_file', '/logs/' || session_id || '.jsonl' FROM u) SELECT * FROM d"
)
def used_dimensions(u):
    return lifecycle.used_dimensions(u)


@with_sql(f"model, CAST(3 * sum(input_tokens) AS BIGINT) AS input_tokens, CAST(3 * count(*) AS BIGINT) AS event_count, CAST(3 * count(DISTINCT message_id) AS BIGINT) AS ids FROM u GROUP BY model")
def replicated(u):
    return lifecycle.replicate(u, 3).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.count("*").alias("event_count"), F.countDistinct("message_id").alias("ids"))


@with_sql("message_id, '{\"message_id\":\"' || message_id || '\",\"model\":\"' || model || '\",\"input_tokens\":' || input_tokens || '}' AS value FROM u")
def ndjson_rows(u):
    return to_ndjson(u.select("message_id", "model", "input_tokens")).withColumn("message_id", F.get_json_object("value", "$.message_id"))


_OWN_SQL = """input_tokens, output_tokens, CASE WHEN provider <> 'codex' THEN cache_creation_input_tokens END AS cache_creation_input_tokens,
 CASE WHEN provider <> 'codex' THEN cache_read_input_tokens END AS cache_read_input_tokens, CASE WHEN provider = 'codex' THEN cache_read_input_tokens END AS cached_input_tokens,
 CASE WHEN provider = 'codex' THEN cache_creation_input_tokens END AS reasoning_output_tokens,
 CASE WHEN provider = 'codex' THEN input_tokens + output_tokens ELSE input_tokens + output_tokens + cache_creation_input_tokens + cache_read_input_tokens END AS total_tokens, event_count AS events"""
_INFO_SQL = "(SELECT strftime(epoch_ms(min(ts_ms)), '%Y-%m-%dT%H:%M:%SZ') || ' ' || strftime(epoch_ms(max(ts_ms)), '%Y-%m-%dT%H:%M:%SZ') FROM u) AS data_range"
_REPORTS_SQL = f""", f AS (SELECT provider, model, {ALL_SQL} FROM u GROUP BY ALL), c AS (SELECT provider, model, round(sum({COST_SQL}), 6) AS cost_usd FROM u JOIN p USING (model) GROUP BY ALL),
 m AS (SELECT provider, {_period_sql(_bucket_sql(86_400))} AS period, model, {ALL_SQL} FROM u GROUP BY ALL),
 d AS (SELECT provider, period, row_number() OVER (PARTITION BY provider ORDER BY period) - 1 AS place FROM m GROUP BY provider, period),
 s AS (SELECT DISTINCT provider, session_id FROM u)
SELECT 'summary' AS report, provider, NULL AS name, row_number() OVER (PARTITION BY provider ORDER BY event_count DESC, model) - 1 AS place, 0 AS at, model, {_OWN_SQL}, cost_usd, {_INFO_SQL}, NULL AS asked, 'mon' AS week
 FROM f LEFT JOIN c USING (provider, model)
UNION ALL SELECT 'daily', provider, period, place, row_number() OVER (PARTITION BY provider, period ORDER BY event_count DESC, model) - 1, model, {_OWN_SQL}, NULL, {_INFO_SQL}, '20240105 {SEOUL}', 'sun' FROM m JOIN d USING (provider, period)
UNION ALL SELECT 'sessions', provider, session_id, row_number() OVER (PARTITION BY provider ORDER BY session_id) - 1, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_INFO_SQL}, NULL, 'mon' FROM s"""


@with_sql(_REPORTS_SQL, prices=True)
def report_documents(u):
    """Documents of three reports, written in parts and read again: each entry with its place."""
    spark = u.sparkSession
    entry = "model string, " + ", ".join(f"{c} long" for c in (*COUNTERS, "cached_input_tokens", "reasoning_output_tokens", "total_tokens", "events")) + ", cost_usd double"
    info = "struct<type string, since string, until string, query_since string, query_until string, timezone string, start_of_week string, generated_at string>"

    def read(parts: DataFrame, rows: str) -> DataFrame:
        path = new_path(spark, "report")
        write_report(parts, path)
        lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("n"))
        whole = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_path", "n", "value"))), lambda x: x.value), "").alias("value"))
        parsed = whole.select(F.from_json("value", f"information {info}, providers map<string,array<{rows}>>").alias("d"))
        return parsed.select("d.information", F.explode("d.providers").alias("provider", "rows")).select("information", "provider", F.posexplode("rows").alias("place", "r"))

    def shown(df: DataFrame, name: Column, at: Column, e: str | None) -> DataFrame:
        fields = [f.split()[0] for f in entry.split(", ")]
        kinds = dict(f.split() for f in entry.split(", "))
        value = [(F.col(f"{e}.{f}") if e else F.lit(None)).cast(kinds[f]).alias(f) for f in fields]
        about = F.col("information")
        asked = F.when(about.query_since.isNotNull(), F.concat_ws(" ", about.query_since, about.timezone))
        return df.select(
            about.type.alias("report"), "provider", name.alias("name"), F.col("place").cast("long").alias("place"), at.cast("long").alias("at"), *value,
            F.concat_ws(" ", about.since, about.until).alias("data_range"), asked.alias("asked"), about.start_of_week.alias("week"),
        ).withColumn("cost_usd", F.round("cost_usd", 6))

    flat = read(report_parts(U.usage(u, by=["provider", "model"], pricing=price_list(u)), report_information(u, "summary")), f"struct<{entry}>")
    daily = read(report_parts(U.usage(u, bucket=86_400, by=["provider", "model"]), report_information(u, "daily", "20240105", tz=SEOUL, week_start=6)), f"struct<period string, usage_per_models array<struct<{entry}>>>")
    sessions = read(report_parts(u.select("provider", F.col("session_id").alias("item")).distinct(), report_information(u, "sessions")), "string")
    models = daily.select("information", "provider", "place", "r.period", F.posexplode("r.usage_per_models").alias("at", "e"))
    parts = [shown(flat, F.lit(None).cast("string"), F.lit(0), "r"), shown(models, F.col("period"), F.col("at"), "e"), shown(sessions, F.col("r"), F.lit(0), None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Order, keys and labels for display


@with_sql(f"model, {ALL_SQL} FROM u GROUP BY model ORDER BY event_count DESC, model LIMIT 3")
def summary_top(u):
    return U.sort_summary(U.usage(u)).limit(3)


@with_sql(f"{_DAYS} AS bucket_ms, {_period_sql(_DAYS)} AS period, model, {ALL_SQL} FROM u GROUP BY {_DAYS}, model ORDER BY period, event_count DESC, model LIMIT 12")
def grouped_top(u):
    return U.sort_grouped(U.usage(u, bucket=86_400)).limit(12)


@with_sql(f"{_period_sql(_DAYS)} || '|' || project || '|' || model AS key, {ALL_SQL} FROM u GROUP BY ALL")
def group_keys(u):
    rows = U.usage(u, bucket=86_400, by=["project", "model"])
    return rows.select(C.group_key(["project", "model"], F.col("period")).alias("key"), *COUNTERS, "event_count")


@with_sql(f"{_DAYS} AS bucket_ms, strftime(epoch_ms({_DAYS}) + INTERVAL 9 HOUR, '%Y-%m-%d') || 'T00:00:00' AS period, model, {ALL_SQL} FROM u GROUP BY {_DAYS}, model")
def report_daily_tz(u):
    return U.report(u, "daily", tz=SEOUL)


@with_sql(
    "message_id, CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 2 = 0 THEN printf('$%.2f', (input_tokens + 1) / 100.0) ELSE printf('$%.4f', (event_id % 99) / 10000.0) END AS shown FROM u"
)
def cost_labels(u):
    number = F.col("message_id").cast("long")
    cost = F.when(number % 7 == 0, F.lit(None)).when(number % 2 == 0, (F.col("input_tokens") + 1) / 100.0).otherwise((number % 99) / 10000.0)
    return u.select("message_id", C.fmt_cost(cost).alias("shown"))


@with_sql(
    "CASE WHEN event_id % 4 = 0 THEN 'codex' WHEN event_id % 4 < 3 THEN 'claude_code' END AS owner, count(*) AS n, min(message_id) AS least FROM u GROUP BY ALL"
)
def owner_of_file(u):
    number, file = F.col("message_id").cast("long"), F.concat(F.lit("0198aaaa-bbbb-4ccc-8ddd-"), F.lpad("message_id", 12, "0"))
    path = (
        # A session file, a file of another name in a provider's folder, and a session file elsewhere.
        F.when(number % 4 == 0, F.concat(F.lit("/home/me/.codex/sessions/2026/rollout-"), file, F.lit(".jsonl")))
        .when(number % 4 == 1, F.concat(F.lit("/home/me/.claude/projects/p/"), F.when(number % 8 == 1, F.concat(file, F.lit("/subagents/agent-x"))).otherwise(file), F.lit(".jsonl")))
        .when(number % 4 == 2, F.concat(F.lit("/home/me/.claude/projects/p/notes-"), "message_id", F.lit(".jsonl")))
        .otherwise(F.concat(F.lit("/x/projects/p/"), file, F.lit(".jsonl")))
    )
    return u.select(logs.owner(path).alias("owner"), "message_id").groupBy("owner").agg(F.count("*").alias("n"), F.min("message_id").alias("least"))


@with_sql("message_id, event_id * 2 + 1 AS line, '{\"id\":' || event_id || '}' AS value FROM u WHERE event_id % 4 <> 0")
def drop_torn(u):
    """Text lines of which every fourth is torn."""
    number = F.col("message_id").cast("long")
    value = F.concat(F.lit('{"id":'), "message_id", F.when(number % 4 == 0, "").otherwise("}"))
    return L.drop_torn(u.select("message_id", (number * 2 + 1).alias("line"), value.alias("value")))


@with_sql(
    "message_id, ts_ms FROM u UNION ALL SELECT message_id, ts_ms + 172800000 FROM u WHERE event_id % 4 = 0 UNION ALL SELECT message_id, ts_ms + 3 * 86400000 FROM u WHERE false"
)
def dedup_horizon(u):
    """Every fourth message comes again after two days, and before that within the hour: with a
    horizon of a day the first is a new row and the second is not."""
    number = F.col("message_id").cast("long")
    early = u.withColumns({"ts_ms": F.col("ts_ms") - 3_600_000, "line_no": F.col("line_no") * 3}).where(number % 8 == 0)
    late = u.withColumns({"ts_ms": F.col("ts_ms") + 2 * DAY_MS, "line_no": F.col("line_no") * 3 + 2}).where(number % 4 == 0)
    now = u.withColumn("line_no", F.col("line_no") * 3 + 1)
    return dedup.latest(early.unionByName(now).unionByName(late), horizon_h=24).select("message_id", "ts_ms")


@with_sql(f"{_PER_MODEL}, s AS (SELECT model, {SUMS_SQL}, round(sum(cost), 9) AS cost FROM c GROUP BY model) SELECT * REPLACE (CASE WHEN model = 'view' THEN 0.5 ELSE cost END AS cost) FROM s", prices=True)
def cost_of_imports(u):
    """Imported sums, one model with a cost of its own (which stays) and one with a cost of zero."""
    sums = u.groupBy("model").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    imported = sums.withColumn("cost", F.when(F.col("model") == "view", 0.5).when(F.col("model") == "click", 0.0))
    return _rounded(pricing.with_cost(imported, price_list(u))).select("model", *COUNTERS, "cost")
