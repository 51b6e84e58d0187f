"""Scalar expressions on usage events, all as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.times import stamp, wall
from tallyforge.schema import COUNTERS, UNKNOWN

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Names of the counters in a type filter.
TYPE_NAMES = dict(zip(("input", "output", "cache_create", "cache_read"), COUNTERS))


def iso_to_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 instant; null unless it has date, time and zone.
    A fraction is cut to milliseconds; an offset form counts only after 1970."""
    cut = F.regexp_replace(text, r"(\.\d{1,6})\d*", "$1")
    ms = F.unix_millis(F.try_to_timestamp(cut))
    return F.when(text.rlike(ISO) & (text.endswith("Z") | (ms > 0)), ms)


def event_key(message_id: Column, stamp: Column) -> Column:
    return F.concat_ws(":", message_id, stamp)


def message_id(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def _above_subagents(path: Column) -> Column:
    """The folder that holds a file's ``subagents`` folder, or the empty string. By cutting
    at slashes: a pattern would be tried at every place of the path."""
    last = F.substring_index(path, "/", -3)
    folder = F.substring_index(F.substring_index(last, "/", 2), "/", -1)
    return F.when(folder == "subagents", F.substring_index(last, "/", 1)).otherwise("")


def session_id(path: Column, provider: Column) -> Column:
    """A sub-agent file belongs to the session two folders up; other files are named by
    their stem, of which codex files use the UUID at the end."""
    stem = _stem(path)
    trailing = F.regexp_extract(stem, rf"({UUID})$", 1)
    above = _above_subagents(path)
    codex = F.when(trailing != "", trailing).otherwise(stem)
    return F.when(provider == "codex", codex).when(above != "", above).otherwise(stem)


def project_of(path: Column, cwd: Column | None = None) -> Column:
    """The folder after ``/projects/``, else the working directory, else ``unknown``."""
    folder = F.regexp_extract(path, r"/projects/([^/]+)", 1)
    known = [F.when(folder != "", folder)] + ([cwd] if cwd is not None else [])
    return F.coalesce(*known, F.lit(UNKNOWN))


def mask_types(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Zero every counter that is not named (a name, names joined by pipes, or a list)."""
    asked = names.split("|") if isinstance(names, str) else list(names)
    if bad := [n for n in asked if n not in TYPE_NAMES]:
        raise ValueError(f"unknown token type: {', '.join(bad)}")
    kept = {TYPE_NAMES[n] for n in asked}
    return df.withColumns({c: F.lit(0).cast("long") for c in COUNTERS if c not in kept})


def provider_view(df: DataFrame, provider: str) -> DataFrame:
    """The four counters under the provider's own names and order, with its total."""
    names = {
        "claude_code": COUNTERS,
        "codex": ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens"),
    }.get(provider, COUNTERS)
    order = (0, 1, 3, 2) if provider == "codex" else (0, 1, 2, 3)
    others = [c for c in df.columns if c not in COUNTERS]
    return df.select(*others, *[F.col(COUNTERS[i]).alias(n) for i, n in zip(order, names)], total_tokens(F.lit(provider)).alias("total_tokens"))


def total_tokens(provider: Column) -> Column:
    """All four counters; for codex, whose other two are parts of them, input and output."""
    i, o, c, r = (F.col(x) for x in COUNTERS)
    return F.when(provider == "codex", i + o).otherwise(i + o + c + r)


def token_array() -> Column:
    return F.array(*[F.col(c) for c in COUNTERS])


def bucket_ms(ts_ms: Column, step_s: int) -> Column:
    """Start of the fixed-width bucket, exact in whole milliseconds."""
    step = F.lit(step_s * 1000)
    return ts_ms - F.pmod(ts_ms, step)


def bucket_label(bucket: Column, step_s: int, tz: str | None = None) -> Column:
    """UTC date and time of a bucket; from a day up and with a zone, the local date of its start."""
    ts = F.timestamp_millis(bucket)
    if step_s >= 86_400 and tz:
        return F.concat(F.to_date(wall(ts, tz)).cast("string"), F.lit("T00:00:00"))
    return stamp(wall(ts))


def calendar_bucket(ts: Column, unit: str, tz: str = "UTC", week_start: int = 0) -> Column:
    """Calendar bucket of local time; ``week_start`` counts from Monday = 0. Weeks are
    numbered within the year of their first day, seven days each from 1 January."""
    local = wall(ts, tz)
    if unit == "week":
        day = F.to_date(local)
        first = F.date_sub(day, F.pmod(F.weekday(day) - week_start, F.lit(7)))
        week = F.floor((F.dayofyear(first) - 1) / 7) + 1
        return F.concat(F.year(first).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    length = {"hour": 13, "day": 10, "month": 7, "year": 4}.get(unit)
    if length is None:
        raise ValueError(f"unknown calendar unit: {unit}")
    label = F.substring(stamp(local), 1, length)
    return F.concat(label, F.lit(":00")) if unit == "hour" else label


def group_key(names: Sequence[str], bucket: Column | None = None) -> Column:
    parts = ([bucket] if bucket is not None else []) + [F.col(n) for n in names]
    return F.concat_ws("|", *parts) if parts else F.lit("total")


def local_time(ts: Column, tz: str = "UTC") -> Column:
    return stamp(wall(ts, tz))


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def source_label(path: Column) -> Column:
    """First eight letters of the file's stem; for a sub-agent, of session and agent."""
    above = _above_subagents(path)
    agent = F.regexp_replace(_stem(path), "^agent-", "")
    return F.when(above != "", F.concat(short_id(above), F.lit("/"), short_id(agent))).otherwise(short_id(_stem(path)))


def fmt_int(n: Column) -> Column:
    return F.format_number(n, 0)


def fmt_cost(cost: Column) -> Column:
    return F.when(cost.isNull(), "-").when(cost < 0.01, F.format_string("$%.4f", cost)).otherwise(F.format_string("$%.2f", cost))


#: Counter and the price per token that it is charged at.
PRICES = {
    "input_tokens": "input_cost_per_token",
    "output_tokens": "output_cost_per_token",
    "cache_creation_input_tokens": "cache_creation_input_token_cost",
    "cache_read_input_tokens": "cache_read_input_token_cost",
}


def event_cost() -> Column:
    """Cost of a row that carries its model's prices; null without a price, and absent
    cache prices count zero."""
    total = reduce(lambda a, b: a + b, [F.col(c) * F.coalesce(F.col(p), F.lit(0.0)) for c, p in PRICES.items()])
    return F.when(F.col("input_cost_per_token").isNotNull(), total)


def normalize_times(df: DataFrame, name: str, tz: str = "UTC", is_until: bool = False, out: str = "ts_ms") -> DataFrame:
    """Epoch milliseconds of a column of mixed time formats: YYYYMMDD (start or, for an
    end, 23:59:59 of the day), YYYYMMDDhhmmss, seconds, 13 digits of milliseconds,
    RFC 3339, or ISO without a zone; local forms are in ``tz``. Null for anything else."""
    text = F.trim(F.col(name))

    def local(*parts: Column | str) -> Column:
        """Milliseconds of a local time, whatever the session's zone is."""
        at = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).try_cast("timestamp_ntz")
        utc = at if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), at)
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc)

    def cut(start: int, length: int = 2) -> Column:
        return F.substring(text, start, length)

    day = (cut(1, 4), "-", cut(5), "-", cut(7))
    return df.withColumn(
        out,
        F.when(text.rlike(r"^\d{8}$"), local(*day, " 23:59:59" if is_until else " 00:00:00"))
        .when(text.rlike(r"^\d{14}$"), local(*day, " ", cut(9), ":", cut(11), ":", cut(13)))
        .when(text.rlike(r"^\d{13}$"), text.try_cast("long"))
        .when(text.rlike(r"^\d{1,12}$"), text.try_cast("long") * 1000)
        .when(text.rlike(ISO), F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{1,6})\d*", "$1"))))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), local(text)),
    )
