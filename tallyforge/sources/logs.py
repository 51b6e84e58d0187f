"""Session logs of two providers as usage events, and a registry for more providers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.schema import COUNTERS, UNKNOWN, complete
from tallyforge.sources.context import carried, split_ends
from tallyforge.sources.lines import carry_forward, prefilter, read_lines

CLAUDE_LINE = (
    "type string, timestamp string, cwd string, message struct<id string, model string, usage struct<"
    "input_tokens string, output_tokens string, cache_creation_input_tokens string, cache_read_input_tokens string>>"
)
CODEX_LINE = (
    "type string, timestamp string, payload struct<type string, id string, cwd string, model string, info struct<"
    "last_token_usage struct<input_tokens string, output_tokens string, cached_input_tokens string, reasoning_output_tokens string>>>"
)
SYNTHETIC = "<synthetic>"
CLAUDE_FILE = rf"/projects/.*(?:/{C.UUID}|/{C.UUID}/subagents/agent-[^/]+)\.jsonl$"
CODEX_FILE = r"/sessions/.*\.jsonl$"


def _count(value: Column) -> Column:
    """A counter as text: absent is 0, whole and not negative is its value, else null."""
    return F.when(value.isNull(), F.lit(0)).when(value.rlike(r"^\d{1,18}$"), value.try_cast("long")).cast("long")


def _valid(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """``j``: each line as a struct, parsed once; lines that are not one complete object are
    dropped. As a plain column it would be parsed again for every filter and field that is pushed
    below it; filters stay above a generator."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("j", F.explode(F.array(parsed))).where("j._bad IS NULL")


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``v``: a struct of columns that are filtered by as well as kept. Like ``j`` behind a generator:
    a filter on a plain column is pushed below it, and works the column out a second time."""
    return rows.withColumn("v", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def parse_claude(lines: DataFrame) -> DataFrame:
    """Events of lines (value, source_file, line_no, ingest_seq): assistant lines with usage.
    A line is dropped if its model is synthetic, its time or one of its counters invalid."""
    rows = _parsed(prefilter(lines, ['"assistant"']), CLAUDE_LINE)
    rows = rows.where((F.col("j.type") == "assistant") & F.col("j.message.usage").isNotNull())
    stamp, name = F.col("j.timestamp"), F.col("j.message.id")
    rows = _once(rows, ts_ms=C.iso_to_ms(stamp), **{c: _count(F.col(f"j.message.usage.{c}")) for c in COUNTERS})
    named = rows.select(
        F.lit("claude_code").alias("provider"),
        # An absent id is no identity: such an event stands for itself.
        F.when(F.coalesce(name, F.lit("")) == "", C.event_key(F.col("source_file"), stamp)).otherwise(name).alias("message_id"),
        C.event_key(F.coalesce(name, F.lit("")), stamp).alias("event_key"),
        "v.ts_ms",
        F.coalesce(F.nullif("j.message.model", F.lit("")), F.lit(UNKNOWN)).alias("model"),
        C.session_id(F.col("source_file"), F.lit("claude_code")).alias("session_id"),
        C.project_of(F.col("source_file")).alias("project"),
        "source_file",
        *[f"v.{c}" for c in COUNTERS],
        "line_no",
        "ingest_seq",
    )
    return complete(named.where(F.col("model") != SYNTHETIC).where(_valid(("ts_ms", *COUNTERS))))


USED = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")
CONTEXT = ("ctx_model", "ctx_session", "ctx_cwd")
CONTEXT_NEEDLES = ('"turn_context"', '"session_meta"')
CODEX_NEEDLES = ('"token_count"', *CONTEXT_NEEDLES)


def _context() -> list[Column]:
    kind = F.col("j.type")
    return [
        F.when(kind == "turn_context", F.col("j.payload.model")).alias("ctx_model"),
        F.when(kind == "session_meta", F.col("j.payload.id")).alias("ctx_session"),
        F.when(kind == "session_meta", F.col("j.payload.cwd")).alias("ctx_cwd"),
    ]


def codex_marked(lines: DataFrame) -> DataFrame:
    """Codex lines as narrow rows: a token count's time and counters, a context line's values."""
    rows = _parsed(prefilter(lines, CODEX_NEEDLES), CODEX_LINE)
    counts = (F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count")
    keys = [c for c in ("source_file", "split", "line_no", "ingest_seq") if c in lines.columns]
    return rows.select(
        *keys, F.when(counts, F.col("j.timestamp")).alias("stamp"),
        *[F.when(counts, F.col(f"j.payload.info.last_token_usage.{u}")).alias(u) for u in USED], *_context(),
    )


def codex_ends(lines: DataFrame) -> DataFrame:
    """(source_file, split, context): what each split of codex lines leaves; only context lines
    are parsed."""
    heads = reduce(lambda a, b: a | b, [F.col("value").contains(n) for n in CONTEXT_NEEDLES])
    parsed = F.when(heads, F.from_json("value", CODEX_LINE))
    rows = lines.withColumn("j", F.explode(F.array(parsed))).select("source_file", "split", "line_no", *_context())
    return split_ends(rows, CONTEXT)


def parse_codex(lines: DataFrame, compat: bool = False, ends: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Events of lines (value, source_file, line_no, ingest_seq): token counts with the model,
    session and folder of the latest context lines before them in their file.

    Lines that come from a scan (with ``split``) are carried on split by split, so that a file
    may be of any size; ``ends`` (``codex_ends`` of them as a table) and ``before`` (source_file,
    context: what lines read earlier left) may be given. Other lines meet by file in a window.
    An event's identity is session and time; with ``compat`` the session alone."""
    marked = codex_marked(lines)
    if "split" in lines.columns:
        rows = carried(marked, CONTEXT, codex_ends(lines) if ends is None else ends, before)
    else:
        rows = carry_forward(marked, CONTEXT)
    return codex_rows(rows, compat)


def codex_rows(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Events of narrow rows that carry their context."""
    used = F.struct(F.struct(F.struct(*USED).alias("last_token_usage")).alias("info"))
    return codex_events(rows.where("stamp IS NOT NULL").withColumn("j", F.struct(F.col("stamp").alias("timestamp"), used.alias("payload"))), compat)


def codex_events(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Events of token-count rows that carry their context (ctx_model, ctx_session, ctx_cwd)."""
    use, stamp = "j.payload.info.last_token_usage", F.col("j.timestamp")
    from_path = C.session_id(F.col("source_file"), F.lit("codex"))
    session = F.coalesce(F.nullif("ctx_session", F.lit("")), from_path, F.lit(UNKNOWN))
    key = C.event_key(session, stamp)
    slots = {
        "input_tokens": "input_tokens",
        "output_tokens": "output_tokens",
        "cache_creation_input_tokens": "reasoning_output_tokens",
        "cache_read_input_tokens": "cached_input_tokens",
    }
    counted = rows.where(F.col(f"{use}.input_tokens").isNotNull())
    counted = _once(counted, ts_ms=C.iso_to_ms(stamp), **{slot: _count(F.col(f"{use}.{source}")) for slot, source in slots.items()})
    named = counted.select(
        F.lit("codex").alias("provider"),
        (session if compat else key).alias("message_id"),
        key.alias("event_key"),
        "v.ts_ms",
        F.coalesce("ctx_model", F.lit(UNKNOWN)).alias("model"),
        session.alias("session_id"),
        F.coalesce("ctx_cwd", C.project_of(F.col("source_file"))).alias("project"),
        "source_file",
        *[f"v.{slot}" for slot in slots],
        "line_no",
        "ingest_seq",
    )
    return complete(named.where(_valid(("ts_ms", *COUNTERS))))


def parse_quarantine(lines: DataFrame) -> DataFrame:
    """Lines whose time does not parse; they become no event and can be kept aside."""
    stamp = F.get_json_object("value", "$.timestamp")
    return lines.where(C.iso_to_ms(F.coalesce(stamp, F.lit(""))).isNull())


@dataclass(frozen=True)
class ProviderSpec:
    """A provider: the folder that its files lie in, which files are its logs, how lines become
    events, and whether lines take context from lines before them."""

    name: str
    file_pattern: str
    needles: tuple[str, ...]
    parse: Callable[..., DataFrame]
    folder: str = ""
    context: bool = False


PROVIDERS: dict[str, ProviderSpec] = {
    "claude_code": ProviderSpec("claude_code", CLAUDE_FILE, ('"assistant"',), parse_claude, folder="/.claude/"),
    "codex": ProviderSpec("codex", CODEX_FILE, CODEX_NEEDLES, parse_codex, folder="/.codex/", context=True),
}


def owner(path: Column, specs: Mapping[str, ProviderSpec] = PROVIDERS) -> Column:
    """Name of the first provider whose folder is in a path, or null. Which files of it are logs
    is another question: ``file_pattern``."""
    return F.coalesce(*[F.when(path.contains(s.folder), F.lit(s.name)) for s in specs.values() if s.folder])


def read_provider(spark: SparkSession, root: str, spec: ProviderSpec, modified_after: str | None = None) -> DataFrame:
    lines = read_lines(spark, root, spec.needles, modified_after, numbered=False).where(F.col("source_file").rlike(spec.file_pattern))
    return spec.parse(lines.withColumn("ingest_seq", F.unix_millis("modified")))


def read_claude_logs(spark: SparkSession, root: str) -> DataFrame:
    return read_provider(spark, root, PROVIDERS["claude_code"])


def read_codex_logs(spark: SparkSession, root: str) -> DataFrame:
    return read_provider(spark, root, PROVIDERS["codex"])


def read_logs(spark: SparkSession, roots: Mapping[str, str], specs: Mapping[str, ProviderSpec] = PROVIDERS) -> DataFrame:
    """Events of several providers, by provider name and root folder."""
    return reduce(DataFrame.unionByName, [read_provider(spark, root, specs[name]) for name, root in roots.items()])


def session_files(spark: SparkSession, root: str, provider: str) -> DataFrame:
    """(session_id, parent, agents): each session's file and the files of its sub-agents.
    Only names, sizes and times are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    found = files.select("path", "length", "modificationTime").where(F.col("path").rlike(PROVIDERS[provider].file_pattern))
    agent = F.col("path").contains("/subagents/")
    return found.groupBy(C.session_id(F.col("path"), F.lit(provider)).alias("session_id")).agg(
        F.min(F.when(~agent, F.col("path"))).alias("parent"),
        F.sort_array(F.collect_list(F.when(agent, F.col("path")))).alias("agents"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("modified"),
    )
