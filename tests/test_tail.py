"""Logs that grow: marks, ranges, splits, ingest and streams of them, context over splits."""

import json
import os
import random
import re

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tallyforge.plans import ingest
from tallyforge.sources import context, logs, tail
from tallyforge.streaming import live

A, B = "0198aaaa-bbbb-4ccc-8ddd-000000000001", "0198aaaa-bbbb-4ccc-8ddd-000000000002"
PATTERN = r"\.jsonl$"
CLAUDE, CODEX = logs.PROVIDERS["claude_code"], logs.PROVIDERS["codex"]


def claude(name, n, at="2026-03-08T12:00:00Z"):
    return json.dumps({"type": "assistant", "timestamp": at, "message": {"id": name, "model": "m-1", "usage": {"input_tokens": n, "output_tokens": 1}}})


def codex(kind, at="2026-03-11T15:36:16Z", **payload):
    return json.dumps({"type": kind, "timestamp": at, "payload": payload})


def count(n):
    stamp = f"2026-03-11T15:{n // 60 % 60:02}:{n % 60:02}Z"
    return codex("event_msg", stamp, type="token_count", info={"last_token_usage": {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 1, "reasoning_output_tokens": 0}})


clock = iter(range(1_800_000_000, 1_900_000_000, 10))


def put(path, text, mode="w"):
    """Write or append, and move the file's time on."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, newline="") as file:
        file.write(text)
    now = next(clock)
    os.utime(path, (now, now))


def lines_read(root, ranges, size):
    out = []
    for part in tail.splits(ranges, size):
        with fs.LocalFileSystem().open_input_file(part.path) as file:
            out += [line.decode() for _, line in tail.lines_of(file, part)]
    return out


def step(root, marks):
    marks, ranges = tail.survey(str(root), PATTERN, marks)
    return marks, [(os.path.basename(r.path), r.start, r.end) for r in ranges], ranges


def test_only_new_bytes_after_an_append(tmp_path):
    f = tmp_path / "a.jsonl"
    put(f, '{"a":1}\n{"a":2}\n')
    marks, found, _ = step(tmp_path, {})
    assert found == [("a.jsonl", 0, 16)]
    assert step(tmp_path, marks)[1] == []
    put(f, '{"a":3}\n', "a")
    marks, found, ranges = step(tmp_path, marks)
    assert found == [("a.jsonl", 16, 24)] and lines_read(tmp_path, ranges, 1 << 20) == ['{"a":3}']
    os.utime(f, (1, 1))  # touched, not changed
    assert step(tmp_path, marks)[1] == []


def test_files_whose_line_has_gone_are_read_whole(tmp_path):
    f = tmp_path / "a.jsonl"
    put(f, '{"a":1}\n{"a":2}\n{"a":3}\n')
    marks, *_ = step(tmp_path, {})
    put(f, '{"a":3}\n')  # compacted
    marks, found, _ = step(tmp_path, marks)
    assert found == [("a.jsonl", 0, 8)]
    put(f, '{"b":9}\n{"b":8}\n')  # rewritten, longer
    marks, found, _ = step(tmp_path, marks)
    assert found == [("a.jsonl", 0, 16)]
    put(f, "")
    marks, found, _ = step(tmp_path, marks)
    assert found == []
    put(f, '{"c":1}\n')
    assert step(tmp_path, marks)[1] == [("a.jsonl", 0, 8)]
    (tmp_path / "notes.txt").write_text("{}\n")
    put(tmp_path / "sub" / "b.jsonl", '{"d":1}\n')
    assert step(tmp_path, step(tmp_path, marks)[0])[1] == []


def test_torn_lines_wait(tmp_path):
    f = tmp_path / "a.jsonl"
    put(f, '{"a":1}\n{"a":')
    marks, found, _ = step(tmp_path, {})
    assert found == [("a.jsonl", 0, 8)]
    put(f, "2}", "a")  # whole now, though without a line end
    marks, found, ranges = step(tmp_path, marks)
    assert found == [("a.jsonl", 8, 15)] and lines_read(tmp_path, ranges, 4) == ['{"a":2}']
    put(f, '\n{"a":3}\n', "a")
    marks, found, ranges = step(tmp_path, marks)
    assert found == [("a.jsonl", 15, 24)] and [x for x in lines_read(tmp_path, ranges, 3) if x] == ['{"a":3}']
    put(tmp_path / "b.jsonl", '{"a"')
    assert step(tmp_path, marks)[1] == []


def test_long_last_lines_are_found_backwards(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BACK", 7)
    f, long = tmp_path / "a.jsonl", '{"x":"' + "y" * 200 + '"}'
    put(f, f'{{"a":1}}\n{long}\n{long[:50]}')
    marks, found, _ = step(tmp_path, {})
    mark = marks[str(f)]
    assert found == [("a.jsonl", 0, 8 + len(long) + 1)] and mark.size == len(long) + 1


@pytest.mark.parametrize("size", [1, 2, 7, 50, 10_000])
def test_every_line_is_in_one_split(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "BLOCK", 16)
    rng = random.Random(size)
    text = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 0, 1, 3, 40]))) for _ in range(60)]
    f = tmp_path / "a.jsonl"
    for end in ("\n", ""):
        put(f, "\n".join(text) + end)
        whole = [tail.Range(str(f), 0, f.stat().st_size, 0)]
        want = f.read_text().split("\n")
        assert lines_read(tmp_path, whole, size) == (want[:-1] if want[-1] == "" else want)


def test_ingest_reads_new_bytes_alone(spark, tmp_path):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    f = root / "projects" / "p" / f"{A}.jsonl"
    put(f, claude("m1", 1) + "\n" + claude("m2", 2) + "\n")
    run = lambda: ingest.ingest_tail(spark, {"claude_code": str(root)}, table)
    assert run() == 2
    manifest = tail.read_manifest(f"{table}-offsets/claude_code.jsonl")
    assert manifest.read == {str(f): f.stat().st_size} and run() == 0
    before, added = f.stat().st_size, claude("m2", 5, "2026-03-09T12:00:00Z") + "\n" + claude("m3", 7) + "\n"
    put(f, added, "a")
    assert run() == 2
    assert tail.read_manifest(f"{table}-offsets/claude_code.jsonl").read == {str(f): f.stat().st_size - before} == {str(f): len(added)}
    rows = {r.message_id: (r.input_tokens, str(r.event_date)) for r in ingest.read_events(spark, table).collect()}
    assert rows == {"m1": (1, "2026-03-08"), "m2": (5, "2026-03-09"), "m3": (7, "2026-03-08")}
    put(f, claude("m3", 7) + "\n" + claude("m4", 4) + "\n")  # compacted: read whole, known events are left out
    assert run() == 1 and ingest.read_events(spark, table).count() == 4
    assert not (tmp_path / "table-staging").exists() or not list((tmp_path / "table-staging").iterdir())


def test_a_failed_ingest_is_repeated(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    f = root / "projects" / "p" / f"{A}.jsonl"
    put(f, claude("m1", 1) + "\n")
    ingest.ingest_tail(spark, {"claude_code": str(root)}, table)
    put(f, claude("m2", 2) + "\n", "a")
    monkeypatch.setattr(ingest, "write_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.ingest_tail(spark, {"claude_code": str(root)}, table)
    monkeypatch.undo()
    assert ingest.ingest_tail(spark, {"claude_code": str(root)}, table) == 0  # read again, known already
    assert {r.message_id for r in ingest.read_events(spark, table).collect()} == {"m1", "m2"}


def test_context_of_lines_read_earlier(spark, tmp_path):
    root, table = tmp_path / "logs", str(tmp_path / "table")
    f = root / "sessions" / f"rollout-{B}.jsonl"
    put(f, "\n".join([codex("session_meta", id=B, cwd="/home/me"), codex("turn_context", model="g-5"), count(1)]) + "\n")
    run = lambda: ingest.ingest_tail(spark, {"codex": str(root)}, table)
    assert run() == 1
    put(f, count(2) + "\n", "a")
    assert run() == 1
    put(f, count(3) + "\n" + codex("turn_context", model="g-6") + "\n" + count(4) + "\n", "a")
    assert run() == 2
    put(f, count(5) + "\n", "a")
    assert run() == 1
    rows = sorted((r.input_tokens, r.model, r.session_id, r.project) for r in ingest.read_events(spark, table).collect())
    assert rows == [(n, m, B, "/home/me") for n, m in ((1, "g-5"), (2, "g-5"), (3, "g-5"), (4, "g-6"), (5, "g-6"))]


def slow_context(rows):
    """(n, model, session) of the counts of one file, line by line."""
    model, session, out = "unknown", None, []
    for kind, value in rows:
        if kind == "model":
            model = value
        elif kind == "session":
            session = value
        else:
            out.append((value, model, session))
    return out


def test_context_over_splits_equals_line_by_line(spark, tmp_path):
    rng, want = random.Random(6), []
    for number in range(3):
        name = f"0198aaaa-bbbb-4ccc-8ddd-{number:012}"
        rows = [("session", f"s{number}")] if number else []
        for i in range(400):
            # Long stretches without context, so that splits have none of their own.
            rows.append(rng.choice([("model", f"g{rng.randrange(9)}"), ("session", f"s{rng.randrange(9)}")]) if rng.random() < 0.01 else ("count", number * 1000 + i))
        text = {"model": lambda v: codex("turn_context", model=v), "session": lambda v: codex("session_meta", id=v, cwd="/c"), "count": count}
        put(tmp_path / "sessions" / f"rollout-{name}.jsonl", "".join(text[k](v) + "\n" for k, v in rows))
        want += [(n, m, s or name) for n, m, s in slow_context(rows)]
    for size in (900, 5_000, 1 << 20):
        lines = tail.tail(spark, str(tmp_path), CODEX.file_pattern, CODEX.needles, split_bytes=size)
        found = sorted((r.input_tokens, r.model, r.session_id) for r in CODEX.parse(lines).collect())
        assert found == sorted(want)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        assert sorted((r.input_tokens, r.model, r.session_id) for r in logs.read_codex_logs(spark, str(tmp_path)).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_task_reads_more_than_a_split(spark, tmp_path):
    """One file of all lines: what each task reads, and that no line is shuffled."""
    put(tmp_path / "sessions" / f"rollout-{B}.jsonl", codex("turn_context", model="g") + "\n" + "".join(count(i) + "\n" for i in range(3000)))
    size = 1 << 16
    lines = tail.tail(spark, str(tmp_path), CODEX.file_pattern, CODEX.needles, split_bytes=size)
    held = lines.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("value") + 1).alias("bytes"), F.countDistinct("split").alias("splits"))
    rows = held.collect()
    assert len(rows) > 5 and all(r.bytes <= size + 400 and r.splits == 1 for r in rows)
    events = CODEX.parse(lines)
    assert events.count() == 3000 and events.where("model = 'g'").count() == 3000
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_file" not in plan


def test_filling_goes_on_over_batches(spark):
    rows = [("f", 0, i, "a" if i == 2 else None) for i in range(50)] + [("f", 9, 100 + i, "b" if i == 20 else None) for i in range(50)] + [("g", 0, 7, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "source_file string, split long, line_no long, c string").coalesce(1)
        found = {(r.source_file, r.line_no): r.c for r in context.filled(df, ["c"]).collect()}
        both = {(r.source_file, r.line_no): r.c for r in context.carried(df, ["c"], context.split_ends(df, ["c"])).collect()}
        numbers = {(r.source_file, r.split, r.line_no) for r in context.numbered(df.drop("line_no")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(found["f", i] == ("a" if i >= 2 else None) and found["f", 100 + i] == ("b" if i >= 20 else None) for i in range(50))
    assert all(both["f", i] == ("a" if i >= 2 else None) and both["f", 100 + i] == ("b" if i >= 20 else "a") for i in range(50)) and both["g", 7] is None
    assert numbers == {("f", 0, i + 1) for i in range(50)} | {("f", 9, i + 51) for i in range(50)} | {("g", 0, 1)}


def test_stream_follows_files_and_restarts(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    f, g = (root / "projects" / "p" / f"{x}.jsonl" for x in (A, B))
    sink = lambda df, e: df.write.mode("overwrite").parquet(f"{out}/epoch={e}")

    def start():
        return live.fan_out(live.tail_usage(spark, str(root), CLAUDE), [sink], str(tmp_path / "ck"), processingTime="0 seconds")

    put(f, claude("m1", 1) + "\n")
    query = start()
    query.processAllAvailable()
    put(f, claude("m2", 2) + "\n" + claude("m3", 3)[:20], "a")
    query.processAllAvailable()
    put(f, claude("m3", 3)[20:] + "\n", "a")
    put(g, claude("m4", 4) + "\n")
    query.processAllAvailable()
    query.stop()
    put(f, claude("m5", 5) + "\n", "a")
    query = start()
    query.processAllAvailable()
    put(g, claude("m6", 6) + "\n", "a")
    query.processAllAvailable()
    query.stop()
    rows = [(r.message_id, r.input_tokens) for r in spark.read.parquet(f"{out}/epoch=*").collect()]
    assert sorted(rows) == [(f"m{i}", i) for i in range(1, 7)]


def test_stream_context_outlives_batches_and_is_dropped(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    names = [f"0198aaaa-bbbb-4ccc-8ddd-{k:012}" for k in range(3)]
    files = [root / "sessions" / f"rollout-{n}.jsonl" for n in names]
    sink = lambda df, e: df.write.mode("overwrite").parquet(f"{out}/epoch={e}")

    def run(**limits):
        lines = live.tail_usage(spark, str(root), CODEX)
        live.carry_stream(lines, CODEX, sink, str(tmp_path / "state"), str(tmp_path / "ck"), availableNow=True, **limits).awaitTermination()
        return {r.input_tokens: (r.model, r.session_id) for r in spark.read.parquet(f"{out}/epoch=*").collect()}

    for k, f in enumerate(files):
        put(f, codex("session_meta", id=f"s{k}", cwd="/c") + "\n" + codex("turn_context", model=f"g{k}") + "\n" + count(k) + "\n")
    assert run() == {k: (f"g{k}", f"s{k}") for k in range(3)}
    put(files[0], count(10) + "\n", "a")
    assert run()[10] == ("g0", "s0")
    put(files[1], count(11) + "\n", "a")
    assert run(most_files=2)[11] == ("g1", "s1")  # three files are known: half of two stay
    assert spark.read.parquet(f"{tmp_path}/state/epoch=2").count() == 1
    assert not (tmp_path / "state" / "epoch=0").exists()
    put(files[1], count(12) + "\n", "a")
    put(files[2], count(13) + "\n", "a")
    found = run(ttl_ms=10**9)
    assert found[12] == ("g1", "s1") and found[13] == ("unknown", names[2])


def test_changes_of_versions_over_batches(spark, tmp_path):
    """Versions arrive in three batches, some of them late; a lost race comes back when the file that
    won it goes on with an earlier time."""
    from tallyforge.plans.stream_catalog import ROCKSDB
    from tallyforge.schema import COUNTERS

    schema = "provider string, message_id string, ts_ms long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", model string, source_file string, ingest_seq long, line_no long"
    batches = [
        [("p", "a", 100, 1, 0, 0, 0, "m", "f1", 1, 1), ("p", "a", 200, 2, 0, 0, 0, "m", "f1", 1, 2), ("p", "b", 5, 7, 0, 0, 0, None, "f1", 1, 3), ("p", None, 5, 7, 0, 0, 0, None, "f1", 1, 4)],
        [("p", "a", 300, 3, 0, 0, 0, "m", "f2", 1, 1), ("p", "a", 90, 9, 0, 0, 0, "m", "f1", 1, 1)],
        [("p", "a", 150, 4, 0, 0, 0, "m", "f2", 1, 2), ("p", "b", 5, 7, 0, 0, 0, None, "f1", 1, 3)],
    ]
    setting = "spark.sql.streaming.stateStore.providerClass"
    before, found = spark.conf.get(setting), []
    spark.conf.set(setting, ROCKSDB)
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            stream = live.stream_replaced(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), ttl_ms=None)
            sink = lambda df, e: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{e}")
            live.fan_out(stream, [sink], str(tmp_path / "ck"), availableNow=True).awaitTermination()
            found.append(sorted(((r.message_id, r.input_tokens, r.old_input_tokens) for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect()), key=str))
    finally:
        spark.conf.set(setting, before)
    assert found == [[("a", 1, None), ("a", 2, 1), ("b", 7, None)], [("a", 3, 2)], [("a", 2, 3)]]


class _Listed:
    """A list state, as a processor sees it."""

    def __init__(self):
        self.values = []

    def get(self):
        return iter(list(self.values))

    def put(self, values):
        self.values = list(values)

    def appendList(self, values):
        self.values += values


def test_changes_of_many_messages_in_one_call(monkeypatch):
    """All messages of a group are one call and one state; each changes as it would alone."""
    import pandas as pd

    rng, state = random.Random(7), _Listed()
    versions = live.Versions(None)
    versions.init(type("Handle", (), {"getListState": lambda self, *a: state})())
    monkeypatch.setattr(live, "_TOGETHER", 7)
    held, rank = {}, lambda r: (r[9], r[2], r[8])
    for epoch in range(4):
        rows = list({(f"m{rng.randrange(40)}", f"f{rng.randrange(3)}", rng.randrange(60)): None for _ in range(150)})
        rows = [("p", m, rng.randrange(1000), n, 0, 0, None if n % 3 else 2, "g", f, 1 + epoch // 2, n) for m, f, n in rows]
        want = []
        for row in sorted(rows, key=lambda r: (r[9], r[8], r[10])):
            files = held.setdefault(row[1], {})
            own, before = files.get(row[8]), max(files.values(), key=rank, default=None)
            if own is None or (own[9], own[10]) < (row[9], row[10]):
                files[row[8]] = row
                now = max(files.values(), key=rank)
                if now != before:
                    want.append((*now, *(before[2:] if before else (None,) * 9)))
        frames = iter([pd.DataFrame(rows[:70], columns=live._NAMES), pd.DataFrame(rows[70:], columns=live._NAMES)])
        found = [tuple(r) for frame in versions.handleInputRows((0,), frames, None) for r in frame.itertuples(index=False)]
        assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(len(json.loads(t)) for (t,) in state.values) <= 2 * sum(map(len, held.values()))


def test_one_log_file_is_written_by_many_tasks(spark, data, tmp_path, monkeypatch):
    from tallyforge.plans import catalog, file_catalog as C
    from tallyforge.sinks import join_files

    joined = {}
    monkeypatch.setattr(C, "EVENTS_OF_TASK", 50)
    monkeypatch.setattr(C, "join_files", lambda spark, root, parts: (joined.update(parts), join_files(spark, root, parts)))
    u = C._events(spark, data)
    rows = catalog.codex_lines(C.in_ranges(u, F.lit(0)))
    root = C.write_logs(rows.select("value", F.lit(0).alias("file"), F.col("line_no").alias("order")), str(tmp_path / "one"), codex=True)
    ((place, parts),) = joined.items()
    assert len(parts) > u.count() / 50 / 2
    want = [r.value for r in catalog.codex_lines(u).orderBy("line_no").collect()]
    assert max(size for _, size in parts) < sum(len(v) + 1 for v in want) / 5
    with open(place) as file:
        assert file.read().splitlines() == want
    C.write_logs(rows.select("value", F.lit(0).alias("file"), F.col("line_no").alias("order")).where("order < 400"), root, codex=True)
    with open(place) as file:  # a shorter version leaves nothing of the longer one
        assert file.read().splitlines() == [r.value for r in catalog.codex_lines(u).where("line_no < 400").orderBy("line_no").collect()]


def test_small_splits_share_tasks(spark, tmp_path):
    text = "".join(f"{i}\n" for i in range(100_000, 130_000))
    put(tmp_path / "sessions" / "a.jsonl", text)
    ranges = tail.survey(str(tmp_path), PATTERN, {})[1]
    planned = tail.splits(ranges, 100)  # 2,100 splits
    assert len(planned) <= tail.MOST_TASKS and max(p.stop - p.start for p in planned) < 1000
    found = [(r.split, r.line_no, r.value) for r in tail.tail(spark, str(tmp_path), PATTERN, split_bytes=100).collect()]
    assert sorted(found) == [(i * 7 // 100 * 100, i * 7, str(100_000 + i)) for i in range(30_000)]
    assert all(p.stop - p.start <= tail.SPLIT for p in tail.splits([tail.Range("a", 0, 100 << 30, 0)], 1 << 16))


def test_events_of_large_logs_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Finding the latest versions takes one shuffle, of as many tasks as the logs' size needs."""
    monkeypatch.setattr(ingest, "LOG_BYTES", 1_000)
    where, seen = tmp_path / "logs" / "projects" / "p" / f"{A}.jsonl", []
    where.parent.mkdir(parents=True)
    line = lambda n: json.dumps({"type": "assistant", "timestamp": f"2024-01-0{1 + n % 3}T00:00:00.{n % 1000:03}Z", "message": {"id": f"m{n % 150}", "model": "m", "usage": {"input_tokens": n}}})
    where.write_text("".join(line(n) + "\n" for n in range(200)))
    plain = ingest.latest
    monkeypatch.setattr(ingest, "latest", lambda df, **given: seen.append(plain(df, **given)) or seen[-1])
    ingest.rebuild(spark, {"claude_code": str(tmp_path / "logs")}, str(tmp_path / "table"))
    plan, tasks = seen[0]._jdf.queryExecution().executedPlan().toString(), -(-where.stat().st_size // 1_000)
    assert plan.count("Exchange hashpartitioning") == 1 and tasks > 20
    assert re.search(r"Exchange hashpartitioning\(message_id#\d+, (\d+)\)", plan).group(1) == str(tasks)
    found = {r.message_id: r.input_tokens for r in ingest.read_events(spark, str(tmp_path / "table")).collect()}
    assert found == {f"m{n % 150}": n for n in range(200)}


def test_batches_that_replace_nothing_are_added(spark, tmp_path):
    """Files of the table stay as they are; a batch with a later version rewrites its day."""
    root, table = tmp_path / "logs", tmp_path / "table"
    f = root / "projects" / "p" / f"{A}.jsonl"
    run = lambda: ingest.ingest_tail(spark, {"claude_code": str(root)}, str(table))
    files = lambda: {p: p.stat().st_mtime_ns for p in table.rglob("*.parquet")}
    put(f, claude("m1", 1) + "\n")
    assert run() == 1
    ingest.keep_rollup(spark, str(table))
    first = files()
    put(f, claude("m2", 2) + "\n" + claude("m3", 3, "2026-03-09T12:00:00Z") + "\n", "a")
    assert run() == 2
    second = files()
    assert first.items() < second.items() and len(second) == 3
    put(f, claude("m1", 9, "2026-03-08T23:00:00Z") + "\n", "a")
    assert run() == 1 and not first.keys() & files().keys()
    rows = sorted((r.message_id, r.input_tokens) for r in ingest.read_events(spark, str(table)).collect())
    assert rows == [("m1", 9), ("m2", 2), ("m3", 3)]
    kept = ingest.read_rollup(spark, str(table)).agg(F.sum("event_count"), F.sum("input_tokens")).first()
    assert tuple(kept) == (3, 14)


def test_growing_logs_are_written_once(spark, data, tmp_path):
    from tallyforge.plans import file_catalog as C

    u, seen = C._events(spark, data), []

    def write(rows, root, append=False):
        seen.append(rows.count())
        return C.claude_logs(rows, root, append)

    for part in (1, 2, 3):
        C._grown(u, str(tmp_path / "grown"), write, part, 3)
    assert sum(seen) == u.count() and min(seen) > 0
    C.claude_logs(u, str(tmp_path / "whole"))
    whole = {p.relative_to(tmp_path / "whole"): p.read_bytes() for p in (tmp_path / "whole").rglob("*.jsonl")}
    assert whole == {p.relative_to(tmp_path / "grown"): p.read_bytes() for p in (tmp_path / "grown").rglob("*.jsonl")}


def test_joined_files_grow_in_stores_that_write_whole_files(spark, tmp_path, monkeypatch):
    from tallyforge import sinks

    monkeypatch.setattr(sinks.fs, "LocalFileSystem", type("Other", (), {}))  # the root counts as another store
    monkeypatch.setattr(sinks, "opened", lambda path: (fs.SubTreeFileSystem("/", fs.FileSystem.from_uri("file:///")[0]), path, "file://"))
    runs = []
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda jobs, n: type("Jobs", (), {"foreach": lambda self, f: runs.extend(map(f, jobs))})())
    for n in (1, 2):
        (tmp_path / f"part{n}").write_text(f"{n}\n")
        sinks.join_files(spark, str(tmp_path), {f"{tmp_path}/a/b.jsonl": [(f"{tmp_path}/part{n}", 2)]}, append=True)
    assert (tmp_path / "a/b.jsonl").read_text() == "1\n2\n" and len(runs) == 2
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b.jsonl"]


def test_blocks_are_cut_into_the_lines_that_a_line_at_a_time_gives(tmp_path, monkeypatch):
    draw, path = random.Random(5), tmp_path / "a.jsonl"
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(tail, "BLOCK", block)
        for _ in range(40):
            text = b"".join(draw.choice([b"a", b"\n", b"\n", b"\r", b"\xff", "é".encode(), b"needle"]) for _ in range(draw.randrange(1, 40)))
            path.write_bytes(text)
            starts = [0, *[n + 1 for n, c in enumerate(text) if c == 10]]
            for needles in ((), ("needle", "a\r")):
                want = [(at, line.rstrip(b"\r").decode("utf-8", "replace")) for at, line in zip(starts, text.split(b"\n")) if line and (not needles or any(n.encode() in line for n in needles))]
                parts = tail.splits([tail.Range(str(path), 0, len(text), 7)], draw.choice([1, 5, 100]))
                rows = [r for p in parts for b in tail.read_split(p, str(tmp_path), needles) for r in b.to_pylist()]
                assert [(r["line_no"], r["value"]) for r in rows] == want


def test_replaced_days_are_renamed(spark, tmp_path):
    from tallyforge.schema import USAGE_EVENTS, complete

    def events(day, n, provider="a:b"):
        row = spark.range(1).select(
            F.lit(provider).alias("provider"), F.lit(f"m{day}").alias("message_id"), F.lit(1_700_000_000_000 + day * 86_400_000).alias("ts_ms"), F.lit("m").alias("model"),
            F.lit("s").alias("session_id"), F.lit("p").alias("project"), F.lit("/f").alias("source_file"),
            *[F.lit(n).alias(c) for c in logs.COUNTERS], F.lit(n).alias("line_no"), F.lit(n).alias("ingest_seq"),
        )
        return complete(row).select(USAGE_EVENTS.names)

    path, staged = str(tmp_path / "table"), str(tmp_path / "staged")
    ingest.write_events(events(0, 1).unionByName(events(1, 1)).unionByName(events(2, 1, "c")), path)
    ingest.write_events(events(1, 5), staged)
    files = {p.name for p in (tmp_path / "staged").rglob("part-*.parquet")}
    gone = [(r.provider, r.event_date) for r in ingest.read_events(spark, path).where("provider = 'c'").collect()]
    ingest._replace_days(spark, staged, path, gone)
    got = ingest.read_events(spark, path)
    assert sorted((r.message_id, r.provider, r.input_tokens) for r in got.collect()) == [("m0", "a:b", 1), ("m1", "a:b", 5)]
    assert files < {p.name for p in (tmp_path / "table").rglob("part-*.parquet")}
    # The whole way: a later version replaces the earlier one, and its day's other files go.
    later = events(1, 9).withColumn("event_key", F.lit("later"))
    assert ingest.ingest(spark, later, path) == 1
    assert sorted((r.message_id, r.input_tokens) for r in ingest.read_events(spark, path).collect()) == [("m0", 1), ("m1", 9)]
