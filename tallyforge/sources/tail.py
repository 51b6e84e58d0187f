"""Logs that grow, read from where the last reading ended: a Python data source of byte ranges.

How far a file has been read is a mark: the end of its last whole line, that line's length and
its hash. A file that still holds the marked line is read from the mark on; one that was
shortened, rewritten or compacted does not, and is read whole again (its known events are left
out later, so nothing counts twice). A last line without a line end is taken if it is one whole
JSON object; otherwise it waits until it is finished.

Ranges are cut into splits of a bounded size, and a line belongs to the split that it starts in,
so one file of any size is read by many tasks; small splits in great number share tasks. ``line_no`` is the place of the line's first byte,
and ``split`` that of its split: both grow along the file. A batch is planned against a manifest of
marks that is replaced once its rows are stored; a stream has the marks as its offset. Either way
the driver holds some 300 bytes for each file, like Spark's own list of files, and looks only into
files whose length or time has changed: at their marked line and at their end.

Files are opened with ``pyarrow.fs``: local and mounted folders, and the stores that it knows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 32 << 20
#: Splits that are tasks of their own; where there are more, a task reads several neighbours of at most
#: ``SPLIT`` bytes, one after the other.
MOST_TASKS = 256
#: Bytes read at once, forwards and backwards, and rows handed on at once.
BLOCK, BACK, ROWS = 1 << 20, 1 << 16, 10_000
LINES = "value string, source_file string, split long, line_no long, modified timestamp, ingest_seq long"


@dataclass(frozen=True)
class Mark:
    """How far a file has been read, and what it was like then."""

    end: int = 0
    size: int = 0
    digest: str = ""
    length: int = -1
    modified_ms: int = -1


@dataclass(frozen=True)
class Range:
    """Bytes of a file from a line's start to a line's end."""

    path: str
    start: int
    end: int
    modified_ms: int


@dataclass
class Split(InputPartition):
    """The lines of a range that start within [start, stop): one split, or neighbours of ``step`` bytes."""

    path: str
    start: int
    stop: int
    end: int
    first: bool
    modified_ms: int
    step: int = SPLIT


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, its path there, and what Spark writes before such a path."""
    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path, "file://"
    system, path = fs.FileSystem.from_uri(root)
    return system, path, f"{parts.scheme}://{parts.netloc}" if not path.startswith(parts.netloc) else f"{parts.scheme}://"


def _digest(line: bytes) -> str:
    return hashlib.blake2b(line, digest_size=8).hexdigest()


def _bytes(file: pa.NativeFile, start: int, end: int) -> bytes:
    file.seek(start)
    return file.read(end - start)


def _line_start(file: pa.NativeFile, end: int) -> int:
    """Where the line that ends before ``end`` starts."""
    at = end
    while at > 0:
        low = max(0, at - BACK)
        found = _bytes(file, low, at).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def whole_object(line: bytes) -> bool:
    """Whether a line is one complete JSON object."""
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def mark_of(file: pa.NativeFile, length: int, modified_ms: int) -> Mark:
    """The mark behind the last whole line of a file."""
    start = _line_start(file, length)
    end = length
    if start < length and not whole_object(_bytes(file, start, length)):
        end = start  # a torn line waits
    if end == start:  # the last whole line ends with a line end
        start = _line_start(file, end - 1) if end else 0
    line = _bytes(file, start, end)
    return Mark(end, len(line), _digest(line), length, modified_ms)


def holds(file: pa.NativeFile, length: int, mark: Mark) -> bool:
    """Whether a file still has the marked line where it was."""
    return mark.end <= length and _digest(_bytes(file, mark.end - mark.size, mark.end)) == mark.digest


def survey(root: str, pattern: str, known: Mapping[str, Mark]) -> tuple[dict[str, Mark], list[Range]]:
    """New marks of all files below a folder, and the ranges that are new since ``known``."""
    system, path, prefix = opened(root)
    files = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    wanted = [f for f in files if f.type == fs.FileType.File and re.search(pattern, f.path)]

    def look(info: fs.FileInfo) -> tuple[str, Mark, Range | None]:
        name, modified = info.path, info.mtime_ns // 1_000_000
        before = known.get(name, Mark())
        if (before.length, before.modified_ms) == (info.size, modified):
            return name, before, None
        with system.open_input_file(name) as file:
            start = before.end if before.size and holds(file, info.size, before) else 0
            mark = mark_of(file, info.size, modified)
        if mark.end < start:  # what stood without a line end was taken, and now looks torn
            mark = Mark(before.end, before.size, before.digest, info.size, modified)
        return name, mark, Range(name, start, mark.end, modified) if mark.end > start else None

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(look, wanted))
    return {name: mark for name, mark, _ in found}, [r for _, _, r in found if r is not None]


def splits(ranges: Sequence[Range], size: int) -> list[Split]:
    number = sum(-(-(r.end - r.start) // size) for r in ranges)
    task = size * max(1, min(-(-number // MOST_TASKS), SPLIT // size))
    return [
        Split(r.path, at, min(at + task, r.end), r.end, at == r.start, r.modified_ms, size)
        for r in ranges
        for at in range(r.start, r.end, task)
    ]


def blocks_of(file: pa.NativeFile, part: Split) -> Iterator[tuple[int, bytes]]:
    """(place, whole lines) of the lines that start within a split, a block of bytes at a time; the
    last line of a range may lack its line end."""
    at = part.start if part.first else part.start - 1
    rest, skipping = b"", not part.first
    file.seek(at)
    while at < part.stop:
        block = file.read(min(BLOCK, part.end - at - len(rest)))
        data = rest + block
        if skipping:  # the line before, which belongs to the split that it starts in
            cut = data.find(b"\n") + 1
            at += cut or len(data)
            if not cut:
                if not block:
                    return
                continue
            data, skipping = data[cut:], False
            if at >= part.stop:
                return
        cut = data.rfind(b"\n") + 1 if block else len(data)
        whole, rest = data[:cut], data[cut:]
        if at + len(whole) > part.stop:
            whole = whole[: whole.find(b"\n", part.stop - 1 - at) + 1 or len(whole)]
        if whole:
            yield at, whole
        if not block:
            return
        at += len(whole)


def lines_of(file: pa.NativeFile, part: Split) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start within a split."""
    for at, data in blocks_of(file, part):
        for line in data.removesuffix(b"\n").split(b"\n"):
            yield at, line
            at += len(line) + 1


def _values(lines: pa.Array, data: bytes) -> pa.Array:
    """Lines as text: without carriage returns at their ends, bytes that are no UTF-8 replaced."""
    if b"\r" not in data:
        try:
            return lines.cast(pa.string())
        except pa.ArrowInvalid:
            pass
    return pa.array([line.rstrip(b"\r").decode("utf-8", "replace") for line in lines.to_pylist()], pa.string())


def read_split(part: Split, root: str, needles: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Lines of a split that hold one of the needles (all, if there are none), as rows. Arrow cuts a
    block into lines and looks for the needles."""
    system, _, prefix = opened(root)
    name = prefix + quote(part.path, safe="/:=@!$&'()*+,;~")
    with system.open_input_file(part.path) as file:
        for at, data in blocks_of(file, part):
            lines = pc.split_pattern(pa.array([data.removesuffix(b"\n")], pa.binary()), "\n").flatten()
            sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
            places = at + np.cumsum(sizes + 1) - sizes - 1
            wanted = sizes > 0
            if needles:
                wanted &= reduce(np.logical_or, [pc.match_substring(lines, n).to_numpy(zero_copy_only=False) for n in needles])
            values, places = _values(lines.filter(pa.array(wanted)), data), places[wanted]
            for k in range(0, len(places), ROWS):
                own = places[k : k + ROWS]
                n = len(own)
                columns = [
                    values.slice(k, n), pa.repeat(pa.scalar(name), n), pa.array(own - (own - part.start) % part.step), pa.array(own),
                    pa.repeat(pa.scalar(part.modified_ms * 1000, pa.int64()), n).cast(pa.timestamp("us", tz="UTC")), pa.repeat(pa.scalar(part.modified_ms, pa.int64()), n),
                ]
                yield pa.record_batch(columns, names=["value", "source_file", "split", "line_no", "modified", "ingest_seq"])


class LogTail(DataSource):
    """Options: ``path`` (folder), ``pattern`` (of file paths), ``needles`` (JSON list), ``splitBytes``,
    and for batches ``plan`` (file of ranges; without it all files are read whole)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Reader:
    def __init__(self, options: Mapping[str, str]):
        self.root, self.pattern, self.plan = options["path"], options.get("pattern", r"\.jsonl$"), options.get("plan")
        self.needles, self.size = json.loads(options.get("needles", "[]")), int(options.get("splitBytes", SPLIT))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(partition, self.root, self.needles)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        ranges = read_plan(self.plan) if self.plan else survey(self.root, self.pattern, {})[1]
        return splits(ranges, self.size) or [Split("", 0, 0, 0, True, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class _Stream(_Reader, DataSourceStreamReader):
    """The offset is the mark of every file. A batch that is repeated after a restart has the
    offsets of the first time, so it reads the same bytes, whatever the files have grown by."""

    def __init__(self, options: Mapping[str, str]):
        super().__init__(options)
        self.marks: dict[str, Mark] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.marks, _ = survey(self.root, self.pattern, self.marks)
        return {path: list(asdict(m).values()) for path, m in self.marks.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        system, _, _ = opened(self.root)
        ranges = []
        for path, values in end.items():
            now, before = Mark(*values), Mark(*start[path]) if path in start else Mark()
            if (now.end, now.size, now.digest) == (before.end, before.size, before.digest):
                continue
            begin = 0
            if before.size and before.end <= now.end:
                with system.open_input_file(path) as file:
                    begin = before.end if holds(file, file.size(), before) else 0
            ranges.append(Range(path, begin, now.end, now.modified_ms))
        return splits([r for r in ranges if r.end > r.start], self.size)

    def commit(self, end: dict) -> None:
        """Nothing to free: marks are the query's own checkpoint."""


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogTail)
    return spark


def _options(root: str, pattern: str, needles: Sequence[str], split_bytes: int) -> dict[str, str]:
    return {"path": root, "pattern": pattern, "needles": json.dumps(list(needles)), "splitBytes": str(split_bytes)}


def tail(spark: SparkSession, root: str, pattern: str, needles: Sequence[str] = (), plan: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Lines of the ranges of a plan, or of all files."""
    reader = registered(spark).read.format("log_tail").options(**_options(root, pattern, needles, split_bytes))
    return (reader.option("plan", plan) if plan else reader).load()


def tail_stream(spark: SparkSession, root: str, pattern: str, needles: Sequence[str] = (), split_bytes: int = SPLIT) -> DataFrame:
    """Lines of files that arrive or grow below a folder, as a stream."""
    return registered(spark).readStream.format("log_tail").options(**_options(root, pattern, needles, split_bytes)).load()


def write_json_lines(path: str, rows: Sequence[dict]) -> None:
    """Replace a small file of JSON lines: the new one is complete before the old one goes."""
    system, at, _ = opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{at}.new") as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    system.move(f"{at}.new", at)


def _rows(path: str) -> list[dict]:
    system, at, _ = opened(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return []
    with system.open_input_stream(at) as file:
        return [json.loads(line) for line in file.read().decode().splitlines()]


def write_plan(path: str, ranges: Sequence[Range]) -> str:
    write_json_lines(path, [asdict(r) for r in ranges])
    return path


def read_plan(path: str) -> list[Range]:
    return [Range(**r) for r in _rows(path)]


@dataclass
class Manifest:
    """Marks of a folder's files, the bytes that the last ingest read of each, and the context
    that its lines leave to those after them."""

    marks: dict[str, Mark]
    read: dict[str, int]
    context: dict[str, dict]


def read_manifest(path: str) -> Manifest:
    rows = _rows(path)
    return Manifest({r["path"]: Mark(**r["mark"]) for r in rows}, {r["path"]: r["read"] for r in rows}, {r["path"]: r["context"] for r in rows if r["context"]})


def write_manifest(path: str, manifest: Manifest) -> None:
    write_json_lines(path, [{"path": p, "mark": asdict(m), "read": manifest.read.get(p, 0), "context": manifest.context.get(p)} for p, m in sorted(manifest.marks.items())])


def file_name(root: str, path: str) -> str:
    """A file's name in ``source_file``."""
    return opened(root)[2] + quote(path, safe="/:=@!$&'()*+,;~")
