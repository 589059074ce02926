"""Only the new bytes of files that grow: byte ranges that tasks open, seek and read, in a batch and as a stream.

A range owns the lines that begin in it. Where it does not begin a file's new part, its task starts one byte earlier, so as
to see whether a line begins there, and it reads on to the end of its last line. Nothing before a file's offset is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
PIECE = 1 << 20
#: Read at a time where only the end of a line is looked for.
TAIL = 1 << 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def read_range(file: BinaryIO, start: int, stop: int, first: int, end: int, piece: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and bytes of the lines that begin in ``start`` to ``stop`` of a file whose new part is ``first`` to ``end``.

    The last line of the new part may lack its end; the bytes between ``first`` and the first line end count as a line.
    """
    at, held = start, bytearray()
    if start > first:
        at = start - 1
        file.seek(at)
        while True:
            part = file.read(min(TAIL, end - at))
            found = part.find(b"\n")
            if found >= 0:
                at, held = at + found + 1, bytearray(part[found + 1 :])
                break
            if not part:
                return
            at += len(part)
    else:
        file.seek(start)
    searched = 0  # no line ends before that in what is held
    while at < stop:
        last = held.rfind(b"\n", searched)
        if last < 0:
            known, searched = at + len(held), len(held)
            part = file.read(min(piece if known < stop else TAIL, max(stop - known, TAIL), end - known)) if known < end else b""
            if not part:
                if held:
                    yield [at], [bytes(held)]
                return
            held += part
            continue
        lines, offsets = bytes(held[:last]).split(b"\n"), []
        for line in lines:
            offsets.append(at)
            at += len(line) + 1
        del held[: last + 1]
        searched = len(held)
        own = sum(o < stop for o in offsets)
        yield offsets[:own], lines[:own]


def decoded(lines: list[bytes]) -> pa.Array:
    """Lines as text; bytes that are no UTF-8 become replacement characters."""
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


def read_ranges(ranges: DataFrame, *kept: str) -> DataFrame:
    """path, ``kept`` columns, offset, line of the lines of ``ranges`` (path, start, stop, first, end, ...)."""
    named = ["path", *kept]
    schema = T.StructType([*(ranges.schema[c] for c in named), T.StructField("offset", T.LongType()), T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = file_system(r["path"])
                with system.open_input_file(path) as file:
                    for offsets, lines in read_range(file, r["start"], r["stop"], r["first"], r["end"]):
                        same = [pa.array([r[c]] * len(lines), batch.schema.field(c).type) for c in named]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(offsets, pa.int64()), decoded(lines)], schema.names)

    return ranges.select(*named, "start", "stop", "first", "end").mapInArrow(run, schema)


def byte_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``files`` (path, offset, length, ...) cut into ranges of about ``range_bytes``, dealt out over tasks.

    Files become ranges where they are; neither files nor ranges go to the driver.
    """
    starts = files.withColumns({"first": F.col("offset"), "end": F.col("length")}).withColumn("start", F.explode(F.expr(f"sequence(offset, length - 1, {range_bytes}L)")))
    ranges = starts.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("end")))
    return ranges.repartition(F.col("path"), F.col("start"))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    first: int
    end: int


def _listed(folder: str) -> dict[str, int]:
    """Length of each file under ``folder``; names that begin with a dot or an underscore are left out."""
    system, path = file_system(folder)
    found = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(path) :].strip("/").split("/"))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and not hidden(f.path)}


def _last_line_end(folder: str, path: str, first: int, end: int) -> int:
    """The end of the last whole line between ``first`` and ``end``; ``first`` if there is none."""
    with file_system(folder)[0].open_input_file(path) as file:
        at = end
        while at > first:
            start = max(at - TAIL, first)
            file.seek(start)
            found = file.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return first


class _Reader:
    """Shared by the batch and the stream reader: ranges of the files of a folder, and their lines."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.whole_lines = options.get("wholelines", "true").lower() == "true"

    def lengths(self, before: dict[str, int]) -> dict[str, int]:
        """Where each file's reading ends now; a file that has shrunk stays where it was."""
        after = {}
        for path, size in _listed(self.folder).items():
            first = before.get(path, 0)
            after[path] = first if size <= first else _last_line_end(self.folder, path, first, size) if self.whole_lines else size
        return before | after

    def ranges(self, before: dict[str, int], after: dict[str, int]) -> list[Range]:
        return [
            Range(path, start, min(start + self.range_bytes, end), before.get(path, 0), end)
            for path, end in sorted(after.items()) for start in range(before.get(path, 0), end, self.range_bytes)
        ]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with file_system(self.folder)[0].open_input_file(partition.path) as file:
            for offsets, lines in read_range(file, partition.start, partition.stop, partition.first, partition.end):
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines)), pa.array(offsets, pa.int64()), decoded(lines)], ["path", "offset", "line"])


class _Batch(_Reader, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.before = json.loads(options.get("offsets", "{}"))

    def partitions(self) -> list[Range]:
        return self.ranges(self.before, self.lengths(self.before))


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are the lengths read of each file, so a restart goes on where the checkpoint ends."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = self.lengths(self.known)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = end | {p: max(n, end.get(p, 0)) for p, n in self.known.items()}
        return self.ranges(start, end)

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """``spark.read`` / ``spark.readStream.format("appended_lines")``: path, offset, line of the files under a folder.

    Options: ``path``; ``rangeBytes`` for a task; ``wholeLines`` (true: a line without its end waits for the next batch);
    for a batch ``offsets``, JSON of the bytes of each file that were read before. Blank lines are lines.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def _given(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self._given())

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self._given())
