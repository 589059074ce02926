"""New bytes of files: ranges against whole files, bytes read, appended and shrunk files in a batch and in a stream."""

import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparklogs.sources import appended, files
from sparklogs.streaming import streams

WATCHERS = "id int, service_name string, watch_path string, env string, enabled boolean, project_id string"


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        part = super().read(n)
        self.got += len(part)
        return part


def lines_of(data, first, end):
    out, at = [], first
    for line in data[first:end].split(b"\n"):
        out.append((at, line))
        at += len(line) + 1
    return out[:-1] if out and out[-1][1] == b"" else out


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_each_line_once(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(appended, "TAIL", rng.choice([1, 3, 64]))
    data = b"".join(rng.choice([b"", b"a", b"bc" * rng.randint(0, 30), "é中".encode()]) + rng.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(60)) + rng.choice([b"", b"no end"])
    first, end = rng.randint(0, len(data) // 2), rng.randint(len(data) // 2, len(data))
    for size in (1, 5, 17, len(data)):
        got = []
        for start in range(first, end, size):
            for offsets, lines in appended.read_range(io.BytesIO(data), start, min(start + size, end), first, end, piece=rng.choice([1, 7, 1000])):
                got += zip(offsets, lines, strict=True)
        assert got == lines_of(data, first, end)


def test_bytes_read_are_the_new_bytes():
    data = b"".join(b"line %d of many\n" % k for k in range(20_000))
    first = data.index(b"line 15000")
    file = Counting(data)
    assert sum(len(lines) for _, lines in appended.read_range(file, first, len(data), first, len(data))) == 5000
    assert file.got == len(data) - first
    # in ranges, each reads at most the byte before it and the end of its last line on top
    total = 0
    for start in range(first, len(data), 10_000):
        file = Counting(data)
        list(appended.read_range(file, start, min(start + 10_000, len(data)), first, len(data)))
        total += file.got
    assert len(data) - first <= total <= len(data) - first + -(-(len(data) - first) // 10_000) * (1 + appended.TAIL)


def test_old_bytes_are_not_read(spark, tmp_path):
    """A file with a hole of 200 GB before its news: reading that would take minutes."""
    log = tmp_path / "w" / "big.log"
    log.parent.mkdir()
    with log.open("wb") as f:
        f.truncate(200 << 30)
        f.seek(0, 2)
        f.write(b"news one\nnews two\n")
    watchers = spark.createDataFrame([(1, "svc", str(tmp_path / "w"), "prod", True, "p")], WATCHERS)
    offsets = spark.createDataFrame([(1, str(log), 200 << 30)], "watcher_config_id int, file_path string, offset long")
    lines, after = files.ingest_file_increments(spark, str(tmp_path), offsets, watchers)
    assert [(r.line, r.offset) for r in lines.orderBy("offset").collect()] == [("news one", 200 << 30), ("news two", (200 << 30) + 9)]
    assert after.first().offset == (200 << 30) + 18


def test_a_file_is_shared_by_tasks(spark, tmp_path):
    log = tmp_path / "w" / "a.log"
    log.parent.mkdir()
    log.write_text("".join(f"row {k} {'x' * (k % 50)}\n" for k in range(3000)))
    watchers = spark.createDataFrame([(1, "svc", str(tmp_path / "w"), "prod", True, "p")], WATCHERS)
    none = spark.createDataFrame([], "watcher_config_id int, file_path string, offset long")
    lines, _ = files.ingest_file_increments(spark, str(tmp_path), none, watchers, range_bytes=1000)
    assert [r.line for r in lines.orderBy("offset").collect()] == log.read_text().splitlines()
    log.write_bytes(b"\xff\xfe broken\nfine\n")
    lines, _ = files.ingest_file_increments(spark, str(tmp_path), none, watchers)
    assert [r.line for r in lines.orderBy("offset").collect()] == ["�� broken", "fine"]


def test_a_batch_from_given_offsets(spark, tmp_path):
    spark.dataSource.register(appended.AppendedLines)
    (tmp_path / "a.log").write_text("one\ntwo\nthr")
    (tmp_path / "b.log").write_text("")
    (tmp_path / "_hidden").write_text("no\n")
    read = spark.read.format("appended_lines").option("path", str(tmp_path))
    assert sorted((r.offset, r.line) for r in read.load().collect()) == [(0, "one"), (4, "two")]
    old = json.dumps({str(tmp_path / "a.log"): 4})
    assert sorted((r.offset, r.line) for r in read.option("offsets", old).option("wholeLines", "false").load().collect()) == [(4, "two"), (8, "thr")]


def test_a_stream_of_growing_files_goes_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "logs" / "deep"
    folder.mkdir(parents=True)
    log, line = folder / "a.log", "2026-01-01T00:00:{:02d}Z [ERROR] fail {}\n".format

    def drained():
        frame = streams.stream_appended(spark, str(tmp_path / "logs"), "svc", F.lit(datetime(2026, 2, 1)), range_bytes=64)
        before = set((tmp_path / "out").glob("*.parquet"))
        query = frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(600)
        new = [str(p) for p in set((tmp_path / "out").glob("*.parquet")) - before]
        return sorted((r.message, r.level) for r in spark.read.schema(frame.schema).parquet(*new).collect()) if new else []

    log.write_text(line(1, 1) + line(2, 2) + line(3, 3)[:20])
    assert drained() == [("fail 1", "ERROR"), ("fail 2", "ERROR")]
    with log.open("a") as f:
        f.write(line(3, 3)[20:] + "\n" + line(4, 4))
    (folder / "b.log").write_text(line(5, 5) * 9)
    assert drained() == [("fail 3", "ERROR"), ("fail 4", "ERROR"), *[("fail 5", "ERROR")] * 9]
    assert drained() == []
    log.write_text("gone\n")  # shorter than what was read: waits until it is longer
    assert drained() == []
