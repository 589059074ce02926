import random
from datetime import datetime

from pyspark.sql import functions as F

from sparklogs.sources.versions import ChunkTable
from sparklogs.streaming import streams


def drop(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def run(frame, name, checkpoint, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(600)
    return frame.sparkSession.table(name).collect()


def test_sessions_close_behind_the_watermark_and_late_rows_go(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    line = "2026-01-01T00:{:02d}:{:02d}Z [ERROR] fail {}".format
    drop(logs, "1.log", [line(0, 0, 1), line(0, 30, 2), "no time here"])
    drop(logs, "2.log", [line(10, 0, 3)])
    drop(logs, "3.log", [line(0, 31, 4), line(20, 0, 5)])
    parsed = streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)), max_files=1)
    rows = run(streams.stream_chunks(parsed), "sessions", tmp_path / "c1")
    closed = sorted((str(r.timestamp_start), r["count"], r.examples, r.log_level) for r in rows)
    assert closed[0][1:] == (2, ["fail 1", "fail 2"], "ERROR")
    assert all("fail 4" not in r[2] for r in closed)
    assert [r.message for r in run(streams.untimed(parsed), "untimed", tmp_path / "c2")] == ["no time here"]


def test_counts_and_first_sights(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    drop(logs, "1.log", ["2026-01-01T00:10:00Z [ERROR] fail 1", "2026-01-01T00:20:00Z [ERROR] fail 2", "2026-01-01T05:00:00Z [INFO] ok"])
    parsed = streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)))
    counts = run(streams.stream_bucket_counts(parsed), "counts", tmp_path / "c1", "complete")
    assert sorted((r.signature, r.n) for r in counts) == [("fail <NUM>", 2), ("ok", 1)]
    assert sorted(r.signature for r in run(streams.stream_new_patterns(parsed), "news", tmp_path / "c2")) == ["fail <NUM>", "ok"]


def test_sessions_go_into_the_chunk_table_and_again(spark, tmp_path):
    logs, store = tmp_path / "in", str(tmp_path / "table")
    logs.mkdir()
    line = "2026-01-01T00:{:02d}:{:02d}Z [ERROR] fail {}".format
    drop(logs, "1.log", [line(10, k, k) for k in range(9)] + ["2026-01-01T00:10:05Z [INFO] fine", line(30, 0, 1)])
    for k in (1, 2):  # the same lines again change nothing
        parsed = streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)))
        streams.stream_upsert(streams.stream_chunks(parsed), store, str(tmp_path / f"c{k}"), 4).awaitTermination(600)
        rows = spark.read.parquet(store).orderBy("signature").collect()
        assert [(r.signature, r["count"], r.examples, r.log_level) for r in rows] == [("fail <NUM>", 9, [f"fail {i}" for i in range(5)], "ERROR"), ("fine", 1, ["fine"], "INFO")]
    drop(logs, "2.log", [line(50, 0, 7)])
    streams.stream_upsert(streams.stream_chunks(streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)))), store, str(tmp_path / "c2"), 4).awaitTermination(600)
    assert spark.read.parquet(store).count() == 3 and spark.read.parquet(store).select("chunk_id").distinct().count() == 3


def test_sessions_keep_five_lines_whatever_the_order():
    rng = random.Random(1)
    lines = [(t, f"m{t}", "INFO") for t in [*range(0, 300, 7), *range(1000, 1100, 9)]]
    rng.shuffle(lines)
    held = []
    for k in range(0, len(lines), 5):
        held = streams.merge_sessions(held, lines[k : k + 5], 40)
    firsts = [sorted(x for x in lines if low <= x[0] < low + 900)[:5] for low in (0, 1000)]
    assert [(s[2], s[3]) for s in held] == [(43, firsts[0]), (12, firsts[1])]


def test_first_sights_are_remembered_in_a_table(spark, tmp_path, monkeypatch):
    logs, store = tmp_path / "in", str(tmp_path / "seen")
    logs.mkdir()
    line = "2026-01-01T00:{:02d}:00Z [ERROR] {}".format

    def run_once(checkpoint="c"):
        parsed = streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)), max_files=1)
        streams.stream_first_sights(parsed, store, str(tmp_path / checkpoint)).awaitTermination(600)
        return sorted((r.signature, str(r.ts)) for r in ChunkTable(spark, store, "pattern_id").read().collect())

    drop(logs, "1.log", [line(5, "disk 1"), line(3, "disk 2"), line(7, "net down"), "no time here"])
    first = [("disk <NUM>", "2026-01-01 00:03:00"), ("net down", "2026-01-01 00:07:00")]
    assert run_once() == first
    drop(logs, "2.log", [line(1, "disk 3"), line(9, "new one")])
    assert run_once() == sorted([*first, ("new one", "2026-01-01 00:09:00")])
    version = ChunkTable(spark, store, "pattern_id").state().version
    assert run_once() == sorted([*first, ("new one", "2026-01-01 00:09:00")])  # a restart without news
    assert ChunkTable(spark, store, "pattern_id").state().version == version
    # another query over the same lines finds nothing new
    assert run_once("other") == sorted([*first, ("new one", "2026-01-01 00:09:00")])
