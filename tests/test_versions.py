"""The chunk table that is merged when read: contents, bytes written, crashes, conflicts, folders, streams."""

import json
import random
import uuid
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparklogs.sources import versions
from sparklogs.sources.versions import ChunkTable, Conflict, folder_of, split_from
from sparklogs.streaming import streams


def batch(spark, ids, value, pad=0):
    return spark.createDataFrame([(f"c{i}", value, i, uuid.uuid4().hex * pad) for i in ids], "chunk_id string, value int, n int, pad string")


def contents(table):
    return {r.chunk_id: r.value for r in table.read().select("chunk_id", "value").collect()}


def test_batches_replace_rows_by_key(spark, tmp_path):
    table, rng, want = ChunkTable(spark, str(tmp_path / "t"), folder_bytes=20_000, smallest=500), random.Random(4), {}
    with pytest.raises(ValueError):
        table.read()
    for k in range(14):
        ids = [rng.randrange(120) for _ in range(rng.choice([0, 1, 40]))]
        table.upsert(batch(spark, set(ids), k, 4), "value")
        want |= dict.fromkeys((f"c{i}" for i in ids), k)
        assert contents(table) == want and table.read().count() == len(want)
    table.compact()
    assert contents(table) == want and not table.state().deltas
    table.vacuum()
    assert contents(table) == want


def test_of_equal_keys_in_a_batch_the_first_by_order_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 9), ("b", 4, None)], "chunk_id string, value int, at int")
    table = ChunkTable(spark, str(tmp_path / "t"))
    table.upsert(rows, "at")
    assert contents(table) == {"a": 3, "b": 4}
    table.upsert(rows, F.asc("value"))
    assert contents(table) == {"a": 1, "b": 4}


def test_a_batch_writes_its_own_rows_alone(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), folder_bytes=1 << 20)
    table.upsert(batch(spark, range(20_000), 0, 8), "value")
    table.compact()
    stored = table.state().base_bytes()
    files = {p for p in Path(tmp_path).rglob("*.parquet")}
    for size in (10, 100):
        table.upsert(batch(spark, range(size), 1, 8), "value")
        new = {p for p in Path(tmp_path).rglob("*.parquet")} - files
        files |= new
        assert sum(p.stat().st_size for p in new) < 4000 + 600 * size < stored / 10
        assert all("delta-" in str(p) for p in new)
    assert contents(table)["c50"] == 1 and contents(table)["c15000"] == 0


def test_a_killed_batch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = ChunkTable(spark, str(tmp_path / "t"), folder_bytes=4000)
    table.upsert(batch(spark, range(50), 1), "value")
    before, commit = contents(table), ChunkTable._commit
    monkeypatch.setattr(ChunkTable, "_commit", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(batch(spark, range(99), 2), "value")
    with pytest.raises(KeyboardInterrupt):
        table.upsert(batch(spark, [], 2), "value")
    assert contents(ChunkTable(spark, str(tmp_path / "t"))) == before
    monkeypatch.setattr(ChunkTable, "_commit", commit)
    table.upsert(batch(spark, range(99), 2), "value")
    after = contents(table)
    # a compaction that is killed changes nothing either
    monkeypatch.setattr(ChunkTable, "_commit", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt))
    table.spark.createDataFrame([], "a int")
    if table.state().deltas:
        with pytest.raises(KeyboardInterrupt):
            table.compact()
    monkeypatch.setattr(ChunkTable, "_commit", commit)
    assert contents(table) == after == {f"c{i}": 2 for i in range(99)}
    left = len(list(Path(tmp_path).rglob("*.parquet")))
    table.vacuum()
    assert contents(table) == after and len(list(Path(tmp_path).rglob("*.parquet"))) < left


def test_two_writers_of_one_number(spark, tmp_path):
    one, two = (ChunkTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.upsert(batch(spark, [1], 1), "value")
    old = two.state()
    one.upsert(batch(spark, [2], 2), "value")
    with pytest.raises(Conflict):
        two._commit(old, {"delta-x": 1}, [])
    assert contents(two) == {"c1": 1, "c2": 2}


def test_a_batch_that_runs_again_is_left_out(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    table.upsert(batch(spark, [1], 1), "value", "w", 0)
    table.upsert(batch(spark, [1], 2), "value", "w", 1)
    version = table.state().version
    table.upsert(batch(spark, [1], 1), "value", "w", 0)
    assert contents(table) == {"c1": 2} and table.state().version == version
    table.upsert(batch(spark, [1], 3), "value", "other", 0)
    assert contents(table) == {"c1": 3}


def test_folders_grow_and_a_split_touches_one_other(spark, tmp_path):
    keys = spark.range(4000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"))
    for n in (1, 2, 3, 5, 8, 13):
        moved = keys.select(folder_of("chunk_id", n).alias("a"), folder_of("chunk_id", n + 1).alias("b")).where("a <> b").distinct().collect()
        assert {(r.a, r.b) for r in moved} == {(split_from(n, n), n)}
    assert [split_from(k, 5) for k in (5, 6, 7, 8, 12, 13)] == [1, 2, 3, 0, 4, 1]
    table = ChunkTable(spark, str(tmp_path / "t"), folder_bytes=30_000)
    for k in range(4):
        table.upsert(batch(spark, range(k * 600, k * 600 + 600), k, 3), "value")
    state = table.state()
    table.compact()
    grown = table.state()
    assert grown.folders > 3 and grown.folders >= state.folders and len(grown.base) == grown.folders
    for folder, own in grown.base.items():
        rows = spark.read.parquet(*[f"{tmp_path}/t/{p}" for p, _ in own])
        assert rows.where(folder_of("chunk_id", grown.folders) != folder).count() == 0
    # one row again: the other folders stay as they are
    table.upsert(batch(spark, [7], 9, 3), "value")
    table.compact()
    same = table.state()
    kept = [k for k in grown.base if grown.base[k] == same.base[k]]
    assert len(kept) >= grown.folders - 1 - 2 * (same.folders - grown.folders) and contents(table)["c7"] == 9


def test_small_batches_are_merged_among_themselves(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), folder_bytes=10 << 20)
    for k in range(versions.CLASS + 1):
        table.upsert(batch(spark, [k, 0], k), "value")
    assert len(table.state().deltas) == 2 and table.state().base == {}
    assert contents(table) == {"c0": 8, **{f"c{k}": k for k in range(1, 9)}}


def test_a_log_is_read_from_its_last_snapshot(spark, tmp_path, monkeypatch):
    table, read = ChunkTable(spark, str(tmp_path / "t"), folder_bytes=2000), []
    for k in range(4):
        table.upsert(batch(spark, range(30), k, 2), "value")
    table.compact()
    table.upsert(batch(spark, [1], 9), "value")
    entry = ChunkTable._read_entry
    monkeypatch.setattr(ChunkTable, "_read_entry", lambda self, name: read.append(name) or entry(self, name))
    table.state()
    log = sorted(p.name for p in (tmp_path / "t" / "_log").glob("[0-9]*.json"))
    snapshots = [n for n in log if json.loads((tmp_path / "t" / "_log" / n).read_text())["snapshot"]]
    assert sorted(read) == [n for n in log if n >= snapshots[-1]] and len(read) < len(log)


def test_sessions_of_a_stream_and_again(spark, tmp_path):
    logs, store = tmp_path / "in", str(tmp_path / "table")
    logs.mkdir()
    line = "2026-01-01T00:{:02d}:{:02d}Z [ERROR] fail {}".format
    (logs / "1.log").write_text("\n".join([line(10, k, k) for k in range(9)] + ["2026-01-01T00:10:05Z [INFO] fine", line(30, 0, 1)]) + "\n")
    for k in (1, 2, 2):  # the same lines by another query, and a restart
        parsed = streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)))
        streams.stream_merge(streams.stream_chunks(parsed), store, str(tmp_path / f"c{k}")).awaitTermination(600)
        rows = ChunkTable(spark, store).read().orderBy("signature").collect()
        assert [(r.signature, r["count"], r.examples) for r in rows] == [("fail <NUM>", 9, [f"fail {i}" for i in range(5)]), ("fine", 1, ["fine"])]
