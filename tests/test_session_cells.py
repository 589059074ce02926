import random
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from sparklogs.streaming import sessions, streams


class Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.state, self.timers, self.reads = {}, set(), 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getMapState(self, name, key, value):
        return self

    def containsKey(self, key):
        self.reads += 1
        return key in self.state

    def getValue(self, key):
        return self.state[key]

    def updateValue(self, key, value):
        self.state[key] = value

    def removeKey(self, key):
        del self.state[key]


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def processor(gap):
    cells, handle = sessions.SessionCells(gap), Handle()
    cells.init(handle)
    return cells, handle


def feed(cells, lines):
    frame = {"micros": [x[0] for x in lines], "message": [x[1] for x in lines], "level": [x[2] for x in lines]}
    assert not list(cells.handleInputRows(("k",) * 4, iter([pd.DataFrame(frame)]), At(0)))


def expire(cells, handle, mark, order=sorted):
    out = []
    while due := order(t for t in handle.timers if t < mark):
        for t in due:
            handle.timers.discard(t)
            info = At(mark)
            info.getExpiryTimeInMs = lambda t=t: t
            for frame in cells.handleExpiredTimer(("k",) * 4, At(mark), info):
                rows = zip(*(frame[c].tolist() for c in ("timestamp_start", "timestamp_end", "count", "examples")), strict=True)
                out.extend((a.value // 1000, b.value // 1000, n, m) for a, b, n, m in rows)
    return out


def slow(lines, gap):
    found = []
    for line in sorted(lines):
        if found and line[0] - found[-1][-1][0] <= gap:
            found[-1].append(line)
        else:
            found.append([line])
    return [(s[0][0], s[-1][0], len(s), [m for _, m, _ in s[:5]]) for s in found]


def named(rows):
    return sorted((a, b, n, list(m)) for a, b, n, m in rows)


def test_cells_like_sorted_lines():
    for seed in range(40):
        rng = random.Random(seed)
        gap, at, lines = 3_000_000, 1_700_000_000_000_000, []
        for k in range(rng.randint(1, 150)):
            at += rng.choice([0, 1, 900_000, 1_000_000, 2_999_999, 3_000_000, 3_000_001, 7_000_000])
            lines.append((at, f"m{k:03}", "INFO"))
        cells, handle = processor(gap)
        late, got, mark = 4_000_000, [], 0
        arrival = sorted(lines, key=lambda x: x[0] + rng.randint(0, late - 1))
        order = sorted if seed % 2 else lambda ts: sorted(ts, reverse=True)
        for k in range(0, len(arrival), 7):
            batch = [x for x in arrival[k : k + 7] if x[0] > mark * 1000]
            assert len(batch) == len(arrival[k : k + 7])
            feed(cells, batch)
            mark = max(mark, (max(x[0] for x in arrival[: k + 7]) - late) // 1000)
            got += expire(cells, handle, mark, order)
        done = [s for s in slow(lines, gap) if s[1] + gap <= mark * 1000]
        assert named(got) == named(done)
        got += expire(cells, handle, (lines[-1][0] + gap) // 1000 + 1, order)
        assert named(got) == named(slow(lines, gap)) and not handle.state and not handle.timers


def test_a_batch_reads_only_its_own_cells():
    cells, handle = processor(1_000_000)
    feed(cells, [(k * 5_000_000, "m", "INFO") for k in range(1000)])
    handle.reads = 0
    feed(cells, [(17 * 5_000_000 + 1, "n", "INFO")])
    assert handle.reads == 1 and len(handle.state) == 1000 and len(handle.timers) == 1000
    assert [(a, n) for a, _, n, _ in expire(cells, handle, 16_000)] == [(k * 5_000_000, 1) for k in range(4)]
    assert handle.reads < 30


def test_a_long_session_is_held_in_its_last_cells():
    cells, handle = processor(1_000_000)
    for k in range(0, 400, 4):
        feed(cells, [((k + j) * 500_000, f"m{k + j:03}", "INFO") for j in range(4)])
        assert not expire(cells, handle, (k + 3) * 500) and len(handle.state) <= 6
    assert [(n, m) for _, _, n, m in expire(cells, handle, 10**6)] == [(400, [f"m{k:03}" for k in range(5)])]


def test_the_stream_gives_the_chunks_of_the_other_one_over_a_restart(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    rng = random.Random(4)

    def drop(name, low):
        lines = [f"2026-01-01T{low + k // 60:02d}:{k % 60:02d}:{rng.randint(0, 59):02d}Z [ERROR] {rng.choice(['fail', 'stop', 'halt'])} {k}" for k in range(0, 240, rng.choice([2, 3]))]
        (logs / name).write_text("\n".join(lines) + "\n")

    def run(make, name, checkpoint):
        parsed = streams.stream_parse(spark, str(logs), "svc", F.lit(datetime(2026, 2, 1)), max_files=1)
        query = make(parsed, 240, "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / checkpoint))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(600)
        return spark.read.parquet(str(tmp_path / name)).select("chunk_id", "signature", "count", "examples", "timestamp_start", "timestamp_end", "log_level").collect()

    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    drop("1.log", 0)
    try:
        spark.conf.set(key, sessions.ROCKSDB)
        run(streams.stream_chunks_by_cells, "cells", "c1")
        drop("2.log", 4)
        cells = run(streams.stream_chunks_by_cells, "cells", "c1")
    finally:
        spark.conf.set(key, before)
    other = run(streams.stream_chunks, "other", "c2")
    assert len(cells) > 20 and sorted(map(tuple, cells)) == sorted(map(tuple, other))
