"""The feed from one reading against the union of its rules, for windows, services and odd rows; and from rollups."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparklogs.operators import events
from sparklogs.streaming import streams

START, END = datetime(2026, 1, 1), datetime(2026, 1, 2)
SCHEMA = "source_service string, signature string, log_level string, timestamp_start timestamp"


def chunks_of(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(60):
        service, signature = f"svc-{s % 4}", rng.choice([f"sig {s % 11}", f"sig {s % 11}", "", None])
        begin, rate = rng.uniform(-20, 20), rng.choice([5, 40, 120])
        for _ in range(rate):
            at = START + timedelta(hours=begin + rng.choice([rng.uniform(0, 2), rng.uniform(0, 24)]), microseconds=rng.randint(0, 10**6))
            rows.append((service, signature, rng.choice(["error", "ERROR", "WARN", "INFO", "FATAL", None, "debug"]) if rng.random() < 0.7 else "INFO", at))
    rows += [("svc-9", "at the edges", "ERROR", t) for t in (START, END, END - timedelta(microseconds=1))] + [("svc-9", "no time", "ERROR", None), (None, "no service", "ERROR", START + timedelta(hours=3))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_rules(chunks, n, service=None):
    buckets = events.window_aggregates(chunks, START, END, n, service)
    series = events.error_series(buckets)
    found = events.events_new_begins(series, events.first_seen(chunks, series), START, END, n).unionByName(events.events_spike(series, START, END, n))
    return found.unionByName(events.events_subside(series, START, END, n)).unionByName(events.events_health(buckets, START, END, n))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("kind", "ts", "service", "signature", "level", "title", "count").collect()), key=str)


@pytest.mark.parametrize(("seed", "n", "service"), [(1, 24, None), (2, 24, "svc-1"), (3, 8, None), (4, 96, None)])
def test_one_reading_gives_what_the_rules_give(spark, seed, n, service):
    chunks = chunks_of(spark, seed)
    want = rows_of(by_rules(chunks, n, service))
    assert len(want) > 4 or service
    assert rows_of(events.event_feed(chunks, START, END, n, None, service)) == want
    rollup = events.event_rollup(chunks)
    twice = rollup.where("n % 2 = 0").unionByName(rollup.where("n % 2 = 1").withColumn("n", F.lit(1).cast("long"))).unionByName(rollup.where("n % 2 = 1 and n > 1").withColumn("n", F.col("n") - 1))
    assert rows_of(events.event_feed_from_rollup(twice, START, END, n, None, service)) == want


def test_the_chunks_are_read_once(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    chunks = spark.read.parquet(path).select((F.col("user_id") % 3).cast("string").alias("source_service"), F.col("event_type").alias("signature"), F.lit("ERROR").alias("log_level"), F.col("ts").cast("timestamp").alias("timestamp_start"))
    plan = events.event_feed(chunks, START, END)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 4


def test_windows_of_a_rollup_begin_at_full_minutes(spark):
    rollup = events.event_rollup(chunks_of(spark, 1))
    for start, end, n in ((START + timedelta(seconds=1), END, 24), (START, END, 7), (START, END + timedelta(seconds=30), 24)):
        with pytest.raises(ValueError):
            events.event_feed_from_rollup(rollup, start, end, n)


def test_a_stream_keeps_the_rollup_over_restarts(spark, tmp_path):
    folder, table = str(tmp_path / "chunks"), str(tmp_path / "rollup")
    parts = [chunks_of(spark, seed) for seed in (5, 6)]
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(folder)
        for _ in range(2):  # again without news
            streams.stream_rollup(spark.readStream.schema(part.schema).parquet(folder), table, str(tmp_path / "checkpoint")).awaitTermination(600)
        every = parts[0] if k == 0 else parts[0].unionByName(parts[1])
        got = streams.read_rollup(spark, table).groupBy("service", "signature", "level", "minute").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, events.event_rollup(every).collect()), key=str)
