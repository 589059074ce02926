from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparklogs.functions.parsing import backfill_signature, chunk_text, extract_signature, log_signature, parse_log_lines

NOW = datetime(2026, 3, 10, 12)

LINES = [
    ("2026-02-03T04:05:06Z [ERROR] disk gone", "ERROR", "disk gone", datetime(2026, 2, 3, 4, 5, 6)),
    ("2026-02-03 04:05:06,250 - WARN  [main] - slow", "WARN", "[main] - slow", datetime(2026, 2, 3, 4, 5, 6, 250000)),
    ("2026-02-03T04:05:06+02:00 INFO moved", "INFO", "moved", datetime(2026, 2, 3, 2, 5, 6)),
    ("[WARNING] low space", "WARNING", "low space", None),
    ("Information about it", "INFO", "Information about it", None),
    ('{"time": "2026-02-03T04:05:06Z", "log_level": "error", "msg": "boom"}', "ERROR", "boom", datetime(2026, 2, 3, 4, 5, 6)),
    ('{"@timestamp": "2026-02-03T04:05:06Z", "message": ""}', "INFO", '{"@timestamp": "2026-02-03T04:05:06Z", "message": ""}', datetime(2026, 2, 3, 4, 5, 6)),
    ('"just text"', "INFO", '"just text"', None),
    ('{"timestamp": 17, "message": "n"}', "INFO", "n", None),
    ("Mar  1 06:07:08 host sshd[7]: error: no key", "ERROR", "host sshd[7]: error: no key", datetime(2026, 3, 1, 6, 7, 8)),
    ("Dec 10 06:07:08 host sshd[7]: Failed password for x", "WARNING", "host sshd[7]: Failed password for x", datetime(2025, 12, 10, 6, 7, 8)),
    ('9.8.7.6 - - [03/Feb/2026:04:05:06 -0700] "GET /a HTTP/1.1" 200 5', "INFO", '9.8.7.6 "GET /a HTTP/1.1" 200 5', datetime(2026, 2, 3, 11, 5, 6)),
    ("[Tue Feb 03 04:05:06 2026] [crit] child died", "CRITICAL", "child died", datetime(2026, 2, 3, 4, 5, 6)),
    ("nothing known", "INFO", "nothing known", None),
]


def test_each_format_gives_level_message_and_utc_time(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, line string")
    got = parse_log_lines(rows, F.lit(NOW)).orderBy("i").select("level", "message", F.col("ts").cast("string").alias("ts")).collect()
    for row, (_, level, message, ts) in zip(got, LINES, strict=True):
        assert (row.level, row.message) == (level, message)
        assert (datetime.fromisoformat(row.ts) if row.ts else None) == ts


def test_legacy_levels_split_a_longer_word(spark):
    row = parse_log_lines(spark.createDataFrame([("[WARNING] x",)], "line string"), F.lit(NOW), legacy_levels=True).first()
    assert (row.level, row.message) == ("WARN", "ING] x")


@pytest.mark.parametrize(
    ("message", "signature"),
    [
        ("took 35 ms", "took <NUM> ms"),
        ("from 10.20.30.40 port 22", "from <IP> port <NUM>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 at 0xFF", "id <UUID> at <HEX>"),
        ("api v2 HTTP/1.1 status=503", "api v2 HTTP/1.1 status=503"),
        ("a1b node12x  y", "a1b node12x y"),
        ("order-12345", "order-<NUM>"),
    ],
)
def test_signature_masks(spark, message, signature):
    assert spark.createDataFrame([(message,)], "m string").select(log_signature(F.col("m"))).first()[0] == signature


def test_signature_round_trip_and_backfill(spark):
    rows = spark.createDataFrame([("s <NUM>", ["a", "b"])], "signature string, examples array<string>")
    rows = rows.withColumn("text", chunk_text(F.col("signature"), F.col("examples")))
    assert rows.select(extract_signature(F.col("text"))).first()[0] == "s <NUM>"
    both = rows.select(F.lit(None).cast("string").alias("signature"), "text").unionByName(rows.select(F.lit(None).cast("string").alias("signature"), F.lit("plain").alias("text")))
    assert {r.text.split("\n")[0]: r.signature for r in backfill_signature(both).collect()} == {"plain": None, "Signature: s <NUM>": "s <NUM>"}
