import json

import pytest
from pyspark.sql import functions as F

from sparklogs.sources import files, tables


def test_raw_lines_skip_blank_ones_and_keep_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  \ntwo\n")
    rows = files.read_raw_logs(spark, str(tmp_path), "svc", project_id="p").orderBy("path", "block", "line_no").collect()
    assert [(r.line, r.source_service, r.source_env, r.project_id) for r in rows] == [("one", "svc", "production", "p"), ("two", "svc", "production", "p")]
    with pytest.raises(ValueError):
        files.read_raw_logs(spark, str(tmp_path), "")


def test_only_new_bytes_of_watched_files(spark, tmp_path):
    old, new, other = tmp_path / "w1" / "old.log", tmp_path / "w1" / "new.log", tmp_path / "other.log"
    old.parent.mkdir()
    old.write_text("before\nafter\n")
    new.write_text("fresh\n\n")
    other.write_text("unwatched\n")
    (tmp_path / "w1" / "done.log").write_text("done\n")
    watchers = spark.createDataFrame([(2, "svc", str(tmp_path / "w1"), "prod", True, "p"), (1, "off", str(tmp_path), "prod", False, "p")], "id int, service_name string, watch_path string, env string, enabled boolean, project_id string")
    offsets = spark.createDataFrame([(2, str(old), 7), (2, str(tmp_path / "w1" / "done.log"), 5)], "watcher_config_id int, file_path string, offset long")
    lines, after = files.ingest_file_increments(spark, str(tmp_path), offsets, watchers)
    assert sorted((r.line, r.source_service, r.source_env) for r in lines.collect()) == [("after", "svc", "prod"), ("fresh", "svc", "prod")]
    assert {r.file_path.rsplit("/", 1)[1]: r.offset for r in after.collect()} == {"old.log": 13, "new.log": 7}


def test_evaluation_documents(spark, tmp_path):
    truth = {"dataset_name": "d", "questions": [{"question": "q1", "ground_truth_services": ["a"], "ground_truth_keywords": ["k"]}, {"question": "q2"}]}
    (tmp_path / "t.json").write_text(json.dumps(truth, indent=1))
    rows = files.read_ground_truth(spark, str(tmp_path / "t.json")).orderBy("question_no").collect()
    assert [(r.question, r.services) for r in rows] == [("q1", ["a"]), ("q2", None)]
    (tmp_path / "e.json").write_text(json.dumps({"query": "q", "expected_answer": {"confidence": "high", "root_cause_must_mention": ["x"]}}))
    row = files.read_expected(spark, str(tmp_path / "e.json")).first()
    assert (row.query, row.confidence, row.root_cause_must_mention) == ("q", "high", ["x"])


def test_upsert_takes_the_last_and_is_repeatable(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "chunk_id string, v int, ingested_at int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], old.schema)
    once = tables.upsert_chunks(old, new)
    want = [("a", 1), ("b", 3), ("c", 4)]
    assert sorted((r.chunk_id, r.v) for r in once.collect()) == want
    assert sorted((r.chunk_id, r.v) for r in tables.upsert_chunks(once, new).collect()) == want


def test_leaderboard_appends(spark, tmp_path):
    row = spark.range(1).select(
        F.lit("r").alias("run_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.lit(0.5).alias("aggregate_score"), F.lit("error").alias("status"),
        F.lit("j").alias("judge_model"), F.array(F.struct(F.lit("b").alias("name"), F.lit(1.0).alias("score"))).alias("criteria"), F.struct(F.lit(1).alias("n")).alias("stats"), F.current_timestamp().alias("created_at"),
    )
    for _ in range(2):
        tables.write_leaderboard(row, str(tmp_path / "board"))
    got = spark.read.parquet(str(tmp_path / "board")).collect()
    assert len(got) == 2 and got[0].criteria == '{"b":1.0}' and str(got[0].aggregate_score) == "0.500"


def test_a_line_read_in_part_goes_on_where_it_ended(spark, tmp_path):
    log = tmp_path / "w" / "a.log"
    log.parent.mkdir()
    log.write_text("first é\r\nhalf done\nlast without an end")
    watchers = spark.createDataFrame([(1, "svc", str(tmp_path / "w"), "prod", True, "p")], "id int, service_name string, watch_path string, env string, enabled boolean, project_id string")
    offsets = spark.createDataFrame([(1, str(log), len("first é\r\nhalf".encode()))], "watcher_config_id int, file_path string, offset long")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    try:
        lines, after = files.ingest_file_increments(spark, str(tmp_path), offsets, watchers)
        assert [r.line for r in lines.orderBy("offset").collect()] == [" done", "last without an end"]
        every, _ = files.ingest_file_increments(spark, str(tmp_path), offsets.limit(0), watchers)
        assert [(r.line, r.offset) for r in every.orderBy("offset").collect()] == [("first é", 0), ("half done", 10), ("last without an end", 20)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.offset for r in after.collect()] == [len(log.read_bytes())]
