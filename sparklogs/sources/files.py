"""Log files and evaluation documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklogs.sources.appended import RANGE_BYTES, byte_ranges, read_ranges

GROUND_TRUTH = (
    "dataset_name string, questions array<struct<question: string, filters: struct<time_from: string, time_to: string, service: string>, "
    "ground_truth_answer: string, ground_truth_services: array<string>, ground_truth_keywords: array<string>>>"
)
EXPECTED = (
    "query string, expected_answer struct<trigger_event: string, trigger_event_acceptable_options: array<string>, "
    "propagation_chain_must_include_in_order: array<string>, root_cause_must_mention: array<string>, root_cause_must_be_one_of: array<string>, "
    "root_cause_must_NOT_assert: array<string>, root_cause_must_NOT_assert_as_root_cause: array<string>, ruled_out_hypotheses_must_include: array<string>, "
    "ruled_out_hypotheses_must_consider: array<string>, confidence: string, gaps_must_include_one_of: array<string>>"
)


def read_raw_logs(spark: SparkSession, paths: str | list[str], service: str, env: str = "production", project_id: str | None = None) -> DataFrame:
    """One row for each line with more than white space: project_id, source_service, source_env, path, block, line_no, line.

    (path, block, line_no) is the order of lines; line_no grows within a split but is not dense.
    """
    if not service:
        raise ValueError("a service is needed")
    lines = spark.read.text(paths)
    return lines.where(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")) != "").select(
        F.lit(project_id).cast("string").alias("project_id"), F.lit(service).alias("source_service"), F.lit(env).alias("source_env"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"),
    )


def new_bytes(files: DataFrame, offsets: DataFrame, watchers: DataFrame) -> DataFrame:
    """Files (path, length, ...) with more bytes than were read, with their watcher and the offset to go on from.

    A file belongs to the first enabled watcher, by id, whose path begins its own. Watchers are a list that people keep,
    so it is sent to the files.
    """
    active = F.broadcast(watchers.where("enabled").select(F.col("id").alias("watcher_id"), "watch_path", "service_name", "env", "project_id"))
    mine = files.join(active, F.col("path").startswith(F.col("watch_path")))
    first = mine.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("watcher_id"))).where("_n = 1").drop("_n")
    read = offsets.select(F.col("watcher_config_id").alias("watcher_id"), F.col("file_path").alias("path"), "offset")
    return first.join(read, ["watcher_id", "path"], "left").withColumn("offset", F.coalesce("offset", F.lit(0))).where("length > offset")


def ingest_file_increments(spark: SparkSession, folder: str, offsets: DataFrame, watchers: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Lines after each file's offset, and the offsets to store next (watcher_config_id, file_path, offset).

    Files are listed, not read, to find those with news; their new bytes are cut into ranges that tasks read, so the work is
    that of the news and a file of any size is shared by many tasks. ``offset`` is a line's first byte. Of a line that was
    read in part only the rest comes. What is written after the files were listed waits for the next run, like the
    offsets, which are the lengths at that time. Blank lines are left out.
    """
    clean = F.regexp_replace("path", "^file:/+", "/")
    # sizes as listed, not as they are when a task looks: lines and offsets then end at the same byte
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("_metadata.file_size").alias("length")).withColumn("path", clean)
    fresh = new_bytes(listed, offsets, watchers)
    lines = read_ranges(byte_ranges(fresh, range_bytes), "project_id", "service_name", "env")
    line = F.regexp_replace("line", r"\r$", "")
    found = lines.select("project_id", F.col("service_name").alias("source_service"), F.col("env").alias("source_env"), "path", "offset", line.alias("line"))
    return found.where(F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")) != ""), fresh.select(F.col("watcher_id").alias("watcher_config_id"), F.col("path").alias("file_path"), F.col("length").alias("offset"))


def read_ground_truth(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each question of the documents: dataset_name, question_no, question, filters, answer, services, keywords."""
    docs = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(paths)
    rows = docs.select("dataset_name", F.posexplode("questions").alias("question_no", "q"))
    return rows.select(
        "dataset_name", "question_no", "q.question", "q.filters", F.col("q.ground_truth_answer").alias("answer"),
        F.col("q.ground_truth_services").alias("services"), F.col("q.ground_truth_keywords").alias("keywords"),
    )


def read_expected(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, query and the fields of the expected answer; those that are no plain text stay JSON."""
    docs = spark.read.schema(EXPECTED).option("multiLine", True).json(paths)
    return docs.select(F.col("_metadata.file_path").alias("path"), "query", "expected_answer.*")


def score_map(scores: Column) -> Column:
    """(name, score) structs as one JSON text, sorted by name."""
    return F.to_json(F.map_from_entries(F.array_sort(scores)))
