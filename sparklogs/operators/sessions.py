"""Parsed lines to chunks: sessions of one signature of one service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.functions.parsing import log_signature

GAP_SECONDS = 30
EXAMPLES = 5
SPAN_SECONDS = 3600
NO_TIME_PARTS = 64
KEYS = ("project_id", "source_service", "source_env", "signature")


def assign_default_project(rows: DataFrame, projects: DataFrame, default: str = "Default") -> DataFrame:
    """A missing project becomes that named ``default``; others are matched by id, then by name."""
    names = projects.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    by_id, by_name = names.alias("by_id"), names.alias("by_name")
    fallback = names.where(F.col("_name") == default).agg(F.min("_id").alias("_default"))  # one row
    wanted = rows.alias("r").join(by_id, F.col("r.project_id") == F.col("by_id._id"), "left").join(by_name, F.col("r.project_id") == F.col("by_name._name"), "left")
    chosen = F.when(F.col("r.project_id").isNull(), F.col("_default")).otherwise(F.coalesce("by_id._id", "by_name._id"))
    rest = [F.col(f"r.{c}") for c in rows.columns if c != "project_id"]
    return wanted.crossJoin(F.broadcast(fallback)).select(*rest, chosen.alias("project_id"))


def chunk_logs(parsed: DataFrame, gap_seconds: float = GAP_SECONDS, order: str = "line_no", span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Sessions of lines with one signature: a gap over ``gap_seconds`` opens a new one, lines without a time form one.

    Columns: the keys, chunk_no, signature, count, examples (the first five messages), timestamp_start, timestamp_end,
    log_level (of the first line), chunk_id (stable over reruns). Needs project_id, source_service, source_env, message,
    level, ts and the line order, an integer.

    Two levels keep a hot signature apart: lines are sorted and cut within spans of ``span_seconds`` (lines without a
    time, within ``NO_TIME_PARTS`` parts), and only what is left of a span, its sessions, is sorted again and joined
    over spans.
    """
    gap = int(gap_seconds * 1_000_000)
    rows = parsed.withColumns({"signature": log_signature(F.col("message")), "_at": F.unix_micros("ts")})
    rows = rows.withColumn("_span", F.when(F.col("ts").isNull(), -1 - F.pmod(F.col(order), F.lit(NO_TIME_PARTS))).otherwise(F.floor(F.col("_at") / (span_seconds * 1_000_000))))
    line = Window.partitionBy(*KEYS, "_span").orderBy("_at", order)
    far = F.col("_at").isNotNull() & (F.col("_at") - F.lag("_at").over(line) > gap)
    numbered = rows.withColumn("_part", F.sum(F.when(far, 1).otherwise(0)).over(line))
    inside = Window.partitionBy(*KEYS, "_span", "_part").orderBy("_at", order)
    placed = numbered.withColumn("_place", F.row_number().over(inside))
    first = F.when(F.col("_place") <= EXAMPLES, F.struct("_at", F.col(order).alias("_line"), "message", "level"))
    pieces = placed.groupBy(*KEYS, "_span", "_part").agg(F.count("*").alias("_count"), F.min("_at").alias("_start"), F.max("_at").alias("_end"), F.collect_list(first).alias("_first"))

    timed = F.col("_start").isNotNull()
    piece = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_first("_start"), "_span", "_part")
    before = F.lag("_end").over(piece)
    opens = F.when(timed & (F.row_number().over(piece) > 1) & (before.isNull() | (F.col("_start") - before > gap)), 1).otherwise(0)
    joined = pieces.withColumn("_opens", opens).withColumn("chunk_no", F.sum("_opens").over(piece))
    # of any piece the first five lines are enough; those of a session stand in its first pieces
    chunks = joined.groupBy(*KEYS, "chunk_no").agg(
        F.sum("_count").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("_first"))), 1, EXAMPLES).alias("_lines"),
        F.timestamp_micros(F.min("_start")).alias("timestamp_start"), F.timestamp_micros(F.max("_end")).alias("timestamp_end"),
    )
    head = F.element_at("_lines", 1)
    chunks = chunks.withColumns({"examples": F.transform("_lines", lambda x: x["message"]), "log_level": head["level"], "_first": head["_line"]})
    identity = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*KEYS, "timestamp_start", "_first")]), 256)
    return chunks.withColumn("chunk_id", identity).drop("_lines", "_first")


def ingest_stats(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: lines_total, lines_with_timestamp, levels (a map of counts), chunk_count, no_timestamps."""
    per = parsed.groupBy("level").agg(F.count("*").alias("n"), F.count("ts").alias("timed"))
    levels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n"))))
    lines = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines_total"), F.coalesce(F.sum("timed"), F.lit(0)).alias("lines_with_timestamp"), levels.alias("levels"))
    total = chunks.agg(F.count("*").alias("chunk_count"))  # both sides are one row
    return lines.crossJoin(F.broadcast(total)).withColumn("no_timestamps", (F.col("lines_total") > 0) & (F.col("lines_with_timestamp") == 0))
