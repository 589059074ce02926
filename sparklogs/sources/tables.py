"""Updates of stored tables, as new DataFrames; a writer then replaces or appends the partitions concerned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.sources.files import score_map

BUCKETS = 64


def upsert_chunks(existing: DataFrame, new: DataFrame, order: str | Column = "ingested_at") -> DataFrame:
    """``existing`` with rows of ``new`` put in by chunk_id; of several new ones the last by ``order`` counts."""
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last(order) if isinstance(order, str) else order))
    once = new.withColumn("_n", last).where("_n = 1").drop("_n")
    return existing.join(once.select("chunk_id"), "chunk_id", "left_anti").unionByName(once)


def upsert_table(path: str, new: DataFrame, order: str | Column = "ingested_at", buckets: int = BUCKETS) -> None:
    """Put rows of ``new`` into the chunk table at ``path`` by chunk_id; the table begins with the first rows.

    The table is dealt into ``buckets`` folders by chunk_id, and only those that the new rows belong to are read and
    written again. The same rows put in twice give the same table. Readers see a folder's old or new files; a store with
    transactions should stand in for plain Parquet where they must never see half an update.
    """
    spark = new.sparkSession
    keyed = new.withColumn("bucket", F.pmod(F.crc32(F.col("chunk_id").cast("binary")), F.lit(buckets)).cast("int")).persist()
    touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        known = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        stored = spark.read.schema(keyed.schema).parquet(path).where(F.col("bucket").isin(touched)) if known else keyed.limit(0)
        upsert_chunks(stored, keyed, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    keyed.unpersist()


def append_evidence(existing: DataFrame, found: DataFrame) -> DataFrame:
    """``existing`` with new evidence: one row for each investigation and chunk, blank ids left out.

    ``found`` has investigation_id, chunk_id, place (its order), service or source_service, timestamp or
    timestamp_start, level, message.
    """
    rows = found.where(F.trim("chunk_id") != "").select(
        "investigation_id", "chunk_id", F.coalesce("service", "source_service").alias("service"), F.coalesce("timestamp_start", "timestamp").alias("timestamp"), "level", "message", "place"
    )
    first = F.row_number().over(Window.partitionBy("investigation_id", "chunk_id").orderBy("place"))
    once = rows.withColumn("_n", first).where("_n = 1").drop("_n", "place")
    return existing.unionByName(once.join(existing.select("investigation_id", "chunk_id"), ["investigation_id", "chunk_id"], "left_anti"))


def leaderboard_rows(results: DataFrame) -> DataFrame:
    """One row for each run and dataset, failed ones too, in the form of the stored leaderboard."""
    return results.select(
        "run_id", "provider", "model", "dataset", F.col("aggregate_score").cast("decimal(4,3)").alias("aggregate_score"), "status", "judge_model",
        score_map(F.col("criteria")).alias("criteria"), F.to_json("stats").alias("stats"), "created_at",
    )


def write_leaderboard(results: DataFrame, path: str) -> None:
    leaderboard_rows(results).write.mode("append").parquet(path)
