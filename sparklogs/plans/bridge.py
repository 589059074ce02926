"""Log tables made from the driver's tables, the same in Spark and in DuckDB SQL, so that every operator runs on data
that grows with them. Chunks and raw lines come from ``events``, retrieval from ``documents`` and ``benchmark``."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklogs.functions.intent import SYNONYMS

START, END = datetime(2024, 1, 5), datetime(2024, 1, 14)
NOW = datetime(2024, 1, 31)

#: The chunk table in DuckDB SQL; oracles are written on top of it.
CHUNKS_SQL = """
ev AS (SELECT event_id, user_id, event_type, value, ts, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events),
chunks AS (
  SELECT 'c' || event_id AS chunk_id, event_id, user_id, value, 'p' || (user_id % 3) AS project_id, 'svc-' || (user_id % 4) AS source_service,
    CASE WHEN event_id % 5 = 0 THEN 'staging' ELSE 'production' END AS source_env,
    CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN day(ts) % 4 = 0 THEN 'WARNING' ELSE 'INFO' END
         WHEN event_type = 'click' THEN 'DEBUG' ELSE 'INFO' END AS log_level,
    'req_' || (event_id % 997) AS request_id, ts AS timestamp_start, ts AS timestamp_end,
    event_type || ' k=' || (k % 2) || ' v' || (day(ts) // 10) AS signature,
    'Signature: ' || event_type || ' k=' || (k % 2) || ' v' || (day(ts) // 10) || chr(10) || 'Examples: ' || event_type || ' k=' || k || ' order-' || (event_id % 50) AS text
  FROM ev)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt out over all cores if it has fewer files than these: one file is often one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table: one chunk for each event."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    day = F.day("ts")
    signature = F.concat("event_type", F.lit(" k="), (k % 2).cast("string"), F.lit(" v"), F.call_function("div", day, F.lit(10)).cast("string"))
    sometimes = F.when(day % 4 == 0, "WARNING").otherwise("INFO")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type").isin("purchase", "signup"), sometimes).when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    text = F.concat(F.lit("Signature: "), signature, F.lit("\nExamples: "), "event_type", F.lit(" k="), k.cast("string"), F.lit(" order-"), (F.col("event_id") % 50).cast("string"))
    named = lambda prefix, n: F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))
    return events.select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), "event_id", "user_id", "value", named("p", 3).alias("project_id"), named("svc-", 4).alias("source_service"),
        F.when(F.col("event_id") % 5 == 0, "staging").otherwise("production").alias("source_env"), level.alias("log_level"),
        F.concat(F.lit("req_"), (F.col("event_id") % 997).cast("string")).alias("request_id"),
        F.col("ts").alias("timestamp_start"), F.col("ts").alias("timestamp_end"), signature.alias("signature"), text.alias("text"),
    )


#: Raw lines in DuckDB SQL: six formats in turn.
LINES_SQL = """
raw_lines AS (
  SELECT event_id, 'svc-' || (user_id % 4) AS source_service, ts, value,
    CASE event_id % 6
      WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' [' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END || '] ' || event_type || ' took ' || (event_id % 90) || ' ms'
      WHEN 1 THEN '{"timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '", "level": "warn", "message": "' || event_type || ' id ' || event_id || '"}'
      WHEN 2 THEN strftime(ts, '%b %d %H:%M:%S') || ' host app[' || (event_id % 700) || ']: ' || CASE event_type WHEN 'error' THEN 'error: disk ' ELSE 'ok disk ' END || (event_id % 7)
      WHEN 3 THEN '10.0.0.' || (event_id % 200) || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || ' HTTP/1.1" 200 ' || event_id
      WHEN 4 THEN '[' || strftime(ts, '%a %b %d %H:%M:%S %Y') || '] [' || CASE event_type WHEN 'error' THEN 'crit' ELSE 'notice' END || '] child ' || event_type || ' state ' || (event_id % 10)
      ELSE 'plain ' || event_type || ' text 0x' || printf('%x', event_id) END AS line
  FROM events)"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, source_service, ts, line: each event as a log line, in six formats in turn."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind, number, error = F.col("event_type"), F.col("event_id"), F.col("event_type") == "error"
    say = lambda pattern: F.date_format("ts", pattern)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    iso = text(say("yyyy-MM-dd'T'HH:mm:ss"), "Z")
    line = (
        F.when(number % 6 == 0, text(iso, " [", F.when(error, "ERROR").otherwise("INFO"), "] ", kind, " took ", number % 90, " ms"))
        .when(number % 6 == 1, text('{"timestamp": "', iso, '", "level": "warn", "message": "', kind, " id ", number, '"}'))
        .when(number % 6 == 2, text(say("MMM dd HH:mm:ss"), " host app[", number % 700, "]: ", F.when(error, "error: disk ").otherwise("ok disk "), number % 7))
        .when(number % 6 == 3, text("10.0.0.", number % 200, " - - [", say("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', kind, ' HTTP/1.1" 200 ', number))
        .when(number % 6 == 4, text("[", say("EEE MMM dd HH:mm:ss yyyy"), "] [", F.when(error, "crit").otherwise("notice"), "] child ", kind, " state ", number % 10))
        .otherwise(text("plain ", kind, " text 0x", F.lower(F.hex("event_id"))))
    )
    return events.select("event_id", F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("source_service"), "ts", "value", line.alias("line"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a temporary one only in plain local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparklogs-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def drained(frame: DataFrame, name: str) -> DataFrame:
    """What a stream gives for the data that is there, written in append mode and read back."""
    spark = frame.sparkSession
    folder = scratch(spark, name)
    stream = frame.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


def synonyms_sql() -> str:
    rows = ", ".join(f"('{k}', {i}, '{v}')" for k, vs in SYNONYMS.items() for i, v in enumerate(vs))
    return f"syn(word, nth, synonym) AS (VALUES {rows})"


#: query_id, variant, text of the variants of a table of (query_id, query).
VARIANTS_SQL = """words AS (SELECT query_id, query, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> ''), 1) AS at_ FROM {q}),
  every AS (SELECT query_id, query AS text, 0 AS ord FROM {q} UNION ALL SELECT query_id, replace(lower(query), word, synonym), at_ * 100 + nth FROM words JOIN syn USING (word)),
  once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY ord) = 1),
  variants AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) - 1 AS INTEGER) AS variant, text FROM once QUALIFY variant < 5)"""


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps as UTC without a zone, which DuckDB reads as its own."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


#: Ranked hits of queries, 250 each: every chunk belongs to one, so there are more queries where there are more events.
HITS_SQL = CHUNKS_SQL + """,
hits AS (SELECT event_id // 250 AS query_id, row_number() OVER (PARTITION BY event_id // 250 ORDER BY value DESC, chunk_id) - 1 AS rank, value AS score, * FROM chunks)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumns({"query_id": F.call_function("div", F.col("event_id"), F.lit(250)), "score": F.col("value")})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "chunk_id")) - 1)
