"""Continuous ingest: parsing, sessions, counts and first sights over streams of log files, and an upsert sink.

State is bounded by the watermark. Rows without a time cannot be sessionised in a stream; ``untimed`` gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparklogs.functions.parsing import log_signature, parse_log_lines
from sparklogs.operators.events import event_rollup
from sparklogs.operators.sessions import EXAMPLES, GAP_SECONDS
from sparklogs.sources.appended import RANGE_BYTES, AppendedLines
from sparklogs.sources.tables import BUCKETS, upsert_table
from sparklogs.sources.versions import ChunkTable
from sparklogs.streaming.sessions import KEYS, SESSIONS, session_cells


def stream_parse(spark: SparkSession, folder: str, service: str, now: Column | None = None, env: str = "production", project_id: str | None = None, max_files: int = 100) -> DataFrame:
    """Parsed rows, with signature, of files that arrive in ``folder``; each file is read once, also over restarts."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return _parsed(lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")), service, now, env, project_id)


def stream_appended(spark: SparkSession, folder: str, service: str, now: Column | None = None, env: str = "production", project_id: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Parsed rows, with signature, of what is written to files under ``folder``, new or growing; each line is read once, when
    it has its end, and of a file only the bytes after those that were read before. Lines carry the ``offset`` of their
    first byte."""
    spark.dataSource.register(AppendedLines)
    lines = spark.readStream.format("appended_lines").option("path", folder).option("rangeBytes", range_bytes).load()
    return _parsed(lines.withColumn("line", F.regexp_replace("line", r"\r$", "")), service, now, env, project_id)


def _parsed(lines: DataFrame, service: str, now: Column | None, env: str, project_id: str | None) -> DataFrame:
    named = {"project_id": F.lit(project_id).cast("string"), "source_service": F.lit(service), "source_env": F.lit(env)}
    raw = lines.where(F.trim("line") != "").select(*[c.alias(k) for k, c in named.items()], *lines.columns)
    return parse_log_lines(raw, F.current_timestamp() if now is None else now).withColumn("signature", log_signature(F.col("message")))


def untimed(parsed: DataFrame) -> DataFrame:
    return parsed.where("ts is null")


_STATE = "sessions array<struct<start: long, end: long, count: long, lines: array<struct<ts: long, message: string, level: string>>>>"


def merge_sessions(open_: list[tuple], lines: list[tuple], gap: int) -> list[tuple]:
    """Sessions (start, end, count, first lines) of open ones and new lines (ts, message, level), times in microseconds.

    Lines at most the gap apart belong together; a session keeps its first ``EXAMPLES`` lines and no others.
    """
    singles = [(ts, ts, 1, [(ts, message, level)]) for ts, message, level in lines]
    out: list[tuple] = []
    for start, end, count, first in sorted([*open_, *singles], key=lambda s: (s[0], s[1])):
        if out and start - out[-1][1] <= gap:
            a, b, n, kept = out[-1]
            out[-1] = (a, max(b, end), n + count, sorted([*kept, *first])[:EXAMPLES])
        else:
            out.append((start, end, count, first))
    return out


def stream_chunks(parsed: DataFrame, gap_seconds: int = GAP_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Closed sessions of one signature of one service; append mode emits each once, when the watermark passes it.

    ``delay`` should not be less than the gap. A line exactly the gap later still belongs to a session. Examples and the
    level follow the order of time and message. The state of a signature is its open sessions: two times, a number and
    five lines each, however many lines there are. ``chunk_id`` comes from the keys and the first line, so a run after a
    restart gives the same one.
    """
    gap = gap_seconds * 1_000_000

    def sessions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(s["start"], s["end"], s["count"], [(x["ts"], x["message"], x["level"]) for x in s["lines"]]) for s in state.get[0]] if state.exists else []
        for frame in frames:
            frame = frame.sort_values("micros", kind="stable")
            held = merge_sessions(held, list(zip(frame["micros"].tolist(), frame["message"].tolist(), frame["level"].tolist(), strict=True)), gap)
        mark = state.getCurrentWatermarkMs() * 1000
        done, held = [s for s in held if s[1] + gap <= mark], [s for s in held if s[1] + gap > mark]
        if held:
            state.update(([{"start": a, "end": b, "count": n, "lines": [{"ts": t, "message": m, "level": v} for t, m, v in lines]} for a, b, n, lines in held],))
            state.setTimeoutTimestamp(max(min(s[1] for s in held) + gap, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if done:
            rows = [(*key, n, [m for _, m, _ in lines], pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), lines[0][2]) for a, b, n, lines in done]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SESSIONS.split(", ")])

    timed = parsed.where("ts is not null").withWatermark("ts", delay).select(*KEYS, "ts", F.unix_micros("ts").alias("micros"), "message", "level")
    return _identified(timed.groupBy(*KEYS).applyInPandasWithState(sessions, SESSIONS, _STATE, "append", GroupStateTimeout.EventTimeTimeout))


def stream_chunks_by_cells(parsed: DataFrame, gap_seconds: int = GAP_SECONDS, delay: str = "1 minute") -> DataFrame:
    """The rows of ``stream_chunks``, from state that is kept in cells of time with a timer each: a batch reads and writes the
    cells of its own lines and those of sessions that close, and nothing of what else is open.

    Needs a state store with column families (RocksDB).
    """
    return _identified(session_cells(parsed, gap_seconds, delay))


def _identified(found: DataFrame) -> DataFrame:
    first = [*KEYS, F.unix_micros("timestamp_start").cast("string"), F.element_at("examples", 1)]
    identity = F.concat_ws("|", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in first])
    return found.withColumn("chunk_id", F.sha2(identity, 256))


def stream_bucket_counts(parsed: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """service, signature, level, start, end, n of tumbling (or sliding) windows; rows behind the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = parsed.withWatermark("ts", delay).groupBy(window.alias("w"), "source_service", "signature", "level").agg(F.count("*").alias("n"))
    return counts.select(F.col("source_service").alias("service"), "signature", "level", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_new_patterns(parsed: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each (project_id, source_service, signature) within the watermark's reach; rows without a time are
    left out."""
    return parsed.where("ts is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["project_id", "source_service", "signature"])


def stream_new_patterns_ever(parsed: DataFrame) -> DataFrame:
    """project_id, signature, ts, each emitted the first time it is seen, however long ago: one flag a signature is kept.

    Needs a state store with column families (RocksDB).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "ts timestamp")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: object) -> Iterator[pd.DataFrame]:
            first = min((pdf["ts"].min() for pdf in rows), default=None)
            if not self.seen.exists():
                self.seen.update((first,))
                yield pd.DataFrame({"project_id": [key[0]], "signature": [key[1]], "ts": [first]})

        def close(self) -> None:
            pass

    rows = parsed.where("ts is not null").select("project_id", "signature", "ts")
    return rows.groupBy("project_id", "signature").transformWithStateInPandas(First(), "project_id string, signature string, ts timestamp", "Append", "None")


def stream_upsert(chunks: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query that puts what is there of ``chunks`` (chunk_id, timestamp_end, ...) into the chunk table at ``path``.

    A micro-batch touches only the folders that its ids belong to; a batch that is run again gives the same table,
    because equal ids replace each other.
    """

    def put(batch: DataFrame, number: int) -> None:
        upsert_table(path, batch, F.desc_nulls_last("timestamp_end"), buckets)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_merge(chunks: DataFrame, path: str, checkpoint: str, **sizes: int) -> StreamingQuery:
    """Start a query that appends what is there of ``chunks`` to the ``ChunkTable`` at ``path``, which merges when it is read.

    A micro-batch writes its own rows; one that runs again after a failure is left out, as the table knows its number.
    ``sizes`` go to the table.
    """

    def put(batch: DataFrame, number: int) -> None:
        ChunkTable(batch.sparkSession, path, **sizes).upsert(batch, F.desc_nulls_last("timestamp_end"), checkpoint, number)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_rollup(chunks: DataFrame, path: str, checkpoint: str, **sizes: int) -> StreamingQuery:
    """Start a query that keeps the ``event_rollup`` of what is there of ``chunks`` at ``path``; ``read_rollup`` reads it.

    A micro-batch appends its own counts; one that runs again is left out. A minute has a row for each batch that it was in.
    """

    def put(batch: DataFrame, number: int) -> None:
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("service", "signature", "level", "minute")]
        rows = event_rollup(batch).withColumn("rollup_id", F.md5(F.concat_ws("\x00", F.lit(f"{checkpoint}/{number}"), *keys)))
        ChunkTable(batch.sparkSession, path, "rollup_id", **sizes).upsert(rows, "minute", checkpoint, number)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return ChunkTable(spark, path, "rollup_id").read().drop("rollup_id")


def stream_first_sights(parsed: DataFrame, path: str, checkpoint: str, **sizes: int) -> StreamingQuery:
    """Start a query that puts the first sight of each (project_id, signature) of what is there of ``parsed`` into the
    ``ChunkTable`` at ``path``: project_id, signature, ts, pattern_id.

    What was seen is in that table and nowhere else: the stream has no state, so nothing grows with its age but the table.
    A batch is summed up to one row a pattern, of which those that the table has go. Rows without a time are left out.
    """

    def put(batch: DataFrame, number: int) -> None:
        key = F.md5(F.concat_ws("\x00", F.coalesce("project_id", F.lit("")), F.col("project_id").isNull().cast("string"), "signature"))
        first = batch.where("ts is not null and signature is not null").groupBy("project_id", "signature").agg(F.min("ts").alias("ts")).withColumn("pattern_id", key)
        table = ChunkTable(batch.sparkSession, path, "pattern_id", **sizes)
        if table.state().schema is not None:
            first = first.join(table.read().select("pattern_id"), "pattern_id", "left_anti").select("project_id", "signature", "ts", "pattern_id")
        table.upsert(first, "ts", checkpoint, number)

    return parsed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
