"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

When one shard is appended, only the keys that move into it change place, a fraction 1 / (n + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.llm.common import mix, written


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, after Lamping and Veach; the loop runs about ln(shards) times over fewer and fewer keys."""
    state, at = mix(keys.view(np.uint64)), np.zeros(len(keys), np.int64)
    jump, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while left.size:
        at[left] = jump[left]
        state[left] = state[left] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[left] >> np.uint64(33)).astype(np.float64) + 1
        jump[left] = ((at[left] + 1) * (2.0**31 / draw)).astype(np.int64)
        left = left[jump[left] < shards]
    return at.astype(np.int32)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot and grown_shard.

    Slots are gapless from 0 in each shard. A scan task numbers its own rows of a shard; what earlier tasks hold is
    then added, so no shard is ever gathered or sorted and a hot shard or key costs nothing extra. Null text counts as
    empty; a null doc_id hashes as key 0; repeated rows get a slot each; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, local long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shard, order = jump_hash(keys, shards), None
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            local = np.empty(len(keys), np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            columns = [*batch.columns, pa.array(shard), pa.array(jump_hash(keys, shards + 1)), pa.array(np.full(len(keys), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    placed = written(narrow.mapInArrow(number, schema), "shards")
    held = placed.groupBy("shard", "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("shard", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), "grown_shard"
    )
