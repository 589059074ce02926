"""Context-triggered piecewise hashing of documents.

A hash of the last seven bytes decides where a piece ends, so an edit changes the pieces near it and no others. Each
piece gives one character; the signature is taken at the coarsest block size that still gives enough pieces, and at the
next coarser one, so that texts of somewhat different length still share a block size. Likeness is one minus the edit
distance of two signatures at a common block size, over the longer length.

A piece has at least a quarter and at most eight times the block size, whatever the text repeats; so a signature never
has more than a few thousand characters, and comparing two is bounded too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklogs.llm.common import BATCH_BYTES, buffers, extended, mix

WINDOW = 7
LEAST_PIECES = 32
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TABLE = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_STEP = 1 << 20


def triggers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a window of seven bytes ends whose hash has at least two low zero bits, and how many it has (31 for zero)."""
    ends, levels = [], []
    for at in range(0, len(raw), _STEP):
        part = _TABLE[raw[max(at - WINDOW + 1, 0) : at + _STEP]]
        window = np.zeros(len(part), np.uint32)
        for k in range(min(WINDOW, len(part))):
            window[k:] += part[: len(part) - k] * np.uint32(pow(0x01000193, k, 2**32))
        window ^= window >> np.uint32(15)
        window *= np.uint32(0x85EBCA6B)
        window ^= window >> np.uint32(13)
        low = window & (~window + np.uint32(1))
        low[window == 0] = 1 << 31
        found = np.flatnonzero(low >= 4)
        found = found[found >= (WINDOW - 1 if at else 0)]
        levels.append(np.log2(low[found].astype(np.float64)).astype(np.int8))
        ends.append(found + max(at - WINDOW + 1, 0))
    return np.concatenate(ends or [np.zeros(0, np.int64)]), np.concatenate(levels or [np.zeros(0, np.int8)])


def piece_ends(marks: list[int], size: int, level: int) -> list[int]:
    """Ends of the pieces of a text of ``size`` bytes at block size 2**level; ``marks`` are the bytes that may end one.

    The next end is the first mark that gives at least a quarter of the block size, or eight times the block size.
    """
    least, most, at, k, out = max(1, (1 << level) // 4), 8 << level, 0, 0, []
    while at < size:
        k = bisect_left(marks, at + least - 1, k)
        at = min(marks[k] + 1 if k < len(marks) else size, at + most, size)
        out.append(at)
    return out


def fingerprints(texts: pa.Array) -> list[str]:
    """``level:signature:coarser signature`` of each whole text; the level is the binary logarithm of the block size.

    The level is the coarsest that gives ``LEAST_PIECES`` pieces, 2 if none does. An empty text has no piece.
    """
    raw, at = buffers(texts)
    ends, levels = triggers(raw)
    cut = np.searchsorted(ends, at)
    out = []
    for i in range(len(at) - 1):
        size = int(at[i + 1] - at[i])
        mine, lev = ends[cut[i] : cut[i + 1]] - at[i], levels[cut[i] : cut[i + 1]]
        # bytes before a text belong to its neighbour in the batch: the first six positions do not trigger
        mine, lev = mine[mine >= WINDOW - 1], lev[mine >= WINDOW - 1]
        level = max(2, size.bit_length() - 4)
        coarse = piece_ends(mine[lev >= level + 1].tolist(), size, level + 1)
        while True:
            fine = piece_ends(mine[lev >= level].tolist(), size, level)
            if level == 2 or len(fine) >= LEAST_PIECES:
                break
            level, coarse = level - 1, fine
        own = memoryview(raw)[int(at[i]) : int(at[i + 1])]
        names = ["".join([_DIGITS[xxhash.xxh3_64_intdigest(own[a:b]) & 63] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]) if cuts else "" for cuts in (fine, coarse)]
        out.append(f"{level}:{names[0]}:{names[1]}")
    return out


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best likeness of two fingerprints over the block sizes that both have; 0 if they have none."""
    ka, kb = (F.split_part(x, F.lit(":"), F.lit(1)).cast("int") for x in (a, b))
    fine, coarse = ([F.split_part(x, F.lit(":"), F.lit(k)) for x in (a, b)] for k in (2, 3))

    def score(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)

    return (
        F.when(a == b, 1.0)
        .when(ka == kb, F.greatest(score(*fine), score(*coarse)))
        .when(ka == kb + 1, score(fine[0], coarse[1]))
        .when(kb == ka + 1, score(coarse[0], fine[1]))
        .otherwise(0.0)
    )


RANGES_A_SPLIT = 4
SAMPLE_A_RANGE = 64


def _order_keys(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as 16 bytes that sort like them."""
    flat = np.stack([key, tie], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.frombuffer(flat.astype(">u8").tobytes(), "S16")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id and text in ranges by descending (doc_id, hash of the text), each followed by the row that opens the next.

    Columns: doc_id, text, key, tie, part, seam (true for that extra row). The ranges come from a sample of about
    ``SAMPLE_A_RANGE`` rows a range, which only decides how even they are; many rows with one doc_id (or none) are
    parted by their texts. At most ``parts`` rows are added and sent to the driver, whatever the number of documents.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("tie"))
    count = rows.count() if parts > 1 else 0
    edges = np.zeros(0, "S16")
    if count:
        sample = rows.select("key", "tie").where(F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE_A_RANGE * parts / count) * 2**30)).limit(2 * SAMPLE_A_RANGE * parts).toArrow()
        keys = np.sort(_order_keys(sample["key"].to_numpy(), sample["tie"].to_numpy()))
        edges = np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else edges
    schema = extended(rows, part="int")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = len(edges) - np.searchsorted(edges, _order_keys(batch.column("key").to_numpy(), batch.column("tie").to_numpy()), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], schema.names)

    ranged = rows.mapInArrow(place, schema)
    narrow = rows.select("doc_id", F.lit("").alias("text"), "key", "tie").mapInArrow(place, schema)
    heads = [(r["part"], *r["top"]) for r in narrow.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("top")).orderBy("part").collect()]
    if not heads:
        return ranged.withColumn("seam", F.lit(False))
    seams = docs.sparkSession.createDataFrame([(k, t, heads[i - 1][0]) for i, (_, k, t) in enumerate(heads)], "key long, tie long, to int")
    extra = rows.join(F.broadcast(seams), ["key", "tie"]).dropDuplicates(["to"]).select("doc_id", "text", "key", "tie", F.col("to").alias("part"), F.lit(True).alias("seam"))
    return ranged.withColumn("seam", F.lit(False)).unionByName(extra)


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see ``op8`` for the columns.

    Edited: the last third of the code points replaced by as many (or all) of the first of the next document, by
    descending doc_id, after the last the first; a lone document follows itself. Ties of doc_id go by a hash of the
    text; null text is empty, a null doc_id comes last; repeated rows follow each other; no rows give none. ``parts``
    ranges (four for each split of the scan, by default, at most 20,000) are sorted on their own.
    """
    parts = parts or min(20_000, RANGES_A_SPLIT * max(6, docs.rdd.getNumPartitions()))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            texts = [r[1] for r in rows]
            prints = fingerprints(pa.array(texts, pa.string()))
            own = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][3]]
            edited = [texts[i][: (n := len(texts[i])) - n // 3] + texts[j][: n // 3] for i, j in own]
            after = fingerprints(pa.array(edited, pa.string())) if edited else []
            columns = [
                [rows[i][0] for i, _ in own], [len(texts[i]) for i, _ in own], [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                [prints[i] for i, _ in own], after, [prints[j] for _, j in own],
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "part", "seam")), strict=True):
                held.append(row)
                size += len(row[1])
                if size > BATCH_BYTES:
                    yield settle(held)
                    held, size = held[-1:], len(row[1]) if not row[3] else 0
        if held:
            yield settle(held)

    ordered = with_next(docs, parts).repartition(parts, "part").sortWithinPartitions("part", F.col("seam").asc(), F.col("key").desc(), F.col("tie").desc())
    found = ordered.select("doc_id", "text", "part", "seam").mapInArrow(run, schema)
    return found.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))})
