"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target size; a document is taken ``floor(rate)`` times plus once more with its fractional inclusion
probability. The flight moves those probabilities through the null space of two balancing constraints (how many
documents, how many words), three documents at a time, until each is 0 or 1. Blocks of documents fly on their own; at most two
of a block stay open and fly once more per source, together with one block that has waited. At most two of a source are
then landed, and pairs of documents of that last flight exchanged until the words are right too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.llm.common import Words, mix, slices, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 20_000
#: A run of rows with one key is flown in pieces of about so many.
MOST_ROWS = 200_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows of (source, source_size).

    Sources in code point order, null last, take the weights in turn. A target stops at ``most`` times its source's
    size and the excess is shared again by weight: the level at which that ends is found by sorting sources by the
    level that fills them. There is one row per source here, whatever the number of documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    up = Window.orderBy("full", F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", weight).withColumn("full", most * F.col("source_size") / F.col("weight"))
    full_before = F.coalesce(F.sum(most * F.col("source_size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - full_before) / open_weight
    leveled = ranked.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", F.col("source").isNull().alias("last"), "source", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("source_size") * float(most), F.coalesce(found * F.col("weight"), F.lit(0.0)))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def _move(active: list[list], draw: float) -> None:
    """One step in the null space of (1, size) over two or three open documents, each a list [size, probability, row]."""
    if len(active) == 3:
        (a, *_), (b, *_), (c, *_) = active
        v = (b - c, c - a, a - b)
        scale = max(map(abs, v))
        v = tuple(x / scale for x in v) if scale else (1.0, -1.0, 0.0)
    else:
        v = (1.0, -1.0)
    up = min(((1 - u[1]) / x if x > 0 else -u[1] / x) for u, x in zip(active, v, strict=True) if x)
    down = min((u[1] / x if x > 0 else (u[1] - 1) / x) for u, x in zip(active, v, strict=True) if x)
    step = up if draw * (up + down) < down else -down
    for u, x in zip(active, v, strict=True):
        u[1] += step * x
        if u[1] < 1e-9 or u[1] > 1 - 1e-9:
            u[1] = float(round(u[1]))


def fly(rows: Iterator[tuple[float, float, float]]) -> Iterator[tuple[int, float]]:
    """Yield (row number, probability) as each of ``rows`` of (size, probability, draw) settles; the last may stay open."""
    active: list[list] = []
    for k, (size, p, draw) in enumerate(rows):
        if p <= 0 or p >= 1:
            yield k, p
            continue
        active.append([size, p, k])
        while len(active) == 3 or (len(active) == 2 and active[0][0] == active[1][0]):
            _move(active, draw)
            yield from ((u[2], u[1]) for u in active if u[1] in (0.0, 1.0))
            active = [u for u in active if u[1] not in (0.0, 1.0)]
            draw = (draw * 1021.7) % 1.0
    yield from ((u[2], u[1]) for u in active)


def land(size: list[float], p: list[float]) -> list[float]:
    """0 or 1 for each of a few open documents: the choice nearest to the expected words, then to the expected number."""
    n = len(size)
    choices = [[float(c >> i & 1) for i in range(n)] for c in range(2**n)]
    off = lambda c: (abs(sum(s * (x - q) for s, x, q in zip(size, c, p, strict=True))), abs(sum(c) - sum(p)), c)
    return min(choices, key=off)


def swap(size: np.ndarray, taken: np.ndarray, off: float, most: int = 64) -> None:
    """Exchange taken and untaken documents in place, pair by pair, until ``off`` words fewer are taken, as nearly as can be.

    One that is much larger than all others keeps the flight's last place; whatever it is rounded to, others make up for
    it, and as many documents are taken as before.
    """
    for _ in range(most):
        sign = 1 if off > 0 else -1
        give, get = np.flatnonzero(taken == (1 if sign > 0 else 0)), np.flatnonzero(taken == (0 if sign > 0 else 1))
        if not len(give) or not len(get):
            return
        get = get[np.argsort(size[get], kind="stable")]
        # what leaves minus what comes in its place, as near below the difference as can be
        at = np.searchsorted(size[get], size[give] - abs(off))
        at_ok = np.minimum(at, len(get) - 1)
        change = np.where(at < len(get), size[give] - size[get[at_ok]], 0)
        best = int(np.argmax(change))
        if change[best] <= 0:
            return
        taken[give[best]], taken[get[at_ok[best]]] = (0, 1) if sign > 0 else (1, 0)
        off -= sign * change[best]


def _flights(last: bool):
    """A mapInArrow function over rows sorted by (source, block): flies each block, keeping three rows at a time open.

    The last flight also lands what is left open, and exchanges documents until the words are right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            size = table["size"].to_numpy().astype(float)
            p = table["open"].to_numpy().copy()
            draw = mix(table["doc_id"].fill_null(0).to_numpy().view(np.uint64) + np.uint64(77)) / 2.0**64
            drawn, wanted = np.flatnonzero((p > 0) & (p < 1)), float((size * p).sum())
            for k, q in fly(zip(size.tolist(), p.tolist(), draw.tolist(), strict=True)):
                p[k] = q
            if last and len(drawn):
                rest = np.flatnonzero((p > 0) & (p < 1)).tolist()
                p[rest] = land(size[rest].tolist(), p[rest].tolist()) if rest else []
                own = p[drawn]
                swap(size[drawn], own, float((size * p).sum()) - wanted)
                p[drawn] = own
            return table.set_column(table.schema.get_field_index("open"), "open", pa.array(p)).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = pa.compute.binary_join_element_wise(pa.compute.fill_null(batch["source"], "\x00"), batch["block"].cast("string"), "\x01")
            runs = pa.compute.run_end_encode(key)
            at = 0
            for end in runs.run_ends.to_pylist():
                part = batch.slice(at, end - at)
                if held and ((held[-1]["source"][0], held[-1]["block"][0]) != (part["source"][0], part["block"][0]) or sum(x.num_rows for x in held) > MOST_ROWS):
                    yield settle(pa.Table.from_batches(held))
                    held = []
                held.append(part)
                at = end
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def word_sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and size, the number of words of each whole text."""
    schema = docs.select(*keep).schema.add("size", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = np.diff(Words(part.column("text")).first)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(n.astype(np.int64))], [*keep, "size"])

    return docs.select(*keep, "text").mapInArrow(count, schema)


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and copies for each row of (doc_id, source, size, ...); others are kept.

    ``block_rows`` only sets how much one flight covers. Draws come from doc_id, so reruns agree. Null sources form a
    source; documents without words have size 0 and never add words; repeated rows are sampled each; no rows give none.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    blocks = max(1, math.ceil((per.agg(F.sum("n")).first()[0] or 0) / block_rows))
    rates = source_targets(per).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    same: Column = sized["source"].eqNullSafe(rates["source"])
    rated = sized.join(rates, same).drop(rates["source"])
    whole = F.floor(F.col("rate") + 1e-12)
    ready = rated.select(*sized.columns, "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("open"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    # block 0 of each source waits for what the others leave open, so that the landing has documents to choose from
    order = ["source", "block", F.desc("size"), "doc_id"]
    first = ready.where("block > 0").repartition("source", "block").sortWithinPartitions(*order).mapInArrow(_flights(False), ready.schema)
    first = written(first, "flight")
    is_open = (F.col("open") > 0) & (F.col("open") < 1)
    rest = first.where(is_open).withColumn("block", F.lit(0)).unionByName(ready.where("block = 0")).repartition("source").sortWithinPartitions(*order)
    landed = first.where(~is_open).unionByName(rest.mapInArrow(_flights(True), first.schema))
    return landed.withColumn("copies", (F.col("whole") + F.round("open")).cast("long")).drop("whole", "open", "block")
