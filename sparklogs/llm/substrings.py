"""Substring deduplication: words covered by a window of words that also starts elsewhere are removed.

The corpus is sharded by content. The smallest hash of 8 words in a window is its anchor; neighbouring windows of one
document with the anchor at the same place form a segment, and equal windows always have equal anchors, so all places where a
window can recur are in different segments of one shard. Each shard builds a compressed FM-index (the Burrows-Wheeler
transform of its segments in a wavelet matrix of bit vectors with rank counts); all segments are streamed against it by
backward search, whose matching statistics give the windows that occur at least twice, and so the intervals at or above
the threshold.

A segment that occurs several times is indexed once, with the number of its occurrences as its weight: the index counts
weights, and it alone decides. The segments of an anchor with very many different ones (a passage that a large part of
the corpus quotes) are cut into single windows, which are summed up and dealt to shards by their own content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklogs.llm.common import Words, expand, rolling, signed, slices, word_hashes, written

WINDOW = 35
GRAM = 8
SHARD_WORDS = 400_000
#: An anchor with more different segments than this is dealt out window by window.
HOT_SEGMENTS = 3000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the smallest of ``values[i : i + width]``; the last ``width - 1`` entries cover less."""
    out, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        if step < len(out):
            left, right = out[:-step], out[step:]
            out = np.concatenate([np.where(values[right] < values[left], right, left), out[len(out) - step :]])
        done += step
    return out


def segments(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text, first window in the text, number of windows, anchor and content hash of each segment of a batch.

    A segment has at most ``window - gram + 1`` windows (28), so a mask of them fits in 64 bits.
    """
    own = word_hashes(words, 2)
    n, count = len(own), np.maximum(np.diff(words.first) - window + 1, 0)
    at = expand(words.first[:-1], count)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    start = np.arange(n)
    grams = rolling(3).runs(own, start, np.minimum(start + gram, n))
    place = sliding_argmin(grams, window - gram + 1)[at]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    size = np.diff(first, append=len(at))
    anchor = grams[place]
    text = np.repeat(np.arange(len(count)), count)[first]
    content = rolling(4).runs(own, at[first], at[first] + size + window - 1)
    return text, at[first] - words.first[text], size, signed(anchor[first]), signed(content)


def window_hashes(words: Words, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of the windows that begin at the given words."""
    own = word_hashes(words, 2), word_hashes(words, 21)
    return tuple(signed(rolling(4).runs(x, first, first + window)) for x in own)


class FMIndex:
    """Counts occurrences of word sequences in a set of weighted segments by backward search.

    ``symbols`` are dense word numbers from 1, segments one after another, each closed by a 0; ``weights`` has one number
    for each symbol. The transform is kept as a wavelet matrix: per bit of the alphabet one packed bit vector with a
    running count, in 32 bits, for every 64 positions.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray | None = None):
        n = len(symbols)
        stops = symbols == 0
        rank = symbols.astype(np.int64) + int(stops.sum())
        rank[stops] = np.arange(int(stops.sum()))  # closing symbols differ, so no suffix runs over its segment
        depth = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - depth, 0)] = rank[depth:] + 1
            key = (rank << 32) | ahead
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else np.zeros(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth *= 2
            if not n or new[-1] == n - 1:
                break
        # weight of all suffixes before each place in their order
        self.weight = np.concatenate([[0], np.cumsum(weights[order] if weights is not None else np.ones(n, np.int64))])
        column = symbols[order - 1]
        top = int(symbols.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))[:-1]])
        self.n, self.levels = n, []
        for bit in range(max(top.bit_length(), 1) - 1, -1, -1):
            on = (column >> bit & 1).astype(bool)
            packed = np.zeros(n // 64 + 1, np.uint64)
            packed.view(np.uint8)[: (n + 7) // 8] = np.packbits(on, bitorder="little")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.uint32)])[:-1]
            self.levels.append((bit, packed, counts, int(n - on.sum())))
            column = np.concatenate([column[~on], column[on]])
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            cell = at >> 6
            ones = counts[cell].astype(np.int64) + np.bitwise_count(packed[cell] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put ``symbol`` before the matched sequence: the new bound for each old bound of a suffix range."""
        return self.before[symbol] + self._descend(symbol, at) - self.base[symbol]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The weight of each suffix range."""
        return self.weight[np.maximum(high, low)] - self.weight[low]


def recurring_windows(index: FMIndex, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each segment ``symbols[first : first + size]`` a bit mask of its windows that occur twice or more.

    Matching statistics by backward search from a segment's end, all segments in step. While the match still occurs
    twice it grows to the left, and every window inside it is marked. When it no longer does, no window that contains it
    can recur, and the search goes on at the last end that avoids it.
    """
    mask = np.zeros(len(first), np.uint64)
    live = np.flatnonzero(size >= window)
    start = first[live]
    end = start + size[live] - 1
    at, low, high = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), index.n)
    while len(live):
        symbol = symbols[at]
        both = index.extend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        new_low, new_high = both[: len(live)], both[len(live) :]
        again = index.occurrences(new_low, new_high) >= 2
        hit = again & (end - at >= window - 1)
        mask[live[hit]] |= np.uint64(1) << (at[hit] - start[hit]).astype(np.uint64)
        back = np.minimum(end - 1, at + window - 1)
        low, high = np.where(again, new_low, 0), np.where(again, new_high, index.n)
        end = np.where(again, end, back)
        at = np.where(again, at - 1, back)
        keep = np.where(again, at >= start, end - start >= window - 1)
        live, start, end, at, low, high = (x[keep] for x in (live, start, end, at, low, high))
    return mask


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of a row: doc_id with null as the least value, and a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64(text).alias("k2"))


def _occurrences(rows: DataFrame, window: int) -> DataFrame:
    schema = "k1 long, k2 long, pos int, size int, anchor long, content long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, pos, size, anchor, content = segments(Words(part.column("text")), window)
                keys = [part.column(k).take(pa.array(text)) for k in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(anchor), pa.array(content)], ["k1", "k2", "pos", "size", "anchor", "content"])

    return rows.select("k1", "k2", "text").mapInArrow(run, schema)


def _texts_of(batch: pa.RecordBatch, wanted: str) -> tuple[Words, pa.StructArray, np.ndarray]:
    """The words of a batch, its flattened list column of structs, and the row each of those belongs to."""
    lists = batch.column(wanted)
    return Words(batch.column("text")), lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _search(window: int):
    """A mapInArrow function over segments sorted by shard: whole shard keys make a shard of about SHARD_WORDS words."""

    def shard(table: pa.Table) -> list[pa.RecordBatch]:
        key, content = table["shard"].to_numpy(), table["content"].to_numpy()
        new = np.ones(len(key), bool)  # repeated rows give their segments several times
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        table = table.filter(pa.array(new)).combine_chunks()
        if not len(table):
            return []
        words = Words(table["words"].chunk(0))
        count = np.diff(words.first)
        _, number = np.unique(word_hashes(words, 2), return_inverse=True)
        first = words.first[:-1] + np.arange(len(count))
        symbols = np.zeros(len(number) + len(count), np.int64)
        symbols[expand(first, count)] = number + 1
        weights = np.repeat(table["n"].to_numpy(), count + 1)
        mask = recurring_windows(FMIndex(symbols, weights), symbols, first, count, window)
        found = np.flatnonzero(mask)
        rows = table.select(["shard", "content"]).take(pa.array(found))
        return rows.append_column("mask", pa.array(signed(mask[found]))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch.column("size").to_numpy().sum()) + window * batch.num_rows
            if size < SHARD_WORDS:
                continue
            table = pa.Table.from_batches(held)
            key = table["shard"].to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last:
                yield from shard(table.slice(0, last))
                table = table.slice(last)
                held, size = table.to_batches(), int(table["size"].to_numpy().sum()) + window * len(table)
        if held:
            yield from shard(pa.Table.from_batches(held))

    return run


def duplicate_marks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2, pos, size, mask: bit i of ``mask`` says that the window at word ``pos + i`` of that row also starts elsewhere."""
    seen = written(_occurrences(rows, window), "segments")
    # different segments and how often each occurs; summed up before the shuffle, so that copies cost nothing after it
    contents = written(seen.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "size")).alias("at")), "contents")
    anchors = written(contents.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where("n > 1").select("anchor", "kinds"), "anchors")
    to_read = contents.join(anchors, "anchor").select("at.*", "anchor", "content", "n", (F.col("kinds") > HOT_SEGMENTS).alias("hot"))
    wanted = to_read.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "size", "anchor", "content", "n", "hot")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, want, row = _texts_of(part, "wanted")
                size = want.field("size").to_numpy().astype(np.int64)
                first = words.first[row] + want.field("pos").to_numpy()
                # a hot anchor's segment is given window by window, each under its own content
                hot = want.field("hot").to_numpy(zero_copy_only=False)
                times = np.where(hot, size, 1)
                which = np.repeat(np.arange(len(size)), times)
                off = expand(np.zeros(len(size), np.int64), times)
                begin = first[which] + off
                many = np.where(hot[which], 1, size[which])
                lo, hi = words.start[begin], words.end[begin + many + window - 2]
                raw = memoryview(words.raw)
                spans = pa.array([bytes(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string())
                take = want.take(pa.array(which))
                one, two = (pa.array(x) for x in window_hashes(words, begin, window)) if hot.any() else (take.field("anchor"), take.field("content"))
                yield pa.RecordBatch.from_arrays(
                    [take.field("anchor"), take.field("content"), take.field("n"), take.field("hot"), pa.array(many, pa.int32()), pa.array(off, pa.int32()), one, two, spans],
                    ["anchor", "content", "n", "hot", "size", "off", "w1", "w2", "words"],
                )

    cut_schema = "anchor long, content long, n long, hot boolean, size int, off int, w1 long, w2 long, words string"
    cuts = written(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(cut, cut_schema), "cuts")
    cold = cuts.where("not hot").select(F.col("anchor").alias("shard"), "content", "n", "size", "words")
    hot = cuts.where("hot")
    once = hot.dropDuplicates(["anchor", "content", "off"])  # again because of repeated rows
    single = once.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("words").alias("words")).select(F.col("w1").alias("shard"), F.col("w2").alias("content"), "n", F.lit(1).alias("size"), "words")
    found = []
    for part in (cold, single):
        found.append(part.repartition("shard").sortWithinPartitions("shard", "content").mapInArrow(_search(window), "shard long, content long, mask long"))
    cold_marks = found[0].withColumnRenamed("shard", "anchor")
    again = written(found[1].select(F.col("shard").alias("w1"), F.col("content").alias("w2")), "windows")
    hot_marks = hot.select("anchor", "content", "off", "w1", "w2").join(again, ["w1", "w2"]).groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    marks = written(cold_marks.unionByName(hot_marks), "marks")
    return seen.join(marks, ["anchor", "content"]).select("k1", "k2", "pos", "size", "mask")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by one space) and intervals (first and last
    word, from 0, of each removed run) of each row of ``docs``.

    Windows are judged on the input, so every copy of a repeated passage goes. Null text has no words; texts shorter
    than a window keep all; repeated rows repeat every window of theirs; extra columns are ignored; no rows give none.
    """
    rows = _keyed(docs)
    # repeated rows share their key and would meet each mark several times
    marks = duplicate_marks(rows, window).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "size", "mask")).alias("marks"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, intervals array<struct<first: long, last: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, mark, row = _texts_of(part, "marks")
                edge = np.zeros(len(words) + window + 1, np.int32)
                if len(mark):
                    bits = np.unpackbits(mark.field("mask").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                    bits &= np.arange(64) < mark.field("size").to_numpy()[:, None]
                    which, off = np.nonzero(bits)
                    at = words.first[row[which]] + mark.field("pos").to_numpy()[which] + off
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                keep = (~gone).tobytes()
                kept = []
                for text, n, a, b in zip(part.column("text").to_pylist(), removed.tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    own = text.encode().split()
                    kept.append(b" ".join(compress(own, keep[a:b]) if n else own))
                # runs of removed words; a text's first word begins a new one
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[words.first[:-1][np.diff(words.first) > 0]] = gone[words.first[:-1][np.diff(words.first) > 0]]
                begin = np.flatnonzero(begins)
                stop = np.minimum(np.searchsorted(np.flatnonzero(~gone), begin), int((~gone).sum()))
                rest = np.append(np.flatnonzero(~gone), len(gone))[stop]
                owner = np.searchsorted(words.first, begin, "right") - 1
                base = words.first[owner]
                last_word = np.minimum(rest, words.first[owner + 1]) - 1
                runs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(last_word - base)], ["first", "last"])
                cuts = pa.array(np.searchsorted(owner, np.arange(len(words.first))), pa.int32())
                columns = [part.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(cuts, runs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "intervals"])

    return rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(run, schema)
