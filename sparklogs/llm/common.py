"""Shared helpers: Arrow text buffers as numpy arrays, word splitting, hashing and written intermediate tables.

A word is a maximal run of characters other than space and the ASCII controls 9 to 13, as it stands in the text.
All helpers work on one Arrow batch at a time, so a task's memory is bounded by the batch and not by its partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_BYTES = 2 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in plain local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="sparklogs-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: All tables that this process has written, the latest last.
WRITTEN: list[DataFrame] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    WRITTEN.append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, given as name=type."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items())])


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it (case counts for nothing in Spark)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or one longer text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at, n = np.cumsum(size), 0, batch.num_rows
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text in them; null counts as empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary_array(parts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column over one byte array cut into consecutive pieces."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts))])


class Words:
    """The words of a batch of texts: byte ``start`` and ``end`` of each, and ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, texts: pa.Array):
        self.raw, self.at = buffers(texts)
        self.start, self.end = spans(self.raw, self.at)
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a text's end also ends a word."""
    n = len(raw)
    solid = ~_SEPARATOR[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    return np.flatnonzero(solid & (~before | edge[:-1])), np.flatnonzero(solid & (~after | edge[1:])) + 1


class Rolling:
    """Polynomial hashes modulo 2**64 of any run of a sequence in O(1), by prefix sums.

    ``seed`` picks the table that bytes go through. All share one base and so one table of its powers, which is as long
    as the longest batch that the process has seen. For runs of up to about a thousand values: longer ones can be built
    so that they collide under any table (use ``PrimeRolling`` or xxHash there).
    """

    up = down = np.ones(1, np.uint64)

    def __init__(self, seed: int):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 0xA0761D6478BD642F % 2**64))

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.up) <= n:
            for name, by in (("up", _ODD), ("down", pow(_ODD, -1, 2**64))):
                powers = np.full(n + 1 + n // 8, by, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers, out=powers))

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` for each pair; bytes go through a random table, 64-bit values as they are."""
        n = len(values)
        self._grow(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.table[values] if values.dtype == np.uint8 else values) * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_P = np.uint64(2**61 - 1)
_LOW, _MID = np.uint64(2**31 - 1), np.uint64(2**30 - 1)
_CHUNK = 1 << 13


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2**61 - 1 of numbers hardly above that, by halves of 31 and 30 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 <<= np.uint64(1)
    a0 *= b0
    a0 += a1
    a0 += middle >> np.uint64(30)
    middle &= _MID
    middle <<= np.uint64(31)
    a0 += middle
    a0 = (a0 & _P) + (a0 >> np.uint64(61))
    return np.where(a0 >= _P, a0 - _P, a0)


class PrimeRolling:
    """Like ``Rolling``, but modulo the prime 2**61 - 1: no pattern of any length makes two runs collide by construction.

    It costs several times as much. ``seed`` picks the random table that bytes go through, so two seeds are two hashes. All share
    one base and so one table of its powers, which is as long as the longest batch that the process has seen. Sums are
    kept as two halves per chunk, which cannot overflow, and reduced only at the ends of runs.
    """

    base = 0x1B7E151628AED2A6
    up = low_up = high_up = down = np.ones(1, np.uint64)

    def __init__(self, seed: int):
        words = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 0xA0761D6478BD642F % 2**64))
        self.table = words >> np.uint64(48)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.up) < n:
            for name, by in (("up", cls.base), ("down", pow(cls.base, -1, int(_P)))):
                powers = np.ones(n + n // 8, np.uint64)
                done, step = 1, by
                while done < len(powers):  # the powers known so far, times the next one
                    more = min(done, len(powers) - done)
                    powers[done : done + more] = _times(powers[:more], np.uint64(step))
                    done, step = done + more, step * step % int(_P)
                setattr(cls, name, powers)
            cls.low_up, cls.high_up = cls.up & np.uint64(0xFFFFFFFF), cls.up >> np.uint64(32)

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
        """Hash of ``values[start:end]`` for each pair, without ``values[left:right]`` if these are given.

        Bytes go through the table, 64-bit values count modulo 2**61 - 1.
        """
        n = len(values)
        self._grow(max(n + 1, _CHUNK))
        low, high, carry = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64), [0, 0]
        for at in range(0, n, _CHUNK):
            part, to = values[at : at + _CHUNK], min(at + _CHUNK, n)
            if values.dtype == np.uint8:
                part = self.table[part]
                np.cumsum(part * self.low_up[at:to], out=low[at + 1 : to + 1])
                np.cumsum(part * self.high_up[at:to], out=high[at + 1 : to + 1])
            else:
                part = _times((part & _P) + (part >> np.uint64(61)), self.up[at:to])
                np.cumsum(part & np.uint64(0xFFFFFFFF), out=low[at + 1 : to + 1])
                np.cumsum(part >> np.uint64(32), out=high[at + 1 : to + 1])
            carry.append((carry[-1] + int(low[to]) + (int(high[to]) << 32)) % int(_P))
        carried = np.array(carry, np.uint64)

        def total(at: np.ndarray) -> np.ndarray:
            h, x = high[at], low[at]
            h = (h >> np.uint64(29)) + ((h & np.uint64(2**29 - 1)) << np.uint64(32)) + (x & _P) + (x >> np.uint64(61))
            h += carried[(at + (_CHUNK - 1)) // _CHUNK]
            return (h & _P) + (h >> np.uint64(61))

        def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = total(b)
            h += np.uint64(2 * (2**61 - 1))
            h -= total(a)
            return (h & _P) + (h >> np.uint64(61))

        out = np.empty(len(start), np.uint64)
        for at in range(0, len(start), _CHUNK):
            a, b = start[at : at + _CHUNK], end[at : at + _CHUNK]
            size = b - a
            if left is None:
                h = between(a, b)
            else:
                lo, hi = left[at : at + _CHUNK], right[at : at + _CHUNK]
                h = between(a, lo) + _times(between(hi, b), self.down[hi - lo])
                h = (h & _P) + (h >> np.uint64(61))
                size = size - (hi - lo)
            out[at : at + len(a)] = mix(_times(h, self.down[a]) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out


_ROLLING: dict[int, Rolling] = {}
_PRIME: dict[int, PrimeRolling] = {}
_LONG_WORD = 512


def rolling(seed: int = 1) -> Rolling:
    return _ROLLING.setdefault(seed, Rolling(seed))


def prime_rolling(seed: int = 1) -> PrimeRolling:
    return _PRIME.setdefault(seed, PrimeRolling(seed))


def word_hashes(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each word; words long enough for patterns that ``Rolling`` does not tell apart go through xxHash."""
    out = rolling(seed).runs(words.raw, words.start, words.end)
    for k in np.flatnonzero(words.end - words.start > _LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(words.raw[words.start[k] : words.end[k]].tobytes(), seed)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start[i] .. start[i] + count[i] - 1`` of all i, one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return shift + np.arange(total)
