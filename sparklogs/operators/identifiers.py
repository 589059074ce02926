"""Chunks that hold an identifier, or words like it, by the trigrams of their words.

A block of chunks knows in which of them each trigram stands. An identifier is looked for in chunks that have all
trigrams it fixes, and words like it in chunks that have enough of its trigrams; only these are looked at closely. Blocks
are made while the chunk table is read once, or stored by ``gram_blocks`` and asked many times.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
#: Identifiers that go to the blocks at once.
ASKED_AT_ONCE = 4096
_ALNUM: list[np.ndarray] = []


def trigrams(text: str) -> tuple[str, ...]:
    """Trigrams of the lower-case words of a text in order, each word padded by two spaces and one."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return tuple(p[i : i + 3] for p in (f"  {w} " for w in words) for i in range(len(p) - 2))


@lru_cache(maxsize=1 << 12)
def _wanted(query: str) -> frozenset[str]:
    return frozenset(trigrams(query))


def word_similarity(query: str, text: str) -> float:
    """The greatest share of common trigrams of ``query`` and any continuous extent of the trigrams of ``text``."""
    return extent_similarity(_wanted(query), trigrams(text))


def extent_similarity(want: frozenset[str], line: tuple[str, ...]) -> float:
    hits, best = [i for i, t in enumerate(line) if t in want], 0.0
    for n, a in enumerate(hits):
        if (len(hits) - n) <= best * len(want):
            break
        extent, common, at = set(), set(), a
        for b in hits[n:]:
            extent.update(line[at : b + 1])
            common.add(line[b])
            at = b + 1
            best = max(best, len(common) / (len(want) + len(extent) - len(common)))
    return best


def fixed_trigrams(entity: str) -> set[str]:
    """Trigrams that a text must have if it holds an identifier somewhere.

    Its first and last word may be parts of longer words there, and next to % or _ any character may follow, so only sides
    of words that the identifier itself closes off are padded.
    """
    out: set[str] = set()
    for piece in re.split("[%_]", entity.lower()):
        marked = "".join(c if c.isalnum() else " " for c in piece)
        for run in re.finditer("[^ ]+", marked):
            s = ("  " if run.start() else "") + run[0] + (" " if run.end() < len(marked) else "")
            out.update(s[i : i + 3] for i in range(len(s) - 2))
    return out


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _alnum() -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _ALNUM[0]


def gram_table(texts: list[str | None], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different trigrams of some texts (as numbers, sorted), where the texts of each begin, and these texts; with ``only``,
    sorted, no others."""
    line = "\x00".join((t or "").replace("\x00", " ") for t in texts).lower()
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = _alnum()[chars]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.cumsum(chars == 0)[start] if len(start) else np.zeros(0, np.int64)
    size = end - start
    # words in a line of their own, each after two spaces and before one
    at = np.cumsum(size + 3) - size - 3
    padded = np.full(int((size + 3).sum()), 32, np.int64)
    inner = np.repeat(at + 2 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    padded[inner] = chars[solid]
    last = np.repeat(at + 2 - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(int((size + 1).sum()))
    gram = padded[last - 2] << 42 | padded[last - 1] << 21 | padded[last]
    doc = np.repeat(doc, size + 1)
    if only is not None and len(only):
        place = np.minimum(np.searchsorted(only, gram), len(only) - 1)
        hit = only[place] == gram
        gram, doc = gram[hit], doc[hit]
    elif only is not None:
        gram, doc = gram[:0], doc[:0]
    order = np.lexsort((doc, gram))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    grams, first = np.unique(gram, return_index=True)
    return grams, np.append(first, len(gram)), doc


@dataclass
class Entity:
    """An identifier as it is looked for."""

    name: str
    grams: np.ndarray
    need: int
    fixed: np.ndarray
    pattern: re.Pattern | None

    @classmethod
    def of(cls, name: str, min_similarity: float) -> Entity:
        grams = np.array(sorted(map(_code, set(trigrams(name)))), np.int64)
        wild, out, at = False, "", 0
        low = name.lower()
        while at < len(low):  # as LIKE reads it
            c = low[at]
            if c == "\\" and low[at + 1 : at + 2] in ("%", "_", "\\"):
                at += 1
                out, wild = out + re.escape(low[at]), True
            elif c in "%_":
                out, wild = out + {"%": ".*", "_": "."}[c], True
            else:
                out += re.escape(c)
            at += 1
        need = int(np.ceil(round(len(grams) * min_similarity, 9)))
        return cls(name, grams, need, np.array(sorted(map(_code, fixed_trigrams(name))), np.int64), re.compile(out, re.DOTALL) if wild else None)

    def held_in(self, text: str) -> bool:
        return bool(self.pattern.search(text.lower())) if self.pattern else self.name.lower() in text.lower()

    def candidates(self, n: int, grams: np.ndarray, first: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Those of ``n`` texts that may hold it, or words like it."""

        def count(own: np.ndarray) -> np.ndarray:
            at = np.searchsorted(grams, own)
            at = at[(at < len(grams)) & (grams[np.minimum(at, max(len(grams) - 1, 0))] == own)] if len(grams) else at[:0]
            return np.bincount(np.concatenate([docs[:0], *(docs[first[k] : first[k + 1]] for k in at.tolist())]), minlength=n)

        held = count(self.fixed) == len(self.fixed)
        return np.flatnonzero(held | (count(self.grams) >= self.need)) if len(self.grams) else np.flatnonzero(held)

    def similarity(self, text: str, lines: dict[str, tuple[str, ...]] | None = None) -> float:
        """``lines`` keeps the trigrams of texts that several entities are compared with."""
        if self.held_in(text):
            return 1.0
        lines = {} if lines is None else lines
        if text not in lines:
            lines[text] = trigrams(text)
        return extent_similarity(_wanted(self.name), lines[text])


def gram_blocks(chunks: DataFrame) -> DataFrame:
    """Blocks of the chunks (chunk_id, text), one a row, to be stored: docs, grams, first, places (of docs)."""
    kind = chunks.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("docs", T.ArrayType(kind)), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            grams, first, docs = gram_table(part.column("text").to_pylist())
            ids = part.column("chunk_id")
            arrays = [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([grams], pa.list_(pa.int64())), pa.array([first], pa.list_(pa.int32())), pa.array([docs], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return chunks.select("chunk_id", "text").mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of some thousand rows, or fewer if their texts are long."""
    for batch in batches:
        size = batch.column("text").cast(pa.large_string()).to_pandas().str.len().fillna(0).to_numpy()
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right"))), at + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class _Nearest:
    """The best k chunks of each entity: by similarity, then the latest (without a time first), then by id."""

    def __init__(self, k: int, min_similarity: float):
        self.k, self.least, self.held = k, min_similarity, {}

    def put(self, entity: int, similarity: float, time: int | None, chunk: object) -> None:
        if similarity >= self.least:
            own = self.held.setdefault(entity, [])
            own.append((-similarity, time is not None, -(time or 0), chunk))
            if len(own) > 4 * self.k + 64:
                own[:] = heapq.nsmallest(self.k, own)

    def rows(self, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
        for e, own in self.held.items():
            best = heapq.nsmallest(self.k, own)
            columns = [[e] * len(best), [x[3] for x in best], [-x[2] if x[1] else None for x in best], [-x[0] for x in best]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def find_by_id(entities: DataFrame, chunks: DataFrame, k: int = 50, min_similarity: float = 0.6, stored: DataFrame | None = None) -> DataFrame:
    """query_id, entity, chunk_id, similarity, place: chunks that hold an entity (similarity 1) or words like it.

    Of each entity the k best by similarity, then time (latest first), then id. ``%`` and ``_`` in an entity match anything.
    The chunk table is read once for each set of ``ASKED_AT_ONCE`` entities; with ``stored``, its ``gram_blocks``, only
    chunks that may count are looked at. Entities without a fixed trigram, of one or two characters, are held against
    every chunk.
    """
    asked = entities.select("query_id", "entity").where("entity is not null and entity <> ''").distinct()
    names = asked.select("entity").distinct()
    rows = chunks.select("chunk_id", "text", F.unix_micros(F.col("timestamp_start").cast("timestamp")).alias("time")).where("text is not null")
    kind = rows.schema["chunk_id"]
    schema = T.StructType([T.StructField("asked", T.IntegerType()), kind, T.StructField("time", T.LongType()), T.StructField("similarity", T.DoubleType())])
    found, sets = [], -(-names.count() // ASKED_AT_ONCE)
    for number in range(sets):
        own = sorted(r["entity"] for r in names.where(F.pmod(F.xxhash64("entity"), F.lit(sets)) == number).collect())  # about ASKED_AT_ONCE
        best = (_scan if stored is None else _verify)(rows, own, k, min_similarity, schema, stored)
        table = names.sparkSession.createDataFrame(list(enumerate(own)), "asked int, entity string")
        found.append(best.join(F.broadcast(table), "asked").drop("asked"))
    if not found:
        return asked.join(rows.limit(0).select("chunk_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("place"), F.lit("").alias("entity")), "entity").select("query_id", "entity", "chunk_id", "similarity", "place")
    every = found[0]
    for table in found[1:]:
        every = every.unionByName(table)
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("similarity"), F.desc_nulls_first("time"), "chunk_id"))
    return asked.join(every.withColumn("place", place).where(F.col("place") <= k), "entity").select("query_id", "entity", "chunk_id", "similarity", "place")


def _scan(rows: DataFrame, names: list[str], k: int, least: float, schema: T.StructType, _: None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = [Entity.of(x, least) for x in names], _Nearest(k, least)
        only = np.unique(np.concatenate([np.zeros(0, np.int64), *(x.grams for x in asked), *(x.fixed for x in asked)]))
        kind = None
        for part in _parts(batches):
            texts, ids, times = (part.column(c).to_pylist() for c in ("text", "chunk_id", "time"))
            kind, table = part.column("chunk_id").type, gram_table(texts, only)
            lines: dict[str, tuple[str, ...]] = {}
            for e, entity in enumerate(asked):
                known: dict[str, float] = {}  # texts repeat in logs
                for row in entity.candidates(len(texts), *table).tolist():
                    text = texts[row]
                    if text not in known:
                        known[text] = entity.similarity(text, lines)
                    best.put(e, known[text], times[row], ids[row])
        if kind is not None:
            yield from best.rows([pa.int32(), kind, pa.int64(), pa.float64()], schema.names)

    return rows.mapInArrow(run, schema)


def _verify(rows: DataFrame, names: list[str], k: int, least: float, schema: T.StructType, stored: DataFrame) -> DataFrame:
    """What the stored blocks let through, joined with its chunks and looked at."""
    kind = stored.schema["docs"].dataType.elementType

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Entity.of(x, least) for x in names]
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values
                table = [batch.column(c)[row].values.to_numpy() for c in ("grams", "first", "places")]
                for e, entity in enumerate(asked):
                    hit = entity.candidates(len(docs), *table)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), e, np.int32)), docs.take(pa.array(hit))], ["asked", "chunk_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, kind = [Entity.of(x, least) for x in names], _Nearest(k, least), None
        for batch in batches:
            kind = batch.column("chunk_id").type
            for e, text, chunk, time in zip(*(batch.column(c).to_pylist() for c in ("asked", "text", "chunk_id", "time")), strict=True):
                best.put(e, asked[e].similarity(text), time, chunk)
        if kind is not None:
            yield from best.rows([pa.int32(), kind, pa.int64(), pa.float64()], schema.names)

    may = stored.mapInArrow(candidates, T.StructType([T.StructField("asked", T.IntegerType()), T.StructField("chunk_id", kind)]))
    return may.join(rows, "chunk_id").select("asked", "chunk_id", "time", "text").mapInArrow(run, schema)
