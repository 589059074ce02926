"""Retrieval for tables of queries: vector and lexical top-k, rank fusion, boosts and identifier search."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparklogs.functions.intent import expand_queries
from sparklogs.functions.text import Embedder, embed_texts
from sparklogs.operators.filters import hydrate
from sparklogs.operators.identifiers import find_by_id, gram_blocks, word_similarity
from sparklogs.operators.text_index import FIELD_WEIGHTS, QUERY_BLOCK, QUERY_WORDS, Bm25, Web, search_blocks, text_blocks, tokens, word_statistics
from sparklogs.operators.views import diversify

# Fusion and boosts.
RRF_K, FAN_OUT = 60, 20
LEVEL_FACTORS = {"FATAL": 2.0, "ERROR": 1.5, "WARN": 1.2, "WARNING": 1.2, "INFO": 1.0, "DEBUG": 0.8}


def ranked(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of each key by score, ties by chunk_id, with rank from 0.

    Scores that agree to nine digits are ties: the order in which Spark adds up a score may change its last digits.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return scores.withColumn("rank", place - 1).where(F.col("rank") < k)


def _best(kept: tuple[np.ndarray, ...], ids: np.ndarray, scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, score, name) of the k best of each query among ``kept`` and a matrix of scores; ids only for what may stay."""
    scores = np.round(scores, 9)
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        query, column = np.nonzero(scores >= least[:, None])
    else:
        query, column = np.nonzero(np.ones(scores.shape, bool))
    query, score, name = (np.concatenate([a, b]) for a, b in zip(kept, (ids[query], scores[query, column], names[column]), strict=True))
    order = np.lexsort((name, -score, query))
    query, score, name = query[order], score[order], name[order]
    first = np.searchsorted(query, query)
    stay = np.arange(len(query)) - first < k
    return query[stay], score[stay], name[stay]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _kinds(queries: DataFrame, vectors: DataFrame, chunk_id: str = "chunk_id") -> tuple[T.StructType, np.dtype, np.dtype]:
    """The schema of what a search finds, and how ids of queries and chunks are held in arrays."""
    query, chunk = queries.schema["query_id"].dataType, vectors.schema[chunk_id].dataType
    chunk = chunk.elementType if isinstance(chunk, T.ArrayType) else chunk
    number, name = (np.dtype(str if t.simpleString() == "string" else np.int64) for t in (query, chunk))
    return T.StructType([T.StructField("query_id", query), T.StructField("chunk_id", chunk), T.StructField("score", T.DoubleType())]), number, name


def _found(ids: np.ndarray, kept: tuple[np.ndarray, ...], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.tolist(), f.type) for c, f in zip((ids[kept[0]], kept[2], kept[1]), to_arrow_schema(schema), strict=True)], schema.names)


#: Vectors that cells are built around, rows of a cell, and rows of one pivot in a task.
PIVOTS, CELL_ROWS, PIVOT_ROWS = 256, 1024, 1 << 16


def vector_cells(vectors: DataFrame) -> DataFrame:
    """The vectors (chunk_id, embedding) in cells of near ones, to be stored: docs, vectors, centre, radius.

    A vector goes to the nearest of ``PIVOTS`` vectors that a hash has drawn; one that more than ``PIVOT_ROWS`` go to is
    dealt into parts by chance. Vectors are shuffled once, however many queries ask.
    """
    rows = vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
    drawn = rows.select("embedding", F.xxhash64("chunk_id", "embedding").alias("h")).orderBy("h").limit(PIVOTS).toArrow().combine_chunks()
    pivots = _matrix(drawn["embedding"].combine_chunks(), len(drawn))
    schema = T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"), batch.num_rows)
                pivot = np.argmin((pivots**2).sum(axis=1) - 2 * x @ pivots.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32))], schema.names)

    near = rows.mapInArrow(nearest, schema)
    parts = F.broadcast(near.groupBy("pivot").agg(F.ceil(F.count("*") / PIVOT_ROWS).alias("parts")))  # PIVOTS rows
    dealt = near.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).drop("parts")
    kind = rows.schema["chunk_id"].dataType
    cells = T.StructType([T.StructField("docs", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(T.FloatType())) for c in ("vectors", "centre")), T.StructField("radius", T.DoubleType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("pivot", "part")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, CELL_ROWS):
                    own = batch.slice(at, min(CELL_ROWS, b - at))
                    x = _matrix(own.column("embedding"), own.num_rows)
                    centre = x.mean(axis=0).astype(np.float32)
                    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
                    arrays = [pa.array([own.column("chunk_id").to_pylist()], pa.list_(own.column("chunk_id").type)), *(pa.array([v], pa.list_(pa.float32())) for v in (x.ravel(), centre)), pa.array([radius])]
                    yield pa.RecordBatch.from_arrays(arrays, cells.names)

    return dealt.repartition("pivot", "part").sortWithinPartitions("pivot", "part").select("pivot", "part", "chunk_id", "embedding").mapInArrow(pack, cells)


def _search_cells(cells: DataFrame, asked: pa.Table, kinds: tuple[T.StructType, np.dtype, np.dtype], k: int) -> DataFrame:
    """What a block of queries finds in the cells. A query passes a cell whose centre and radius leave no score of its k best."""
    schema, number, name = kinds
    ids, matrix = np.array(asked["query_id"].to_pylist(), number), _matrix(asked["embedding"].combine_chunks(), len(asked))
    length = np.sqrt((matrix**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kth = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, name)), np.full(len(ids), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = matrix @ _matrix(batch.column("centre"), batch.num_rows).T + np.outer(length, batch.column("radius").to_numpy())
            for cell in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                rows = np.flatnonzero(bound[:, cell] * (1 + 1e-9) + 1e-6 >= kth)
                if len(rows):
                    docs = batch.column("docs")[cell].values
                    x = batch.column("vectors")[cell].values.to_numpy().astype(np.float64).reshape(len(docs), -1)
                    kept = _best(kept, rows, matrix[rows] @ x.T, np.array(docs.to_pylist(), name), k)
                    place = np.arange(len(kept[0])) - np.searchsorted(kept[0], kept[0])
                    kth[kept[0][place == k - 1]] = kept[1][place == k - 1]
        if len(kept[0]):
            yield _found(ids, kept, schema)

    return cells.mapInArrow(run, schema)


def vector_topk(queries: DataFrame, vectors: DataFrame | None, k: int = FAN_OUT, stored: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score (inner product), rank: the exact nearest vectors of each query.

    Up to ``QUERY_BLOCK`` queries (query_id, embedding) are sent to the scan of the vectors, and nothing else moves. More of
    them ask ``vector_cells`` in such blocks, one after another; ``stored`` may hold these cells, which then are asked in
    any case. A task keeps its own best k of each query, so the last shuffle holds k rows a query and task.
    """
    queries = queries.select("query_id", "embedding").where("embedding is not null")
    n = queries.count()
    kinds = _kinds(queries, vectors, "chunk_id") if stored is None else _kinds(queries, stored, "docs")
    schema, number, name = kinds
    if not n:
        return ranked((vectors if stored is None else stored).sparkSession.createDataFrame([], schema), ["query_id"], k)
    if stored is None and n <= QUERY_BLOCK:
        head = queries.toArrow().combine_chunks()
        ids, matrix = np.array(head["query_id"].to_pylist(), number), _matrix(head["embedding"].combine_chunks(), len(head))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, name)
            for batch in batches:
                if batch.num_rows:
                    kept = _best(kept, np.arange(len(ids)), matrix @ _matrix(batch.column("embedding"), batch.num_rows).T, np.array(batch.column("chunk_id").to_pylist(), name), k)
            if len(kept[0]):
                yield _found(ids, kept, schema)

        return ranked(vectors.select("chunk_id", "embedding").where("embedding is not null").mapInArrow(scan, schema), ["query_id"], k)
    blocks = -(-n // QUERY_BLOCK)
    # several blocks read the cells; an executor that is lost costs its part of them again
    cells = stored if stored is not None else vector_cells(vectors).persist(StorageLevel.DISK_ONLY)
    every = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks() for b in range(blocks)]
    return ranked(reduce(DataFrame.unionByName, [_search_cells(cells, asked, kinds, k) for asked in every if len(asked)]), ["query_id"], k)


def postings(chunks: DataFrame, column: str = "text") -> DataFrame:
    """term, chunk_id, tf, size (words of the chunk) of each word of each chunk, to be stored and asked many times.

    A row's words are counted before they are shuffled; partition or bucket the stored table by term.
    """
    terms = chunks.select("chunk_id", tokens(F.col(column)).alias("terms"))
    return terms.select("chunk_id", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy("term", "chunk_id", "size").agg(F.count("*").alias("tf"))


def _query_blocks(rows: DataFrame) -> Iterator[pa.Table]:
    """``rows`` (query_id, words, ...) in tables of about ``QUERY_BLOCK`` queries or ``QUERY_WORDS`` words each, one at a time
    on the driver; all rows of a query are in one."""
    size = rows.agg(F.count_distinct("query_id").alias("n"), F.sum(F.size("words")).alias("words")).first()
    n = max(-(-size["n"] // QUERY_BLOCK), -(-(size["words"] or 0) // QUERY_WORDS))
    tables = (rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).toArrow().combine_chunks() for k in range(n))
    return (t for t in tables if len(t))


def _all_of(found: list[DataFrame], queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    none = queries.limit(0).crossJoin(blocks.limit(0).select(F.get("docs", F.lit(0)).alias("chunk_id"))).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    return ranked(reduce(DataFrame.unionByName, found, none), ["query_id"], k)


def bm25_topk(queries: DataFrame, chunks: DataFrame | None, k: int = FAN_OUT, stored: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25 over the terms of each query (query_id, query); blank queries find none.

    ``stored`` may hold the ``text_blocks`` of the chunks, which then are not read. Blocks are asked twice by each set of
    queries: in how many chunks its words stand, and for the best k. Nothing is joined; a task gives k rows a query.
    """
    blocks = text_blocks(chunks, ("text",)) if stored is None else stored
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("words")).where(F.size("words") > 0)
    found = []
    for table in _query_blocks(asked):
        lists = table["words"].combine_chunks()
        words = lists.flatten().dictionary_encode()
        df, n, mean = word_statistics(blocks, words.dictionary)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        own = np.split(words.indices.to_numpy(zero_copy_only=False), np.cumsum(size)[:-1])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        found.append(search_blocks(blocks, table["query_id"].combine_chunks(), queries.schema["query_id"].dataType, words.dictionary, partial(Bm25, own, idf, mean, k)))
    return _all_of(found, queries, blocks, k)


def fts_topk(queries: DataFrame, chunks: DataFrame | None, k: int = FAN_OUT, stored: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank for web-search queries: words and "phrases" must all occur, ``or`` joins
    alternatives, a leading minus excludes.

    The score adds up, over the words and phrases found, their occurrences times the weight of the field. There is no
    stemming, and words may stand in any field of a chunk. A phrase is a run of places in one field, looked up from its
    rarest word on. ``stored`` may hold the ``text_blocks`` of the chunks, which then are not read.
    """
    blocks = text_blocks(chunks) if stored is None else stored
    pieces = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))).alias("at", "piece"))
    own = Window.partitionBy("query_id").orderBy("at")
    is_or = F.lower("piece") == "or"
    pieces = pieces.withColumns({"is_or": is_or, "after_or": F.coalesce(F.lag(is_or).over(own), F.lit(False))})
    excludes = F.col("piece").startswith("-")
    clauses = pieces.where("not is_or").select(
        "query_id", F.sum(F.when(F.col("after_or") & ~excludes, 0).otherwise(1)).over(own).alias("clause"), excludes.alias("no"), tokens(F.col("piece")).alias("words")
    ).where(F.size("words") > 0)
    found = []
    for table in _query_blocks(clauses):
        lists = table["words"].combine_chunks()
        words = lists.flatten().dictionary_encode()
        runs = np.split(words.indices.to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        names = table["query_id"].combine_chunks().dictionary_encode()
        asked: list[list[tuple[int, bool, tuple[int, ...]]]] = [[] for _ in range(len(names.dictionary))]
        for q, clause, no, run in zip(names.indices.to_pylist(), table["clause"].to_pylist(), table["no"].to_pylist(), runs, strict=True):
            asked[q].append((clause, no, tuple(run.tolist())))
        weights = np.array(list(FIELD_WEIGHTS.values()))
        found.append(search_blocks(blocks, names.dictionary, queries.schema["query_id"].dataType, words.dictionary, partial(Web, asked, weights, k)))
    return _all_of(found, queries, blocks, k)


def rrf_fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, rank: the sum of 1 / (k + rank) over the rankings (query_id, variant, leg, chunk_id,
    rank from 0); ties go to what appears first by variant, leg and rank."""
    fused = rankings.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("variant", "leg", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", "chunk_id"))
    return fused.withColumn("rank", place - 1).drop("first")


def apply_boosts(fused: DataFrame, chunks: DataFrame, now: datetime | None = None, levels: bool = True) -> DataFrame:
    """Scores times the factor of a chunk's level and, if ``now`` is given, 1 / (1 + a tenth of its age in hours)."""
    table = F.create_map(*[F.lit(x) for pair in LEVEL_FACTORS.items() for x in pair])
    factor = F.coalesce(F.try_element_at(table, F.upper("log_level")), F.lit(1.0)) if levels else F.lit(1.0)
    if now is not None:
        hours = (F.unix_micros(F.lit(now)) - F.unix_micros("timestamp_start")) / 3.6e9
        factor = factor / (1 + 0.1 * F.greatest(F.lit(0.0), F.coalesce(hours, F.lit(0.0))))
    rows = fused.join(chunks.select("chunk_id", "log_level", "timestamp_start"), "chunk_id", "left").withColumn("score", F.col("score") * factor)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "rank", "chunk_id"))
    return rows.withColumn("rank", place - 1).drop("log_level", "timestamp_start")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 10, now: datetime | None = None, embedder: Embedder | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """The best k chunks of each query (query_id, query): variants, a vector and a BM25 leg each, fusion, boosts.

    ``chunks`` needs embedding, of the same backend. Blank queries find nothing here.
    """
    variants = expand_queries(queries.where(F.trim("query") != ""))
    key = F.concat_ws("\x00", F.col("query_id").cast("string"), F.col("variant").cast("string"))
    asked = variants.select(key.alias("query_id"), F.col("text").alias("query"))
    dense = vector_topk(embed_texts(asked, "query", embedder), chunks, fan_out).withColumn("leg", F.lit(0))
    lexical = bm25_topk(asked, chunks, fan_out).withColumn("leg", F.lit(1))
    both = dense.unionByName(lexical)
    kind = queries.schema["query_id"].dataType
    parts = F.split("query_id", "\x00")
    legs = both.select(parts[0].cast(kind).alias("query_id"), parts[1].cast("int").alias("variant"), "leg", "chunk_id", "rank")
    return apply_boosts(rrf_fuse(legs), chunks, now).where(F.col("rank") < k)


def hybrid_search_diverse(queries: DataFrame, chunks: DataFrame, k: int = 10, over_fetch: int = 3, cap_ratio: float = 0.4, **how) -> DataFrame:
    """Like ``hybrid_search`` from ``over_fetch * k`` hits, with services taking turns; ``place`` counts from 1."""
    pool = hybrid_search(queries, chunks, max(k, over_fetch * k), **how)
    return diversify(hydrate(pool, chunks.select("chunk_id", "source_service")), k, cap_ratio)
