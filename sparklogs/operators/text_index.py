"""Words of chunks in blocks, with their places, and lexical search that skips what cannot come among the best.

A block is some hundred chunks in one row: their ids, the different words, and for each word the places where it stands.
Places count through a block, field by field and chunk by chunk with a gap after each, so a phrase is a run of places
that cannot cross a border. Of each word a block knows in how many chunks it stands, its greatest count in one of them and
the least size of those, which bound what it can add to a BM25 score. Blocks are built without a shuffle, can be stored,
and are asked by a bounded set of queries at a time; a task returns its best k of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Scoring, and the fields of a chunk with their weights; the first is the text.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"text": 1.0, "source_service": 0.4, "log_level": 0.2}
BLOCK_ROWS = 2048
BLOCK_WORDS = 1 << 20
#: Queries, and different words of queries, that go to the blocks at once.
QUERY_BLOCK = 4096
QUERY_WORDS = 100_000
_CLOSE = 1e-6


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def text_blocks(chunks: DataFrame, fields: tuple[str, ...] = tuple(FIELD_WEIGHTS)) -> DataFrame:
    """The blocks of ``chunks`` (chunk_id and the fields), one a row; the first field is the one that BM25 counts.

    A null field has no words. A chunk of very many words is a block of its own.
    """
    rows = chunks.select("chunk_id", *[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"f{k}") for k, c in enumerate(fields)])
    ints = ("sizes", "starts", "first", "places", "df", "most", "least")
    schema = T.StructType([
        T.StructField("fields", T.IntegerType()), T.StructField("docs", T.ArrayType(rows.schema["chunk_id"].dataType)), T.StructField("terms", T.ArrayType(T.StringType())),
        *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ints),
    ])

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        lists = [part.column(f"f{k}") for k in range(len(fields))]
        length = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(length + 1)])
        place = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order, count = np.argsort(term, kind="stable"), len(words.dictionary)
        first = np.searchsorted(term[order], np.arange(count + 1))
        # how often each word stands in each chunk's text
        own = int(length[:n].sum())
        pair, times = np.unique(term[:own] * n + np.repeat(np.arange(n), length[:n]), return_counts=True)
        df, most, least = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        if own:
            which, head = np.unique(pair // n, return_index=True)
            df[which] = np.diff(head, append=len(pair))
            most[which], least[which] = np.maximum.reduceat(times, head), np.minimum.reduceat(length[pair % n], head)
        numbers = [pa.array([x], pa.list_(pa.int32())) for x in (length[:n], starts, first, place[order], df, most, least)]
        return pa.RecordBatch.from_arrays([pa.array([len(fields)], pa.int32()), pa.array([part.column("chunk_id").to_pylist()], pa.list_(part.column("chunk_id").type)), pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())), *numbers], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(batch.column(f"f{k}").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields)))
            ends, at = np.cumsum(size), 0
            while at < batch.num_rows:
                most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_WORDS, "right"))
                to = min(max(at + 1, most), at + BLOCK_ROWS, batch.num_rows)
                yield block(batch.slice(at, to - at))
                at = to

    return rows.mapInArrow(run, schema)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Store ``text_blocks`` as Parquet, each block in a row group of its own.

    Spark's reader decodes up to 4,096 rows of a row group at once, and the writer keeps a group until it ends: with blocks of some
    MB both would hold whole files.
    """
    blocks.write.option("parquet.block.row.count.limit", 1).parquet(path)


class Block:
    """One row of ``text_blocks`` as arrays, and where the asked words stand in it."""

    def __init__(self, batch: pa.RecordBatch, row: int, asked: pa.Array):
        read = lambda c: batch.column(c)[row].values
        self.docs = read("docs")
        self.n = len(self.docs)
        self.sizes, self.starts, self.first, self.places, self.most, self.least = (read(c).to_numpy(zero_copy_only=False) for c in ("sizes", "starts", "first", "places", "most", "least"))
        found = pc.index_in(read("terms"), value_set=asked)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        #: Place of each asked word among the block's words, -1 if it has none.
        self.at = np.full(len(asked), -1)
        self.at[found.filter(pa.array(hit)).to_numpy(zero_copy_only=False)] = np.flatnonzero(hit)

    def of(self, word: int) -> np.ndarray:
        """The places of an asked word."""
        k = self.at[word]
        return self.places[self.first[k] : self.first[k + 1]] if k >= 0 else self.places[:0]

    def owner(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk and field that places stand in."""
        own = np.searchsorted(self.starts, places, "right") - 1
        return own % self.n, own // self.n

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all asked words: where the chunks of each begin, the word, the chunk in whose text it stands, and how often."""
        there = np.flatnonzero(self.at >= 0)
        a, b = self.first[self.at[there]].astype(np.int64), self.first[self.at[there] + 1].astype(np.int64)
        size = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        doc, field = self.owner(self.places[at])
        pair, tf = np.unique((np.repeat(there, size) * self.n + doc)[field == 0], return_counts=True)
        word = pair // self.n
        return np.searchsorted(word, np.arange(len(self.at) + 1)), word, pair % self.n, tf

    def names(self, rows: np.ndarray) -> np.ndarray:
        return np.array(self.docs.take(pa.array(rows)).to_pylist(), None if pa.types.is_integer(self.docs.type) else str)


class Best:
    """The best k of some queries so far: scores to nine digits, ties by the smaller name."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.kth = k, {}, np.full(queries, -np.inf)

    def put(self, query: int, score: np.ndarray, names: Callable[[np.ndarray], np.ndarray], rows: np.ndarray) -> None:
        score = np.round(score, 9)
        stay = score >= self.kth[query]
        score, rows = score[stay], rows[stay]
        if len(score) > self.k:
            stay = score >= np.partition(score, -self.k)[-self.k]
            score, rows = score[stay], rows[stay]
        if not len(score):
            return
        name = names(rows)
        if query in self.held:
            score, name = (np.concatenate(x) for x in zip(self.held[query], (score, name), strict=True))
        order = np.lexsort((name, -score))[: self.k]
        self.held[query] = score[order], name[order]
        if len(order) == self.k:
            self.kth[query] = score[order[-1]]


class Bm25:
    """BM25 of a bounded set of queries, block by block. A query passes a block whose words cannot reach its k-th score; in
    others only chunks that a word which is needed for that stands in are scored, and each only while it can still reach it."""

    def __init__(self, queries: list[np.ndarray], idf: np.ndarray, mean: float, k: int):
        self.queries, self.idf, self.mean, self.best = queries, idf, mean, Best(len(queries), k)
        self.scored = 0

    def _weight(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def add(self, block: Block) -> None:
        there = block.at >= 0
        bound = np.zeros(len(there))
        at = block.at[there]
        bound[there] = np.where(block.most[at] > 0, self.idf[there] * self._weight(block.most[at].astype(float), block.least[at]), 0.0)
        first, word, docs, tf = block.postings()
        weights = self.idf[word] * self._weight(tf.astype(float), block.sizes[docs])
        for q, words in enumerate(self.queries):
            most = bound[words]
            order = np.argsort(-most, kind="stable")
            words, most = words[order], most[order]
            words, most = words[most > 0], most[most > 0]
            kth = self.best.kth[q] - _CLOSE
            if not len(words) or most.sum() < kth:
                continue
            rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what the words from one on can add
            needed = int(np.argmax(rest < kth)) if rest[-1] < kth else len(words)
            spans = [slice(first[w], first[w + 1]) for w in words[:needed].tolist()]
            score = np.bincount(np.concatenate([docs[x] for x in spans]), np.concatenate([weights[x] for x in spans]), block.n)
            rows = np.flatnonzero(score)
            for k in range(needed, len(words)):
                rows = rows[score[rows] + rest[k] >= kth]
                if not len(rows):
                    break
                own = slice(first[words[k]], first[words[k] + 1])
                doc, weight = docs[own], weights[own]
                at = np.minimum(np.searchsorted(doc, rows), len(doc) - 1)
                score[rows] += np.where(doc[at] == rows, weight[at], 0.0)
            self.scored += len(rows)
            if len(rows):
                self.best.put(q, score[rows], block.names, rows)


class Web:
    """Web-search queries, block by block: (clause, excluded, words of the piece) lists. The rarest clause comes first."""

    def __init__(self, queries: list[list[tuple[int, bool, tuple[int, ...]]]], weights: np.ndarray, k: int):
        self.queries, self.weights, self.best = queries, weights, Best(len(queries), k)

    def add(self, block: Block) -> None:
        known: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}

        def piece(words: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
            """Chunks that hold a run of words, and its occurrences there times the weights of their fields."""
            if words not in known:
                lists = [block.of(w) for w in words]
                rare = min(range(len(words)), key=lambda i: len(lists[i]))
                start = lists[rare] - rare
                for i in sorted(set(range(len(words))) - {rare}, key=lambda i: len(lists[i])):
                    if not len(start):
                        break
                    at = np.minimum(np.searchsorted(lists[i], start + i), max(len(lists[i]) - 1, 0))
                    start = start[lists[i][at] == start + i] if len(lists[i]) else start[:0]
                doc, field = block.owner(start)
                total = np.bincount(doc, self.weights[field], block.n) if len(doc) else np.zeros(block.n)
                rows = np.flatnonzero(total)
                known[words] = rows, total[rows]
            return known[words]

        for q, pieces in enumerate(self.queries):
            clauses: dict[int, list[tuple[int, ...]]] = {}
            for clause, no, words in pieces:
                if not no:
                    clauses.setdefault(clause, []).append(words)
            if not clauses:
                continue
            size = {c: sum(min(len(block.of(w)) for w in words) for words in own) for c, own in clauses.items()}
            left, score = None, np.zeros(block.n)
            for c in sorted(clauses, key=size.get):
                met = np.zeros(block.n, bool)
                for words in clauses[c]:
                    rows, total = piece(words)
                    met[rows] = True
                    score[rows] += total
                left = met if left is None else left & met
                if not left.any():
                    break
            for _, no, words in pieces:
                if no and left.any():
                    left[piece(words)[0]] = False
            rows = np.flatnonzero(left)
            if len(rows):
                self.best.put(q, score[rows], block.names, rows)


def _asked(batch: pa.RecordBatch, asked: pa.Array) -> Iterator[Block]:
    for row in range(batch.num_rows):
        yield Block(batch, row, asked)


def search_blocks(blocks: DataFrame, query_ids: pa.Array, id_type: T.DataType, asked: pa.Array, search: Callable[[], Bm25 | Web]) -> DataFrame:
    """query_id, chunk_id, score: what a search finds in each task; it is made anew there."""
    kind = to_arrow_type(blocks.schema["docs"].dataType.elementType)
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("chunk_id", blocks.schema["docs"].dataType.elementType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = search()
        for batch in batches:
            for block in _asked(batch, asked):
                own.add(block)
        names = query_ids.to_pylist()
        for q, (score, name) in own.best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(score), query_ids.type), pa.array(name.tolist(), kind), pa.array(score)], schema.names)

    return blocks.mapInArrow(run, schema)


def word_statistics(blocks: DataFrame, asked: pa.Array) -> tuple[np.ndarray, int, float]:
    """In how many chunks each asked word stands, how many chunks have words, and how many on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(len(asked), np.int64), 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                found = pc.index_in(batch.column("terms")[row].values, value_set=asked)
                hit = found.is_valid()
                df[found.filter(hit).to_numpy(zero_copy_only=False)] += batch.column("df")[row].values.filter(hit).to_numpy(zero_copy_only=False)
                sizes = batch.column("sizes")[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                n, words = n + int((sizes > 0).sum()), words + int(sizes.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, [-1, -2])), pa.array(np.append(df[there], [n, words]))], ["word", "n"])

    got = blocks.select("terms", "df", "sizes").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row an asked word at most
    df, word, n = np.zeros(len(asked), np.int64), got["word"].to_numpy(), got["n"].to_numpy()
    df[word[word >= 0]] = n[word >= 0]
    count, total = (int(n[word == k].sum()) for k in (-1, -2))
    return df, count, total / max(count, 1)
