"""Quality by ordinal regression: a cumulative-link model on graded ratings over hashed text.

P(grade > k) = sigmoid(f - threshold_k) with one shared f, the mean weight of a text's hashed words and word shapes, and
ordered thresholds. The expected grade is the sum of these tails; a tail probability selects documents. The model is
fitted on a bounded sample of rated documents (``FIT_ROWS``); every document is scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklogs.llm.common import Words, extended, rolling, slices, word_hashes, written
from sparklogs.llm.toxicity import fold

BUCKETS = 1 << 18
FIT_ROWS = 12_000
#: So many distinct buckets of fitting rows go to the driver at most, 8 bytes each.
FIT_ENTRIES = 8 << 20
SCALE = 10.0
#: Kinds of bytes: upper case, lower case or part of a longer character, digit, and each other sign by itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3


def hashed_words(words: Words) -> np.ndarray:
    """Two buckets for each word: of the word itself and of its shape, where equal kinds in a row count once."""
    own = word_hashes(words, 8)
    kind = _KIND[words.raw]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.start] = True
    shapes = np.concatenate([[0], np.cumsum(new)])
    shape = rolling(9).runs(kind[new], shapes[words.start], shapes[words.end])
    half = np.uint64(BUCKETS // 2 - 1)
    return np.stack([(own & half).astype(np.int64), (shape & half).astype(np.int64) + BUCKETS // 2])


def sparse_rows(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each text and their share of its words."""
    words = Words(texts)
    pair, text = hashed_words(words), words.text_of()
    key = np.sort(np.concatenate([(text << 18) | p for p in pair]))
    new = np.flatnonzero(np.diff(key, prepend=-1))
    share = np.diff(new, append=len(key)) / np.maximum(np.diff(words.first), 1)[key[new] >> 18] * SCALE
    cut = np.searchsorted(key[new], np.arange(1, len(words.first) - 1) << 18)
    return np.split((key[new] & (BUCKETS - 1)).astype(np.int32), cut), np.split(share.astype(np.float32), cut)


def fit_ordinal(rows: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, grades: int, steps: int = 150, ridge: float = 1e-3, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps with adapted rates; thresholds stay ordered as a first one and
    the logarithms of the gaps. Without rows the weights are zero and the thresholds 0, 1, 2 and so on."""
    weight, base = np.zeros(BUCKETS), np.arange(max(grades - 1, 1), dtype=float)
    n = len(rows)
    if not n:
        return weight.astype(np.float32), base
    row, col, val = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows), np.concatenate(values)
    used, col = np.unique(col, return_inverse=True)
    above = np.arange(grades - 1) < grade[:, None]  # is the grade above k?
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w, state = np.zeros(len(used)), [np.zeros(len(used) + len(raw)), np.zeros(len(used) + len(raw))]
    for step in range(1, steps + 1):
        cuts = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        f = np.bincount(row, val * w[col], n)
        tail = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -30, 30)))
        # P(grade = g) = tail[g - 1] - tail[g]
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        own = np.arange(n)
        p = np.maximum(full[own, grade] - full[own, grade + 1], 1e-9)
        by_f = -(slope[own, grade] - slope[own, grade + 1]) / p / n
        by_cut = np.zeros(grades - 1)
        np.add.at(by_cut, grade[grade > 0] - 1, (slope[own, grade] / p)[grade > 0] / n)
        low = grade < grades - 1
        np.add.at(by_cut, grade[low], -(slope[own, grade + 1] / p)[low] / n)
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(col, val * by_f[row], len(used)) + ridge * w, tails[:1], tails[1:] * np.exp(raw[1:])])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, raw = w - move[: len(used)], raw - move[len(used) :]
    weight[used] = w
    return weight.astype(np.float32), np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def grade_documents(docs: DataFrame, ratings: DataFrame, grades: int, select_above: int = 0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` with held_out, expected_grade (0 to grades - 1), tail_probability = P(grade > select_above)
    and keep (1 if that is at least one half), which replace columns of these names. ``ratings`` has doc_id and grade, an integer from 0.

    Without ratings every text gets the thresholds 0, 1, ... alone, and so keep = 1 by the default ``select_above``.
    Ratings whose crc32(doc_id as text) mod 5 is 0 are held out. A document rated twice counts with its lower grade. A
    text without words (null, empty) gets the thresholds alone; repeated rows score alike; an empty table gives no rows.
    """
    docs = docs.drop("held_out", "expected_grade", "tail_probability", "keep")
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, values = sparse_rows(part.column("text"))
                size = pa.array([len(r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("draw"), part.column("grade"), size, pa.array(rows, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["draw", "grade", "n", "row", "value"]
                )

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "text").alias("draw"), "grade", "text")  # fit_rows at most
    hashed = written(chosen.mapInArrow(collect, "draw long, grade int, n long, row array<int>, value array<float>"), "hashed")
    # a document that stands there repeatedly counts once; of very long ones fewer fit
    sizes = hashed.groupBy("draw").agg(F.min("n").alias("n")).orderBy("draw").limit(fit_rows).toArrow()
    fitting = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), FIT_ENTRIES, "right"))
    last = sizes["draw"][min(max(fitting, 1), len(sizes)) - 1].as_py() if len(sizes) else None
    got = hashed.where(F.col("draw") <= F.lit(last)).dropDuplicates(["draw"]).orderBy("draw").select("grade", "row", "value").toArrow()
    rows, values = ([x.values.to_numpy() for x in got[k]] for k in ("row", "value"))
    weight, cuts = fit_ordinal(rows, values, got["grade"].to_numpy().astype(np.int64), grades)
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    schema = extended(docs, expected_grade="double", tail_probability="double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                own = shared.value[hashed_words(words)].sum(axis=0, dtype=np.float64)
                total = np.concatenate([[0], np.cumsum(own)])
                f = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(np.diff(words.first), 1) * SCALE
                tail = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tail.sum(axis=1)), pa.array(np.ascontiguousarray(tail[:, select_above]))], schema.names)

    return docs.mapInArrow(score, schema).withColumns({"held_out": fold(F.col("doc_id")) == 0, "keep": (F.col("tail_probability") >= 0.5).cast("int")})
