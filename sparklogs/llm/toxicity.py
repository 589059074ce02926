"""Toxicity from class-conditional Kneser-Ney models over the bytes of words.

Two models of order six, toxic and ordinary, are counted from labelled documents. Where a class has not seen an
expression, both back off to the same Kneser-Ney continuation counts, gathered from all documents, so rare expressions
cost both classes alike. A passage's score is its length-normalised log-likelihood ratio; a document's is a logistic
function of the ratio over the whole text and of its most toxic passage, fitted on labelled rows that counted no model
and moved so that one half is the cut with the best F1 on those rows.

Labels come from a bounded sample (``CLASS_ROWS`` rows and ``CLASS_BYTES`` bytes of text a class for counting, ``FIT_ROWS``
rows for the logistic function), so the scoring tables are bounded too and can be broadcast; continuation counts cover the
whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.llm.common import Words, expand, extended, forget, slices, word_hashes, written

ORDER = 6
DISCOUNT = 0.75
PASSAGE = 3
CLASS_ROWS = 10_000
CLASS_BYTES = 48 << 20
FIT_ROWS = 20_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MERGE = 1 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5: 0 is held out, 4 fits the logistic function, the others count the models."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A place in ``words`` of each distinct word, and the number of the distinct word at every place."""
    _, first, which = np.unique(word_hashes(words, 6), return_index=True, return_inverse=True)
    return first, which


def byte_grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of six bytes of the chosen words, lower case, packed in integers, and how many each word has.

    A word stands between five spaces and one; it has a gram for each byte and one for its end.
    """
    size = words.end[chosen] - words.start[chosen]
    line = np.full(int((size + ORDER).sum()), 32, np.uint8)
    at = np.cumsum(size + ORDER) - size - ORDER
    line[expand(at + ORDER - 1, size)] = _LOWER[words.raw[expand(words.start[chosen], size)]]
    last = expand(at + ORDER - 1, size + 1)
    gram = np.zeros(len(last), np.int64)
    for k in range(ORDER):
        gram |= line[last - k].astype(np.int64) << (8 * k)
    return gram, size + 1


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    gram = np.concatenate([p[0] for p in parts])
    found, which = np.unique(gram, return_inverse=True)
    return found, *(np.bincount(which, np.concatenate([p[k] for p in parts]), len(found)).astype(np.int64) for k in (1, 2))


def gram_counts(tagged: DataFrame) -> DataFrame:
    """gram, toxic and ordinary count of all texts of (text, toxic); rows without a label only show that a gram exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                words = Words(part.column("text"))
                label = part.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)[words.text_of()]
                chosen, which = distinct_words(words)
                gram, count = byte_grams(words, chosen)
                held.append((gram, *(np.repeat(np.bincount(which, label == c, len(chosen)), count) for c in (1, 0))))
                held[-1:] = [_merged(held[-1:])]
                if sum(len(x[0]) for x in held) > 2 * _MERGE:
                    held = [_merged(held)]
                    if len(held[0][0]) > _MERGE:  # too many different ones to hold: Spark sums them up
                        yield from out(held[0])
                        held = []
        if held:
            yield from out(_merged(held))

    def out(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)]) for c in columns], ["gram", "toxic", "ordinary"])

    counts = tagged.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "gram long, toxic long, ordinary long")
    return counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def continuation_model(grams: DataFrame) -> DataFrame:
    """gram of five bytes and ``shared``, its Kneser-Ney probability after its first four, over all of the corpus.

    A gram counts once for each different byte that precedes it; each order is interpolated with the next lower one,
    down to a uniform choice of a byte. Every order is written, so that no query holds more than two of them: in one
    query, Spark would plan all of them anew after each of its 40 jobs and keep every plan on the driver.
    """
    orders, level = {}, grams.select("gram")
    for n in range(ORDER - 1, 0, -1):
        level = written(level.groupBy(F.col("gram").bitwiseAND(F.lit(256**n - 1)).alias("gram")).agg(F.count("*").alias("n")), "order")
        orders[n] = level
    below = None
    for n in range(1, ORDER):
        context = Window.partitionBy("context")  # at most 256 rows
        joined = orders[n].withColumn("context", F.shiftrightunsigned("gram", 8)).withColumns({"total": F.sum("n").over(context), "kinds": F.count("*").over(context)})
        if below is None:
            lower: Column = F.lit(1 / 256)
        else:
            joined = joined.withColumn("lower", F.col("gram").bitwiseAND(F.lit(256 ** (n - 1) - 1))).join(below.withColumnRenamed("gram", "lower"), "lower")
            lower = F.col("shared")
        last, below = below, written(joined.select("gram", ((F.col("n") - DISCOUNT) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * lower).alias("shared")), "shared")
        forget(orders[n], *([] if last is None else [last]))
    return below


def ratio_tables(grams: DataFrame) -> tuple[np.ndarray, ...]:
    """Sorted grams with their log-likelihood ratio, and sorted contexts with that of any byte not seen after them.

    Only grams and contexts of labelled rows are in them, so the sample bounds their size.
    """
    seen = grams.where("toxic + ordinary > 0").withColumn("context", F.shiftrightunsigned("gram", 8)).withColumn("tail", F.col("gram").bitwiseAND(F.lit(256 ** (ORDER - 1) - 1)))
    shared = continuation_model(grams)
    table = seen.join(shared.withColumnRenamed("gram", "tail"), "tail").select("gram", "context", "toxic", "ordinary", "shared").toArrow()
    forget(shared)
    gram, context, shared_p = (table[k].to_numpy() for k in ("gram", "context", "shared"))
    found, which = np.unique(context, return_inverse=True)
    logs, unseen = [], []
    for label in ("toxic", "ordinary"):
        n = table[label].to_numpy().astype(float)
        total, kinds = np.bincount(which, n, len(found)), np.bincount(which, n > 0, len(found))
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total[which], 1) + rest[which] * shared_p))
        unseen.append(np.log(rest))
    order = np.argsort(gram)
    return gram[order], (logs[0] - logs[1])[order].astype(np.float32), found, (unseen[0] - unseen[1]).astype(np.float32)


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.float32), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return np.where(hit, values[at], np.float32(0)), hit


def text_features(texts: pa.Array, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each whole text: ratio per byte over all of it, over its highest passage of three words, the highest ratio of
    a word, and the logarithm of its words. Zeros for a text without words."""
    words = Words(texts)
    chosen, which = distinct_words(words)
    gram, count = byte_grams(words, chosen)
    grams, back = np.unique(gram, return_inverse=True)
    value, hit = _lookup(tables[0], tables[1], grams)
    value = np.where(hit, value, _lookup(tables[2], tables[3], grams >> 8)[0])[back]
    total = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
    last = np.cumsum(count)
    own = (total[last] - total[last - count])[which] if len(chosen) else np.zeros(0)
    size = count[which] if len(chosen) else np.zeros(0, np.int64)
    score, length = (np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in (own, size))
    out = np.zeros((len(words.first) - 1, 4))
    full = np.flatnonzero(np.diff(words.first))
    if not len(full):
        return out
    first, end = words.first[:-1][full], words.first[1:][full]
    stop = np.minimum(np.arange(len(own)) + PASSAGE, np.repeat(end, end - first))
    passage = (score[stop] - score[:-1]) / (length[stop] - length[:-1])
    out[full, 0] = (score[end] - score[first]) / (length[end] - length[first])
    out[full, 1] = np.maximum.reduceat(passage, first)
    out[full, 2] = np.maximum.reduceat(own, first) / 10
    out[full, 3] = np.log(end - first) / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton steps. If a class is missing, nothing can be told apart:
    the weights are zero and the bias says no."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = -1.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of ``z`` above which calling a row toxic gives the best F1; halfway to the next lower value."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    f1[:-1][z[:-1] == z[1:]] = 0  # equal values are not told apart
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1e-6)


def counting_rows(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> DataFrame:
    """doc_id and toxic of the rows of ``labels`` (one a document, with fold) whose texts count the models: of each class the
    first ``rows`` in an order of their own, as far as their texts stay within ``size`` bytes; a text of over a sixteenth of
    that is passed over. All rows of a doc_id count for its size."""
    draw = F.xxhash64("doc_id")
    drawn = [labels.where((F.col("toxic") == c) & F.col("fold").isin(1, 2, 3)).orderBy(draw, "doc_id").limit(rows).select("doc_id", "toxic") for c in (0, 1)]
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    sized = sizes.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return sized.where(F.col("size") <= size // 16).withColumn("sum", before).where(F.col("sum") <= size).select("doc_id", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, fit_rows: int = FIT_ROWS, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """The rows of ``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5 on), which replace columns of these
    names; ``labels`` has doc_id, toxic.

    Only labels whose crc32(doc_id as text) mod 5 is not 0 are learnt from; a document with several labels counts as
    toxic if one says so. At most ``class_rows`` documents and ``class_bytes`` bytes of a class are counted, see
    ``counting_rows``; every document is scored, whatever its length. Texts without words (null, empty) get the score of zero evidence; without labels of
    both classes to fit on no text is toxic; repeated rows score alike; an empty table gives no rows.
    """
    docs = docs.drop("score", "held_out", "predicted")
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id")))
    draw = F.xxhash64("doc_id")
    model_rows = F.broadcast(counting_rows(docs, labels, class_rows, class_bytes))  # 2 * class_rows at most
    grams = written(gram_counts(docs.select("doc_id", "text").join(model_rows, "doc_id", "left")), "grams")
    shared = docs.sparkSession.sparkContext.broadcast(ratio_tables(grams))
    forget(grams)

    fit_labels = F.broadcast(labels.where("fold = 4").orderBy(draw, "doc_id").limit(fit_rows).select("doc_id", "toxic"))
    names = ["a", "b", "c", "d"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                x = text_features(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(x[:, k]) for k in range(4))], ["toxic", *names])

    fitted = docs.select("doc_id", "text").join(fit_labels, "doc_id").select("toxic", "text").mapInArrow(features, "toxic int, a double, b double, c double, d double")
    fitted = fitted.distinct().orderBy(F.xxhash64(*names), "toxic", *names).limit(fit_rows).toArrow()  # repeated rows count once
    x, y = np.column_stack([fitted[k].to_numpy() for k in names]), fitted["toxic"].to_numpy().astype(float)
    weight = fit_logistic(x, y)
    weight[-1] -= best_cut(x @ weight[:-1] + weight[-1], y)

    schema = extended(docs, score="double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                z = text_features(part.column("text"), shared.value) @ weight[:-1] + weight[-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema.names)

    return docs.mapInArrow(scored, schema).withColumns({"held_out": fold(F.col("doc_id")) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})
