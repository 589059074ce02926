"""Language of a text in two steps: first its family, then one-versus-one linear support vector machines in the family.

A text is lower case, letters stay and everything else is a space; its features are the hashed grams of two to four
bytes, as shares of all its grams. Every machine separates two families, or two languages of one family, and is fitted by
one task on a bounded sample (``CLASS_ROWS`` texts and ``CLASS_ENTRIES`` gram shares of each language). Weights are whole
numbers, so equal texts score alike wherever they stand. Every text is read whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.llm.common import buffers, extended, slices, written

SIZES = (2, 3, 4)
BUCKETS = 1 << 16
CLASS_ROWS = 1000
CLASS_ENTRIES = 1 << 20
#: Shares are this much larger in a machine, whose weights and margins then are of about one.
SCALE = 16.0
#: Weights are multiples of one over this.
UNIT = 1 << 16
UNKNOWN = "und"
_STEP = 1 << 19
_PAD = 3
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str, families: dict[str, str] = FAMILY_OF) -> str:
    """The family of a language; one that is not listed is a family of its own. Of ``de-AT`` the part before the sign counts."""
    return families.get(language.replace("_", "-").split("-")[0].lower(), language)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; such rows teach nothing."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Line:
    """The texts of a batch in one line of bytes, each after three spaces and before one."""

    def __init__(self, texts: pa.Array):
        raw, at = buffers(pc.utf8_lower(texts))
        size = np.diff(at)
        self.start = at + (_PAD + 1) * np.arange(len(at))
        self.line = np.full(int(self.start[-1]), 32, np.uint8)
        self.line[np.arange(len(raw)) + np.repeat(self.start[:-1] - at[:-1] + _PAD, size)] = _LETTER[raw]

    def buckets(self, a: int, b: int) -> np.ndarray:
        """For each size the buckets of the grams that end at ``a`` to ``b``; ``BUCKETS`` where there is none."""
        from_ = max(a - max(SIZES) + 1, 0)
        part = self.line[from_:b].astype(np.uint32)
        pads = np.concatenate([self.start[:-1] + k for k in range(_PAD)])
        pads = pads[(pads >= a) & (pads < b)] - a
        out = np.empty((len(SIZES), b - a), np.int64)
        gram, blank = np.zeros(b - a, np.uint32), 0
        for k in range(max(SIZES)):
            before = np.full(b - a, 32, np.uint32)
            there = part[max(a - k - from_, 0) : b - k - from_]
            before[b - a - len(there) :] = there
            gram |= before << np.uint32(8 * k)
            blank |= 32 << (8 * k)
            if k + 1 in SIZES:
                row = out[SIZES.index(k + 1)]
                row[:] = ((gram ^ np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                row[gram == blank] = BUCKETS
                row[pads] = BUCKETS
        return out

    def shares(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The different buckets of each text and the shares that they have in its grams."""
        rows, values = [], []
        for first, last in zip(self.start[:-1].tolist(), self.start[1:].tolist(), strict=True):
            count = np.zeros(BUCKETS + 1, np.int64)
            for a in range(first, last, _STEP):
                count += np.bincount(self.buckets(a, min(a + _STEP, last)).ravel(), minlength=BUCKETS + 1)
            own = np.flatnonzero(count[:-1])
            rows.append(own.astype(np.int32))
            values.append((count[own] / max(count[:-1].sum(), 1)).astype(np.float32))
        return rows, values

    def sums(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of the weights of its grams, for each column of ``weight`` (BUCKETS + 1 rows, the last of
        zeros), and the number of its grams."""
        n = len(self.start) - 1
        total, count = np.zeros((n, weight.shape[1]), np.int64), np.zeros(n, np.int64)
        for a in range(0, len(self.line), _STEP):
            b = min(a + _STEP, len(self.line))
            buckets = self.buckets(a, b)
            first, last = np.searchsorted(self.start, a, "right") - 1, np.searchsorted(self.start, b)
            at = np.maximum(self.start[first:last] - a, 0)
            count[first:last] += np.add.reduceat((buckets < BUCKETS).sum(axis=0), at)
            for k in range(weight.shape[1]):
                own = weight[:, k]
                total[first:last, k] += np.add.reduceat(own[buckets[0]] + own[buckets[1]] + own[buckets[2]], at)
        return total, count


def fit_machine(rows: list[np.ndarray], values: list[np.ndarray], first: np.ndarray, ridge: float = 1e-4, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss, positive for ``first``.

    Both classes weigh one half. Newton steps on the rows inside the margin, by conjugate gradients.
    """
    n = len(rows)
    row, col, val = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows), np.concatenate(values) * SCALE
    used, col = np.unique(col, return_inverse=True)
    y = np.where(first, 1.0, -1.0)
    share = np.where(first, 0.5 / max(first.sum(), 1), 0.5 / max((~first).sum(), 1))
    forth = lambda w: np.bincount(row, val * w[:-1][col], n) + w[-1]
    back = lambda v: np.append(np.bincount(col, val * v[row], len(used)), v.sum())
    keep = np.append(np.full(len(used), ridge), 1e-6)
    w = np.zeros(len(used) + 1)
    loss = lambda w, f: (keep * w * w).sum() / 2 + (share * np.maximum(1 - y * f, 0) ** 2).sum()
    f = forth(w)
    for _ in range(steps):
        inside = share * (y * f < 1)
        slope = keep * w - 2 * back(inside * (y - f))
        move, rest = np.zeros_like(w), -slope
        line, size = rest.copy(), rest @ rest
        aim = size * 1e-4
        for _ in range(20):
            if size <= aim:
                break
            bent = keep * line + 2 * back(inside * forth(line))
            by = size / (line @ bent)
            move, rest = move + by * line, rest - by * bent
            size, old = rest @ rest, size
            line = rest + size / old * line
        now, step, along = loss(w, f), 1.0, forth(move)
        while step > 1e-3 and loss(w + step * move, f + step * along) > now:
            step /= 2
        w, f = w + step * move, f + step * along
        if now - loss(w, f) < 1e-6 * now:
            break
    weight = np.zeros(BUCKETS)
    weight[used] = w[:-1]
    return weight, float(w[-1])


def training_rows(docs: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """lang, draw, row, value: gram shares of up to ``class_rows`` labelled texts of each language, drawn by a hash of doc_id.

    Only documents that are not held out and have a text and a language count. Texts are read for the drawn rows alone.
    """
    known = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as there are languages
    chosen = F.lit(False)
    for lang, n in counts.items():  # half as many again as needed, or all
        chosen = chosen | ((F.col("lang") == lang) & (F.col("draw") <= F.lit(min(int(2**64 * min((1.5 * class_rows + 100) / n, 1)) - 2**63, 2**63 - 1))))
    schema = "lang string, draw long, n long, row array<int>, value array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                rows, values = Line(part.column("text")).shares()
                arrays = [pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("lang").cast(pa.string()), part.column("draw"), *arrays], ["lang", "draw", "n", "row", "value"])

    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    drawn = known.where(chosen).select("lang", "draw", "text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= class_rows)
    hashed = written(drawn.select("lang", "draw", "text").mapInArrow(run, schema), "grams")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("draw", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return hashed.where("n > 0").withColumn("before", before).where(F.col("before") < CLASS_ENTRIES).drop("before", "n")


class Machines:
    """All fitted machines: ``pairs[k]`` = (first, second) of families or of languages has column k of ``weight``."""

    def __init__(self, languages: list[str], families: dict[str, str]):
        self.languages = languages
        self.members: dict[str, list[str]] = {}
        for lang in languages:
            self.members.setdefault(family_of(lang, families), []).append(lang)
        self.pairs = [(True, a, b) for a, b in combinations(sorted(self.members), 2)]
        self.pairs += [(False, a, b) for own in self.members.values() for a, b in combinations(own, 2)]
        self.weight, self.bias = np.zeros((BUCKETS + 1, len(self.pairs)), np.int32), np.zeros(len(self.pairs))

    def fit(self, rows: DataFrame, families: dict[str, str]) -> None:
        """One task a machine; its rows are a bounded sample."""
        spark = rows.sparkSession
        sides = [(k, lang, lang in (self.members[a] if of else [a])) for k, (of, a, b) in enumerate(self.pairs) for lang in (self.members[a] + self.members[b] if of else [a, b])]
        if not sides:
            return

        def fit(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            order = np.lexsort((table["draw"].to_numpy(), table["lang"].to_numpy(zero_copy_only=False).astype(str)))
            table = table.take(pa.array(order))
            rows, values = ([x.values.to_numpy() for x in table[c]] for c in ("row", "value"))
            weight, bias = fit_machine(rows, values, table["first"].to_numpy(zero_copy_only=False).astype(bool))
            whole = np.clip(np.rint(weight * UNIT), -(2**29), 2**29).astype(np.int32)
            return pa.table({"k": pa.array([table["k"][0].as_py()], pa.int32()), "weight": pa.array([whole.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

        dealt = rows.join(F.broadcast(spark.createDataFrame(sides, "k int, lang string, first boolean")), "lang")  # two or more rows a machine
        for r in dealt.groupBy("k").applyInArrow(fit, "k int, weight binary, bias double").collect():  # BUCKETS numbers a machine
            self.weight[:-1, r["k"]], self.bias[r["k"]] = np.frombuffer(r["weight"], np.int32), r["bias"]

    def _choose(self, names: list[str], margin: np.ndarray, of: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each text the place of the name that wins most of its comparisons (ties: the larger sum of margins, then the
        first name), and its mean probability in them."""
        n = len(margin)
        votes, total, chance = (np.zeros((n, len(names))) for _ in range(3))
        for k, (kind, a, b) in enumerate(self.pairs):
            if kind == of and a in names and b in names:
                i, j, m = names.index(a), names.index(b), margin[:, k]
                p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                total[:, i] += m
                total[:, j] -= m
                chance[:, i] += p
                chance[:, j] += 1 - p
        best = np.argmax(votes + 0.25 * np.tanh(total), axis=1)
        return best, chance[np.arange(n), best] / (len(names) - 1) if len(names) > 1 else np.ones(n)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        n = len(texts)
        language, score = np.full(n, UNKNOWN, object), np.zeros(n)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.languages or not lettered.any():
            return language, score
        total, count = Line(texts).sums(self.weight)
        margin = total / UNIT * SCALE / np.maximum(count, 1)[:, None] + self.bias
        families = sorted(self.members)
        family, sure = self._choose(families, margin, True)
        for f, name in enumerate(families):
            own = np.flatnonzero(lettered & (family == f))
            which, chance = self._choose(self.members[name], margin[own], False)
            language[own] = np.array(self.members[name], object)[which]
            score[own] = sure[own] * chance
        return language, score


def identify_language(docs: DataFrame, families: dict[str, str] = FAMILY_OF, class_rows: int = CLASS_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score (0 to 1), which replace columns of
    these names; ``families`` names the family of a language.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out; languages are learnt from the others' text and lang alone. A
    null text, or one without a letter of any script, is ``und`` with score 0, and so is every text if nothing can be learnt;
    of a single learnt language every text is. Repeated rows get the same answer; an empty table gives no rows.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    rows = training_rows(docs.select("doc_id", "text", "lang"), class_rows)
    machines = Machines(sorted(r["lang"] for r in rows.select("lang").distinct().collect()), families)
    machines.fit(rows, families)
    shared = docs.sparkSession.sparkContext.broadcast(machines)
    schema = extended(docs, lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                language, score = shared.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(language, pa.string()), pa.array(score)], schema.names)

    return docs.mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id")))
