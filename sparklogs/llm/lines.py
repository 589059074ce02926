"""Line deduplication: of equal lines, and of lines within one edit of each other, the earliest stays.

Equal lines are joined first, by hash. The others are joined by deletion neighbourhoods: a line gives every variant with
one character deleted as a hashed key, lines with an equal variant meet, and their edit distance is verified. A short
line gives all of its variants. Of a longer one only those are made that can meet one: an edit leaves one half of a line
as it is, and all of the line outside of the sixteenth that holds it, so lines that share neither with another line are
done, and the variants of the rest are those of that sixteenth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklogs.llm.common import buffers, extended, mix, prime_rolling, signed, slices, unused, written
from sparklogs.llm.ngram_join import holding

#: Lines of up to so many characters give all variants at once; lines of at least so many are looked up by halves first.
SHORT = 16
PARTS = 8
_LEAST = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 1 << 17


class Lines:
    """The lines of a batch of texts that hold more than white space, their numbers, hashes and characters."""

    def __init__(self, texts: pa.Array):
        self.raw, at = buffers(texts)
        n = len(at) - 1
        breaks = np.flatnonzero(self.raw == 10)
        per = np.searchsorted(breaks, at)
        count = np.diff(per) + 1
        self.text = np.repeat(np.arange(n), count)
        first = np.cumsum(count) - count
        self.number = np.arange(len(self.text)) - first[self.text]
        self.start, self.end = np.empty(len(self.text), np.int64), np.empty(len(self.text), np.int64)
        self.start[first], self.end[first + count - 1] = at[:-1], at[1:]
        inner = np.ones(len(self.text), bool)
        inner[first] = False
        self.start[inner] = breaks + 1
        inner[:] = True
        inner[first + count - 1] = False
        self.end[inner] = breaks
        solid = np.concatenate([[0], np.cumsum((self.raw != 32) & ((self.raw < 9) | (self.raw > 13)))])
        full = np.flatnonzero(solid[self.end] > solid[self.start])
        self.all_of = count
        self.text, self.number, self.start, self.end = (x[full] for x in (self.text, self.number, self.start, self.end))
        self.chars = np.append(np.flatnonzero((self.raw & 0xC0) != 0x80), len(self.raw))
        self.first_char = np.searchsorted(self.chars, self.start)
        self.length = np.searchsorted(self.chars, self.end) - self.first_char

    def digests(self, lines: np.ndarray) -> np.ndarray:
        """(lines, 2): 128 bits of xxHash of each of the given lines."""
        raw = memoryview(self.raw)
        found = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(self.start[lines].tolist(), self.end[lines].tolist(), strict=True))
        return np.frombuffer(found, "<i8").reshape(-1, 2)

    def asked(self, row: np.ndarray, number: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (text, line number, hash) are lines here, as a mask, and their places.

        A repeated doc_id may ask for another text's line, whose hash differs.
        """
        if not len(self.text):
            return np.zeros(len(row), bool), np.zeros(0, np.int64)
        place, wanted = (self.text << 32) | self.number, (row << 32) | number
        at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        ok = place[at] == wanted
        ok[ok] = self.digests(at[ok])[:, 0] == h1[ok]
        return ok, at[ok]

    def outside(self, line: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Hash of the first ``left`` and the last ``m - right`` characters of lines, with m and a mark."""
        a = self.chars[self.first_char[line] + left]
        b = self.chars[self.first_char[line] + self.length[line] - (m - right)]
        rest = prime_rolling(15).runs(self.raw, self.start[line], self.end[line], a, b)
        return mix(rest + (m * 64 + mark).astype(np.uint64) * _ODD)

    def half_keys(self) -> np.ndarray:
        """(lines, 4): for m the length and one less, hashes of what an edit in the second or the first half leaves."""
        line, keys = np.flatnonzero(self.length >= SHORT), np.zeros((len(self.text), 4), np.uint64)
        zero = np.zeros(len(line), np.int64)
        for k in range(4):
            m = self.length[line] - (k >> 1)
            half = m // 2
            keys[line, k] = self.outside(line, m, half, m, zero) if k % 2 == 0 else self.outside(line, m, zero, half, zero + 1)
        return keys

    def strings(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        raw = memoryview(self.raw)
        return pa.array([bytes(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())


def _positions(docs: DataFrame) -> DataFrame:
    """id and hash of the document, line, h1, h2, four half keys (0 for a short line) and the text of a short line, for each
    line with more than white space."""
    names = ["id", "doc", "line", "h1", "h2", "p0", "s0", "p1", "s1", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines = Lines(part.column("text"))
                keys, digests = signed(lines.half_keys().T.copy()), lines.digests(np.arange(len(lines.text)))
                short = np.flatnonzero(lines.length <= SHORT)
                where = np.full(len(lines.text), -1)
                where[short] = np.arange(len(short))
                own = lines.strings(lines.start[short], lines.end[short]).take(pa.array(where, mask=where < 0))
                owner = pa.array(lines.text)
                columns = [part.column("id").take(owner), part.column("doc").take(owner), pa.array(lines.number, pa.int32()), *map(pa.array, digests.T.copy()), *map(pa.array, keys), own]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, "id long, doc long, line int, h1 long, h2 long, p0 long, s0 long, p1 long, s1 long, short string")


def _sixteenths(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, payload, id, line, h1: for each wanted half of a line what each of its eighths leaves, and that eighth's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines, lists = Lines(part.column("text")), part.column("wanted")
                want = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                own = want.field("h1").to_numpy()
                ok, at = lines.asked(row, want.field("line").to_numpy(), own)
                row, kind, own = row[ok], want.field("kind").to_numpy()[ok], own[ok]
                m = lines.length[at] - (kind >> 1)
                half = m // 2
                low, high = np.where(kind % 2 == 0, half, 0), np.where(kind % 2 == 0, m, half)
                each = np.repeat(np.arange(len(at)), PARTS)
                j = np.tile(np.arange(PARTS), len(at))
                span = (high - low)[each]
                left, right = low[each] + j * span // PARTS, low[each] + (j + 1) * span // PARTS
                line = at[each]
                key = lines.outside(line, m[each], left, right, 2 + (kind % 2)[each] * PARTS + j)
                payload = lines.strings(lines.chars[lines.first_char[line] + left], lines.chars[lines.first_char[line] + lines.length[line] - (m[each] - right)])
                columns = [pa.array(signed(key)), payload, part.column("id").take(pa.array(row[each])), pa.array(lines.number[line], pa.int32()), pa.array(own[each])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "payload", "id", "line", "h1"])

    joined = docs.join(wanted, ["id", "doc"]).select("id", "text", "wanted")
    return joined.mapInArrow(run, "key long, payload string, id long, line int, h1 long")


def _variants(close: DataFrame) -> DataFrame:
    """key, id, line, h1, variant and gap: each payload with one character deleted, and where; gap -1 is the payload itself."""
    names = ["key", "id", "line", "h1", "variant", "gap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "payload", 1 << 18):
                raw, at = buffers(part.column("payload"))
                chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                first = np.searchsorted(chars, at)
                size = np.diff(first)
                whole = np.arange(len(size))
                row = np.concatenate([whole, np.repeat(whole, size)])
                gap = np.concatenate([np.full(len(size), -1), np.arange(len(chars) - 1) - np.repeat(first[:-1], size)])
                # the deleted character's bytes; of the payload itself, none
                left = np.concatenate([at[:-1], chars[:-1]])
                right = np.concatenate([at[:-1], chars[1:]])
                hashes = prime_rolling(17).runs(raw, at[:-1][row], at[1:][row], left, right)
                key = part.column("key").to_numpy()[row].view(np.uint64)
                columns = [*(part.column(c).take(pa.array(row)) for c in names[:4]), pa.array(signed(mix(hashes + key * _ODD))), pa.array(gap, pa.int32())]
                for begin in range(0, len(row), _BATCH):
                    yield pa.RecordBatch.from_arrays([c.slice(begin, _BATCH) for c in columns], names)

    return close.mapInArrow(run, "key long, id long, line int, h1 long, variant long, gap int")


def repeated_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """id, doc, line, h1 of each line that an earlier line (by id, then line number) equals or is within ``edits`` of (0 or 1).

    ``docs`` has id, doc and text; ``doc`` is a hash of the text, so that what is gathered belongs to one text even where
    very many rows share an id.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    lines = written(_positions(docs), "lines")
    here = F.struct("id", "line")
    keys = ["p0", "s0", "p1", "s1"]
    # equal lines have equal keys, so any of them will do
    firsts = written(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line", "doc")).alias("at"), F.count("*").alias("n"), *[F.first(k).alias(k) for k in [*keys, "short"]]), "first-lines")
    equal = lines.select("id", "doc", "line", "h1", "h2").join(firsts.where("n > 1").select("h1", "h2", "at"), ["h1", "h2"]).where(here > F.struct("at.id", "at.line")).select("id", "doc", "line", "h1")
    if not edits:
        return equal.distinct()

    halves = firsts.where("p0 <> 0").select("h1", "at", F.posexplode(F.array(*keys)).alias("kind", "key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = halves.join(shared, "key", "left_semi")
    wanted = near.groupBy("at.id", "at.doc").agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "h1", "kind")).alias("wanted"))
    rests = written(_sixteenths(docs, wanted), "sixteenths")
    meeting = rests.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    short = firsts.where("short is not null").select(F.lit(0).cast("long").alias("key"), F.col("short").alias("payload"), "at.id", "at.line", "h1")
    close = written(rests.join(meeting, "key", "left_semi").dropDuplicates(["key", "id", "line", "h1"]).unionByName(short), "close")

    variants = written(_variants(close), "variants")
    # lines that lost the same character place differ there only; a variant and a line that it is are one edit apart
    first = F.min(F.struct("id", "line", "h1", "key")).alias("first")
    same_place = variants.where("gap >= 0").groupBy("variant", "gap").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    whole = variants.where("gap < 0").groupBy("variant").agg(first)
    longer = variants.where("gap >= 0").groupBy("variant").agg(first)
    met = (
        variants.where("gap >= 0").join(same_place, ["variant", "gap"]).select("key", "id", "line", "h1", "first")
        .unionByName(variants.where("gap >= 0").join(whole, "variant").select("key", "id", "line", "h1", "first"))
        .unionByName(variants.where("gap < 0").join(longer, "variant").select("key", "id", "line", "h1", "first"))
    ).where(here > F.struct("first.id", "first.line")).distinct()
    other = close.select(F.struct("id", "line", "h1", "key").alias("first"), F.col("payload").alias("first_payload"))
    both = met.join(close, ["key", "id", "line", "h1"]).join(other, "first")
    edited = both.where((F.col("key") == F.col("first.key")) & (F.levenshtein("payload", "first_payload", 1) >= 0)).select("id", "line", "h1")
    # rows that share an id may have such a line in the same place; each text is told of its own
    edited = written(edited.distinct(), "edited")
    placed = holding(lines.select("id", "doc", "line", "h1"), edited, "h1").join(edited, ["id", "line", "h1"])
    return equal.unionByName(placed.select("id", "doc", "line", "h1")).distinct()


def dedup_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """The rows of ``docs`` with text replaced by its kept lines, and n_lines, n_dropped, which replace columns of these names.

    A line goes if an earlier line of the corpus (by doc_id, null first, then line number) equals it or is ``edits``
    insertions, deletions or substitutions of a character away (1, or 0 for equal lines only), whatever its length;
    whether that earlier line itself stays does not matter. Lines of white space only always stay. Null text counts as
    empty; rows that share a doc_id are decided by their line numbers and contents, so repeated rows come out alike; no
    rows give none.
    """
    docs = docs.drop("n_lines", "n_dropped")
    key, own_hash, lost = unused("_id", docs.columns), unused("_hash", docs.columns), unused("_gone", docs.columns)
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.xxhash64(text).alias("doc"), text.alias("text"))
    gone = repeated_lines(read, edits).groupBy(F.col("id").alias(key), F.col("doc").alias(own_hash)).agg(F.collect_list(F.struct("line", "h1")).alias(lost))
    rest = [c for c in docs.columns if c != "text"]
    schema = extended(docs.select("text", *rest), n_lines="int", n_dropped="int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines, lists = Lines(part.column("text")), part.column(lost)
                own = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                number = own.field("line").to_numpy()
                ok, _ = lines.asked(row, number, own.field("h1").to_numpy())
                drop = np.unique((row[ok] << 32) | number[ok])
                cut = np.searchsorted(drop, np.arange(len(lists) + 1) << 32)
                texts = part.column("text").fill_null("").to_pylist()
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    skip = set((drop[cut[i] : cut[i + 1]] & 0xFFFFFFFF).tolist())
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in skip)
                columns = [pa.array(texts, pa.string()), *(part.column(c) for c in rest), pa.array(lines.all_of, pa.int32()), pa.array(np.diff(cut), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    joined = docs.withColumns({key: F.coalesce("doc_id", F.lit(_LEAST)), own_hash: F.xxhash64(text)}).join(gone, [key, own_hash], "left").select("text", *rest, lost)
    return joined.mapInArrow(run, schema).select(*docs.columns, "n_lines", "n_dropped")
