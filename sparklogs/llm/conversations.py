"""Repair of conversations by a suffix-shared word graph of their role and fault signatures.

A conversation is a word with one letter for each row: its role's initial and whether it is sound, truncated or has to
go. Repair keeps, reroles, deletes and inserts rows so that the roles read ``(s?(ua)+)?``, at the least cost. What a
repair costs from a row on depends on the letters from there to the end alone, so all conversations share one automaton
whose nodes are the different suffixes. Words are sorted by their reverse, as for building a minimal automaton from
sorted input: those that share a suffix stand side by side, each node is met once, with its cost-to-go and best next
edits for the four grammar states, and what no later word can share is let go. A task holds one word's path at a time;
only a path that crosses a border of two tasks is built twice.

Rows move in streams sorted by conversation and turn, so no conversation has to fit in memory; what grows with it is its
word and its audit, a byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklogs.llm.common import written

#: Grammar states: nothing yet (accepts), after system, after user, after assistant (accepts).
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an added or rerole'd row; its role is user, or assistant if this is ASSISTANT.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Letters of a word: s, u, a or x (another role), upper case if truncated, and this one for a row that has to go.
GONE = "-"
#: Costs of ending in each state, and the edits that end there.
END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "II", "I", "")
SPACE = " \t\n\x0b\x0c\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


@lru_cache(maxsize=None)
def edge(after: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """A node from the one after it: its costs less their minimum, that minimum, and for each state the edits up to and with
    its own row and the state that they lead to; of equally cheap edits those whose initials come first in ASCII.

    ``after`` has the next node's costs less their minimum. These differ by a few edits at most, so there are few
    arguments, whatever the number of nodes.
    """
    more = TRUNCATED if letter.isupper() else 0
    options: list[dict[str, tuple[int, int]]] = []
    for state in range(4):
        found = {"D": (DELETE + after[state], state)}
        if letter != GONE:
            to = KEPT.get((state, letter.lower()))
            if to is not None:
                found["K"] = (KEEP + more + after[to], to)
            found["R"] = (REROLE + more + after[NEXT[state]], NEXT[state])
        options.append(found)
    cost = [min(c for c, _ in found.values()) for found in options]
    for _ in range(2):  # two inserts lead from any state to any other that inserts lead to
        cost = [min(c, INSERT + cost[NEXT[state]]) for state, c in enumerate(cost)]
    ways = []
    for state in range(4):
        edits, at = "", state
        while True:
            best = {k for k, (c, _) in options[at].items() if c == cost[at]} | ({"I"} if INSERT + cost[NEXT[at]] == cost[at] else set())
            edits += min(best)
            if edits[-1] != "I":
                break
            at = NEXT[at]
        ways.append((edits, options[at][edits[-1]][1]))
    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(ways)


class Suffixes:
    """The path of nodes of the word that was asked last, from the end of the word."""

    def __init__(self) -> None:
        self.word, self.made = "", 0
        self.nodes: list[tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]] = []

    def repair(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of the word whose reverse this is; nodes that it shares with the word before are not made again."""
        shared, most = 0, min(len(reverse), len(self.word))
        while shared < most and reverse[shared] == self.word[shared]:
            shared += 1
        del self.nodes[shared:]
        for letter in reverse[shared:]:
            after, total = self.nodes[-1][:2] if self.nodes else (END, 0)
            costs, least, ways = edge(after, letter)
            self.nodes.append((costs, total + least, ways))
        self.made += len(reverse) - shared
        self.word = reverse
        state, audit = START, []
        for _, _, ways in reversed(self.nodes):
            edits, state = ways[state]
            audit.append(edits)
        audit.append(END_EDITS[state])
        return (self.nodes[-1][0][START] + self.nodes[-1][1] if self.nodes else END[START]), "".join(audit)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with damage by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` away, 3 gives it twice, 4 makes it the user's. Nulls of role and text, and in the key, are one space."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("time")).drop("time")


def _same() -> Column:
    """Equal for rows of equal role and text."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def signatures(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` and of ``ids``: conv_id, its counts, and its word, reversed.

    Only hashes of texts are dealt out. Repeated texts are told by (conversation, hash), so a long conversation is spread.
    """
    solid = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(solid == "", "b").when(F.right(solid, F.lit(1)).isin(".", "!", "?"), " ").otherwise("t")
    narrow = rows.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), _same().alias("same"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy(F.asc_nulls_first("turn")))
    faulty = narrow.withColumn("nth", nth).withColumn("fault", F.when(F.col("fault") == "b", "b").when(F.col("nth") > 1, "d").otherwise(F.col("fault")))
    asked = ids.select("conv_id").distinct().select("conv_id", F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"), F.lit("").alias("same"), F.lit(0).alias("nth"))
    stream = faulty.unionByName(asked).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "same", "nth")
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("reverse", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(schema), None
        for batch in batches:
            for conv, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        yield from out.add(*_counted(now))
                    # conversation, least and last turn and their number, blank, duplicate, truncated, illegal, initial before, word
                    now = [conv, None, None, 0, 0, 0, 0, 0, None, bytearray()]
                if fault is None:
                    continue
                if turn is not None and turn != now[2]:
                    now[1], now[2], now[3] = turn if now[1] is None else now[1], turn, now[3] + 1
                if fault in "bdt":
                    now[4 + "bdt".index(fault)] += 1
                now[7] += now[8] is not None and now[8] + initial not in ("su", "ua", "au")
                now[8] = initial
                letter = initial if initial in ("s", "u", "a") else "x"
                now[9] += (GONE if fault in "bd" else letter.upper() if fault == "t" else letter).encode()
        if now:
            yield from out.add(*_counted(now))
        yield from out.rest()

    return stream.drop("same", "nth").mapInArrow(run, schema)


def _counted(now: list) -> tuple:
    gaps = now[2] - now[1] + 1 - now[3] if now[3] else 0
    return (now[0], gaps, *now[4:8], now[9][::-1].decode())


class _Out:
    """Rows gathered into batches of some thousand, or fewer if they are long."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if self.size > 1 << 21:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def audits(words: DataFrame) -> DataFrame:
    """``words`` with cost and audit for its column ``reverse``, which goes.

    Words are dealt in ranges of their reverse; the conversation is in the order too, so a word that very many share is no
    single task's.
    """
    kept = [f for f in words.schema if f.name != "reverse"]
    schema = T.StructType([*kept, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = words.repartitionByRange(parts, "reverse", "conv_id").sortWithinPartitions("reverse", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, seen, found = Suffixes(), None, (0, "")
        for batch in batches:
            costs, texts = [], []
            for reverse in batch.column("reverse").to_pylist():
                if reverse != seen:
                    seen, found = reverse, path.repair(reverse)
                costs.append(found[0])
                texts.append(found[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(costs, pa.int64()), pa.array(texts, pa.string())], schema.names)

    return stream.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn (a whole number), role, text; other columns go. ``ids`` has the conversations to report on,
    those without rows too (zeros, an empty audit, the hash of the empty string). A row's first fault counts: blank, an
    earlier row's role and text, or no ``.!?`` at its end. Rows come by turn, nulls first, those of one turn by a hash of
    role and text. Null roles and texts are one space, null conversations are one conversation; a role's first letter
    counts, and one other than s, u, a can be rerole'd or deleted only. An empty table gives no rows.
    """
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", "turn", *space)
    words = written(signatures(rows, rows if ids is None else ids), "words")  # its ranges are sampled, so it is read twice
    heads = audits(words)
    moved = rows.select("conv_id", F.lit(1).alias("kind"), "turn", _same().alias("same"), "role", "text", *(F.lit(None).cast("long").alias(c) for c in (*_COUNTS, "cost")))
    first = heads.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("same"), F.lit("").alias("role"), F.col("audit").alias("text"), *_COUNTS, "cost")
    stream = first.unionByName(moved).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "same").drop("turn", "same")
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(schema), None
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in (*_COUNTS, "cost")), strict=True)
            for conv, kind, role, text, counts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), numbers, strict=True):
                if kind == 0:  # the conversation's counts and audit come before its rows
                    if now:
                        yield from out.add(*now.finished())
                    now = _Repaired((conv, *counts), text)
                else:
                    now.row(role, text)
        if now:
            yield from out.add(*now.finished())
        yield from out.rest()

    return stream.mapInArrow(run, schema)


class _Repaired:
    """The hash of a conversation's repaired rows, which come one by one."""

    def __init__(self, head: tuple, audit: str):
        self.head, self.audit, self.at, self.state, self.hash, self.empty = head, audit, 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(((("" if self.empty else "\n") + role + ":") + text).encode())
        self.empty = False

    def _added(self) -> str:
        self.state = NEXT[self.state]
        return "assistant" if self.state == ASSISTANT else "user"

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._added(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[0]]
            self._put(role, text)
        elif edit == "R":
            self._put(self._added(), text)

    def finished(self) -> tuple:
        self._inserts()
        return (*self.head, self.audit, self.hash.hexdigest())
