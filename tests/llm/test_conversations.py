"""Conversation repair: audits by brute force, whole rows by a plain restatement, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from sparklogs.llm import conversations
from sparklogs.llm.conversations import Suffixes, damage, repair_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(word):
    """Least (cost, audit) over all edits, with up to three inserts before a row; the state is the last role's initial."""

    @lru_cache(maxsize=None)
    def go(i, state, added):
        found = [(0, "", "")] if i == len(word) and state in ("", "a") else []
        options = [("I", 2, r, 0) for r in "ua" if added < 3]
        if i < len(word):
            late = int(word[i].isupper())
            options.append(("D", 3, None, 1))
            if word[i] != "-":
                options += [("K", late, word[i].lower(), 1), *(("R", 2 + late, r, 1) for r in "ua")]
        for letter, cost, role, step in options:
            to = state if role is None else STEP.get((state, role))
            if to is not None:
                c, audit, roles = go(i + step, to, 0 if step else added + 1)
                found.append((c + cost, letter + audit, (role or "") + roles))
        return min(found, default=(10**9, "", ""))

    return go(0, "", 0)


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(5)
    words = ["".join(p) for n in range(4) for p in itertools.product("suaxSUAX-", repeat=n)]
    words += ["".join(rng.choices("suuaaaxUA-", k=rng.randint(4, 40))) for _ in range(400)]
    path = Suffixes()
    for word in sorted(words, key=lambda w: w[::-1]):
        cost, audit, roles = cheapest(word)
        assert path.repair(word[::-1]) == (cost, audit) and GRAMMAR.fullmatch(roles)
    # every different suffix is a node once
    assert path.made == len({w[i:] for w in words for i in range(len(w))})


def plain(rows):
    """The repair of one conversation's rows after damage, given as (turn, role, text) in order."""
    seen, faults, word = set(), [], ""
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        word += "-" if fault in ("b", "d") else initial.upper() if fault == "t" else initial
    cost, audit, roles = cheapest(word)
    out, at, k = [], 0, 0
    for letter in audit:
        if letter == "I":
            out.append({"u": "user", "a": "assistant"}[roles[k]] + ":")
            k += 1
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            out.append(f"{role}:{text}")
            k += 1
        elif letter == "R":
            out.append({"u": "user", "a": "assistant"}[roles[k]] + ":" + text)
            k += 1
    initials = [r[1][:1] for r in rows]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def check(rows, found):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert got == {conv: plain(ordered(own)) for conv, own in by.items()}


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "no turn."), (1, None, "user", "no turn."), (1, 3, "assistant", "yes."), (1, 3, "assistant", "yes."), (1, 9, "tool", "what?"), (1, 9, "", "empty role."),
        (2, 0, "system", " \t\x0b\n"), (2, 1, "user", "a b\r\n"), (2, 2, "assistant", "é!"), (2, 2, "usher", "kept as a user."), (2, 2**40, "assistant", "x" * 200_000 + "."),
        (None, 5, "user", "nobody's."), (None, 6, "assistant", "nobody's."), (3, None, "system", "alone."), (3, None, "x", ""),
    ]
    table = spark.createDataFrame([(*r, "q", 1) for r in rows], "conv_id long, turn long, role string, text string, gaps string, kind int").repartition(3)
    check(rows, repair_conversations(table))
    assert repair_conversations(table.limit(0)).count() == 0
    nulls = spark.createDataFrame([(4, 0, None, None)], "conv_id long, turn long, role string, text string")
    check([(4, 0, " ", " ")], repair_conversations(nulls))


def test_a_conversation_with_a_third_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(7 if k % 3 == 0 else 1000 + k, k // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["yes.", "no", "why?", "", f"row {k}."])) for k in range(1500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r.conv_id: r for r in repair_conversations(table).collect()}
    assert len(got) == len({r[0] for r in rows}) and len(got[7].audit.replace("I", "")) == 500
    small = [r for r in rows if r[0] != 7]
    by = {}
    for conv, *row in small:
        by.setdefault(conv, []).append(tuple(row))
    assert all(tuple(got[c])[1:] == plain(ordered(own)) for c, own in by.items())


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (*range(8), None)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if kind == 4 else role or " "), ("" if kind == 1 else re.sub("[.!?]", "", text or " ") if kind == 2 else text or " ")
        want += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    damaged = damage(table)
    assert sorted(map(tuple, damaged.collect()), key=str) == sorted(want, key=str)
    got = {r.conv_id: r for r in repair_conversations(damaged, table).collect()}
    assert set(got) == {r[0] for r in rows}
    lost = set(got) - {r[0] for r in want}
    for c in lost:
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_conversations_without_rows_are_reported(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "conv_id long")
    got = {r.conv_id: r for r in repair_conversations(rows, ids).collect()}
    assert set(got) == {1, 2, None} and got[1].audit == "KI"
    assert (got[2].gaps, got[2].cost, got[2].audit, got[2].repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("parts", [1, 5])
def test_words_that_many_share_are_dealt_out(spark, parts):
    words = spark.range(400).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, "auau").otherwise(F.concat(F.lit("au"), F.repeat(F.lit("-"), (F.col("id") % 5).cast("int")))).alias("reverse"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.conv_id: (r.cost, r.audit) for r in conversations.audits(words).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == 400 and got[0] == (0, "KKKK") and got[1] == (3, "DKK") and got[10] == (0, "KK")
