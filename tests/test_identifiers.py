"""Identifier search against all pairs: stored and scanned, in many sets, with odd texts and real documents."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparklogs.operators import identifiers
from sparklogs.operators.identifiers import Entity, find_by_id, fixed_trigrams, gram_blocks, gram_table, trigrams, word_similarity

DATA = "/root/testdata/sf0.001"


def test_gram_table_like_plain_trigrams():
    texts = ["Order-17 failed", None, "", "x", "ÄÖ 中文 ab", "a\x00b", "İstanbul ΣΑΣ", "x" * 200, "--"]
    grams, first, docs = gram_table(texts)
    got = {(int(g), int(d)) for k, g in enumerate(grams) for d in docs[first[k] : first[k + 1]]}
    assert got == {(identifiers._code(g), i) for i, t in enumerate(texts) for g in trigrams((t or "").replace("\x00", " "))}
    few, first, docs = gram_table(texts, grams[::3])
    assert few.tolist() == grams[::3].tolist() and len(gram_table([None, ""])[0]) == 0 and len(gram_table(texts, grams[:0])[0]) == 0


def test_what_holds_an_identifier_has_its_fixed_trigrams():
    rng = random.Random(6)
    parts = ["order", "-", "17", "_", "%", " ", ".", "É", "x", "req"]
    for _ in range(3000):
        name = "".join(rng.choices(parts, k=rng.randint(1, 4)))
        text = "".join(rng.choices(parts, k=rng.randint(0, 3))) + name.replace("%", rng.choice(["", "zz", "-q"])).replace("_", rng.choice("-z ")) + "".join(rng.choices(parts, k=rng.randint(0, 3)))
        if name:
            assert Entity.of(name, 0.6).held_in(text) and fixed_trigrams(name) <= set(trigrams(text))


def brute(entities, rows, k, least=0.6):
    out = {}
    for q, e in entities:
        if e:
            own = [(-Entity.of(e, least).similarity(t), at is not None, -(at.timestamp() if at else 0), c) for c, t, at in rows if t is not None]
            out[q] = [(c, round(-s, 9)) for s, _, _, c in sorted(x for x in own if -x[0] >= least)[:k]]
    return {q: own for q, own in out.items() if own}


@pytest.mark.parametrize(("block", "at_once"), [(2048, 4096), (5, 3)])
def test_like_all_pairs(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(identifiers, "BLOCK_ROWS", block)
    monkeypatch.setattr(identifiers, "ASKED_AT_ONCE", at_once)
    rng = random.Random(8)
    parts = ["order-17", "order-18", "odrer-17", "req_9f", "svc pay", "svcpay", "é-1", "x", "17", "pay%ment", "payXment", "back\\slash", "ORDER-177"]
    rows = [(f"c{i:03}", None if i % 23 == 0 else " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), None if i % 9 == 0 else datetime(2026, 1, 1) + timedelta(hours=i % 13)) for i in range(150)]
    entities = list(enumerate(["order-17", "der-1", "pay_ment", "x", "17", "Order-1", "req_9f", "nothing", "svc p", "%", "é-1", "--", "k\\s", "odrer 17", "svcpy"])) + [(98, ""), (99, None), (97, "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, timestamp_start timestamp").repartition(3)
    asked = spark.createDataFrame(entities, "query_id int, entity string")
    want = brute(entities, rows, 7)
    for stored in (None, gram_blocks(chunks)):
        got = {}
        for r in find_by_id(asked, chunks, 7, stored=stored).orderBy("query_id", "place").collect():
            assert r.place == len(got.setdefault(r.query_id, [])) + 1
            got[r.query_id].append((r.chunk_id, round(r.similarity, 9)))
        assert got == want
    assert find_by_id(asked.limit(0), chunks).count() == 0 and find_by_id(asked, chunks.limit(0)).count() == 0


def test_misspelled_words_of_documents_like_all_pairs(spark):
    """Similarities below one on whole real texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.lit(datetime(2026, 1, 1)).alias("timestamp_start"))
    rows = [(r.chunk_id, r.text, r.timestamp_start) for r in docs.collect()]
    words = [w.strip(".,") for _, t, _ in rows[:40] for w in t.split()[3:4]]
    entities = [(i, w[:2] + w[3:4] + w[2:3] + w[4:]) for i, w in enumerate(words) if len(w) > 6][:12]
    want = brute(entities, rows, 20, 0.4)
    assert sum(s < 1 for own in want.values() for _, s in own) > 20
    got = {}
    for r in find_by_id(spark.createDataFrame(entities, "query_id int, entity string"), docs, 20, 0.4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.similarity, 9)))
    assert got == want


def test_the_chunk_table_is_read_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("timestamp").alias("timestamp_start"))
    plan = find_by_id(spark.createDataFrame([(1, "abc-1"), (2, "x")], "query_id int, entity string"), docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_word_similarity_of_a_part_of_a_word():
    assert word_similarity("order", "an order came") == 1.0 and word_similarity("ordre", "an order came") < 1
