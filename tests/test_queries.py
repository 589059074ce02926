"""Registered queries against their oracles on the smallest tables."""

import math
import random
import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparklogs.plans.all_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: At this size fewer chunks hold an identifier than the search returns, so similar ones, which SQL does not rank, follow.
NEEDS_MORE_ROWS = {"find_by_id"}


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "NaT":
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return round(x, 6)
    return repr([plain(y) for y in x]) if isinstance(x, list | tuple) else str(x) if hasattr(x, "isoformat") else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - NEEDS_MORE_ROWS))
def test_query_matches_its_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _slow_similarity(query, text):
    """The share of common trigrams of a query and the best run of trigrams of a text, run by run."""

    def grams(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return [p[i : i + 3] for p in (f"  {w} " for w in words) for i in range(len(p) - 2)]

    want, line = set(grams(query)), grams(text)
    best = 0.0
    for i in range(len(line)):
        for j in range(i + 1, len(line) + 1):
            run = set(line[i:j])
            best = max(best, len(run & want) / len(run | want))
    return best


def test_similar_words_like_brute_force():
    from sparklogs.operators.retrieval import word_similarity

    rng = random.Random(3)
    words = ["order-12", "ordre-12", "payment", "pay ment", "x", "12", "a_b", "Gateway", "gate"]
    for _ in range(300):
        query, text = " ".join(rng.sample(words, rng.randint(1, 2))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        assert word_similarity(query, text) == pytest.approx(_slow_similarity(query, text))


def test_identifiers_and_words_like_them_like_brute_force(spark):
    from sparklogs.operators.retrieval import find_by_id

    rng = random.Random(4)
    parts = ["order-17", "order-18", "odrer-17", "req_9f", "svc pay", "svcpay", "é-1", "x", "17", "pay%ment", "payXment", "über"]
    texts = {f"c{i}": " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for i in range(60)}
    entities = ["order-17", "der-1", "pay_ment", "x", "17", "Order-1", "req_9f", "nothing", "svc p", "%", "é-1", "ÜBER", "--"]
    chunks = spark.createDataFrame([(c, t, datetime(2026, 1, 1)) for c, t in texts.items()], "chunk_id string, text string, timestamp_start timestamp")
    asked = spark.createDataFrame([(i, e) for i, e in enumerate(entities)] + [(99, None), (98, "")], "query_id int, entity string")
    got = {(r.query_id, r.chunk_id, round(r.similarity, 6)) for r in find_by_id(asked, chunks, 1000).collect()}
    want = set()
    for i, e in enumerate(entities):
        pattern = re.compile(re.escape(e).replace("%", ".*").replace("_", "."), re.IGNORECASE)
        for c, t in texts.items():
            s = 1.0 if pattern.search(t) else _slow_similarity(e, t)
            if s >= 0.6:
                want.add((i, c, round(s, 6)))
    assert got == want


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_vectors_like_brute_force_in_blocks(spark, monkeypatch, block):
    from sparklogs.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = random.Random(5)
    vectors = [(f"v{i:03}", [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(90)]
    queries = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(20)]
    made = [spark.createDataFrame(rows, f"{name}, embedding array<float>").repartition(3) for rows, name in ((queries, "query_id long"), ([*vectors, ("none", None)], "chunk_id string"))]
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieval.vector_topk(*made, 5).collect()}
    for i, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), c) for c, v in vectors)[:5]
        assert [got[i, k] for k in range(5)] == [(c, -s) for s, c in scored]
    assert retrieval.vector_topk(made[0].limit(0), made[1], 5).count() == 0


@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_search_diverse"])
def test_hybrid_search_asks_with_whole_texts(spark, monkeypatch, name):
    from sparklogs.operators import retrieval

    asked = {}

    def note(queries, chunks):
        asked["queries"] = queries
        return queries.select("query_id", F.lit("c").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"), F.lit(1).alias("place"))

    monkeypatch.setattr(retrieval, name, note)
    QUERIES[name](spark, DATA)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {r.query_id: r["query"] for r in asked["queries"].collect()} == texts
