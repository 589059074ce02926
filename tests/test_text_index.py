"""Block search against plain scoring of all pairs, with small blocks, many sets of queries, ties and odd texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparklogs.operators import retrieval, text_index
from sparklogs.plans import eval_queries

WORDS = ["alpha", "beta", "gamma", "delta", "the", "a", "of", "x1", "é", "中文"]


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = None if i % 17 == 0 else " ".join(rng.choices(WORDS, [1, 1, 2, 3, 40, 30, 20, 1, 1, 1], k=rng.choice([0, 1, 5, 30]))) + rng.choice(["", ".", " -- "])
        out.append((f"c{i:03}", text, f"svc-{i % 3}", "ERROR" if i % 4 == 0 else None))
    return out


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bm25(queries, rows, k):
    docs = {c: split(t) for c, t, *_ in rows}
    sized = [w for w in docs.values() if w]
    n, mean = len(sized), sum(map(len, sized)) / len(sized)
    df = Counter(w for words in sized for w in set(words))
    out = {}
    for q, text in queries:
        scores = []
        for c, words in docs.items():
            tf = Counter(words)
            hit = [w for w in set(split(text)) if tf[w]]
            if hit:
                s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w in hit)
                scores.append((-round(s, 9), c))
        out |= {(q, i): (c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])}
    return out


QUERIES = [(1, "alpha the beta"), (2, "THE of a"), (3, "x1, é!"), (4, ""), (5, " ?? "), (6, "nothing here"), (7, "中文 the the the"), (8, None), (9, "the alpha beta gamma delta of a x1")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(rows_of(200, 1), "chunk_id string, text string, source_service string, log_level string").repartition(3)


@pytest.mark.parametrize(("rows", "asked"), [(512, 4096), (7, 4096), (16, 2)])
def test_bm25_like_all_pairs(spark, chunks, monkeypatch, rows, asked):
    monkeypatch.setattr(text_index, "BLOCK_ROWS", rows)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", asked)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    want = bm25(QUERIES, rows_of(200, 1), 6)
    stored = text_index.text_blocks(chunks)
    for found in (retrieval.bm25_topk(queries, chunks, 6), retrieval.bm25_topk(queries, None, 6, stored)):
        got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in found.collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
    assert retrieval.bm25_topk(queries.limit(0), chunks).count() == 0
    assert retrieval.bm25_topk(queries, chunks.limit(0)).count() == 0


def test_few_chunks_are_scored():
    """With one rare word, chunks that hold only frequent ones are passed over once k chunks are known."""
    rng = np.random.default_rng(2)
    asked = pa.array(["rare", "the", "of"])
    docs = [[("the" if rng.random() < 0.9 else "of") for _ in range(30)] + (["rare"] if i % 50 == 0 else []) for i in range(2000)]
    df = np.array([40, 2000, 1990])
    search = text_index.Bm25([np.array([0, 1, 2])], np.log1p((2000 - df + 0.5) / (df + 0.5)), 30.0, 5)
    for at in range(0, 2000, 100):
        part = docs[at : at + 100]
        terms = sorted({w for d in part for w in d})
        places, starts, first = {w: [] for w in terms}, [0], [0]
        for d in part:
            for i, w in enumerate(d):
                places[w].append(starts[-1] + i)
            starts.append(starts[-1] + len(d) + 1)
        for w in terms:
            first.append(first[-1] + len(places[w]))
        row = {
            "docs": [f"c{at + i:04}" for i in range(100)], "sizes": list(map(len, part)), "terms": terms, "starts": starts, "first": first, "places": sum(places.values(), []),
            "most": [max(d.count(w) for d in part) for w in terms], "least": [min(len(d) for d in part if w in d) for w in terms],
        }
        search.add(text_index.Block(pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}), 0, asked))
    assert search.scored < 2000 * 0.2 and all(int(name[1:]) % 50 == 0 for name in search.best.held[0][1])


def web(query, rows, k):
    """Scores by looking at every run of words of every field."""
    pieces = re.findall(r'-?"[^"]*"|[^\s"]+', query or "")
    clauses, excluded, last_or, n = [], [], False, 0
    for p in pieces:
        if p.lower() == "or":
            last_or = True
            continue
        no, words = p.startswith("-"), split(p)
        if not (last_or and not no):
            n += 1
        last_or = False
        if words:
            (excluded if no else clauses).append((n, words))
    scores = []
    for c, text, service, level in rows:
        found, score, bad = set(), 0.0, False
        for field, weight in ((text, 1.0), (service, 0.4), (level, 0.2)):
            have = split(field)
            count = lambda w, have=have: sum(have[i : i + len(w)] == w for i in range(len(have) - len(w) + 1))
            for n_, words in clauses:
                if times := count(words):
                    found.add(n_)
                    score += times * weight
            bad |= any(count(w) for _, w in excluded)
        if found and found == {n_ for n_, _ in clauses} and not bad:
            scores.append((-round(score, 9), c))
    return [(c, -s) for s, c in sorted(scores)[:k]]


WEB = ["alpha the", '"the a" or beta', '"of the of" -gamma', "error alpha", '"svc 1" the', 'x1 or é or "the the the" -"a of"', "-the", "", "missing the", '"the" "a"', "of or of", "OR the", 'svc -"error"', "中文 or gamma"]


@pytest.mark.parametrize(("rows", "asked"), [(512, 4096), (11, 3)])
def test_web_search_like_every_run(spark, chunks, monkeypatch, rows, asked):
    monkeypatch.setattr(text_index, "BLOCK_ROWS", rows)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", asked)
    queries = spark.createDataFrame(list(enumerate(WEB)), "query_id long, query string")
    stored = text_index.text_blocks(chunks)
    for found in (retrieval.fts_topk(queries, chunks, 9), retrieval.fts_topk(queries, None, 9, stored)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
        for i, q in enumerate(WEB):
            assert got.get(i, []) == [(c, round(s, 9)) for c, s in web(q, rows_of(200, 1), 9)], q
    assert retrieval.fts_topk(queries.limit(0), chunks).count() == 0


def test_blocks_hold_every_word_once(spark, chunks, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_WORDS", 40)
    blocks = text_index.text_blocks(chunks, ("text", "source_service")).collect()
    texts = {c: (t, s) for c, t, s, _ in rows_of(200, 1)}
    assert sorted(c for b in blocks for c in b.docs) == sorted(texts)
    for b in blocks:
        n = len(b.docs)
        line = {}
        for k, term in enumerate(b.terms):
            for p in b.places[b.first[k] : b.first[k + 1]]:
                line[p] = term
        for f in range(2):
            for i, c in enumerate(b.docs):
                a, z = b.starts[f * n + i], b.starts[f * n + i + 1] - 1
                assert [line.pop(p) for p in range(a, z)] == split(texts[c][f])
        assert not line and [b.sizes[i] for i in range(n)] == [len(split(texts[c][0])) for c in b.docs]


def test_integer_ids_and_ties(spark):
    rows = spark.createDataFrame([(i, "same words") for i in (9, 10, 2, 33)], "chunk_id long, text string")
    asked = spark.createDataFrame([("q", "words")], "query_id string, query string")
    assert [r.chunk_id for r in retrieval.bm25_topk(asked, rows, 3).orderBy("rank").collect()] == [2, 9, 10]
    assert retrieval.bm25_topk(asked, rows, 3).where(F.col("score") > 0).count() == 3
    narrow = rows.withColumn("chunk_id", F.col("chunk_id").cast("int"))
    assert [r.chunk_id for r in retrieval.bm25_topk(asked, narrow, 3).orderBy("rank").collect()] == [2, 9, 10]
    vectors = narrow.select("chunk_id", F.array(F.col("chunk_id").cast("float")).alias("embedding"))
    one = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>")
    for stored in (None, retrieval.vector_cells(vectors)):
        assert [r.chunk_id for r in retrieval.vector_topk(one, vectors, 2, stored).orderBy("rank").collect()] == [33, 10]


def test_stored_blocks_are_read_one_at_a_time(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text_index, "BLOCK_ROWS", 10)
    monkeypatch.setattr(eval_queries, "scratch", lambda *_: f"file://{tmp_path}/blocks")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        found = eval_queries.bm25_stored(spark, "/root/testdata/sf0.001").collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    files = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / "blocks").glob("*.parquet"))]
    assert max(m.num_rows for m in files) > 1  # else a file has one group anyway
    assert all(m.row_group(k).num_rows == 1 for m in files for k in range(m.num_row_groups))
    assert sorted(found) == sorted(eval_queries.bm25_topk(spark, "/root/testdata/sf0.001").collect())
