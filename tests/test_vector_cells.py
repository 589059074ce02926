"""Vector search in cells against all inner products: stored and not, in one or many blocks, gathered and odd vectors."""

import numpy as np
import pytest

from sparklogs.operators import retrieval
from sparklogs.operators.retrieval import vector_cells, vector_topk


def brute(queries, vectors, k):
    out = {}
    for q, e in queries:
        if e is not None:
            best = sorted((-round(float(np.dot(np.float32(e).astype(float), np.float32(v).astype(float))), 9), c) for c, v in vectors if v is not None)[:k]
            out |= {(q, i): (c, -s) for i, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize(("block", "rows", "clusters"), [(4096, 1024, 0), (16, 20, 6), (16, 20, 0)])
def test_like_all_inner_products(spark, monkeypatch, block, rows, clusters):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "CELL_ROWS", rows)
    monkeypatch.setattr(retrieval, "PIVOTS", 12)
    monkeypatch.setattr(retrieval, "PIVOT_ROWS", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)) * (0.05 if clusters else 1) + (rng.normal(size=(6, 5))[rng.integers(0, 6, 600)] if clusters else 0)
    x[:200] = x[0]  # one vector that a third of the rows share
    vectors = [(f"v{i:03}", [float(v) for v in x[i]]) for i in range(600)] + [("none", None)]
    queries = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(50)] + [(99, None)]
    table = spark.createDataFrame(vectors, "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(2)
    want = brute([(q, e) for q, e in queries], vectors, 7)
    for stored in (None, vector_cells(table)):
        got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in vector_topk(asked, table if stored is None else None, 7, stored).collect()}
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] or abs(got[x][1] - want[x][1]) < 1e-7 for x in want)
    assert vector_topk(asked.limit(0), None, 7, vector_cells(table)).count() == 0
    assert vector_topk(asked, table.limit(0), 7).count() == 0


def test_cells_hold_all_rows_and_reach_them(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELL_ROWS", 30)
    x = np.random.default_rng(5).normal(size=(200, 3)).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)], "chunk_id long, embedding array<float>")
    cells = vector_cells(table).collect()
    assert sorted(d for c in cells for d in c.docs) == list(range(200)) and max(len(c.docs) for c in cells) <= 30
    for c in cells:
        assert np.allclose(np.reshape(c.vectors, (-1, 3)), x[c.docs])
        assert np.sqrt(((x[c.docs] - np.array(c.centre)) ** 2).sum(axis=1)).max() <= c.radius + 1e-5
