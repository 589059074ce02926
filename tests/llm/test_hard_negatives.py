"""Hard negatives against all inner products, with odd rows, and what the tree prunes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklogs.llm import hard_negatives
from sparklogs.llm.hard_negatives import LEAF, Asked, Tree, mine_negatives, page_order

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    valid = [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, c, q in valid:
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v)), i, d) for i, d, v in valid if len(v) == len(q)]
        for s, p, _ in sorted(x for x in scores if x[2] == c and x[1] != a)[:positives]:
            fits = sorted(x for x in scores if x[2] != c and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(table, **more):
    return sorted(map(tuple, mine_negatives(table, F.col("vec_id") % 100 == 0, **more).collect()))


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = x * 0.1 + rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)]
    return x.astype(np.float32)


@pytest.mark.parametrize("clusters", [0, 12])
def test_like_all_inner_products(spark, monkeypatch, clusters):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 300)  # several slabs of both coordinates
    x = vectors(1500, 8, 3, clusters)
    rows = [(i, i % 4, [float(v) for v in x[i]]) for i in range(1500)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) > 400
    assert mined(table) == want
    assert mined(table, block_rows=4) == want  # several blocks of anchors


def test_bounds_of_a_pilot_change_nothing(spark, monkeypatch):
    x = vectors(900, 6, 8)
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(900)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "PILOT", 1)
    assert mined(table) == brute(rows)


def test_one_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 100)
    x = vectors(900, 5, 4)
    rows = [(i, i % 5, [0.5, -0.25, 0.125, 1.0, 0.0] if i % 3 == 0 else [float(v) for v in x[i]]) for i in range(900)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 1, [1.0, 1.0]), (3, 2, [0.5, 0.5]), (4, 2, [0.5, 0.5]), (4, 2, [0.5, 0.5]), (5, 3, [1.0, 0.0]), (None, 2, [0.5, 0.5]), (6, None, [0.5, 0.5]),
        (7, 2, None), (8, 2, [0.5, None]), (9, 2, [nan, 0.5]), (10, 2, [inf, 0.5]), (11, 2, [0.5]), (12, 1, [0.5, 0.5, 0.5]), (13, 2, []), (100, 9, [3.0, 1.0]), (200, 1, [0.0, 0.0]), (200, 1, [0.0, 0.0]), (300, 4, []),
        (301, 4, []), (400, 2, [-1.0, -1.0]), (500, 1, [1e30, 2.0]), (501, 1, [1e30, 0.0]), (502, 3, [1e-3, 0.0]),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", asked string, rank string").repartition(2)
    got, most = mined(table), 2**63 - 1
    clip = lambda s: max(min(s, most), -most)
    want = [r for r in brute(rows) if abs(r[4]) <= most]
    assert [r for r in got if abs(r[4]) < most] == sorted((*r[:4], clip(r[4]), clip(r[5])) for r in want)
    assert mined(table.limit(0)) == [] and mined(table.where("vec_id % 100 <> 0")) == [] and mined(table.where("vec_id in (0, 3)")) == []


def test_pages_hold_all_rows_once():
    x = vectors(1000, 4, 1).astype(float)
    pages = page_order(x)
    assert sorted(np.concatenate(pages).tolist()) == list(range(1000)) and max(map(len, pages)) <= LEAF
    # tiles are narrower than the whole in the coordinates that were cut
    width = np.mean([np.ptp(x[p], axis=0) for p in pages], axis=0) / np.ptp(x, axis=0)
    assert sorted(width)[0] < 0.6


def test_boxes_are_pruned_where_vectors_gather():
    from sparklogs.llm.hard_negatives import _leaf_rows

    x = np.floor(256 * vectors(4000, 3, 9, clusters=40).astype(float))
    ids, labels = np.arange(4000), np.arange(4000) % 2
    leaves = [r for b in _leaf_rows([(x, ids, labels, np.zeros(4000, bool))]) for r in b.to_pylist()]
    one = np.full((1, 1), np.iinfo(np.int64).min)
    asked = Asked(x[:1], ids[:1], labels[:1], one, np.full((1, 1), np.iinfo(np.int64).max), one, 5, True)
    asked.search(Tree(leaves))
    score = x @ x[0]
    want = sorted((-int(score[i]), int(i)) for i in range(1, 4000) if labels[i] == labels[0])[:5]
    assert sorted(zip((-asked.held[1]).tolist(), asked.held[2].tolist())) == want
    assert asked.visited < len(leaves) / 2
