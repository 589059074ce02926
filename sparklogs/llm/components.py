"""Connected components of a graph of links, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklogs.llm.common import forget, written


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) for every node of the links (a, b); both are longs.

    Alternates the large-star and small-star steps, which end with every node linked to the least of its component after
    about a logarithmic number of rounds; if ``rounds`` were not enough, that is an error. Links are made distinct
    before each step, so a step's rows never exceed twice the links; each round is written to the shared folder, and the
    one before is deleted.
    """
    pairs = written(_tidy(links), "links")
    mark, done = _mark(pairs), 0
    while mark[0]:
        if done == rounds:
            raise RuntimeError(f"components not finished after {rounds} rounds")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = written(_tidy(large), "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        linked = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        before, last = mark, pairs
        pairs = written(_tidy(linked), "links")
        mark, done = _mark(pairs), done + 1
        forget(last, large)
        if mark == before:
            break
    nodes = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
