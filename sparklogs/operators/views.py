"""Views over ranked hits: clusters, timelines, bursts, diversification, follow-ups and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.functions.parsing import extract_signature


def _gaps(rows: DataFrame, keys: list[str], order: list[Column], opens: Column, name: str) -> DataFrame:
    """Number the islands of rows: ``opens`` is true where one begins; the first row of a key begins island 0."""
    own = Window.partitionBy(*keys).orderBy(*order)
    begin = F.when(F.row_number().over(own) == 1, False).otherwise(opens)
    return rows.withColumn("_begin", begin.cast("int")).withColumn(name, F.sum("_begin").over(own)).drop("_begin")


def cluster_chunks(hits: DataFrame, min_count: int = 2) -> DataFrame:
    """query_id, signature, n, services, first_ts, last_ts of hits grouped by the signature in their text."""
    rows = hits.withColumn("signature", extract_signature(F.col("text"))).where("signature <> ''")
    groups = rows.groupBy("query_id", "signature").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("source_service")).alias("services"), F.min("timestamp_start").alias("first_ts"), F.max("timestamp_start").alias("last_ts")
    )
    return groups.where(F.col("n") >= min_count)


def build_timeline(hits: DataFrame) -> DataFrame:
    """Runs of equal (service, level, signature) of each query in time order; hits without time or signature are skipped
    and break no run."""
    rows = hits.withColumn("signature", extract_signature(F.col("text"))).where("signature <> '' and timestamp_start is not null")
    rows = rows.select("query_id", "chunk_id", F.col("source_service").alias("service"), F.col("log_level").alias("level"), "signature", "timestamp_start")
    order = [F.col("timestamp_start"), F.col("chunk_id")]
    own = Window.partitionBy("query_id").orderBy(*order)
    what = F.struct("service", "level", "signature")
    runs = _gaps(rows, ["query_id"], order, ~what.eqNullSafe(F.lag(what).over(own)), "run")
    return runs.groupBy("query_id", "run", "service", "level", "signature").agg(
        F.min("timestamp_start").alias("first_ts"), F.max("timestamp_start").alias("last_ts"), F.count("*").alias("repeat_count")
    )


def densest_burst(hits: DataFrame, gap_seconds: int = 120, k: int = 5) -> DataFrame:
    """The first k hits of the largest group of each query without a gap over ``gap_seconds``; the earliest of equal ones."""
    rows, order = hits.where("timestamp_start is not null"), [F.col("timestamp_start"), F.col("chunk_id")]
    own = Window.partitionBy("query_id").orderBy(*order)
    far = F.unix_micros("timestamp_start") - F.unix_micros(F.lag("timestamp_start").over(own)) > gap_seconds * 1_000_000
    grouped = _gaps(rows, ["query_id"], order, far, "burst")
    size = F.count("*").over(Window.partitionBy("query_id", "burst"))
    place = F.row_number().over(Window.partitionBy("query_id", "burst").orderBy(*order))
    ranked = grouped.withColumns({"_size": size, "place": place})
    best = F.max(F.struct("_size", -F.col("burst"))).over(Window.partitionBy("query_id"))
    return ranked.where((F.col("place") <= k)).withColumn("_best", best).where((F.col("_size") == F.col("_best")[F.lit("_size")]) & (-F.col("burst") == F.col("_best")[F.lit("col2")])).drop("_best", "_size", "burst")


def diversify(hits: DataFrame, k: int = 10, cap_ratio: float = 0.4) -> DataFrame:
    """The first k hits of each query, with at most ``ceil(k * cap_ratio)`` of one service as long as others can fill up.

    Hits that exceed their service's share come after all that do not, in rank order; ``place`` counts from 1. Missing
    and empty services count as one.
    """
    cap = max(1, -int(-k * cap_ratio // 1))
    service = F.coalesce(F.nullif("source_service", F.lit("")), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("query_id", "_service").orderBy("rank", "chunk_id"))
    rows = hits.withColumn("_service", service).withColumn("_over", (nth > cap) if k > 1 else F.lit(False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_over", "rank", "chunk_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("_service", "_over")


def merge_entity_hits(hits: DataFrame, entity_hits: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Hybrid hits, then up to k entity hits (score 0) of each query that are not among them, with a confidence.

    ``queries`` has query_id and entities. Confidence is low without hits, or if there are entities and none of them
    stands in a hit's text; medium otherwise. A query without hits gives one row without a chunk.
    """
    first = hits.select("query_id", "chunk_id", "text", "score", "rank", F.lit(0).alias("source"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    more = entity_hits.withColumn("_n", place).where(F.col("_n") <= k).select("query_id", "chunk_id", "text", F.lit(0.0).alias("score"), "rank", F.lit(1).alias("source"))
    both = first.unionByName(more)
    once = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("source", "rank"))
    merged = both.withColumn("_n", once).where("_n = 1").drop("_n")
    rows = queries.select("query_id", "entities").join(merged, "query_id", "left")
    named = F.exists("entities", lambda e: F.lower("text").contains(F.lower(e)))
    literal = F.max(F.coalesce(named, F.lit(False))).over(Window.partitionBy("query_id"))
    low = F.col("chunk_id").isNull() | ((F.size("entities") > 0) & ~literal)
    return rows.withColumn("confidence", F.when(low, "low").otherwise("medium")).drop("entities")


def followup_bias(cited: DataFrame, pad_minutes: int = 5, dominance: float = 2.0) -> DataFrame:
    """query_id, service, time_from, time_to from the chunks that the previous turn cited.

    A service is pinned if it is the only one or is cited ``dominance`` times as often as the next.
    """
    counts = cited.where("source_service is not null").groupBy("query_id", "source_service").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy("query_id").orderBy(F.desc("n"), "source_service")
    top = counts.withColumns({"_place": F.row_number().over(by_count), "_next": F.lead("n").over(by_count)}).where("_place = 1")
    pinned = top.where(F.col("_next").isNull() | (F.col("n") >= dominance * F.col("_next"))).select("query_id", F.col("source_service").alias("service"))
    pad = F.make_dt_interval(mins=F.lit(pad_minutes))
    times = cited.groupBy("query_id").agg((F.min("timestamp_start") - pad).alias("time_from"), (F.max("timestamp_start") + pad).alias("time_to"))
    return times.join(pinned, "query_id", "left")


def fill_filters(queries: DataFrame, bias: DataFrame) -> DataFrame:
    """Blank service and times of queries come from the bias; what a query states stays."""
    told = bias.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("service", "time_from", "time_to")])
    rows = queries.join(told, "query_id", "left")
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in ("service", "time_from", "time_to")}).drop("_service", "_time_from", "_time_to")


def transcripts(messages: DataFrame, investigations: DataFrame, conversations: DataFrame, projects: DataFrame) -> DataFrame:
    """Chat turns and investigations of each conversation in one table, with mode, place in time order and project name."""
    text = lambda: F.lit(None).cast("string")
    chat = messages.select("conversation_id", "created_at", F.lit("chat").alias("mode"), "role", "content", text().alias("investigation_id"), text().alias("status"))
    work = investigations.select("conversation_id", "created_at", F.lit("investigation").alias("mode"), text().alias("role"), F.col("query").alias("content"), "investigation_id", "status")
    both = chat.unionByName(work)
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "mode", F.asc_nulls_first("investigation_id"), "role", "content"))
    named = conversations.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left").select("conversation_id", "title", "project_name")
    return both.join(named, "conversation_id", "left").withColumn("place", place)
