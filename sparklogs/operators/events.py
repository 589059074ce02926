"""The event feed: bucket counts of a window and the rules that turn them into events.

Everything after ``window_aggregates`` works on at most ``n`` rows per service, signature and level.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Level classes, kinds in order of priority, and rule thresholds.
ERROR_CLASS = ("ERROR", "CRITICAL", "FATAL", "WARN", "WARNING")
KINDS = ("health_degraded", "new_pattern", "begins", "spike", "health_recovered", "subsides")
SEVERITY = {"FATAL": 3, "CRITICAL": 3, "ERROR": 2, "WARNING": 1, "WARN": 1}
BEGINS_MIN, SPIKE_MIN, SPIKE_RATIO, SUBSIDE_MIN, QUIET_BUCKETS = 3, 5, 3.0, 5, 2
HEALTH_MIN, DEGRADED_SHARE, RECOVERED_SHARE = 10, 0.5, 0.25
MAX_EVENTS = 25
N_BUCKETS = 24


def micros(ts: Column | datetime) -> Column:
    return F.unix_micros((F.lit(ts) if isinstance(ts, datetime) else ts).cast("timestamp"))


def in_window(chunks: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Chunks that start in [start, end); the bounds reach the scan."""
    return chunks.where((F.col("timestamp_start") >= F.lit(start)) & (F.col("timestamp_start") < F.lit(end)))


def window_aggregates(chunks: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS, service: str | None = None) -> DataFrame:
    """service, signature, level, bucket (1 to n), n: counts in [start, end) of chunks with a signature."""
    rows = in_window(chunks, start, end).where("signature is not null and signature <> ''")
    if service is not None:
        rows = rows.where(F.col("source_service") == service)
    passed = (micros(F.col("timestamp_start")) - micros(start)) * n
    bucket = (F.call_function("div", passed, micros(end) - micros(start)) + 1).cast("int")
    return rows.groupBy(
        F.col("source_service").alias("service"), "signature", F.upper("log_level").alias("level"), bucket.alias("bucket")
    ).agg(F.count("*").alias("n"))


def first_seen(chunks: DataFrame, buckets: DataFrame) -> DataFrame:
    """signature, first_ever: the earliest chunk of each signature in ``buckets``, over all of ``chunks``."""
    asked = buckets.select("signature").distinct()
    return chunks.join(asked, "signature", "left_semi").groupBy("signature").agg(F.min("timestamp_start").alias("first_ever"))


def _rank(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[level], F.lit(0))


def error_series(buckets: DataFrame) -> DataFrame:
    """service, signature, level, bucket, n of error-class rows; level is the most severe one of the series."""
    rows = buckets.where(F.col("level").isin(*ERROR_CLASS))
    series = Window.partitionBy("service", "signature")
    worst = F.max(F.struct(_rank(F.col("level")), F.col("level"))).over(series)["level"]
    per = rows.withColumn("level", worst).groupBy("service", "signature", "level", "bucket")
    return per.agg(F.sum("n").alias("n"))


def bucket_time(start: datetime, end: datetime, n: int, bucket: Column) -> Column:
    """Where bucket number ``bucket`` begins, 0-based: its end is that of the next."""
    return F.timestamp_micros(micros(start) + F.call_function("div", (micros(end) - micros(start)) * bucket, F.lit(n)))


def _event(kind: str, ts: Column, title: Column, count: Column, signature: Column | None = None, level: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("kind"), ts.alias("ts"), F.col("service"), (F.col("signature") if signature is None else signature).alias("signature"),
        (F.col("level") if level is None else level).alias("level"), title.alias("title"), count.cast("long").alias("count"),
    ]


def events_new_begins(series: DataFrame, seen: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS) -> DataFrame:
    """new_pattern for a series first ever seen in the window; begins for an older one that starts after bucket 1 with 3 or more."""
    first = series.groupBy("service", "signature", "level").agg(F.min(F.struct("bucket", "n")).alias("f")).select("service", "signature", "level", "f.*")
    rows = first.join(seen, "signature", "left")
    new = F.coalesce(F.col("first_ever") >= F.lit(start), F.lit(False))
    begins = (F.col("bucket") > 1) & (F.col("n") >= BEGINS_MIN)
    kind = F.when(new, "new_pattern").when(begins, "begins")
    event = _event("", bucket_time(start, end, n, F.col("bucket") - 1), F.col("signature"), F.col("n"))
    return rows.withColumn("k", kind).where("k is not null").select(F.col("k").alias("kind"), *event[1:])


def events_spike(series: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS) -> DataFrame:
    """The largest bucket, not the first, with 5 or more and three times the mean of the active ones before it."""
    own = Window.partitionBy("service", "signature").orderBy("bucket")
    rows = series.withColumn("before", F.avg("n").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.where((F.col("n") >= SPIKE_MIN) & (F.col("n") >= SPIKE_RATIO * F.col("before")))
    best = found.groupBy("service", "signature", "level").agg(F.min(F.struct((-F.col("n")).alias("less"), "bucket")).alias("b"))
    best = best.select("service", "signature", "level", (-F.col("b.less")).alias("n"), F.col("b.bucket").alias("bucket"))
    return best.select(*_event("spike", bucket_time(start, end, n, F.col("bucket") - 1), F.concat("signature", F.lit(" (×"), F.col("n").cast("string"), F.lit(")")), F.col("n")))


def events_subside(series: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS) -> DataFrame:
    """A series of 5 or more that is quiet for the last two buckets, stamped at the end of its last one."""
    rows = series.groupBy("service", "signature", "level").agg(F.sum("n").alias("total"), F.max("bucket").alias("bucket"))
    quiet = rows.where((F.col("total") >= SUBSIDE_MIN) & (F.col("bucket") <= n - QUIET_BUCKETS))
    return quiet.select(*_event("subsides", bucket_time(start, end, n, F.col("bucket")), F.col("signature"), F.lit(0)))


def events_health(buckets: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS) -> DataFrame:
    """A service degrades when half of a bucket's rows are errors and recovers at a quarter; small buckets say nothing."""
    errors = F.sum(F.when(F.col("level").isin(*ERROR_CLASS), F.col("n")).otherwise(0))
    rows = buckets.groupBy("service", "bucket").agg(F.sum("n").alias("total"), errors.alias("errors")).where(F.col("total") >= HEALTH_MIN)
    share = F.col("errors") / F.col("total")
    marked = rows.withColumn("bad", F.when(share >= DEGRADED_SHARE, True).when(share <= RECOVERED_SHARE, False)).where("bad is not null")
    turned = marked.withColumn("was", F.coalesce(F.lag("bad").over(Window.partitionBy("service").orderBy("bucket")), F.lit(False))).where("bad <> was")
    ts, none = bucket_time(start, end, n, F.col("bucket") - 1), F.lit(None).cast("string")
    kind = F.when(F.col("bad"), "health_degraded").otherwise("health_recovered")
    level = F.when(F.col("bad"), "ERROR").otherwise("INFO")
    event = _event("", ts, F.col("service"), F.when(F.col("bad"), F.col("errors")).otherwise(0), none, level)
    return turned.select(kind.alias("kind"), *event[1:])


def _bucket(at: Column, start: datetime, end: datetime, n: int) -> Column:
    """The bucket of a time, null outside the window."""
    passed = micros(at) - micros(start)
    return F.when((at >= F.lit(start)) & (at < F.lit(end)), (F.call_function("div", passed * n, micros(end) - micros(start)) + 1).cast("int"))


def series_counts(chunks: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS, service: str | None = None) -> DataFrame:
    """service, signature, level, bucket, n, first of all chunks with a signature; rows outside the window, and of other
    services than an asked one, have no bucket and only tell when a signature was first seen."""
    bucket = _bucket(F.col("timestamp_start"), start, end, n)
    if service is not None:
        bucket = F.when(F.col("source_service") == service, bucket)
    rows = chunks.where("signature is not null and signature <> ''")
    return rows.groupBy(F.col("source_service").alias("service"), "signature", F.upper("log_level").alias("level"), bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min("timestamp_start").alias("first")
    )


def feed_of(counts: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS) -> DataFrame:
    """All events of ``series_counts``, by the rules of the ``events_`` functions, from one reading of them.

    Each series, and each service for its health, becomes one row with an array of at most ``n`` buckets, and the rules are
    functions of that array.
    """
    bad = F.col("level").isin(*ERROR_CLASS) & F.col("bucket").isNotNull()
    rank = _rank(F.col("level"))
    both = counts.withColumn("key", F.explode(F.array(F.struct(F.lit(False).alias("health"), F.col("signature").alias("name")), F.struct(F.lit(True).alias("health"), F.lit("").alias("name")))))
    keyed = both.select("service", "key.health", "key.name", "level", "bucket", "n", "first", bad.alias("bad"), rank.alias("rank"))
    # a service of very many series is summed up before it is dealt out
    per = keyed.groupBy("service", "health", "name", "bucket").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("errors"), F.max(F.when(F.col("bad"), F.struct("rank", "level"))).alias("worst"), F.min("first").alias("first")
    )
    rows = per.groupBy("service", "health", "name").agg(
        F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "total", "errors")))).alias("b"), F.max("worst")["level"].alias("level"), F.min("first").alias("first")
    )
    # a signature's first sight, over all services
    rows = rows.withColumn("first_ever", F.min("first").over(Window.partitionBy("health", "name"))).where(F.size("b") > 0)
    kind_of = "struct<kind:string,ts:timestamp,signature:string,level:string,title:string,count:bigint>"
    at = lambda bucket: bucket_time(start, end, n, bucket)
    event = lambda kind, ts, signature, level, title, count: F.struct(kind.alias("kind"), ts.alias("ts"), signature.alias("signature"), level.alias("level"), title.alias("title"), count.cast("long").alias("count")).cast(kind_of)
    name, level = F.col("name"), F.col("level")
    own = F.filter("b", lambda x: x["errors"] > 0)
    rows = rows.withColumn("own", own)
    head, last = F.get("own", F.lit(0)), F.element_at("own", -1)
    new = F.coalesce(F.col("first_ever") >= F.lit(start), F.lit(False))
    kind = F.when(new, "new_pattern").when((head["bucket"] > 1) & (head["errors"] >= BEGINS_MIN), "begins")
    first_event = F.when(kind.isNotNull(), event(kind, at(head["bucket"] - 1), name, level, name, head["errors"]))
    mean = lambda i: F.aggregate(F.slice("own", F.lit(1), i), F.lit(0).cast("double"), lambda a, x: a + x["errors"]) / i
    spikes = F.transform("own", lambda x, i: F.when((i > 0) & (x["errors"] >= SPIKE_MIN) & (x["errors"] >= SPIKE_RATIO * mean(F.greatest(i, F.lit(1)))), F.struct((-x["errors"]).alias("less"), x["bucket"].alias("bucket"))))
    top = F.array_min(F.array_compact(spikes))
    spike = F.when(top.isNotNull(), event(F.lit("spike"), at(top["bucket"] - 1), name, level, F.concat(name, F.lit(" (×"), (-top["less"]).cast("string"), F.lit(")")), -top["less"]))
    total = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x["errors"])
    subside = F.when((total >= SUBSIDE_MIN) & (last["bucket"] <= n - QUIET_BUCKETS), event(F.lit("subsides"), at(last["bucket"]), name, level, name, F.lit(0)))
    of_series = F.when(F.size("own") > 0, F.array(first_event, spike, subside)).otherwise(F.array().cast(f"array<{kind_of}>"))
    # health: buckets that say something, and where that turns
    share = lambda x: x["errors"] / x["total"]
    said = F.filter(F.transform("b", lambda x: F.when(x["total"] >= HEALTH_MIN, F.struct(x["bucket"].alias("bucket"), x["errors"].alias("errors"), F.when(share(x) >= DEGRADED_SHARE, True).when(share(x) <= RECOVERED_SHARE, False).alias("bad")))), lambda x: x["bad"].isNotNull())
    rows = rows.withColumn("said", said)
    none = F.lit(None).cast("string")
    turns = F.transform("said", lambda x, i: F.when(x["bad"] != F.when(i > 0, F.get("said", i - 1)["bad"]).otherwise(F.lit(False)), event(
        F.when(x["bad"], "health_degraded").otherwise("health_recovered"), at(x["bucket"] - 1), none, F.when(x["bad"], "ERROR").otherwise("INFO"), F.col("service"), F.when(x["bad"], x["errors"]).otherwise(0))))
    found = F.array_compact(F.when(F.col("health"), turns).otherwise(of_series))
    return rows.select("service", F.explode(found).alias("e")).select("e.kind", "e.ts", "service", "e.signature", "e.level", "e.title", "e.count")


def event_feed(chunks: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS, max_events: int | None = MAX_EVENTS, service: str | None = None) -> DataFrame:
    """Events of a window with ``place``, their order in time; beyond ``max_events`` those of higher kinds and larger counts
    stay. Without that bound (None) all events come, and ``place`` counts within an hour, so that nothing is sorted in one task.
    The chunks are read once.
    """
    return _placed(feed_of(series_counts(chunks, start, end, n, service), start, end, n), max_events)


def event_rollup(chunks: DataFrame) -> DataFrame:
    """service, signature, level, minute, n, first: counts of chunks with a signature, to be kept instead of them; sums and
    minima of such rows are such rows again."""
    rows = chunks.where("signature is not null and signature <> ''")
    return rows.groupBy(F.col("source_service").alias("service"), "signature", F.upper("log_level").alias("level"), F.date_trunc("minute", F.col("timestamp_start").cast("timestamp")).alias("minute")).agg(
        F.count("*").alias("n"), F.min("timestamp_start").alias("first")
    )


def event_feed_from_rollup(rollup: DataFrame, start: datetime, end: datetime, n: int = N_BUCKETS, max_events: int | None = MAX_EVENTS, service: str | None = None) -> DataFrame:
    """``event_feed`` from rows of ``event_rollup``, in any number of parts. The window and its buckets have to begin at full
    minutes."""
    minutes, odd = divmod((end - start).total_seconds(), 60)
    if odd or minutes % n or start.second or start.microsecond:
        raise ValueError("the window and its buckets begin at full minutes")
    bucket = _bucket(F.col("minute"), start, end, n)
    if service is not None:
        bucket = F.when(F.col("service") == service, bucket)
    counts = rollup.groupBy("service", "signature", "level", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return _placed(feed_of(counts, start, end, n), max_events)


def _placed(events: DataFrame, max_events: int | None) -> DataFrame:
    priority = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    within = Window.partitionBy(F.date_trunc("hour", "ts")) if max_events is None else Window.partitionBy()
    if max_events is not None:
        events = events.orderBy(priority, F.desc("count"), "ts", "service", F.asc_nulls_last("signature")).limit(max_events)
    place = F.row_number().over(within.orderBy("ts", priority, "service", F.asc_nulls_last("signature"), "title"))
    return events.withColumn("place", place)
