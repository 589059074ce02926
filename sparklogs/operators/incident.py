"""Incident scans on the chunk table: symptom lines, context before the first error, roll-ups and overviews."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklogs.operators.events import ERROR_CLASS

SYMPTOM_LEVELS = ("ERROR", "WARNING")
SWEEP_ROWS = 50


def between(start: datetime, end: datetime) -> Column:
    """Both ends count, as in SQL."""
    return F.col("timestamp_start").between(F.lit(start), F.lit(end))


def _scope(chunks: DataFrame, services: list[str] | None, project_id: str | None) -> DataFrame:
    if services:
        chunks = chunks.where(F.col("source_service").isin(*services))
    return chunks.where(F.col("project_id") == project_id) if project_id else chunks


def scan_logs(chunks: DataFrame, start: datetime, end: datetime, levels: tuple[str, ...] = SYMPTOM_LEVELS, services: list[str] | None = None, k: int = 50, project_id: str | None = None) -> DataFrame:
    """The first k chunks of the window at the given levels, oldest first."""
    rows = _scope(chunks, services, project_id).where(between(start, end) & F.col("log_level").isin(*levels))
    return rows.orderBy(F.asc_nulls_last("timestamp_start"), "chunk_id").limit(k)


def first_errors(chunks: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """source_service, first_error: one row for each service with an ERROR in the window."""
    return chunks.where(between(start, end) & (F.col("log_level") == "ERROR")).groupBy("source_service").agg(F.min("timestamp_start").alias("first_error"))


def pre_context(chunks: DataFrame, start: datetime, end: datetime, seconds: int = 300, limit: int = 20, services: list[str] | None = None, project_id: str | None = None) -> DataFrame:
    """For each service with an ERROR in the window, the nearest ``limit`` chunks of [first error - seconds, first error)
    that are neither ERROR nor DEBUG; a missing level counts as neither. ``place`` counts back from the error."""
    rows = _scope(chunks, services, project_id)
    if seconds <= 0 or limit <= 0:
        return rows.limit(0).withColumns({"first_error": F.lit(None).cast("timestamp"), "place": F.lit(None).cast("int")})
    first = first_errors(rows, start, end)
    quiet = ~F.col("log_level").eqNullSafe("ERROR") & ~F.col("log_level").eqNullSafe("DEBUG")
    reach = F.make_dt_interval(secs=F.lit(seconds))
    # the bounds that hold for every service prune the scan; the rest is an equi join with a range condition
    near = rows.where(quiet & (F.col("timestamp_start") >= F.lit(start - timedelta(seconds=seconds))) & (F.col("timestamp_start") < F.lit(end)))
    close = near.join(first, "source_service").where((F.col("timestamp_start") >= F.col("first_error") - reach) & (F.col("timestamp_start") < F.col("first_error")))
    back = Window.partitionBy("source_service").orderBy(F.desc("timestamp_start"), "chunk_id")
    return close.withColumn("place", F.row_number().over(back)).where(F.col("place") <= limit)


def scan_summary(chunks: DataFrame, start: datetime, end: datetime, services: list[str] | None = None, seconds: int = 300, limit: int = 20) -> DataFrame:
    """service, errors, warnings, first_error, pre_context_count of services with symptoms in the window."""
    rows = _scope(chunks, services, None).where(between(start, end) & F.col("log_level").isin(*SYMPTOM_LEVELS))
    per = rows.groupBy("source_service").agg(
        F.count_if(F.col("log_level") == "ERROR").alias("errors"), F.count_if(F.col("log_level") == "WARNING").alias("warnings"),
        F.min(F.when(F.col("log_level") == "ERROR", F.col("timestamp_start"))).alias("first_error"),
    )
    before = pre_context(chunks, start, end, seconds, limit, services).groupBy("source_service").agg(F.count("*").alias("n"))
    return per.join(before, "source_service", "left").select(F.col("source_service").alias("service"), "errors", "warnings", "first_error", F.coalesce("n", F.lit(0)).alias("pre_context_count"))


def service_summary(chunks: DataFrame, start: datetime, end: datetime, services: DataFrame | None = None) -> DataFrame:
    """Totals of every service in the window; with ``services`` (a column service) one row for each, empty ones too."""
    level = lambda x: F.count_if(F.col("log_level") == x)
    per = chunks.where(between(start, end)).groupBy(F.col("source_service").alias("service")).agg(
        F.count("*").alias("total"), F.count_distinct("request_id").alias("requests"), level("ERROR").alias("errors"), level("WARNING").alias("warnings"),
        level("INFO").alias("infos"), F.min("timestamp_start").alias("earliest"), F.max("timestamp_end").alias("latest"),
    )
    if services is None:
        return per
    return services.select("service").distinct().join(per, "service", "left").na.fill(0, ["total", "requests", "errors", "warnings", "infos"])


def auto_sweep(chunks: DataFrame, start: datetime, end: datetime, exclude: list[str] | None = None, rows: int = SWEEP_ROWS) -> DataFrame:
    """The first ``rows`` symptom chunks of the window, then per service: place, service, errors, warnings, first_error,
    ordered chunk_ids, label ("service@time of its first error", the service alone without one) and total.

    Services without an error come first, the others by their first one; ``total`` counts the chunks of all services.
    """
    found = chunks.where(between(start, end) & F.col("log_level").isin(*SYMPTOM_LEVELS))
    if exclude:
        found = found.where(~F.col("source_service").isin(*exclude))
    top = found.orderBy("timestamp_start", "chunk_id").limit(rows)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("timestamp_start", "chunk_id"))), lambda x: x["chunk_id"])
    per = top.groupBy(F.col("source_service").alias("service")).agg(
        F.count_if(F.col("log_level") == "ERROR").alias("errors"), F.count_if(F.col("log_level") == "WARNING").alias("warnings"),
        F.min(F.when(F.col("log_level") == "ERROR", F.col("timestamp_start"))).alias("first_error"), ordered.alias("chunk_ids"),
    )
    every = Window.partitionBy()  # of at most ``rows`` services
    label = F.when(F.col("first_error").isNull(), F.col("service")).otherwise(F.concat_ws("@", "service", F.date_format("first_error", "yyyy-MM-dd'T'HH:mm:ss")))
    place = F.row_number().over(every.orderBy(F.asc_nulls_first("first_error"), "service"))
    return per.withColumns({"place": place, "label": label, "total": F.sum(F.size("chunk_ids")).over(every)})


def error_clusters(chunks: DataFrame, start: datetime, end: datetime, service: str | None = None, k: int = 10, per_project: bool = False) -> DataFrame:
    """The k largest groups of error-class chunks with one signature, of the whole table or of each project."""
    rows = chunks.where((F.col("timestamp_start") >= F.lit(start)) & (F.col("timestamp_start") < F.lit(end)) & F.col("log_level").isin(*ERROR_CLASS))
    rows = rows.where("signature is not null and signature <> ''")
    if service is not None:
        rows = rows.where(F.col("source_service") == service)
    keys = ["project_id", "signature"] if per_project else ["signature"]
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("source_service")).alias("services"), F.min("timestamp_start").alias("first_ts"), F.max("timestamp_start").alias("last_ts")
    )
    if not per_project:
        return groups.orderBy(F.desc("n"), "signature").limit(k)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "signature"))
    return groups.withColumn("place", place).where(F.col("place") <= k).drop("place")


def suggested_actions(clusters: DataFrame, k: int = 3) -> DataFrame:
    """project_id, place, label, query: what to ask about the k largest clusters of each project."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "signature"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    where = F.when(F.size("services") > 0, F.concat(F.lit(" on "), F.get("services", F.lit(0)))).otherwise("")
    query = F.concat(F.lit("Investigate '"), "signature", F.lit("'"), where, F.lit(" between "), stamp("first_ts"), F.lit(" and "), stamp("last_ts"))
    return clusters.withColumn("place", place).where(F.col("place") <= k).select("project_id", "place", F.concat(F.lit("Investigate: "), F.substring("signature", 1, 60)).alias("label"), query.alias("query"))


def service_rollup(chunks: DataFrame) -> DataFrame:
    """service, n, last_seen."""
    return chunks.groupBy(F.col("source_service").alias("service")).agg(F.count("*").alias("n"), F.max("timestamp_start").alias("last_seen"))


def project_service_counts(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each project with its number of different services, 0 without chunks."""
    per = chunks.groupBy("project_id").agg(F.count_distinct("source_service").alias("services"))
    return projects.join(per, "project_id", "left").select("project_id", F.coalesce("services", F.lit(0)).alias("services"))


def overview_window(chunks: DataFrame, now: datetime, span: timedelta) -> DataFrame:
    """project_id, time_from, time_to, anchored: [now - span, now), or ending a hundredth after a project's last chunk if
    that window is empty."""
    inside = (F.col("timestamp_start") >= F.lit(now - span)) & (F.col("timestamp_start") < F.lit(now))
    per = chunks.groupBy("project_id").agg(F.count_if(inside).alias("n"), F.max("timestamp_start").alias("latest"))
    moved = (F.col("n") == 0) & F.col("latest").isNotNull()
    end = F.when(moved, F.col("latest") + F.lit(span / 100)).otherwise(F.lit(now))
    return per.select("project_id", (end - F.lit(span)).alias("time_from"), end.alias("time_to"), moved.alias("anchored"))
