"""Filters, look-ups and small joins on the chunk table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Filters:
    """Conditions of a search; those left out do not restrict. Levels compare upper-cased, blank ones are ignored."""

    service: str | None = None
    env: str | None = None
    level: str | list[str] | None = None
    time_from: datetime | None = None
    time_to: datetime | None = None
    project_id: str | None = None

    def condition(self) -> Column:
        levels = [self.level] if isinstance(self.level, str) else list(self.level or [])
        levels = [x.strip().upper() for x in levels if x and x.strip()]
        parts = [
            F.col(name) == value
            for name, value in (("source_service", self.service), ("project_id", self.project_id), ("source_env", self.env))
            if value
        ]
        if levels:
            parts.append(F.col("log_level").isin(*levels))
        if self.time_from:
            parts.append(F.col("timestamp_start") >= F.lit(self.time_from))
        if self.time_to:
            parts.append(F.col("timestamp_end") <= F.lit(self.time_to))
        whole = F.lit(True)
        for part in parts:
            whole = whole & part
        return whole


def apply_filters(chunks: DataFrame, filters: Filters) -> DataFrame:
    """Chunks that meet all conditions; each is a plain comparison and reaches the scan."""
    return chunks.where(filters.condition())


def filter_search(chunks: DataFrame, filters: Filters, k: int = 20) -> DataFrame:
    """The newest k chunks that meet the conditions, score 1; chunks without a time come first."""
    found = apply_filters(chunks, filters).orderBy(F.desc_nulls_first("timestamp_start"), "chunk_id").limit(k)
    return found.withColumn("score", F.lit(1.0))


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, rank, ...) with the columns of their chunks; rank keeps the order, unknown ids stay."""
    extra = [c for c in chunks.columns if c == "chunk_id" or c not in hits.columns]
    return hits.join(chunks.select(*extra), "chunk_id", "left")


def get_timeline(ids: DataFrame, chunks: DataFrame, project_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The chunks of a set of ids; with a ``limit`` the first so many in time order, those without a time last."""
    found = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if project_id is not None:
        found = found.where(F.col("project_id") == project_id)
    return found if limit is None else found.orderBy(F.asc_nulls_last("timestamp_start"), "chunk_id").limit(limit)


def known_services(chunks: DataFrame, watchers: DataFrame) -> DataFrame:
    """project_id, service: services seen in chunks and names of enabled watchers."""
    seen = chunks.select("project_id", F.col("source_service").alias("service")).distinct()
    return seen.unionByName(watchers.where("enabled").select("project_id", F.col("service_name").alias("service"))).where("service is not null").distinct()


def unchecked_services(known: DataFrame, calls: DataFrame) -> DataFrame:
    """investigation_id, service: known services that no tool call names.

    ``calls`` has investigation_id, service (an argument), services (a list argument) and result_keys. ``known`` has
    investigation_id and service.
    """
    lists = F.array_union(F.array_union(F.array_compact(F.array("service")), F.coalesce("services", F.array().cast("array<string>"))), F.coalesce("result_keys", F.array().cast("array<string>")))
    named = calls.select("investigation_id", F.explode(lists).alias("service")).distinct()
    return known.join(named, ["investigation_id", "service"], "left_anti")
