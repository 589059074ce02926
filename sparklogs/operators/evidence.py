"""Checks on structured incident answers against the evidence of their investigations.

An answer row has investigation_id, affected_services, trigger_event (chunk_id, service, timestamp, log_line),
propagation_chain (an array of service, chunk_id, ts, what), root_cause, ruled_out_hypotheses, confidence and gaps; an
evidence row has investigation_id, chunk_id, service, level, message, timestamp and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence in rising order, hedging words, texts of gaps.
CONFIDENCE = ("low", "medium", "high")
HEDGES = (
    "possibly", "likely", "may have", "might have", "unclear", "unable to determine", "hypothesis", "not confirmed",
    "insufficient evidence", "cannot confirm", "uncertain",
)
SYNTH_LEVELS = ("ERROR", "WARNING", "CRITICAL", "FATAL")
REQUIRED = ("confidence", "root_cause", "affected_services")


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def cited_ids(answer_trigger: str = "trigger_event", chain: str = "propagation_chain") -> Column:
    """Distinct chunk ids that an answer cites."""
    hops = F.transform(F.coalesce(chain, _none("array<struct<service:string,chunk_id:string,ts:string,what:string>>")), lambda h: h["chunk_id"])
    ids = F.array_append(hops, F.col(f"{answer_trigger}.chunk_id"))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))


def _pool(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers with ``_n``, the size of their evidence, its ``_services`` and lower-case ``_texts``, and ``_outside``, the
    cited ids that are not in it.

    An investigation's evidence is what one run of questions found, some hundreds of rows at most, so it is gathered into
    one row, in one shuffle, and everything else is done there.
    """
    text = F.lower(F.coalesce("message", F.lit("")))
    own = evidence.groupBy("investigation_id").agg(F.count("*").alias("_n"), F.collect_set("chunk_id").alias("_ids"), F.collect_set("service").alias("_services"), F.collect_set(text).alias("_texts"))
    rows = answers.join(own, "investigation_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = rows.withColumns({c: F.coalesce(c, _none("array<string>")) for c in ("_ids", "_services", "_texts")})
    return rows.withColumn("_outside", F.array_except(cited_ids(), F.col("_ids"))).drop("_ids")


def validate_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """investigation_id, errors, valid."""
    chain = F.coalesce("propagation_chain", _none("array<struct<service:string,chunk_id:string,ts:string,what:string>>"))
    confidence, trigger, some = F.coalesce("confidence", F.lit("")), F.col("trigger_event.chunk_id"), F.col("_n") > 0
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    missing = F.filter(chain, lambda h: F.array_contains("_outside", h["chunk_id"]))
    errors = F.concat(
        F.array(F.when(~confidence.isin(*CONFIDENCE), say("bad confidence: ", confidence))),
        F.array(F.when(some & F.array_contains("_outside", trigger), say("trigger not in evidence: ", trigger))),
        F.array(F.when((F.size(F.coalesce("affected_services", _none("array<string>"))) >= 2) & (F.size(chain) == 0), F.lit("no propagation chain for several services"))),
        F.when(some, F.transform(missing, lambda h: say("hop not in evidence: ", h["chunk_id"]))).otherwise(_none("array<string>")),
        F.array(F.when((F.coalesce(F.size("ruled_out_hypotheses"), F.lit(0)) <= 0) & (confidence != "high"), F.lit("no hypothesis ruled out"))),
    )
    return _pool(answers, evidence).select("investigation_id", F.array_compact(errors).alias("errors")).withColumn("valid", F.size("errors") == 0)


def _absent(what: Column, by_service: bool = False) -> Column:
    """Those of an array that stand in no evidence text (or service)."""
    held = lambda w: F.exists("_texts", lambda t: t.contains(F.lower(w)))
    seen = (lambda w: held(w) | F.array_contains("_services", w)) if by_service else held
    return F.filter(F.array_distinct(F.array_compact(what)), lambda w: ~seen(w))


def enforce_floors(answers: DataFrame, evidence: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """investigation_id, confidence, gaps, notes after the floors, in order.

    A bad confidence is low; no evidence, or none that holds any of the question's entities, is low; high needs two
    cited chunks; without gaps and with fewer than three citations it falls by one; services that no evidence shows cost
    one; a hedging root cause is not high. ``entities`` has investigation_id and entities.
    """
    rows = _pool(answers, evidence).withColumn("_cited", F.size(cited_ids()))
    asked = _none("array<string>")
    if entities is not None:
        rows = rows.join(entities.select("investigation_id", F.col("entities").alias("_entities")), "investigation_id", "left")
        asked = F.coalesce("_entities", asked)
    shown = F.exists("_services", lambda s: s != "")
    rows = rows.withColumns({
        "_unseen": F.when(shown, F.size(_absent(F.coalesce("affected_services", _none("array<string>")), by_service=True))).otherwise(0),
        "_asked": F.size(F.array_distinct(asked)), "_lost": F.size(_absent(asked)),
    })
    given = F.lower(F.coalesce("confidence", F.lit("")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), given) - 1, F.lit(-1)).cast("int")
    rows = rows.withColumns({"_rank": F.greatest(rank, F.lit(0)), "_gaps": F.coalesce("gaps", _none("array<string>")), "notes": F.when(rank < 0, F.array(F.lit("bad confidence"))).otherwise(_none("array<string>"))})

    def floor(rows: DataFrame, when: Column, rank: Column, note: str, as_gap: bool = True) -> DataFrame:
        changes = {"_rank": F.when(when, rank).otherwise(F.col("_rank")), "notes": F.when(when, F.array_append("notes", F.lit(note))).otherwise(F.col("notes"))}
        if as_gap:
            changes["_gaps"] = F.when(when, F.array_append("_gaps", F.lit(note))).otherwise(F.col("_gaps"))
        return rows.withColumns(changes)

    lower, level = F.greatest(F.col("_rank") - 1, F.lit(0)), F.col("_rank")
    rows = floor(rows, (F.col("_n") == 0) & (level > 0), F.lit(0), "no evidence")
    rows = floor(rows, (F.col("_n") > 0) & (F.col("_asked") > 0) & (F.col("_lost") == F.col("_asked")) & (level > 0), F.lit(0), "no entity of the question in the evidence")
    rows = floor(rows, (level == 2) & (F.col("_cited") < 2), lower, "fewer than two citations")
    bare = (level > 0) & (F.size("_gaps") == 0)
    rows = rows.withColumn("_bare", bare)
    rows = floor(rows, F.col("_bare") & (F.col("_cited") >= 3), level, "no gaps listed", as_gap=False)
    rows = floor(rows, F.col("_bare") & (F.col("_cited") < 3), lower, "no gaps and fewer than three citations")
    rows = floor(rows, F.col("_unseen") > 0, lower, "services that no evidence shows")
    hedged = F.exists(F.array(*map(F.lit, HEDGES)), lambda h: F.lower(F.coalesce("root_cause", F.lit(""))).contains(h))
    rows = floor(rows, (level == 2) & hedged, F.lit(1), "hedging root cause")
    return rows.select("investigation_id", F.element_at(F.array(*map(F.lit, CONFIDENCE)), level + 1).alias("confidence"), F.col("_gaps").alias("gaps"), "notes")


def synthesize_answers(evidence: DataFrame, calls: DataFrame) -> DataFrame:
    """A fallback answer for each investigation that called a tool: services in order of appearance, the first symptom as
    trigger, confidence low, gaps that name the tools tried."""
    level = F.upper(F.coalesce("level", F.lit("")))
    line = F.substring(F.coalesce("message", F.lit("")), 1, 500)
    trigger = F.when(level.isin(*SYNTH_LEVELS), F.struct("place", F.col("chunk_id").alias("chunk_id"), "service", F.col("timestamp").cast("string").alias("timestamp"), line.alias("log_line")))
    services = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce("service", F.lit("")) != "", F.struct("place", "service")))), lambda x: x["service"]))
    found = evidence.groupBy("investigation_id").agg(services.alias("affected_services"), F.min(trigger).alias("_t"))
    tools = calls.groupBy("investigation_id").agg(F.sort_array(F.collect_set("tool")).alias("tools"))
    rows = tools.join(found, "investigation_id", "left")
    gaps = F.array_compact(F.array(F.lit("no compiled answer"), F.concat(F.lit("tools tried: "), F.array_join("tools", ", ")), F.when(F.col("affected_services").isNull(), F.lit("no evidence"))))
    return rows.select(
        "investigation_id", F.coalesce("affected_services", _none("array<string>")).alias("affected_services"), F.col("_t.chunk_id").alias("trigger_chunk_id"), F.col("_t.service").alias("trigger_service"),
        F.col("_t.log_line").alias("trigger_line"), F.lit("unable_to_determine").alias("root_cause"), F.lit("low").alias("confidence"), gaps.alias("gaps"),
    )


def precheck_answers(answers: DataFrame) -> DataFrame:
    """investigation_id, errors: missing required fields and an invalid confidence."""
    empty = {"affected_services": F.coalesce(F.size("affected_services"), F.lit(0)) <= 0}
    lacking = [F.when(empty.get(c, F.coalesce(F.col(c), F.lit("")) == ""), F.lit(f"missing {c}")) for c in REQUIRED]
    bad = F.when((F.col("confidence") != "") & ~F.col("confidence").isin(*CONFIDENCE), F.concat(F.lit("bad confidence: "), F.col("confidence")))
    return answers.select("investigation_id", F.array_compact(F.array(*lacking, bad)).alias("errors"))
