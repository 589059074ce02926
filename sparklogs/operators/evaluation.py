"""Evaluation of retrieval and of structured answers, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and the fields that make a criterion apply.
RETRIEVAL_TARGET, AGENT_TARGET, PASS_SCORE, GOLD_SCORE, FAIL_SCORE, KEYWORD_SHARE = 0.6, 0.3, 0.8, 0.8, 0.5, 0.4
CRITERIA = {
    "trigger_identification": ("trigger_event", "trigger_event_acceptable_options"),
    "root_cause_accuracy": ("root_cause_must_mention", "root_cause_must_be_one_of"),
    "propagation_chain": ("propagation_chain_must_include_in_order",),
    "red_herring_handling": ("ruled_out_hypotheses_must_include", "ruled_out_hypotheses_must_consider"),
    "confidence_calibration": ("confidence",),
    "gap_awareness": ("gaps_must_include_one_of",),
    "hallucination_avoidance": ("root_cause_must_NOT_assert", "root_cause_must_NOT_assert_as_root_cause"),
}


def score_retrieval(hits: DataFrame, truth: DataFrame, target: float = RETRIEVAL_TARGET) -> DataFrame:
    """Recall of services and keywords for each question of ``truth`` (query_id, services, keywords) in its hits.

    A keyword counts if it stands in a hit's text, in any case; nothing asked for counts as all found.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    seen = hits.groupBy("query_id").agg(
        F.collect_set("source_service").alias("_services"), F.collect_list(text).alias("_texts"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3).alias("top_scores")
    )
    rows = truth.join(seen, "query_id", "left")
    nothing = F.array().cast("array<string>")
    services, texts = F.coalesce("_services", nothing), F.coalesce("_texts", nothing)
    found = F.filter("keywords", lambda k: F.exists(texts, lambda t: t.contains(F.lower(k))))
    share = lambda got, want: F.when(F.size(want) > 0, F.size(got) / F.size(want)).otherwise(1.0)
    scored = rows.select(
        "query_id", share(F.array_intersect("services", services), F.array_distinct("services")).alias("service_recall"), share(found, F.col("keywords")).alias("keyword_recall"),
        F.sort_array(found).alias("found"), F.sort_array(F.array_except("keywords", found)).alias("missed"), F.sort_array(services).alias("services"),
        F.coalesce("top_scores", F.array().cast("array<double>")).alias("top_scores"),
    )
    return scored.withColumn("meets_target", (F.col("service_recall") >= target) & (F.col("keyword_recall") >= target))


def retrieval_averages(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(keys or [])).agg(F.count("*").alias("questions"), F.avg("service_recall").alias("service_recall"), F.avg("keyword_recall").alias("keyword_recall"))


def active_criteria(expected: DataFrame) -> DataFrame:
    """dataset, criteria: those whose fields are set (not null, empty text or empty list)."""
    kinds = dict(expected.dtypes)
    given = lambda c: F.coalesce(F.size(c) > 0 if kinds[c].startswith("array") else F.col(c) != "", F.lit(False))
    applies = []
    for name, fields in CRITERIA.items():
        some = F.lit(False)
        for field in fields:
            if field in kinds:
                some = some | given(field)
        applies.append(F.when(some, F.lit(name)))
    return expected.select("dataset", F.array_compact(F.array(*applies)).alias("criteria"))


def _overlaps(phrase: Column, text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.trim(phrase)), r"\s+"), lambda w: F.length(w) > 3)
    enough = F.size(F.filter(words, lambda w: text.contains(w))) / F.size(words) >= KEYWORD_SHARE
    return F.when(F.size(words) == 0, text.contains(F.lower(phrase))).otherwise(enough)


def score_deterministic(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """run_id, dataset, name, score of the criteria that need no judge.

    ``answers`` has run_id, dataset, confidence, gaps; ``expected`` has dataset, confidence, gaps_must_include_one_of.
    """
    want = expected.select("dataset", F.col("confidence").alias("_confidence"), F.col("gaps_must_include_one_of").alias("_gaps"))
    rows = answers.join(want, "dataset")
    gaps = F.coalesce("gaps", F.array().cast("array<string>"))
    text = F.lower(F.array_join(gaps, " "))
    exact = F.when(F.coalesce("confidence", F.lit("")) == F.col("_confidence"), 1.0).otherwise(0.0)
    aware = F.when(F.size(gaps) == 0, 0.0).when(F.exists("_gaps", lambda g: _overlaps(g, text)), 1.0).otherwise(0.4)
    confidence = rows.where("_confidence <> ''").select("run_id", "dataset", F.lit("confidence_calibration").alias("name"), exact.alias("score"))
    return confidence.unionByName(rows.where(F.size("_gaps") > 0).select("run_id", "dataset", F.lit("gap_awareness").alias("name"), aware.alias("score")))


def aggregate_judgement(scores: DataFrame, criteria: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, dataset, aggregate_score, status from judge scores (run_id, dataset, name, score).

    Scores are held in 0 to 1, names that do not apply are ignored, missing ones count 0, the mean is rounded to three
    digits. ``runs`` has run_id, dataset, parse_attempts: all zero after two attempts is a parse error of the judge.
    """
    wanted = runs.join(criteria, "dataset").select("run_id", "dataset", "parse_attempts", F.explode_outer("criteria").alias("name"))
    given = scores.groupBy("run_id", "dataset", "name").agg(F.max(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("score"))
    rows = wanted.join(given, ["run_id", "dataset", "name"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    total = rows.groupBy("run_id", "dataset", "parse_attempts").agg(F.round(F.avg("score"), 3).alias("aggregate_score"), F.max("score").alias("_best"))
    failed = (F.col("_best") == 0) & (F.col("parse_attempts") >= 2)
    status = F.when(failed, "judge_parse_error").when(F.col("aggregate_score") >= PASS_SCORE, "pass").otherwise("fail")
    return total.select("run_id", "dataset", "aggregate_score", status.alias("status"))


def judge_calibration(scores: DataFrame) -> DataFrame:
    """dataset, gold, fail, verdict from the judge's scores of a good and a bad answer (dataset, kind, score)."""
    wide = scores.groupBy("dataset").pivot("kind", ["gold", "fail"]).agg(F.max("score"))
    verdict = F.when(F.col("gold").isNull() | F.col("fail").isNull(), "incomplete").when((F.col("gold") >= GOLD_SCORE) & (F.col("fail") <= FAIL_SCORE), "calibrated")
    return wide.withColumn("verdict", verdict.when(F.col("gold") < GOLD_SCORE, "too strict").otherwise("too lenient"))


def investigation_stats(steps: DataFrame) -> DataFrame:
    """investigation_id, iterations (steps of no kind), reflections, tools (distinct, sorted)."""
    return steps.groupBy("investigation_id").agg(
        F.count_if(F.col("kind").isNull()).alias("iterations"), F.count_if(F.col("kind") == "reflection").alias("reflections"), F.sort_array(F.collect_set("tool")).alias("tools")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """run_id, passed, failed, errored, average_score."""
    status = lambda *x: F.count_if(F.col("status").isin(*x))
    return results.groupBy("run_id").agg(
        status("pass").alias("passed"), status("fail").alias("failed"), F.count_if(~F.col("status").isin("pass", "fail")).alias("errored"), F.avg("aggregate_score").alias("average_score")
    )


def model_matrix(results: DataFrame, datasets: list[str]) -> DataFrame:
    """A row for each model with its score on each dataset, their average and all iterations."""
    wide = results.groupBy("model").pivot("dataset", datasets).agg(F.max("aggregate_score"))
    total = results.where(F.col("dataset").isin(*datasets)).groupBy("model").agg(F.avg("aggregate_score").alias("average"), F.sum("iterations").alias("iterations"))
    return wide.join(total, "model", "left")


def leaderboard_best(leaderboard: DataFrame) -> DataFrame:
    """The best row of each model and dataset; runs that ended in an error do not count."""
    best = F.row_number().over(Window.partitionBy("model", "dataset").orderBy(F.desc("aggregate_score"), F.desc("created_at"), "run_id"))
    return leaderboard.where(~F.col("status").isin("error", "provider_error")).withColumn("_n", best).where("_n = 1").drop("_n")
