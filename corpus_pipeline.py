"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, mixing of sources, packing.

Each stage reads all that its predecessor kept and returns a DataFrame; ``run`` writes each as Parquet and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklogs.llm import lines, mixing, ngram_join, packing, toxicity
from sparklogs.llm.common import WRITTEN, forget, unused, written


def _shielded(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns other than doc_id and text renamed, out of the way of what an operator adds, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"_column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select([F.col(c).alias(to) for c, to in names.items()]), [F.col(to).alias(c) for c, to in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go; the rest stays as it is."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = _shielded(docs)
    return toxicity.score_toxicity(rows, labels).where("predicted = 0").select(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document of which nothing else was left goes with them."""
    rows, back = _shielded(docs)
    kept = lines.dedup_lines(rows).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^ \t-\r]"))).select(back)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least doc_id, and of several texts under that doc_id one."""
    classes = ngram_join.ngram_join(docs.select("doc_id", "text"))
    own = unused("_hash", docs.columns)
    heads = written(classes.select(F.col("class_id").alias("head"), F.col("class_hash")).distinct(), "heads")
    hashed = docs.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(heads, hashed["doc_id"].eqNullSafe(heads["head"]) & (hashed[own] == heads["class_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate and the balanced sample ask for: not at all, or up to three times."""
    own, times = unused("_hash", docs.columns), unused("_times", docs.columns)
    keyed = docs.withColumn(own, F.xxhash64("text"))
    sized = written(mixing.word_sizes(keyed.select("doc_id", "source", F.col(own).alias("hash"), "text"), ["doc_id", "source", "hash"]), "sizes")
    copies = mixing.mix_sources(sized).groupBy(F.col("doc_id").alias("of"), F.col("hash").alias("of_hash")).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    once = keyed.dropDuplicates(["doc_id", own])
    mixed = once.join(copies, once["doc_id"].eqNullSafe(copies["of"]) & (once[own] == copies["of_hash"]))
    return mixed.select(*(once[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see ``packing.pack_documents``."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = len(WRITTEN)
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*WRITTEN[before:-1])
        WRITTEN[before:-1] = []
    return docs
