"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklogs.llm import fingerprints, lines, media, mixing, ngram_join, packing, quality, sharding, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep string, id string, size string, copies string, n_lines string, media string, held_out string, tail_probability string, expected_grade string, _id string, _gone string, _hash string, _times string, hash string, node string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "Alpha beta\ngamma delta."), (2, None), (3, ""), (4, " \n\t "), (5, "Alpha beta\ngamma delta."), (None, "a null id stands here"), (6, LONG),
    (7, "repeated row"), (7, "repeated row"), (8, "é ü 中文 😀 <|endoftext|> x  y"), (9, LONG + " tail"),
]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 4 == 3 else f"s{k % 3}", None if t is None else len(t), *["x"] * 16) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).sortWithinPartitions("doc_id", "text").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, 0), (7, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_substrings(docs, nothing):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    counts = Counter(tuple(w[i : i + 35]) for _, t in TEXTS for w in [words(t)] for i in range(len(w) - 34))
    want = set()
    for i, t in TEXTS:
        w = words(t)
        gone = set()
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == want
    assert substrings.remove_repeats(nothing).count() == 0


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack_documents(docs).collect()
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in TEXTS]
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    by_id = {i: x for i, x in ids}
    for r in rows:
        assert r.doc_tokens == len(by_id[r.doc_id])
        assert zlib.crc32(by_id[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack_documents(nothing).count() == 0


def test_media(docs, nothing):
    rows = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert (rows[i].payload_sha256, rows[i].tail_crc32) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert rows[1].feature == rows[5].feature and rows[1].media_sha256 == rows[5].media_sha256
    clips = media.media_clips(media.media_table(docs)).groupBy("doc_id").agg(F.sum("frames").alias("n")).collect()
    assert {r.doc_id: r.n for r in clips}[1] == 1
    assert media.media_digests(nothing).count() == 0


def test_ngram_join(docs, nothing):
    rows = ngram_join.ngram_join(docs).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].class_id == by_id[1].class_id == 1 and by_id[1].copies == 2 and by_id[1].n_links == 0
    assert by_id[9].class_id == 6 and by_id[9].n_links == by_id[6].n_links == 1
    assert by_id[2].class_id == by_id[3].class_id == by_id[4].class_id == 2 and by_id[7].copies == 2
    assert by_id[None].class_id is None
    assert ngram_join.ngram_join(nothing).count() == 0


def test_toxicity_and_quality(docs, labels, nothing, spark):
    scored = toxicity.score_toxicity(docs, labels)
    rows = scored.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows}[1] == (zlib.crc32(b"1") % 5 == 0)
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    graded = quality.grade_documents(docs, ratings, grades=3).collect()
    assert len(graded) == len(TEXTS) and all(0 <= r.expected_grade <= 2 for r in graded)
    assert quality.grade_documents(nothing, ratings, grades=3).count() == 0
    assert quality.grade_documents(docs, ratings.limit(0), grades=3).count() == len(TEXTS)


def test_sharding(docs, nothing):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(TEXTS)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows}[2] == (8, 0)
    assert sharding.shard_documents(nothing).count() == 0


def test_mixing(docs, nothing):
    sized = mixing.word_sizes(docs, ["doc_id", "source"])
    rows = mixing.mix_sources(sized).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.copies <= 3 for r in rows)
    again = mixing.mix_sources(sized).collect()
    assert sorted((r.doc_id or 0, r.size, r.copies) for r in rows) == sorted((r.doc_id or 0, r.size, r.copies) for r in again)
    assert mixing.mix_sources(mixing.word_sizes(nothing, ["doc_id", "source"])).count() == 0


def test_fingerprints(docs, nothing):
    rows = fingerprints.fingerprint_edits(docs, 3).collect()
    order = sorted(TEXTS, key=lambda x: -(x[0] if x[0] is not None else -(2**63)))
    want = {}
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        want[i] = (len(text), hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest())
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows}
    assert len(rows) == len(TEXTS) and {k: v for k, v in got.items() if k != 7} == {k: v for k, v in want.items() if k != 7}
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[5] and prints[2] == prints[3]
    assert fingerprints.fingerprint_edits(nothing).count() == 0


def test_lines(docs, nothing):
    rows = lines.dedup_lines(docs).collect()
    kept = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in rows}
    assert len(rows) == len(TEXTS)
    assert kept[1] == ("Alpha beta\ngamma delta.", 2, 0) and kept[5] == ("", 2, 2)
    assert kept[2] == kept[3] == ("", 1, 0) and kept[4] == (" \n\t ", 2, 0)
    assert lines.dedup_lines(nothing).count() == 0


def test_rows_that_share_a_doc_id_keep_their_own_results(spark):
    rows = [(1, "one text " * 30), (1, "another text, longer " * 20), (1, None), (2, "one text " * 30), (None, "no id"), (None, "no id either")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for found in (substrings.remove_repeats(table), sharding.shard_documents(table), media.media_digests(table), ngram_join.ngram_join(table), lines.dedup_lines(table), fingerprints.fingerprint_edits(table, 4)):
        assert sorted((r.doc_id or 0 for r in found.collect())) == [0, 0, 1, 1, 1, 2]
    kept = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(table).collect()}
    assert kept == {(1, 60, 60), (1, 60, 60), (1, 0, 0), (2, 60, 60), (None, 2, 0), (None, 3, 0)}
    pieces = packing.pack_documents(table).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in pieces}) == 6


def test_stages(docs, nothing, labels, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, nothing):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            before, left = left, stage(spark, left, str(tmp_path))
            if name != "packing":
                assert left.columns == before.columns
                left.write.parquet(str(tmp_path / f"{name}-{table is docs}"))
                left = spark.read.schema(before.schema).parquet(str(tmp_path / f"{name}-{table is docs}"))
        assert (left.count() > 0) == (table is docs)
