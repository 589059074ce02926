"""Operators against brute force, round trips, and held-out accuracy."""

import os
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparklogs.llm import common, components, fingerprints, lines, media, mixing, ngram_join, packing, quality, queries, sharding, substrings, toxicity

DATA = "/root/testdata/sf0.001"


def test_fm_index_counts_like_a_scan():
    random.seed(3)
    sequences = [[random.randint(1, 3) for _ in range(random.randint(1, 40))] for _ in range(30)]
    symbols = np.array([x for s in sequences for x in (*s, 0)])
    index = substrings.FMIndex(symbols)
    for _ in range(200):
        pattern = [random.randint(1, 3) for _ in range(random.randint(1, 6))]
        low, high = np.zeros(1, int), np.full(1, index.n)
        for c in reversed(pattern):
            low, high = (index.extend(np.array([c]), x) for x in (low, high))
        want = sum(s[i : i + len(pattern)] == pattern for s in sequences for i in range(len(s)))
        assert max(0, int(high[0] - low[0])) == want


@pytest.mark.parametrize("hot", [3000, 2])
def test_repeated_windows_like_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    random.seed(5)
    passage = [f"p{i}" for i in range(50)]
    fill = lambda n: [f"f{random.randint(0, 400)}" for _ in range(n)]
    texts = [fill(20) + passage + fill(random.randint(0, 30)) for _ in range(12)] + [["a", "b", "c"] * 30, fill(200)]
    texts.append(texts[0][:40] + ["new"] + texts[0][41:])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(docs).collect()}
    places = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 34):
            places.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, k + j) for at in places.values() if len(at) > 1 for i, k in at for j in range(35)}
    assert got == {i: " ".join(x for k, x in enumerate(w) if (i, k) not in gone) for i, w in enumerate(texts)}


def test_video_round_trip_and_index():
    random.seed(1)
    payloads = [bytes(random.randrange(256) for _ in range(64 * n)) for n in (1, 3, 40)] + [bytes(64), b"\xff" * 128, bytes([0, 255] * 64)]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    count = np.array([len(p) // 64 for p in payloads])
    files = media.write_avi(samples, count)
    back, frames = media.decode_videos(files)
    assert frames.tolist() == count.tolist() and back.tobytes() == b"".join(payloads)
    with pytest.raises(ValueError):
        media.read_index(b"no video")


def test_shots_follow_the_picture():
    frames = np.repeat(np.array([[10] * 64, [200] * 64], np.uint8), 10, axis=0)
    assert [x.tolist() for x in media.shots(frames, np.array([20]))] == [[0, 10]]


def test_links_like_brute_force(spark, monkeypatch):
    random.seed(7)
    base = [f"w{random.randint(0, 5000)}" for _ in range(120)]
    texts = [list(base) for _ in range(30)]
    for k, t in enumerate(texts):
        for _ in range(k % 4):
            t[random.randrange(len(t))] = f"x{random.randint(0, 99)}"
    texts += [[f"y{random.randint(0, 9999)}" for _ in range(80)] for _ in range(30)]
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    kinds = {}
    for t in texts:
        kinds.setdefault(tuple(t), {tuple(t[i : i + 5]) for i in range(len(t) - 4)})
    links = {k: 0 for k in kinds}
    for a, b in combinations(kinds, 2):
        if 5 * len(kinds[a] & kinds[b]) >= 4 * len(kinds[a] | kinds[b]):
            links[a] += 1
            links[b] += 1
    assert [got[i].n_links for i in range(len(texts))] == [links[tuple(t)] for t in texts]


def test_forest_depth_meets_its_recall():
    depth = ngram_join.forest_depth(0.8)
    recall = lambda d: 1 - (1 - 0.8**d) ** ngram_join.TREES
    assert recall(depth) >= ngram_join.RECALL > recall(depth + 1)


def test_near_lines_like_brute_force(spark):
    random.seed(9)
    letters = "abcdé "

    def edit(s):
        i = random.randrange(len(s))
        return random.choice([s[:i] + s[i + 1 :], s[:i] + random.choice(letters) + s[i:], s[:i] + random.choice(letters) + s[i + 1 :]])

    pool = ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) + "z" for _ in range(60)]
    pool += [edit(random.choice(pool)) for _ in range(150)]
    texts = ["\n".join(random.choice(pool) for _ in range(8)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    first, want = {}, {}
    for i, t in enumerate(texts):
        for k, s in enumerate(t.split("\n")):
            first.setdefault(s, (i, k))
    for i, t in enumerate(texts):
        kept = []
        for k, s in enumerate(t.split("\n")):
            near = (first[o] < (i, k) for o in first if o == s or (abs(len(o) - len(s)) < 2 and distance(o, s) <= 1))
            if not s.strip() or not any(near):
                kept.append(s)
        want[i] = "\n".join(kept)
    assert got == want


def test_lines_of_rows_without_an_id(spark):
    """Each text without an id is told of its own lines only, and of near lines that stand in the same place of several."""
    early, near = "one early line that stands alone here", "one early line that stands alone herd"
    docs = [(None, early)] + [(None, f"own beginning {i} {i * 7919}\n{near}\nown end {i * 104729}") for i in range(300)]
    docs += [(5, f"first of five, {c}\n{near}") for c in "abc"]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    read = frame.select(F.coalesce("doc_id", F.lit(lines._LEAST)).alias("id"), F.xxhash64("text").alias("doc"), "text")
    gone = lines.repeated_lines(read).collect()
    most = Counter((r.id, r.doc) for r in gone)
    assert len(most) >= 303 and max(most.values()) <= 3
    kept = lines.dedup_lines(frame).collect()
    assert len(kept) == len(docs) and not any(near in r.text for r in kept) and sum(early in r.text for r in kept) == 1


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(20_000)
    for n in (1, 7, 24):
        before, after = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        moved = before != after
        assert (after[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(before, minlength=n).min() > 0.8 * len(keys) / n


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("b", 100), ("a", 10), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weights, size = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 10, "b": 100, "c": 1000, None: 50}
    want, open_, left = {}, set(weights), 1160.0
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
            open_.remove(s)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_cube_keeps_words_and_documents_in_balance(spark):
    random.seed(2)
    rows = [(i, f"s{i % 3}", random.randint(1, 900)) for i in range(6000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), block_rows=500).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < 900
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) < 3


def test_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    random.seed(4)
    parts = [" ", "  ", "\n", "\t", "abc", "12", "<|endoftext|>", "é", "中文", "😀", "don't", " \n", "　", "\x00"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(500)]
    encoder, library = packing.Encoder(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _idf(lists):
    """The idf of every word that two texts or more have."""
    df = Counter(t for terms, _ in lists for t in terms.tolist())
    return {t: float(np.float32(np.log1p((len(lists) - n + 0.5) / (n + 0.5)))) for t, n in df.items() if n > 1}


def _asked(lists):
    idf = _idf(lists)
    kept = [[t for t in terms.tolist() if t in idf] for terms, _ in lists]
    return [(np.array(t, np.int64), np.array([idf[x] for x in t], np.float32)) for t in kept]


def test_neighbours_like_brute_force():
    random.seed(6)
    texts = [" ".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(1, 12))) for _ in range(60)]
    lists = packing.term_lists(pa.array(texts))
    idf, mean = _idf(lists), float(np.mean([tf.sum() for _, tf in lists]))
    index = packing.Index(lists, mean)
    index.unused[[0, 5]] = False
    score = {}
    for d, (terms, tf) in enumerate(lists):
        if d not in (0, 5):
            s = sum(idf.get(t, 0) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * tf.sum() / mean)) for t, n in zip(terms.tolist(), tf.tolist(), strict=True) if t in lists[0][0])
            if s > 0:
                score[d] = s
    best = sorted(score, key=lambda d: (-round(score[d], 4), d))[:5]
    assert [round(score[d], 3) for d in index.neighbours(*_asked(lists)[0])[:5]] == [round(score[d], 3) for d in best]


def test_neighbours_use_every_word_and_fill_a_long_window():
    rng = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(80)]
    lists = packing.term_lists(pa.array(texts))
    asked, idf, index = _asked(lists), _idf(lists), packing.Index(lists, 60.0)
    score = {d: sum(idf[t] for t in np.intersect1d(lists[0][0], lists[d][0]).tolist()) for d in range(1, 80)}
    best = sorted((d for d in score if score[d]), key=lambda d: (-round(score[d], 6), d))
    index.unused[0] = False
    assert index.neighbours(*asked[0]) == best and len(best) > 16
    index.unused[0] = True
    assert list(packing.order_by_retrieval(index, asked, [40] * 80))[: 1 + min(len(best), 51)] == [0, *best[:51]]


def test_frequencies_and_idf_of_words(spark):
    texts = ["a b c", "a b", "a a d", "e"]
    lists = packing.term_lists(pa.array(texts))
    rows = [(k, terms.tolist(), tf.tolist()) for k, (terms, tf) in enumerate(lists)]
    encoded = spark.createDataFrame(rows, "key long, terms array<long>, tf array<int>")
    df, count, mean = packing.document_frequencies(encoded)
    assert (count, mean) == (4, 9 / 4) and sorted(r.df for r in df.collect()) == [2, 3]
    got = {r.key: (r.terms, r.idf) for r in packing.with_idf(encoded.select("key", "terms"), df, count).collect()}
    for k, (terms, idf) in enumerate(_asked(lists)):
        assert got[k][0] == terms.tolist() and np.allclose(got[k][1], idf)


@pytest.mark.parametrize("shard_rows", [4096, 10])
def test_related_documents_of_different_splits_share_windows(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    rng = random.Random(9)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(20)]
    rows = [(100 * split + k, " ".join(rng.sample(words, 20))) for split in range(4) for k, words in enumerate(topics)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    pieces = packing.pack_documents(docs, 512).toPandas()
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all() and pieces["doc_id"].nunique() == 80
    assert (pieces.groupby("sequence_id")["length"].sum().isin([2**k for k in range(10)])).all()
    shared = pieces.merge(pieces, on="sequence_id")
    near = shared[(shared["doc_id_x"] % 100 == shared["doc_id_y"] % 100) & (shared["doc_id_x"] != shared["doc_id_y"])]
    assert near["doc_id_x"].nunique() >= 60


def test_fingerprints_see_local_edits():
    random.seed(8)
    text = "".join(random.choice("abcdefgh ") for _ in range(6000))
    edited = text[:3000] + "an edit" + text[3000:]
    a, b, c = (x.split(":") for x in fingerprints.fingerprints(pa.array([text, edited, text[::-1]])))
    assert a[0] == b[0] and sum(x != y for x, y in zip(a[1], b[1], strict=False)) < len(a[1])
    assert a[1][:10] == b[1][:10] and a[1][-10:] == b[1][-10:] and a[1][:10] != c[1][:10]


def test_models_learn_planted_signs(spark):
    random.seed(10)
    plain = lambda: [f"{random.choice('bcdfg')}{random.choice('aeiou')}{random.choice('lmnrs')}" for _ in range(40)]
    rows = []
    for i in range(1500):
        w, bad = plain(), i % 5 == 0
        if bad:
            w[random.randrange(40)] = "zzqxk" + random.choice("abc")
        rows.append((i, " ".join(w) if i % 7 else " ".join(x.upper() + "!!" for x in w), int(i % 7 != 0), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()
    got = {r.doc_id: r for r in toxicity.score_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()}
    held = [(got[i].predicted, t) for i, _, _, t in rows if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97
    graded = quality.grade_documents(table.select("doc_id", "text"), table.selectExpr("doc_id", "quality * 2 as grade"), grades=3).collect()
    good = {i: q for i, _, q, _ in rows}
    assert np.mean([r.keep == good[r.doc_id] for r in graded if r.held_out]) > 0.97


def test_thresholds_are_ordered():
    _, cuts = quality.fit_ordinal([np.array([k % 3], np.int32) for k in range(60)], [np.ones(1, np.float32)] * 60, np.arange(60) % 3, 3)
    assert cuts[0] < cuts[1]


def test_texts_under_one_doc_id_keep_their_links(spark):
    near = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    a, b = near("a"), near("b")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b), (3, b), (None, b + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.copy_of, r.copies, r.n_links, r.n_linked_docs) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {(1, 1, 1, 1, 1, 1), (2, 1, 2, 1, 1, 1), (1, None, 1, 3, 1, 1), (3, None, 1, 3, 1, 1), (None, None, None, 1, 1, 3)}
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, b + " end"), (1, a)]


def _jaccard_links(texts):
    kinds = {t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in dict.fromkeys(texts)}
    return kinds, [(a, b) for a, b in combinations(kinds, 2) if 5 * len(kinds[a] & kinds[b]) >= 4 * len(kinds[a] | kinds[b])]


@pytest.mark.parametrize("block", [256, 3])
def test_classes_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for k in range(12):
        base = [f"{k}x{rng.randint(0, 500)}" for _ in range(90)]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(90)] = f"new{rng.randint(0, 9999)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    kinds, pairs = _jaccard_links(texts)
    root = {t: t for t in kinds}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in pairs:
        root[find(a)] = find(b)
    least, links = {}, Counter(t for p in pairs for t in p)
    for i, t in enumerate(texts):
        least.setdefault(find(t), i)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(pairs) > 20 and got == {i: (least[find(t)], links[t]) for i, t in enumerate(texts)}


def test_over_full_nodes_are_parted_where_they_share_least():
    shared = np.array([9, 7, 12, 12, 8, 12, 12, 12, 7, 12])
    parts = ngram_join.part_node(shared, 4)
    assert parts[0] == (0, 3) and parts[-1][1] == 11
    assert all(a[1] - 1 == b[0] for a, b in zip(parts[:-1], parts[1:], strict=True)) and all(b - a <= 5 for a, b in parts)
    assert ngram_join.part_node(shared, 11) == [(0, 11)]


def test_links_of_real_documents_like_all_pairs(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.sql(f"select doc_id, class_id, n_links from ({queries.ORACLES['op4_ngram_join']})").fetchall()
    got = queries.op4_ngram_join(spark, "/root/testdata/sf0.01").select("doc_id", "class_id", "n_links").collect()
    assert sum(n for *_, n in want) > 0 and sorted(tuple(r) for r in got) == sorted(want)


def test_components_say_when_they_are_not_finished(spark):
    chain = spark.range(64).selectExpr("id as a", "id + 1 as b")
    assert components.components(chain).where("component <> 0").count() == 0
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)


def test_hashes_tell_patterned_runs_apart():
    a, b = "a", "b"
    for _ in range(12):  # sequences on which every polynomial modulo 2**64 agrees
        a, b = a + b, b + a
    raw, n = np.frombuffer((a + b).encode(), np.uint8), len(a)
    at = np.array([0, n])
    one, two = common.prime_rolling(3).runs(raw, at, at + n)
    assert one != two
    skipped = common.prime_rolling(3).runs(raw, at, at + n, at + 5, at + 9)
    joined = np.concatenate([raw[:5], raw[9:n]])
    assert skipped[0] == common.prime_rolling(3).runs(joined, np.array([0]), np.array([n - 4]))[0]
    words = common.Words(pa.array([f"{a} {b} {a}"]))
    first, second, third = common.word_hashes(words, 2)
    assert first == third != second


def test_substrings_come_from_the_index_alone(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"{k}a {k}b {passage} {k}c") for k in range(5)] + [(9, "x " * 100), (10, "y " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.intervals] for r in substrings.remove_repeats(docs).collect()}
    assert got == {**{k: [(2, 61)] for k in range(5)}, 9: [(0, 99)], 10: []}
    found = substrings.duplicate_marks(substrings._keyed(docs))
    assert found.count() > 0
    for hot in (3000, 1):  # an index that finds nothing leaves nothing marked
        monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
        monkeypatch.setattr(substrings, "_search", lambda window: lambda batches: iter(()))
        assert substrings.duplicate_marks(substrings._keyed(docs)).count() == 0


def _slow_fingerprint(text):
    """A fingerprint byte by byte."""
    raw = text.encode()

    def ends_at(i, level):
        if i < fingerprints.WINDOW - 1:
            return False
        h = sum(int(fingerprints._TABLE[raw[i - k]]) * pow(0x01000193, k, 2**32) for k in range(fingerprints.WINDOW)) % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2**32
        h ^= h >> 13
        return h % 2**level == 0

    def signature(level):
        pieces, start = [], 0
        for i in range(len(raw)):
            size = i + 1 - start
            if i + 1 == len(raw) or size == 8 << level or (size >= (1 << level) // 4 and ends_at(i, level)):
                pieces.append(raw[start : i + 1])
                start = i + 1
        return "".join(fingerprints._DIGITS[xxhash.xxh3_64_intdigest(p) & 63] for p in pieces)

    levels = [k for k in range(2, 20) if k == 2 or len(signature(k)) >= fingerprints.LEAST_PIECES]
    return f"{levels[-1]}:{signature(levels[-1])}:{signature(levels[-1] + 1)}"


def test_fingerprints_like_brute_force():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh é\n") for _ in range(n)) for n in (0, 1, 6, 7, 40, 300, 2500)] + ["b" * 3000, "the " * 500]
    assert fingerprints.fingerprints(pa.array(texts)) == [_slow_fingerprint(t) for t in texts]


def test_likeness_like_brute_force(spark):
    rng = random.Random(13)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    prints = fingerprints.fingerprints(pa.array([text, text[:3000], text[:2000] + text[2100:], text * 3, "", "ab", text[::-1]]))
    rows = [(a, b) for a in prints for b in prints]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for r in got:
        (ka, *sa), (kb, *sb) = r.a.split(":"), r.b.split(":")
        common_ = [(x, y) for i, x in enumerate(sa) for j, y in enumerate(sb) if int(ka) + i == int(kb) + j]
        want = max([1 - distance(x, y) / max(len(x), len(y), 1) for x, y in common_], default=0.0)
        assert abs(r.x - want) < 1e-9


def test_repeating_text_has_a_short_fingerprint():
    for text in ("b" * 5_000_000, "the " * 250_000, "abcdefghijkl" * 80_000):
        assert len(fingerprints.fingerprints(pa.array([text]))[0]) < 4200


def test_many_rows_with_one_doc_id_are_parted(spark):
    rows = [(7, f"text {i}") for i in range(400)] + [(8, "eight"), (6, "six")]
    ranges = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert ranges.where("not seam").groupBy("part").count().count() >= 6
    found = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert found.count() == 402


def test_words_are_right_even_with_one_huge_document(spark):
    rng = random.Random(14)
    rows = [(i, f"s{i % 2}", 20_000 if i < 2 else rng.randint(1, 700)) for i in range(900)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), block_rows=450).collect()
    for s in ("s0", "s1"):
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 5
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) < 3


def test_jump_hash_like_the_published_loop():
    def jump(key, buckets):
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.array([0, 1, 2, -1, 10**12, -(2**63), *range(100, 600)], np.int64)
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in common.mix(keys.view(np.uint64))]


def test_toxicity_plans_stay_small_on_the_driver(spark, monkeypatch):
    grams = spark.createDataFrame([(x * 7919 % 256**6, x % 3, 1) for x in range(1, 500)], "gram long, toxic long, ordinary long")
    plans, tables = [], []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables.append(common.written(df, name))
        return tables[-1]

    monkeypatch.setattr(toxicity, "written", noted, raising=True)
    model = toxicity.continuation_model(grams)
    plans.append(model._jdf.queryExecution().executedPlan().toString())
    assert max(p.count("Exchange hashpartitioning") for p in plans) <= 3  # of all orders in one plan over 30
    left = [t for t in tables if os.path.isdir(t.written_to.removeprefix("file://"))]
    assert left == tables[-1:]
    assert model.count() == grams.select(F.col("gram").bitwiseAND(F.lit(256**5 - 1))).distinct().count()


def test_kneser_ney_like_dictionaries(spark):
    rng = random.Random(15)
    texts = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(20)]
    label = [rng.choice([0, 1, None]) for _ in texts]
    tagged = spark.createDataFrame(list(zip(texts, label, strict=True)), "text string, toxic int")
    grams, values, contexts, unseen = toxicity.ratio_tables(toxicity.gram_counts(tagged))
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    own = {0: Counter(), 1: Counter()}
    every = set()
    for t, c in zip(texts, label, strict=True):
        for w in t.split():
            line = " " * (n - 1) + w + " "
            for i in range(n - 1, len(line)):
                g = line[i - n + 1 : i + 1]
                every.add(g)
                if c is not None:
                    own[c][g] += 1
    orders, level = {}, every
    for k in range(n - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in level)
        level = set(orders[k])

    def shared(g):
        if not g:
            return 1 / 256
        same = {x: c for x, c in orders[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return (same[g] - d) / total + d * len(same) / total * shared(g[1:])

    def p(c, g):
        same = {x: k for x, k in own[c].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return max(own[c][g] - d, 0) / max(total, 1) + (d * len(same) / total if total else 1) * shared(g[1:])

    pack = lambda g: sum(ord(x) << (8 * k) for k, x in enumerate(reversed(g)))
    want = {pack(g): np.log(p(1, g)) - np.log(p(0, g)) for g in every if own[0][g] + own[1][g]}
    assert grams.tolist() == sorted(want) and np.allclose(values, [want[g] for g in grams.tolist()], atol=1e-5)
    rest = lambda c, k: (lambda s: d * len(s) / sum(s.values()) if s else 1.0)({x: v for x, v in own[c].items() if pack(x) >> 8 == k})
    assert np.allclose(unseen, [np.log(rest(1, k)) - np.log(rest(0, k)) for k in contexts.tolist()], atol=1e-5)


def test_counted_texts_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "ab " * (10 + i)) for i in range(60)] + [(60, "long " * 40_000), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(61)], "doc_id long, toxic int, fold int")
    every = toxicity.counting_rows(docs, labels, 100, 1 << 20).collect()
    assert sorted(r.doc_id for r in every) == list(range(60))  # the long one has over a sixteenth of the bytes
    size = {i: 3 * (10 + i) for i in range(60)}
    some = toxicity.counting_rows(docs, labels, 100, 3400).collect()
    for c in (0, 1):
        own = sum(size[r.doc_id] for r in some if r.toxic == c)
        assert 3400 - 3 * 70 < own <= 3400
    assert len(toxicity.counting_rows(docs, labels, 5, 1 << 20).collect()) == 10


def test_a_very_long_labelled_text_is_scored_and_not_counted(spark):
    rows = [(i, "you vile rotten fool" if i % 2 else "a calm walk by the lake") for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, "a calm walk by the lake " * 20_000), (401, "you vile rotten fool " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(402)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels, class_bytes=1 << 20).collect()}
    assert len(found) == 402 and all(v == i % 2 for i, v in found.items() if i < 400)
    assert (found[400], found[401]) == (0, 1)


def test_the_cut_has_the_best_f1():
    rng = np.random.default_rng(1)
    z = np.round(rng.normal(size=200), 1)
    y = (z + rng.normal(size=200) > 1).astype(float)
    f1 = lambda cut: 2 * ((z > cut) & (y > 0)).sum() / ((z > cut).sum() + y.sum())
    assert f1(toxicity.best_cut(z, y)) == max(f1(c) for c in np.unique(z) - 1e-6)


def test_ordinal_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 4)).astype(np.int32) for _ in range(300)]
    values = [np.ones(len(r), np.float32) for r in rows]
    truth = rng.normal(size=12)
    grade = np.digitize([truth[r].sum() + rng.logistic() for r in rows], [-1.0, 1.0])
    weight, cuts = quality.fit_ordinal(rows, values, grade, 3, steps=1500, ridge=1e-3, rate=0.02)

    def loss(w, c):
        f = np.array([w[r].sum() for r in rows])
        tail = np.concatenate([np.ones((300, 1)), 1 / (1 + np.exp(-(f[:, None] - c))), np.zeros((300, 1))], axis=1)
        return -np.log(tail[np.arange(300), grade] - tail[np.arange(300), grade + 1]).mean() + 5e-4 * (w**2).sum()

    w = weight[:12].astype(float)
    best = loss(w, cuts)
    for k in range(12):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, cuts) > best - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = cuts.copy()
            moved[k] += step
            assert loss(w, moved) > best - 1e-6


def test_without_ratings_thresholds_are_ordered_and_all_stay(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    rows = quality.grade_documents(docs, spark.createDataFrame([], "doc_id long, grade int"), grades=3).collect()
    assert [r.keep for r in rows] == [1, 1] and all(abs(r.expected_grade - (0.5 + 1 / (1 + np.e))) < 1e-9 for r in rows)


class _Jpeg:
    """A slow baseline encoder: planes of quantised blocks to a frame, with the common Huffman tables."""

    def __init__(self, planes, quant, sampling, size, restart=0, own_tables=False):
        self.bits, self.out, self.codes = [], bytearray(b"\xff\xd8"), {}
        for key, (counts, symbols) in media._COMMON.items():
            n, own = bytes.fromhex(counts), bytes.fromhex(symbols)
            if key[0]:
                own += bytes(s for s in range(256) if s >> 4 < 16 and 1 <= s & 15 <= 10 and s not in own)
            code, k = 0, 0
            for length in range(1, 17):
                for _ in range(n[length - 1]):
                    self.codes[key, own[k]] = (code, length)
                    code, k = code + 1, k + 1
                code <<= 1
            if own_tables:
                self.segment(0xC4, bytes([key[0] << 4 | key[1]]) + n + own)
        zigzag = [int(x) for x in media._ZIGZAG]
        for i, q in enumerate(quant):
            self.segment(0xDB, bytes([i]) + bytes(int(q[z]) for z in zigzag))
        parts = b"".join(bytes([i + 1, h << 4 | v, min(i, len(quant) - 1)]) for i, (v, h) in enumerate(sampling))
        self.segment(0xC0, b"\x08" + size[0].to_bytes(2, "big") + size[1].to_bytes(2, "big") + bytes([len(planes)]) + parts)
        if restart:
            self.segment(0xDD, restart.to_bytes(2, "big"))
        scan = b"".join(bytes([i + 1, 0x11 if i else 0]) for i in range(len(planes)))
        self.segment(0xDA, bytes([len(planes)]) + scan + b"\x00\x3f\x00")
        last = [0] * len(planes)
        rows, columns = planes[0].shape[0] // sampling[0][0], planes[0].shape[1] // sampling[0][1]
        for mcu in range(rows * columns):
            if restart and mcu and mcu % restart == 0:
                self.flush()
                self.out += bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
                last = [0] * len(planes)
            r, c = divmod(mcu, columns)
            for i, (v, h) in enumerate(sampling):
                for y in range(v):
                    for x in range(h):
                        block = planes[i][r * v + y, c * h + x].reshape(-1)[zigzag]
                        self.value((0, min(i, 1)), 0, int(block[0]) - last[i])
                        last[i], run = int(block[0]), 0
                        for k in range(1, 64):
                            if block[k] == 0:
                                run += 1
                                continue
                            while run > 15:
                                self.code((1, min(i, 1)), 0xF0)
                                run -= 16
                            self.value((1, min(i, 1)), run, int(block[k]))
                            run = 0
                        if run:
                            self.code((1, min(i, 1)), 0)
        self.flush()
        self.frame = bytes(self.out) + b"\xff\xd9"

    def segment(self, marker, body):
        self.out += bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def put(self, value, length):
        self.bits += [value >> (length - 1 - i) & 1 for i in range(length)]

    def code(self, table, symbol):
        self.put(*self.codes[table, symbol])

    def value(self, table, run, x):
        n = abs(x).bit_length()
        self.code(table, run << 4 | n)
        self.put(x if x > 0 else x + (1 << n) - 1, n)

    def flush(self):
        self.bits += [1] * (-len(self.bits) % 8)
        for i in range(0, len(self.bits), 8):
            byte = int("".join(map(str, self.bits[i : i + 8])), 2)
            self.out += bytes([byte]) + (b"\x00" if byte == 255 else b"")
        self.bits = []


def _inverse(block, quant):
    out = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            a = np.cos((2 * np.arange(8) + 1) * u * np.pi / 16) * (1 if u else np.sqrt(0.5)) / 2
            b = np.cos((2 * np.arange(8) + 1) * v * np.pi / 16) * (1 if v else np.sqrt(0.5)) / 2
            out += block[u, v] * quant[u * 8 + v] * np.outer(a, b)
    return np.clip(np.rint(out + 128), 0, 255)


@pytest.mark.parametrize(("sampling", "size", "restart", "own"), [([(1, 1)], (20, 30), 0, False), ([(2, 2), (1, 1), (1, 1)], (30, 50), 0, True), ([(2, 1), (1, 1), (1, 1)], (33, 16), 3, False), ([(1, 1)], (64, 64), 5, True)])
def test_any_baseline_frame_is_decoded(sampling, size, restart, own):
    rng = np.random.default_rng(5)
    down, across = max(v for v, _ in sampling), max(h for _, h in sampling)
    rows, columns = -(-size[0] // (8 * down)), -(-size[1] // (8 * across))
    quant = [rng.integers(1, 30, 64), rng.integers(1, 40, 64)][: len(sampling)]

    def video():
        planes = []
        for v, h in sampling:
            p = rng.integers(-12, 13, (rows * v, columns * h, 8, 8)) * (rng.random((rows * v, columns * h, 8, 8)) < 0.15)
            p[:, :, 0, 0] = rng.integers(-30, 31, p.shape[:2])
            planes.append(p)
        return planes

    frames = [video() for _ in range(3)]
    coded = [_Jpeg(p, quant, sampling, size, restart, own).frame for p in frames]
    for planes, frame in zip(frames, coded, strict=True):
        for i, got in enumerate(media.decode_planes(frame)):
            q = quant[min(i, len(quant) - 1)]
            want = np.block([[_inverse(b, q) for b in row] for row in planes[i]])
            height, width = -(-size[0] * sampling[i][0] // down), -(-size[1] * sampling[i][1] // across)
            assert got.shape == (height, width) and np.abs(got.astype(int) - want[:height, :width]).max() <= 1
    lengths = np.array([len(f) for f in coded])
    means = media.decode_frames(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(lengths) - lengths, lengths)
    for planes, got in zip(frames, means, strict=True):
        v, h = sampling[0]
        want = np.clip(planes[0][:, :, 0, 0] * int(quant[0][0]) // 8 + 128, 0, 255)
        assert (got == want.reshape(rows, v, columns, h).transpose(0, 2, 1, 3).reshape(-1)).all()


def test_videos_of_other_writers_and_none_at_all(spark):
    rng = np.random.default_rng(6)
    chunk = lambda tag, body: tag + len(body).to_bytes(4, "little") + body + b"\x00" * (len(body) % 2)
    frames = []
    for level in (-20, 25):
        for _ in range(6):
            p = rng.integers(-2, 3, (2, 2, 8, 8))
            p[:, :, 0, 0] = level
            frames.append(_Jpeg([p], [np.full(64, 16)], [(1, 1)], (16, 16)).frame)
    movie = chunk(b"LIST", b"rec " + b"".join(chunk(b"00dc", f) for f in frames[:4])) + b"".join(chunk(b"00dc", f) for f in frames[4:])
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", (500_000).to_bytes(4, "little") + bytes(52))) + chunk(b"LIST", b"movi" + movie)
    mine = media.texts_as_video(pa.array(["some text"]))[0]
    rows = [(1, bytearray(chunk(b"RIFF", body))), (2, bytearray(b"no video")), (3, None), (4, bytearray(mine)), (5, bytearray(chunk(b"RIFF", body)[:700]))]
    got = media.media_clips(spark.createDataFrame(rows, "doc_id long, media binary").repartition(1)).collect()
    assert sorted((r.doc_id, r.clip, r.first_frame, r.frames, r.start_s, r.end_s) for r in got if r.doc_id != 5) == [(1, 0, 0, 6, 0.0, 3.0), (1, 1, 6, 6, 3.0, 6.0), (4, 0, 0, 1, 0.0, 0.04)]


def test_a_long_text_is_stored_in_runs(monkeypatch):
    monkeypatch.setattr(media, "RUN", 50)
    text = "some words in a row " * 600
    one = media.texts_as_video(pa.array([text]))
    samples, count = media.decode_videos(one)
    assert samples.tobytes()[: len(text)] == text.encode() and count.tolist() == [-(-len(text) // 64)]
    monkeypatch.setattr(media, "RUN", 1 << 14)
    assert media.texts_as_video(pa.array([text])) == one


def test_ids_of_real_documents_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder, library = packing.Encoder(packing.vocabulary_path()), Tokenizer.from_file(packing.vocabulary_path())
    assert all(np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
