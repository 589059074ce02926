"""Language: grams by brute force, machines against a slow fit, held-out accuracy, and odd rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparklogs.llm import language
from sparklogs.llm.language import BUCKETS, Line, Machines, family_of, fit_machine, identify_language

DATA = "/root/testdata/sf0.01"
TEXTS = ["Où est-ce?", "", "12 !!", None, "É", "a", "中文 text", "x" * 3000 + " ÄB", " tail "]


def plain_buckets(text, size):
    line = b"   " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()) + b" "
    out = []
    for end in range(3, len(line)):
        gram = line[end - size + 1 : end + 1]
        if gram.strip(b" "):
            out.append((((int.from_bytes(gram, "big") ^ (size - 1)) * 0x9E3779B1) % 2**32) >> 16)
    return out


def test_grams_like_brute_force(monkeypatch):
    line = Line(pa.array(TEXTS))
    rows, values = line.shares()
    weight = np.zeros((BUCKETS + 1, 2), np.int32)
    weight[:-1] = np.random.default_rng(1).integers(-1000, 1000, (BUCKETS, 2))
    sums = [line.sums(weight)]
    monkeypatch.setattr(language, "_STEP", 7)  # many parts of a text, and texts of many in a part
    sums.append(line.sums(weight))
    for total, count in sums:
        for i, text in enumerate(TEXTS):
            want = [b for size in language.SIZES for b in plain_buckets(text or "", size)]
            assert count[i] == len(want) and total[i].tolist() == weight[want].sum(axis=0).tolist()
    for i, text in enumerate(TEXTS):
        want = [b for size in language.SIZES for b in plain_buckets(text or "", size)]
        assert rows[i].tolist() == sorted(set(want))
        assert np.allclose(values[i], [want.count(b) / len(want) for b in rows[i]])


def test_a_machine_finds_the_least_loss():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    values = [rng.random(6).astype(np.float32) / 4 for _ in rows]
    first = np.array([v[r < 10].sum() > v[r >= 10].sum() for r, v in zip(rows, values)])
    weight, bias = fit_machine(rows, values, first, ridge=1e-2, steps=40)
    x = np.zeros((60, 21))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r] = v * language.SCALE
    x[:, 20] = 1
    keep, y = np.append(np.full(20, 1e-2), 1e-6), np.where(first, 1.0, -1.0)
    share = np.where(first, 0.5 / first.sum(), 0.5 / (~first).sum())
    loss = lambda w: (keep * w * w).sum() / 2 + (share * np.maximum(1 - y * (x @ w), 0) ** 2).sum()
    w = np.zeros(21)
    for _ in range(20_000):  # plain gradient steps
        w -= 0.02 * (keep * w - 2 * x.T @ (share * y * np.maximum(1 - y * (x @ w), 0)))
    assert loss(np.append(weight[:20], bias)) <= loss(w) + 1e-3
    assert not weight[20:].any()


def test_families_come_first():
    assert [family_of(x) for x in ("de", "en", "fr-CA", "PT_br", "xx")] == ["germanic", "germanic", "romance", "romance", "xx"]
    machines = Machines(["de", "en", "es", "fr", "xx"], language.FAMILY_OF)
    assert machines.pairs == [(True, "germanic", "romance"), (True, "germanic", "xx"), (True, "romance", "xx"), (False, "de", "en"), (False, "es", "fr")]
    margin = np.array([[1.0, 1.0, 0.5, -1.0, 1.0], [-1.0, -2.0, -0.1, 1.0, 1.0]])
    machines.weight = np.zeros((BUCKETS + 1, 5), np.int32)
    names = sorted(machines.members)
    assert [names[k] for k in machines._choose(names, margin, True)[0]] == ["germanic", "xx"]
    assert machines._choose(["de", "en"], margin, False)[0].tolist() == [1, 0]
    for bias, want in ((margin[0], "en"), (margin[1], "xx")):
        machines.bias = bias
        assert machines.predict(pa.array(["text", "12", None]))[0].tolist() == [want, "und", "und"]


def test_held_out_accuracy_and_whole_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = identify_language(docs).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    assert all(0 < r.score <= 1 for r in rows if re.search("[a-z]", r.text))


def test_answers_do_not_depend_on_language_source_or_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300")
    asked = docs.withColumns({"lang": F.when(language.held_out(F.col("doc_id")), "de").otherwise(F.col("lang")), "source": F.lit("s")})
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in identify_language(t).collect()} for t in (docs, asked))
    assert one == two


def test_odd_rows(spark):
    learn = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "the house and the garden " * 3 if k % 2 else "das haus und der garten " * 3, "en" if k % 2 else "de") for k, i in enumerate(learn)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 + 3\t\n", None), (103, "THE GARDEN", None), (None, "der garten", "de"), (104, "haus und garten " * 20_000, None), (100, "le jardin", "fr"), (105, "Ü", None)]
    table = spark.createDataFrame([(*r, "a", "b", "c", 1, 2) for r in rows + odd], "doc_id long, text string, lang string, score string, lang_pred string, held_out string, draw int, k int").repartition(3)
    got = identify_language(table, class_rows=12).collect()
    assert len(got) == len(rows + odd)
    by = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got}
    assert by[100, None] == by[101, ""] == by[102, "12 + 3\t\n"] == ("und", 0.0)
    assert by[103, "THE GARDEN"][0] == "en" and by[104, "haus und garten " * 20_000][0] == "de" and by[105, "Ü"][0] in ("de", "en", "fr")
    assert identify_language(table.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in identify_language(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in identify_language(table.withColumn("lang", F.lit("xx"))).collect()} == {"xx", "und"}
