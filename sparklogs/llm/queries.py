"""The queries of this subpackage: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklogs.llm import conversations, fingerprints, hard_negatives, language, lines, media, mixing, ngram_join, packing, quality, sharding, substrings, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_docs(spark, sf_dir)).drop("kept", "intervals")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_docs(spark, sf_dir))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots of the videos that ``op3_media`` describes, as timed clips."""
    return media.media_clips(media.media_table(_docs(spark, sf_dir).select("doc_id", "text")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_docs(spark, sf_dir)).drop("class_hash")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir), 24)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.written(mixing.word_sizes(_docs(spark, sf_dir), ["doc_id", "source"]), "sizes")
    mixed = mixing.mix_sources(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(_docs(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; documents more likely than not to be above 0 are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    graded = quality.grade_documents(_docs(spark, sf_dir).select("doc_id", "text"), ratings, grades=3)
    return graded.select("doc_id", "held_out", "expected_grade", "tail_probability", "keep")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_language(_docs(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_conversations(conversations.damage(table), table)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substrings, op2_packing, op3_media, op4_ngram_join, op5_toxicity, op6_sharding, op7_mixing, op8_fingerprints, op9_lines, op10_quality, op11_language, op12_negatives, op13_conversations, media_clips)
}
#: Lines that an earlier one equals or is one edit away from, by plain edit distance of all lines of about one length.
#: DuckDB's distance counts bytes, and a character has four at most: what it lets pass is compared without one character.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS s
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
), solid AS (SELECT * FROM lines WHERE regexp_matches(s, '[^ \t-\r]')
), firsts AS (
  SELECT s, min(struct_pack(doc_id := doc_id, line := line)) AS spot, length(s) AS n FROM solid GROUP BY s
), longer AS (
  SELECT s, spot, n + k AS n FROM firsts, (SELECT unnest([-1, 0, 1]) AS k)
), near AS (
  SELECT DISTINCT b.spot FROM longer a JOIN firsts b ON a.n = b.n AND a.spot < b.spot
  WHERE levenshtein(a.s, b.s) <= 4 AND len(list_filter(range(0, length(a.s) + 1), lambda i: left(a.s, i) = left(b.s, i)
    AND substring(a.s, i + 1 + (length(a.s) >= length(b.s))::INTEGER) = substring(b.s, i + 1 + (length(b.s) >= length(a.s))::INTEGER))) > 0
), gone AS (
  SELECT x.doc_id, x.line FROM solid x JOIN firsts f ON x.s = f.s WHERE struct_pack(doc_id := x.doc_id, line := x.line) > f.spot
  UNION SELECT spot.doc_id, spot.line FROM near
)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.line) AS INTEGER) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN g.line IS NULL THEN l.s END, chr(10) ORDER BY l.line), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
"""

#: Words, their windows of 35 as hashes, and what windows that start twice cover.
OP1_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
words AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS k FROM docs),
windows AS (
  SELECT doc_id, k, md5(array_to_string(list(word) OVER w, ' ')) AS seen FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) QUALIFY count(*) OVER w = 35
), twice AS (SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY seen) > 1
), marked AS (SELECT doc_id, k, k - coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -99) < 35 AS gone, word
  FROM (SELECT w.doc_id, w.k, w.word, t.k AS start FROM words w LEFT JOIN twice t USING (doc_id, k)))
SELECT d.doc_id, count(m.k) AS n_words, count(m.k) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY m.k) FILTER (NOT gone), '')) AS kept_sha256
FROM docs d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""

#: Runs of five words of all different texts, all pairs that share one, and the closure of the links.
OP4_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), ' ') AS s FROM documents),
kinds AS (SELECT s, min(doc_id) AS id, count(*) AS copies FROM docs GROUP BY s),
words AS (SELECT id, unnest(string_split(s, ' ')) AS word, generate_subscripts(string_split(s, ' '), 1) AS k, len(string_split(s, ' ')) AS n FROM kinds WHERE s <> ''),
runs AS (SELECT DISTINCT id, array_to_string(list(word) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS g, k <= greatest(n - 4, 1) AS whole FROM words QUALIFY whole),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY 1),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM runs a JOIN runs b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS id, min(b) AS least FROM reach GROUP BY 1),
degree AS (SELECT a AS id, count(*) AS n_links, sum(copies) AS docs_ FROM links JOIN kinds ON b = id GROUP BY 1)
SELECT doc_id, least(id, coalesce(least, id)) AS class_id, id AS copy_of, copies, coalesce(n_links, 0) AS n_links, CAST(coalesce(docs_, 0) AS BIGINT) AS n_linked_docs
FROM docs JOIN kinds USING (s) LEFT JOIN classes USING (id) LEFT JOIN degree USING (id)
"""


def _times(x: str, factor: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


#: CRC-32 byte by byte, and the jump hash of a mixed key step by step; slots follow doc_id, as the rows of the table do.
OP6_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) r(i) UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, octet_length(encode(s)) + 8 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))),
  lambda acc, x: xor(t[(xor(acc, x) & 255) + 1], acc >> 8)), 4294967295) AS text_crc32 FROM docs, tab),
m1 AS (SELECT doc_id, CAST(coalesce(doc_id, 0) AS UBIGINT) AS k FROM documents),
m2 AS (SELECT doc_id, {_times("xor(k, k >> 30)", 0xBF58476D1CE4E5B9)} AS k FROM m1),
m3 AS (SELECT doc_id, {_times("xor(k, k >> 27)", 0x94D049BB133111EB)} AS k FROM m2),
jumps AS (
  SELECT doc_id, n, xor(k, k >> 31) AS state, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS jump FROM m3, (SELECT unnest([24, 25]) AS n)
  UNION ALL SELECT doc_id, n, s, jump, CAST(floor((jump + 1) * (CAST(2147483648 AS DOUBLE) / CAST((s >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, CAST((CAST(state AS UHUGEINT) * CAST(2862933555777941757 AS UHUGEINT) + CAST(1 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS s FROM jumps WHERE jump < n)
), placed AS (SELECT doc_id, CAST(max(place) FILTER (n = 24) AS INTEGER) AS shard, CAST(max(place) FILTER (n = 25) AS INTEGER) AS grown_shard FROM jumps WHERE jump >= n GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM crcs JOIN placed USING (doc_id)
"""


def _edits(state: int) -> str:
    """The cheapest way from a row on, as (cost, audit, repaired rows), without inserts before it; a missing way costs 10**9."""
    def way(letter: str, cost: str, to: int, role: str = "", when: str = "true") -> str:
        row = f"{role} || ':' || text || coalesce(chr(10) || s{to}.r, '')" if role == "role" else f"'{role}:' || text || coalesce(chr(10) || s{to}.r, '')" if role else f"s{to}.r"
        return f"CASE WHEN {when} THEN struct_pack(c := s{to}.c + {cost}, a := '{letter}' || s{to}.a, r := {row}) ELSE struct_pack(c := 1000000000, a := '', r := NULL) END"

    kept = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]
    other, new = (3, "assistant") if state == 2 else (2, "user")
    ways = [way("D", "3", state), way("R", "2 + late", other, new, "NOT gone"), *(way("K", "late", to, "role", f"NOT gone AND left(role, 1) = '{x}'") for x, to in kept)]
    return f"list_min([{', '.join(ways)}])"


def _inserts(state: int) -> str:
    """The cheapest way with up to two inserts before the row."""
    one = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    a, b = one[state], one[one[state]]
    first, second = f"'{name[a]}:' || coalesce(chr(10) || b{a}.r, '')", f"'{name[a]}:' || chr(10) || '{name[b]}:' || coalesce(chr(10) || b{b}.r, '')"
    return f"list_min([b{state}, struct_pack(c := b{a}.c + 2, a := 'I' || b{a}.a, r := {first}), struct_pack(c := b{b}.c + 4, a := 'II' || b{b}.a, r := {second})])"


#: Damage row by row, faults by window functions, and the cheapest repair from the last row back, one row a step.
OP13_SQL = rf"""
WITH RECURSIVE bits AS (SELECT i, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) r(i) UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
keyed AS (SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))),
  lambda acc, x: xor(t[(xor(acc, x) & 255) + 1], acc >> 8)), 4294967295) % 20 AS kind FROM keyed, tab),
rows_ AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS time FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM rows_),
placed AS (SELECT conv_id, turn, role, text, nth, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS before,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), nth)),
faulty AS (SELECT *, CASE WHEN solid = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
steps AS (
  SELECT conv_id, n + 1 AS k, struct_pack(c := 0, a := '', r := CAST(NULL AS VARCHAR)) AS s0, struct_pack(c := 4, a := 'II', r := 'user:' || chr(10) || 'assistant:') AS s1,
    struct_pack(c := 2, a := 'I', r := 'assistant:') AS s2, struct_pack(c := 0, a := '', r := CAST(NULL AS VARCHAR)) AS s3 FROM counted
  UNION ALL SELECT conv_id, k, {', '.join(f'{_inserts(q)} AS s{q}' for q in range(4))}
  FROM (SELECT conv_id, k, {', '.join(f'{_edits(q)} AS b{q}' for q in range(4))}
    FROM (SELECT f.conv_id, f.k, f.role, f.text, f.fault IN ('b', 'd') AS gone, (f.fault = 't')::INTEGER AS late, s0, s1, s2, s3 FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k - 1))
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN (SELECT * FROM steps WHERE k = 1) s ON i.conv_id IS NOT DISTINCT FROM s.conv_id
"""

#: All inner products of anchors and rows.
OP12_SQL = """
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n USING (anchor_id) WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op1_substrings": OP1_SQL, "op4_ngram_join": OP4_SQL, "op6_sharding": OP6_SQL, "op9_lines": OP9_SQL, "op12_negatives": OP12_SQL, "op13_conversations": OP13_SQL}
