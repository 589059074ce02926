"""Registered queries on retrieval, evidence, answers and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklogs.functions import text
from sparklogs.operators import evaluation, evidence, retrieval, text_index
from sparklogs.plans.bridge import CHUNKS_SQL, HITS_SQL, NOW, VARIANTS_SQL, chunks, hits, scratch, spread, synonyms_sql, table
from sparklogs.plans.registry import query
from sparklogs.sources import tables


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Retrieval: documents are the chunks, benchmark items the queries

def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.col("source").alias("source_service"),
        F.when(F.col("doc_id") % 3 == 0, "ERROR").otherwise("INFO").alias("log_level"), F.lit(NOW).alias("timestamp_start"),
    )


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  s AS (SELECT query_id, 'v' || vec_id AS chunk_id, list_dot_product(q.e, v.e) AS x FROM q, v)
  SELECT query_id, chunk_id, round(x, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 20""")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.vector_topk(asked, rows.select(_text("v", F.col("vec_id")).alias("chunk_id"), "embedding"))
    return found.withColumn("score", F.round("score", 4))


Q_SQL = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
BM25_SQL = """toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL), sz AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz),
  qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM q), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  sc AS (SELECT query_id, 'd' || doc_id AS chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS x FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (doc_id), st GROUP BY 1, 2)"""


@query(f"WITH {Q_SQL}, {BM25_SQL} SELECT query_id, chunk_id, round(x, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) <= 20")
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25_topk(_queries(spark, sf_dir), _documents(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


@query(f"WITH {Q_SQL}, {BM25_SQL} SELECT query_id, chunk_id, round(x, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) <= 20")
def bm25_stored(spark, sf_dir):
    """The same from stored blocks, which one run writes and many ask.

    A block has some MB; Spark's Arrow batches of 64 MB would hold ten of them, several times over in each task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    path = scratch(spark, "blocks")
    text_index.write_blocks(text_index.text_blocks(_documents(spark, sf_dir)), path)
    found = retrieval.bm25_topk(_queries(spark, sf_dir), None, stored=spark.read.parquet(path))
    return found.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


#: Each item asks for its first two words as a phrase or any other word of its text, on ERROR chunks, without its last word.
FTS_SQL = """w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
  f AS (SELECT 'd' || doc_id AS chunk_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: ' ' || x || ' '), '') AS body, 1.0 AS weight FROM documents
    UNION ALL SELECT 'd' || doc_id, ' ' || source || ' ', 0.4 FROM documents UNION ALL SELECT 'd' || doc_id, CASE WHEN doc_id % 3 = 0 THEN ' error ' ELSE ' info ' END, 0.2 FROM documents),
  c AS (SELECT query_id, 1 AS clause, false AS no, ' error ' AS phrase FROM w UNION ALL SELECT query_id, 2, false, ' ' || t[1] || '  ' || t[2] || ' ' FROM w
    UNION ALL SELECT query_id, 2, false, ' ' || unnest(t[3:len(t) - 1]) || ' ' FROM w UNION ALL SELECT query_id, 3, true, ' ' || t[len(t)] || ' ' FROM w),
  m AS (SELECT query_id, chunk_id, clause, no, weight * (length(body) - length(replace(body, phrase, ''))) / length(phrase) AS x FROM c JOIN f ON contains(body, phrase)),
  s AS (SELECT query_id, chunk_id, sum(x) AS x FROM m WHERE NOT no GROUP BY ALL HAVING count(DISTINCT clause) = 2)"""


@query(f"WITH {FTS_SQL} SELECT query_id, chunk_id, round(x, 4) AS score FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.no AND m.query_id = s.query_id AND m.chunk_id = s.chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) <= 20")
def fts_topk(spark, sf_dir):
    t = retrieval.tokens(F.col("text"))
    rest = F.array_join(F.slice(t, F.lit(3), F.size(t) - 3), " or ")
    said = F.concat(F.lit('error "'), t[0], F.lit(" "), t[1], F.lit('" or '), rest, F.lit(" -"), F.element_at(t, -1))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("query"))
    return retrieval.fts_topk(asked, _documents(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


LEGS_SQL = """legs AS (SELECT query_id, 0 AS variant, 0 AS leg, chunk_id, rank FROM hits WHERE rank < 20 UNION ALL
  SELECT query_id, 1, 1, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY timestamp_start DESC, chunk_id) - 1 AS r FROM hits QUALIFY r < 20),
  fused AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min((variant, leg, rank)) AS first FROM legs GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id) - 1 AS rank FROM fused)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    one = rows.where("rank < 20").select("query_id", F.lit(0).alias("variant"), F.lit(0).alias("leg"), "chunk_id", "rank")
    newest = retrieval.ranked(rows.withColumn("score", F.unix_micros("timestamp_start")), ["query_id"], 20)
    return retrieval.rrf_fuse(one.unionByName(newest.select("query_id", F.lit(1).alias("variant"), F.lit(1).alias("leg"), "chunk_id", "rank")))


@query("WITH " + HITS_SQL + ", " + LEGS_SQL + " SELECT query_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 9))


@query("WITH " + HITS_SQL + ", " + LEGS_SQL + """ SELECT query_id, chunk_id, round(score * CASE log_level WHEN 'ERROR' THEN 1.5 WHEN 'WARNING' THEN 1.2 WHEN 'DEBUG' THEN 0.8 ELSE 1.0 END
  / (1 + 0.1 * greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(timestamp_start)) / 3.6e9)), 9) AS score FROM ranked JOIN chunks USING (chunk_id)""")
def apply_boosts(spark, sf_dir):
    return retrieval.apply_boosts(_fused(spark, sf_dir), chunks(spark, sf_dir), NOW).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


#: Words hashed by MD5 into 64 signed counts of length one, in single precision, as a list for each (key, text) of ``t``.
EMBED_SQL = """{name}_h AS (SELECT key, CAST('0x' || left(md5(w), 8) AS UBIGINT) AS h FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {table})),
  {name}_c AS (SELECT key, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS c FROM {name}_h GROUP BY ALL),
  {name}_n AS (SELECT key, sqrt(sum(c * c)) AS n FROM {name}_c GROUP BY 1),
  {name} AS (SELECT key, d, CAST(CAST(CASE WHEN n > 0 THEN c / n ELSE 0 END AS FLOAT) AS DOUBLE) AS v FROM {name}_c JOIN {name}_n USING (key) WHERE c <> 0)"""
HYBRID_SQL = f"""{Q_SQL.replace("q AS", "asked AS")}, {synonyms_sql()}, {VARIANTS_SQL.format(q="asked")},
  q AS (SELECT query_id || '/' || variant AS query_id, text AS query FROM variants), {BM25_SQL},
  qt_t AS (SELECT query_id AS key, query AS text FROM q), doc_t AS (SELECT 'd' || doc_id AS key, coalesce(text, '') AS text FROM documents),
  {EMBED_SQL.format(name="qe", table="qt_t")}, {EMBED_SQL.format(name="de", table="doc_t")},
  dots AS (SELECT qe.key AS query_id, de.key AS chunk_id, sum(qe.v * de.v) AS x FROM qe JOIN de USING (d) GROUP BY ALL),
  pairs AS (SELECT qt_t.key AS query_id, doc_t.key AS chunk_id FROM qt_t, doc_t),
  two AS (SELECT query_id, chunk_id, 0 AS leg, coalesce(x, 0) AS x FROM pairs LEFT JOIN dots USING (query_id, chunk_id) UNION ALL SELECT query_id, chunk_id, 1, x FROM sc),
  legs AS (SELECT CAST(split_part(query_id, '/', 1) AS BIGINT) AS query_id, CAST(split_part(query_id, '/', 2) AS INTEGER) AS variant, leg, chunk_id,
    row_number() OVER (PARTITION BY query_id, leg ORDER BY round(x, 9) DESC, chunk_id) - 1 AS rank FROM two QUALIFY rank < 20),
  fused AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min((variant, leg, rank)) AS first FROM legs GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id) - 1 AS rank FROM fused),
  boosted AS (SELECT query_id, chunk_id, source AS service, score * CASE WHEN doc_id % 3 = 0 THEN 1.5 ELSE 1.0 END AS score, rank FROM placed JOIN documents ON chunk_id = 'd' || doc_id),
  found AS (SELECT query_id, chunk_id, service, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank, chunk_id) - 1 AS rank FROM boosted)"""


@query(f"WITH {EMBED_SQL.format(name='e', table='t_').replace('e_h AS', 't_ AS (SELECT doc_id AS key, text FROM documents), e_h AS', 1)} SELECT key AS doc_id, CAST(d AS INTEGER) AS place, round(v, 6) AS value FROM e")
def embed_texts(spark, sf_dir):
    """The components that are not zero."""
    vectors = text.embed_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM found WHERE rank < 10")
def hybrid_search(spark, sf_dir):
    found = retrieval.hybrid_search(_queries(spark, sf_dir), text.embed_texts(_documents(spark, sf_dir), "text"))
    return found.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {HYBRID_SQL}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id, service ORDER BY rank) AS turn FROM found WHERE rank < 30),
  capped AS (SELECT *, turn > 4 AS over_cap FROM pool)
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY over_cap, rank) AS INTEGER) AS place FROM capped QUALIFY place <= 10""")
def hybrid_search_diverse(spark, sf_dir):
    found = retrieval.hybrid_search_diverse(_queries(spark, sf_dir), text.embed_texts(_documents(spark, sf_dir), "text"))
    return found.select("query_id", "chunk_id", "place")


@query("WITH " + CHUNKS_SQL + """, e AS (SELECT n_nationkey AS query_id, 'der-' || n_nationkey AS entity FROM nation),
  s AS (SELECT query_id, entity, chunk_id, 1.0::DOUBLE AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY timestamp_start DESC NULLS FIRST, chunk_id) AS INTEGER) AS place FROM e JOIN chunks ON text ILIKE '%' || entity || '%' QUALIFY place <= 50)
  SELECT * FROM s""")
def find_by_id(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), _text("der-", F.col("n_nationkey")).alias("entity"))
    return retrieval.find_by_id(asked, spread(chunks(spark, sf_dir)))


# Answers of investigations, from orders; their evidence, from line items

ANSWERS_SQL = """evidence AS (SELECT l_orderkey AS investigation_id, 'e' || l_orderkey || '-' || l_linenumber AS chunk_id, 'svc-' || (l_suppkey % 4) AS service,
    CASE l_returnflag WHEN 'R' THEN 'ERROR' WHEN 'A' THEN 'WARNING' ELSE 'INFO' END AS level, 'part ' || l_partkey || ' late at svc-' || (l_partkey % 6) AS message, l_shipdate AS timestamp,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS place FROM lineitem),
  answers AS (SELECT o_orderkey AS id, ['svc-' || (o_orderkey % 4), 'svc-' || (o_orderkey % 6)] AS affected,
    'e' || o_orderkey || '-' || (o_orderkey % 8) AS trigger_id, list_transform(range(1, o_orderkey % 5 + 1), lambda i: 'e' || o_orderkey || '-' || i) AS chain,
    CASE WHEN o_orderkey % 3 = 0 THEN 'likely a full disk' ELSE 'a full disk' END AS root_cause, o_orderkey % 2 = 0 AS ruled,
    CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'sure' ELSE 'high' END AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN ['one gap'] ELSE [] END AS gaps FROM orders)"""
HOP = "struct<service:string,chunk_id:string,ts:string,what:string>"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return rows.select(
        F.col("l_orderkey").alias("investigation_id"), _text("e", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("chunk_id"), _text("svc-", F.col("l_suppkey") % 4).alias("service"),
        F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "WARNING").otherwise("INFO").alias("level"),
        _text("part ", F.col("l_partkey"), " late at svc-", F.col("l_partkey") % 6).alias("message"), F.col("l_shipdate").alias("timestamp"), F.row_number().over(order).alias("place"),
    )


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("o_orderkey"), F.lit(None).cast("string")
    hops = F.expr(f"transform(filter(sequence(0, o_orderkey % 5), i -> i > 0), i -> cast(struct('s', concat('e', o_orderkey, '-', i), '', '') as {HOP}))")
    return table(spark, sf_dir, "orders").select(
        n.alias("investigation_id"), F.array(_text("svc-", n % 4), _text("svc-", n % 6)).alias("affected_services"),
        F.struct(_text("e", n, "-", n % 8).alias("chunk_id"), none.alias("service"), none.alias("timestamp"), none.alias("log_line")).alias("trigger_event"), hops.alias("propagation_chain"),
        F.when(n % 3 == 0, "likely a full disk").otherwise("a full disk").alias("root_cause"), F.when(n % 2 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("ruled_out_hypotheses"),
        F.when(n % 5 == 0, "low").when(n % 5 == 1, "medium").when(n % 5 == 2, "sure").otherwise("high").alias("confidence"),
        F.when(n % 4 == 0, F.array(F.lit("one gap"))).otherwise(F.array().cast("array<string>")).alias("gaps"),
    )


@query(f"""WITH {ANSWERS_SQL}, p AS (SELECT a.*, (SELECT count(*) FROM evidence e WHERE e.investigation_id = a.id) AS n, coalesce((SELECT list(chunk_id) FROM evidence e WHERE e.investigation_id = a.id), []) AS pool FROM answers a)
  SELECT id AS investigation_id, list_concat(
    CASE WHEN confidence = 'sure' THEN ['bad confidence: sure'] ELSE [] END, CASE WHEN n > 0 AND NOT list_contains(pool, trigger_id) THEN ['trigger not in evidence: ' || trigger_id] ELSE [] END,
    CASE WHEN len(chain) = 0 THEN ['no propagation chain for several services'] ELSE [] END, CASE WHEN n > 0 THEN list_transform(list_filter(chain, lambda c: NOT list_contains(pool, c)), lambda c: 'hop not in evidence: ' || c) ELSE [] END,
    CASE WHEN NOT ruled AND confidence <> 'high' THEN ['no hypothesis ruled out'] ELSE [] END) AS errors, len(errors) = 0 AS valid FROM p""")
def validate_answers(spark, sf_dir):
    return evidence.validate_answers(_answers(spark, sf_dir), _evidence(spark, sf_dir))


@query(f"""WITH {ANSWERS_SQL}, ev AS (SELECT investigation_id AS id, count(*) AS n, list(service) AS services, string_agg(message, ' ') || ' ' AS body FROM evidence GROUP BY 1),
  p AS (SELECT a.id, a.root_cause, a.confidence AS given, a.gaps, list_distinct(list_append(chain, trigger_id)) AS cited, coalesce(n, 0) AS n, coalesce(contains(body, 'part ' || a.id || ' '), false) AS named,
    len(list_filter(affected, lambda s: NOT list_contains(services, s) AND NOT contains(body, s))) AS unseen FROM answers a LEFT JOIN ev USING (id)),
  r0 AS (SELECT *, CASE given WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 0 END AS r, CASE WHEN given = 'sure' THEN ['bad confidence'] ELSE [] END AS notes FROM p),
  r1 AS (SELECT *, n = 0 AND r > 0 AS hit FROM r0), s1 AS (SELECT * REPLACE (CASE WHEN hit THEN 0 ELSE r END AS r, CASE WHEN hit THEN list_append(notes, 'no evidence') ELSE notes END AS notes, CASE WHEN hit THEN list_append(gaps, 'no evidence') ELSE gaps END AS gaps) FROM r1),
  r2 AS (SELECT * EXCLUDE hit, n > 0 AND NOT named AND r > 0 AS hit FROM s1), s2 AS (SELECT * REPLACE (CASE WHEN hit THEN 0 ELSE r END AS r, CASE WHEN hit THEN list_append(notes, 'no entity of the question in the evidence') ELSE notes END AS notes, CASE WHEN hit THEN list_append(gaps, 'no entity of the question in the evidence') ELSE gaps END AS gaps) FROM r2),
  r3 AS (SELECT * EXCLUDE hit, r = 2 AND len(cited) < 2 AS hit FROM s2), s3 AS (SELECT * REPLACE (CASE WHEN hit THEN 1 ELSE r END AS r, CASE WHEN hit THEN list_append(notes, 'fewer than two citations') ELSE notes END AS notes, CASE WHEN hit THEN list_append(gaps, 'fewer than two citations') ELSE gaps END AS gaps) FROM r3),
  r4 AS (SELECT * EXCLUDE hit, r > 0 AND len(gaps) = 0 AS hit FROM s3), s4 AS (SELECT * REPLACE (CASE WHEN hit AND len(cited) < 3 THEN r - 1 ELSE r END AS r, CASE WHEN NOT hit THEN notes WHEN len(cited) >= 3 THEN list_append(notes, 'no gaps listed') ELSE list_append(notes, 'no gaps and fewer than three citations') END AS notes, CASE WHEN hit AND len(cited) < 3 THEN list_append(gaps, 'no gaps and fewer than three citations') ELSE gaps END AS gaps) FROM r4),
  r5 AS (SELECT * EXCLUDE hit, n > 0 AND unseen > 0 AS hit FROM s4), s5 AS (SELECT * REPLACE (CASE WHEN hit THEN greatest(r - 1, 0) ELSE r END AS r, CASE WHEN hit THEN list_append(notes, 'services that no evidence shows') ELSE notes END AS notes, CASE WHEN hit THEN list_append(gaps, 'services that no evidence shows') ELSE gaps END AS gaps) FROM r5),
  r6 AS (SELECT * EXCLUDE hit, r = 2 AND contains(root_cause, 'likely') AS hit FROM s5)
  SELECT id AS investigation_id, ['low', 'medium', 'high'][CASE WHEN hit THEN 1 ELSE r END + 1] AS confidence, CASE WHEN hit THEN list_append(gaps, 'hedging root cause') ELSE gaps END AS gaps, CASE WHEN hit THEN list_append(notes, 'hedging root cause') ELSE notes END AS notes FROM r6""")
def enforce_floors(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    asked = answers.select("investigation_id", F.array(_text("part ", F.col("investigation_id"), " ")).alias("entities"))
    return evidence.enforce_floors(answers, _evidence(spark, sf_dir), asked)


@query(f"""WITH {ANSWERS_SQL}, firsts AS (SELECT investigation_id, service, min(place) AS p FROM evidence GROUP BY ALL), s AS (SELECT investigation_id, list(service ORDER BY p) AS services FROM firsts GROUP BY 1),
  t AS (SELECT * FROM evidence WHERE level IN ('ERROR', 'WARNING') QUALIFY row_number() OVER (PARTITION BY investigation_id ORDER BY place) = 1)
  SELECT a.id AS investigation_id, coalesce(services, []) AS affected_services, t.chunk_id AS trigger_chunk_id, t.service AS trigger_service, t.message AS trigger_line, 'unable_to_determine' AS root_cause, 'low' AS confidence,
    CASE WHEN services IS NULL THEN ['no compiled answer', 'tools tried: scan, search', 'no evidence'] ELSE ['no compiled answer', 'tools tried: scan, search'] END AS gaps
  FROM answers a LEFT JOIN s ON s.investigation_id = a.id LEFT JOIN t ON t.investigation_id = a.id""")
def synthesize_answers(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("investigation_id"), F.explode(F.array(F.lit("search"), F.lit("scan"), F.lit("search"))).alias("tool"))
    return evidence.synthesize_answers(_evidence(spark, sf_dir), calls)


@query("""SELECT o_orderkey AS investigation_id, list_concat(CASE WHEN o_orderkey % 3 = 0 THEN ['missing confidence'] ELSE [] END, CASE WHEN o_orderkey % 7 = 0 THEN ['missing root_cause'] ELSE [] END,
  CASE WHEN o_orderkey % 2 = 0 THEN ['missing affected_services'] ELSE [] END, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 2 THEN ['bad confidence: sure'] ELSE [] END) AS errors FROM orders""")
def precheck_answers(spark, sf_dir):
    n = F.col("investigation_id")
    rows = _answers(spark, sf_dir).withColumns({
        "confidence": F.when(n % 3 != 0, F.col("confidence")), "root_cause": F.when(n % 7 == 0, "").otherwise(F.col("root_cause")),
        "affected_services": F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("affected_services")),
    })
    return evidence.precheck_answers(rows)


# Evaluation

SCORED_SQL = "WITH " + HITS_SQL + """, top AS (SELECT * FROM hits WHERE rank < 10), truth AS (SELECT DISTINCT query_id, ['svc-1', 'svc-9'] AS services, CASE WHEN query_id % 5 = 0 THEN [] ELSE ['ORDER-' || query_id, 'purchase', 'absent'] END AS keywords FROM hits),
  a AS (SELECT query_id, list_sort(list(DISTINCT source_service)) AS seen, string_agg(lower(text), chr(1)) AS body, list(round(score, 6) ORDER BY score DESC)[1:3] AS best FROM top GROUP BY 1),
  f AS (SELECT t.*, seen, best, list_filter(keywords, lambda k: contains(body, lower(k))) AS found FROM truth t JOIN a USING (query_id)),
  scored AS (SELECT query_id, len(list_intersect(services, seen)) / 2 AS service_recall, CASE WHEN len(keywords) = 0 THEN 1.0 ELSE len(found) / len(keywords) END AS keyword_recall, list_sort(found) AS found,
   list_sort(list_filter(keywords, lambda k: NOT list_contains(found, k))) AS missed, seen AS services, array_to_string(best, ',') AS top_scores, len(list_intersect(services, seen)) / 2 >= 0.6 AND (len(keywords) = 0 OR len(found) / len(keywords) >= 0.6) AS meets_target FROM f)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    n = F.col("query_id")
    words = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_text("ORDER-", n), F.lit("purchase"), F.lit("absent")))
    truth = rows.select("query_id").distinct().select("query_id", F.array(F.lit("svc-1"), F.lit("svc-9")).alias("services"), words.alias("keywords"))
    return evaluation.score_retrieval(rows.where("rank < 10"), truth)


@query(SCORED_SQL + " SELECT * EXCLUDE top_scores REPLACE (round(keyword_recall, 6) AS keyword_recall), len(string_split(top_scores, ',')) AS top_count, round(string_split(top_scores, ',')[1]::DOUBLE, 4) AS top_score FROM scored")
def score_retrieval(spark, sf_dir):
    best = F.col("top_scores")
    return _scored(spark, sf_dir).withColumns({"keyword_recall": F.round("keyword_recall", 6), "top_count": F.size(best).cast("long"), "top_score": F.round(best[0], 4)}).drop("top_scores")


@query(SCORED_SQL + " SELECT meets_target, count(*) AS questions, round(avg(service_recall), 6) AS service_recall, round(avg(keyword_recall), 6) AS keyword_recall FROM scored GROUP BY 1")
def retrieval_averages(spark, sf_dir):
    found = evaluation.retrieval_averages(_scored(spark, sf_dir), ["meets_target"])
    return found.withColumns({c: F.round(c, 6) for c in ("service_recall", "keyword_recall")})


EXPECTED_SQL = """expected AS (SELECT p_partkey AS dataset, CASE WHEN p_partkey % 2 = 0 THEN 'x' END AS trigger_event, CASE WHEN p_partkey % 3 = 0 THEN ['y'] ELSE [] END AS must, CASE WHEN p_partkey % 4 = 1 THEN 'high' ELSE '' END AS confidence,
  CASE WHEN p_partkey % 5 < 3 THEN ['missing disk metrics here', 'no'] END AS gaps_want FROM part)"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("p_partkey"), F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(
        n.alias("dataset"), F.when(n % 2 == 0, "x").alias("trigger_event"), F.when(n % 3 == 0, F.array(F.lit("y"))).otherwise(none).alias("root_cause_must_be_one_of"),
        F.when(n % 4 == 1, "high").otherwise("").alias("confidence"), F.when(n % 5 < 3, F.array(F.lit("missing disk metrics here"), F.lit("no"))).alias("gaps_must_include_one_of"),
    )


@query(f"""WITH {EXPECTED_SQL} SELECT dataset, list_concat(CASE WHEN trigger_event IS NOT NULL THEN ['trigger_identification'] ELSE [] END, CASE WHEN len(must) > 0 THEN ['root_cause_accuracy'] ELSE [] END,
  CASE WHEN confidence <> '' THEN ['confidence_calibration'] ELSE [] END, CASE WHEN gaps_want IS NOT NULL THEN ['gap_awareness'] ELSE [] END) AS criteria FROM expected""")
def active_criteria(spark, sf_dir):
    return evaluation.active_criteria(_expected(spark, sf_dir))


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS dataset, o_orderkey % 3 AS parse_attempts, CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['Disk METRICS were missing'] ELSE ['nothing known'] END AS gaps FROM orders)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    gaps = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("Disk METRICS were missing"))).otherwise(F.array(F.lit("nothing known")))
    return table(spark, sf_dir, "orders").select(n.alias("run_id"), F.col("o_custkey").alias("dataset"), (n % 3).alias("parse_attempts"), F.when(n % 3 == 0, "high").otherwise("low").alias("confidence"), gaps.alias("gaps"))


@query(f"""WITH {EXPECTED_SQL}, {RUNS_SQL} SELECT run_id, dataset, 'confidence_calibration' AS name, CASE WHEN r.confidence = e.confidence THEN 1.0 ELSE 0.0 END AS score FROM runs r JOIN expected e USING (dataset) WHERE e.confidence <> ''
  UNION ALL SELECT run_id, dataset, 'gap_awareness', CASE WHEN len(gaps) = 0 THEN 0.0 WHEN contains(lower(gaps[1]), 'disk') OR contains(lower(gaps[1]), 'no') THEN 1.0 ELSE 0.4 END FROM runs r JOIN expected e USING (dataset) WHERE gaps_want IS NOT NULL""")
def score_deterministic(spark, sf_dir):
    return evaluation.score_deterministic(_runs(spark, sf_dir), _expected(spark, sf_dir))


@query(f"""WITH {RUNS_SQL}, given AS (SELECT l_orderkey AS run_id, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'other' END AS name, max(least(greatest(l_discount * 30 - 1, 0), 1)) AS score FROM lineitem GROUP BY 1, 2),
  w AS (SELECT run_id, dataset, parse_attempts, unnest(['a', 'b', 'c']) AS name FROM runs), m AS (SELECT w.run_id, dataset, parse_attempts, avg(coalesce(score, 0)) AS x, max(coalesce(score, 0)) AS best FROM w LEFT JOIN given USING (run_id, name) GROUP BY ALL)
  SELECT run_id, dataset, round(x, 3) AS aggregate_score, CASE WHEN best = 0 AND parse_attempts >= 2 THEN 'judge_parse_error' WHEN round(x, 3) >= 0.8 THEN 'pass' ELSE 'fail' END AS status FROM m""")
def aggregate_judgement(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_linenumber") % 3 == 0, "a").when(F.col("l_linenumber") % 3 == 1, "b").otherwise("other")
    scores = lines.select(F.col("l_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset"), name.alias("name"), (F.col("l_discount") * 30 - 1).alias("score"))
    runs = _runs(spark, sf_dir)
    names = runs.select("dataset").distinct().withColumn("criteria", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return evaluation.aggregate_judgement(scores, names, runs)


RESULTS_SQL = """results AS (SELECT l_orderkey AS run_id, 'm' || (l_suppkey % 5) AS model, 'd' || (l_linenumber % 4) AS dataset, l_discount * 10 AS aggregate_score,
  CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'fail' ELSE 'error' END AS status, l_linenumber AS iterations, l_shipdate AS created_at FROM lineitem)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "fail").otherwise("error")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), _text("m", F.col("l_suppkey") % 5).alias("model"), _text("d", F.col("l_linenumber") % 4).alias("dataset"), (F.col("l_discount") * 10).alias("aggregate_score"),
        status.alias("status"), F.col("l_linenumber").alias("iterations"), F.col("l_shipdate").alias("created_at"),
    )


@query(f"""WITH {RESULTS_SQL}, w AS (SELECT model AS dataset, max(aggregate_score) FILTER (status = 'pass' AND iterations < 3) AS gold, min(aggregate_score) FILTER (status = 'fail' AND iterations < 0) AS none, max(aggregate_score) FILTER (status = 'fail' AND iterations = 7) AS fail FROM results GROUP BY 1)
  SELECT dataset, gold, fail, CASE WHEN gold IS NULL OR fail IS NULL THEN 'incomplete' WHEN gold >= 0.8 AND fail <= 0.5 THEN 'calibrated' WHEN gold < 0.8 THEN 'too strict' ELSE 'too lenient' END AS verdict FROM w""")
def judge_calibration(spark, sf_dir):
    kind = F.when((F.col("status") == "pass") & (F.col("iterations") < 3), "gold").when((F.col("status") == "fail") & (F.col("iterations") == 7), "fail")
    rows = _results(spark, sf_dir).select(F.col("model").alias("dataset"), kind.alias("kind"), F.col("aggregate_score").alias("score"))
    return evaluation.judge_calibration(rows)


@query("""SELECT l_orderkey AS investigation_id, count(*) FILTER (l_returnflag = 'N') AS iterations, count(*) FILTER (l_returnflag = 'A') AS reflections, list_sort(list(DISTINCT 'tool' || (l_suppkey % 3))) AS tools FROM lineitem GROUP BY 1""")
def investigation_stats(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "reflection").when(F.col("l_returnflag") == "R", "plan")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("investigation_id"), kind.alias("kind"), _text("tool", F.col("l_suppkey") % 3).alias("tool"))
    return evaluation.investigation_stats(rows)


@query(f"WITH {RESULTS_SQL} SELECT run_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'error') AS errored, round(avg(aggregate_score), 6) AS average_score FROM results GROUP BY 1")
def run_summary(spark, sf_dir):
    return evaluation.run_summary(_results(spark, sf_dir)).withColumn("average_score", F.round("average_score", 6))


@query(f"""WITH {RESULTS_SQL} SELECT model, max(aggregate_score) FILTER (dataset = 'd0') AS d0, max(aggregate_score) FILTER (dataset = 'd1') AS d1, max(aggregate_score) FILTER (dataset = 'd2') AS d2,
  max(aggregate_score) FILTER (dataset = 'd3') AS d3, round(avg(aggregate_score), 6) AS average, CAST(sum(iterations) AS BIGINT) AS iterations FROM results GROUP BY 1""")
def model_matrix(spark, sf_dir):
    return evaluation.model_matrix(_results(spark, sf_dir), ["d0", "d1", "d2", "d3"]).withColumn("average", F.round("average", 6))


@query(f"WITH {RESULTS_SQL} SELECT model, dataset, aggregate_score, created_at, run_id FROM results WHERE status <> 'error' QUALIFY row_number() OVER (PARTITION BY model, dataset ORDER BY aggregate_score DESC, created_at DESC, run_id) = 1")
def leaderboard_best(spark, sf_dir):
    return evaluation.leaderboard_best(_results(spark, sf_dir)).select("model", "dataset", "aggregate_score", "created_at", "run_id")


@query(f"""WITH {RESULTS_SQL} SELECT run_id, model, dataset, CAST(CAST(least(aggregate_score, 1.0) AS DECIMAL(4,3)) AS DOUBLE) AS aggregate_score, status, '{{"a":' || iterations || ',"b":2}}' AS criteria, '{{"iterations":' || iterations || '}}' AS stats, created_at FROM results""")
def leaderboard_rows(spark, sf_dir):
    criterion = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("long").alias("score"))
    rows = _results(spark, sf_dir).withColumns({
        "provider": F.lit("p"), "judge_model": F.lit("j"), "aggregate_score": F.least("aggregate_score", F.lit(1.0)),
        "criteria": F.array(criterion("b", F.lit(2)), criterion("a", F.col("iterations"))), "stats": F.struct("iterations"),
    })
    return tables.leaderboard_rows(rows).withColumn("aggregate_score", F.col("aggregate_score").cast("double")).select("run_id", "model", "dataset", "aggregate_score", "status", "criteria", "stats", "created_at")
