"""The operators' queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_join, language, line_dedup, lm_score, minhash, mixing, quality_crf, quality_rules, sentencepiece


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.decisions(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.linked(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.compared(docs, good)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classified(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.sample(docs.where(_fold(3) != 1)))
    return language.identified(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.trained(docs.where(_fold(4) != 2), _read(spark, sf_dir, "labels").where(_fold(4) != 2))
    score = quality_crf.scored(docs, model).select("doc_id", F.col("_quality").alias("score"))
    return score.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= quality_crf.KEEP_AT).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels")
    model = quality_rules.fit(*quality_rules.sample(docs, labels), quality_rules.good_share(labels))
    return quality_rules.rules(docs, model)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_embedding_join, op3_sentencepiece, op4_language, op5_lm_score, op6_line_dedup, op7_quality_crf, op8_quality_rules, op9_minhash, op10_chat)}

#: Every run of every length, compared in full: slower than the suffix array and free of its arguments.
LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, dense_rank() OVER (ORDER BY line) AS id, count(*) OVER (PARTITION BY line) AS n FROM l),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM k WHERE n > 1),
i AS (SELECT doc_id, island, min(k) AS k0, list(id ORDER BY k) AS ids, list(words ORDER BY k) AS ws FROM r GROUP BY doc_id, island),
s AS (SELECT doc_id, k0, ids, ws, unnest(range(1, len(ids) + 1)) AS a FROM i),
e AS (SELECT doc_id, k0, ids, ws, a, unnest(range(a, len(ids) + 1)) AS b FROM s),
runs AS (SELECT doc_id, k0 + a - 1 AS f, k0 + b - 1 AS t, ids[a:b] AS key FROM e WHERE list_sum(ws[a:b]) >= 50),
firsts AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, f) AS nth FROM runs),
gone AS (SELECT DISTINCT r.doc_id, r.pos FROM firsts x JOIN r ON r.doc_id = x.doc_id AND r.k BETWEEN x.f AND x.t WHERE nth > 1),
g AS (SELECT doc_id, count(*) AS n_deleted, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS deleted FROM gone GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""

#: All pairs of vectors.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""

#: All pairs of documents that share a shingle.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
p AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, root = d.doc_id AS kept
FROM documents d JOIN c ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Digests of the source rows, and the length of their rendering.
CHAT_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, role || text AS said, '</?s>|\[/?(INST|ROLE|SYS)\]' AS control FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(said) + length(said) - length(replace(said, chr(92), ''))
    + 2 * len(regexp_extract_all(role, control)) + 2 * len(regexp_extract_all(text, control))) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op2_embedding_join": EMBEDDING_SQL, "op6_line_dedup": LINE_DEDUP_SQL, "op9_minhash": MINHASH_SQL, "op10_chat": CHAT_SQL}
