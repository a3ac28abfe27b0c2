"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramlake.llm import bloom_lm, imatch, maglev, metric_join, mixing, pieces, quality, ranked, superminhash, toxicity, url_cascade, vafile, viterbi_count

#: Shards of op9.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public tokenizer's file: in the folder GRAMLAKE_TOKENIZERS, or of the package that holds them."""
    if folder := os.environ.get("GRAMLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judged(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.sharded(table(spark, sf_dir, "documents"), list(SHARDS))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_count.counted(table(spark, sf_dir, "documents"), tokenizer())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprinted(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.coded(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    every = (op1_embedding_near_dedup, op2_lm_scoring, op3_sentencepiece, op4_toxicity, op5_mixing, op6_quality_rules, op7_url_filter, op8_minhash_near_dedup, op9_sharding, op10_token_counts, op11_ranked_search, op12_fingerprints, op13_vector_codes)
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(named.c, v.vec_id) AS component_id,
  coalesce(coalesce(named.c, v.vec_id) = v.vec_id, true) AS kept
FROM v LEFT JOIN named ON v.vec_id = named.a LEFT JOIN n ON v.vec_id = n.a
"""

_OP5 = f"""
WITH RECURSIVE s AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, round((sum(n) OVER ())::DOUBLE / sum(pow(n::DOUBLE, 0.5)) OVER () * pow(n::DOUBLE, 0.5) / n, 9) AS rate FROM s),
per AS (SELECT src, rate, greatest(ceil(rate / {mixing.MAX_RATE}), 1)::INTEGER AS draws, rate / greatest(ceil(rate / {mixing.MAX_RATE}), 1) AS one FROM r),
t AS (SELECT src, one, 0 AS k, exp(-one) AS p, exp(-one) AS cdf FROM per
  UNION ALL SELECT src, one, k + 1, p * one / (k + 1), cdf + p * one / (k + 1) FROM t WHERE k < {mixing.TERMS}),
d AS (SELECT *, row_number() OVER () AS row, coalesce(source, '') AS src, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':11' AS id FROM documents),
u AS (SELECT row, d.src, ('0x' || substr(md5(id || CASE WHEN rate <= {mixing.MAX_RATE} THEN '' ELSE ':draw:' || draw END), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u
  FROM d JOIN per ON d.src = per.src, unnest(range(1, draws + 1)) AS x(draw)),
n AS (SELECT row, count(*) AS n FROM u JOIN t ON u.src = t.src AND t.cdf <= u.u AND t.k < {mixing.TERMS} GROUP BY row),
c AS (SELECT d.*, per.rate, k FROM d JOIN n USING (row) JOIN per ON d.src = per.src, unnest(range(0, n.n)) AS x(k))
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, k::INTEGER AS mix_copy,
  ('0x' || substr(md5(id || ':order:' || k), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS mix_key
FROM c
"""

_KEYS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_cascade.RULES)
_BLOCKED = ", ".join(f"('{a}.{b}')" for a in url_cascade.BLOCKED_NAMES for b in url_cascade.BLOCKED_ENDS)
_OP7 = f"""
WITH p AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (VALUES {_KEYS}), blocked(h) AS (VALUES {_BLOCKED}),
fit AS (
  SELECT row, arg_max(rules.h || rules.p, (length(rules.h || rules.p), length(rules.h))) AS rule, arg_max(v, (length(rules.h || rules.p), length(rules.h))) AS verdict
  FROM p JOIN rules ON (p.host = rules.h OR p.host LIKE '%.' || rules.h) AND starts_with(p.path, rules.p) GROUP BY row
), listed AS (SELECT DISTINCT row FROM p JOIN blocked ON p.host = blocked.h OR p.host LIKE '%.' || blocked.h)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed.row IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (row) LEFT JOIN listed USING (row)
"""

_OP8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s WHERE doc_id IS NOT NULL),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
links AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, links.b FROM reach r JOIN links ON r.b = links.a),
named AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, coalesce(doc_id = c, true) AS kept FROM s LEFT JOIN named ON doc_id = a
"""


def oracle_sql() -> dict[str, str]:
    """op2 (its filter's score), op3, op4, op6 (its sketches), op9, op10 and the pipeline are tested in tests/llm instead."""
    return {"op1_embedding_near_dedup": _OP1, "op5_mixing": _OP5, "op7_url_filter": _OP7, "op8_minhash_near_dedup": _OP8, "op11_ranked_search": ranked.SQL, "op12_fingerprints": imatch.SQL, "op13_vector_codes": vafile.SQL}
