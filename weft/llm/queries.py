"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import fingerprints, ngram_join, packing, quality, sentencepiece_table, token_counts, topk, toxicity, url_filter, warc_zip
from weft.llm._common import table


#: Rules of op4: verdict, host, path.
RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that rules decide."""
    return url_filter.by_rules(table(spark, sf_dir, "pages"), RULES).select(F.col("_id").alias("page_id"), "host", "path", "rule", F.col("ruled").alias("verdict"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probe(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(token_counts.lengths(docs, public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_token_counts, op3_sentencepiece, op4_url_filter, op5_quality, op6_top_k, op7_toxicity, op8_ngram_join, op9_fingerprints, op10_packing,
        url_rules,
    )
}
#: Sets of distinct 3-word shingles as in op8, for SQL.
_SHINGLES = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
listed AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) END AS s FROM words
)"""
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
_RULES = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
ORACLE_SQL: dict[str, str] = {
    "url_rules": f"""
WITH u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT i, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT p.i, name, verdict, row_number() OVER (PARTITION BY p.i ORDER BY length(name) DESC, name DESC) AS n
  FROM p JOIN (VALUES {_RULES}) v(name, h, start, verdict) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)
)
SELECT page_id, host, path, name AS rule, verdict FROM p LEFT JOIN f ON f.i = p.i AND n = 1""",
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op8_ngram_join": f"""
WITH RECURSIVE {_SHINGLES},
class AS (SELECT list_sort(s) AS k, min(doc_id) AS c, len(s) AS n FROM listed WHERE len(s) > 0 GROUP BY ALL),
item AS (SELECT c, n, unnest(k) AS x FROM class),
shared AS (SELECT a.c AS a, b.c AS b, count(*) AS i, any_value(a.n) AS n, any_value(b.n) AS m FROM item a JOIN item b ON a.x = b.x AND a.c < b.c AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * i >= 90 * (n + m - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT c, c FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least_id AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT l.doc_id, CAST(len(l.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, l.doc_id) AS component_id
FROM listed l LEFT JOIN class c ON c.k = list_sort(l.s) LEFT JOIN least_id m ON m.c = c.c""",
}
