"""The queries of this subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, parsing, phrases, pieces, quantised, secrets, sharding, simhash, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), MODEL)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return rows.select("*", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.deduplicate_passages(_table(spark, sf_dir, "documents"), texts=False)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compare_with_edits(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def queries() -> dict:
    found = [op1_sentencepiece, op2_language_id, op3_mixing, op4_secrets, op5_embedding_dedup, op6_sharding, op7_substring_dedup, op8_simhash_dedup, op9_fingerprints, op10_warc]
    return {f.__name__: f for f in found}


#: Brute force over all pairs; a recursive walk along the links.
_OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
walk(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, l.component_id, e.vec_id = l.component_id AS kept FROM embeddings e JOIN least l ON e.vec_id = l.vec_id"""

_OP7 = r"""WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50),
hashed AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM hashed) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id"""

#: Five hexadecimal digits of a digest are four of base 32. URLs as these tables have them: a scheme, a host, maybe a port, path, query.
_OP10 = r"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages),
u AS (SELECT *, sha1(body) AS hex, lower(array_to_string(list_reverse(string_split(regexp_extract(url, '^\w+://([^/:?#]*)', 1), '.')), ',')) AS host, regexp_extract(url, '^(\w+)://[^/:?#]*(:\d+)?([^?#]*)(\?[^#]+)?', ['scheme', 'port', 'path', 'query']) AS x FROM p),
d AS (SELECT *, host || CASE WHEN (x.scheme = 'http' AND x.port = ':80') OR (x.scheme = 'https' AND x.port = ':443') THEN '' ELSE x.port END || ')' || CASE WHEN x.path = '' THEN '/' ELSE lower(x.path) END || lower(x.query) AS url_key FROM u)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to,
row_number() OVER (ORDER BY coalesce(url_key, ')/'), page_id % 4000000000, page_id) - 1 AS position FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.oracle(), "op5_embedding_dedup": _OP5, "op7_substring_dedup": _OP7, "op10_warc": _OP10}
