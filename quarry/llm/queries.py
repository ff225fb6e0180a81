"""The registered queries of the training-data operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, byte_bpe, centroids, decontamination, exact_dedup, language, resampling, secrets, simhash, substring_dedup, token_counts, token_store, toxicity
from quarry.llm.common import new_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    token_store.write_tokens(documents(spark, sf_dir), path := new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.token_digests(spark, path)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact_dedup.exact_dedup(docs, exact_dedup.middle_id(docs)).drop("in_history")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir)).drop("kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op10_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS points FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
m AS (SELECT DISTINCT doc_id, item_id, k, i FROM grams JOIN win USING (k, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
p AS (SELECT item_id::VARCHAR AS item, least(len(w), 10) AS k, unnest(w) AS word, unnest(range(len(w))) AS off FROM b WHERE len(w) > 0),
q AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
s AS (SELECT DISTINCT doc_id, item, k, off, pos - off + e AS shift FROM q JOIN p USING (word), range(-3, 4) r(e)),
z AS (SELECT DISTINCT doc_id, item FROM (SELECT doc_id, item, k, off, lead(off, (k - k // 5 - 1)::INT) OVER (PARTITION BY doc_id, item, shift ORDER BY off) AS last FROM s) WHERE last - off < k),
near AS (SELECT doc_id, count(*) AS n_near_items, string_agg(item, ',' ORDER BY item) AS near_items FROM z ANTI JOIN (SELECT doc_id, item_id::VARCHAR AS item FROM m) USING (doc_id, item) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
coalesce(n_near_items, 0) AS n_near_items, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)
"""

NEAREST = """a{n} AS (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{n}) GROUP BY r, vec_id)"""
MOVED = """c{m} AS (SELECT c, coalesce(u, w) AS w FROM c{n} LEFT JOIN (SELECT c, list(u ORDER BY i) AS u FROM (SELECT c, i, (((t - ((t % n) + n) % n)) // n)::BIGINT AS u FROM (SELECT c, i, sum(x) AS t, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY c, i)) GROUP BY c) USING (c))"""
OP11_SQL = """
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT v, sha256('1:' || vec_id) AS h FROM k ORDER BY h, v LIMIT 16)),
""" + ",\n".join(f"{NEAREST.format(n=n)},\n{MOVED.format(n=n, m=n + 1)}" for n in range(3)) + f""",
{NEAREST.format(n=3)}
SELECT vec_id, a3.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a3.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON a3.c = c3.c
"""

#: A CRC-32 goes over the bytes with a table of 256 values, which eight shifts each make.
OP12_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, x)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, range(1, 4) s(n))
  UNION ALL SELECT NULL, array_to_string(w[i:i + n - 1], ' ') FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, range(1, 4) s(n))),
u AS (SELECT DISTINCT f FROM g),
h AS (SELECT f, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT), lambda y, v: xor(y >> 8, tab[(xor(y, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM (SELECT f, hex(encode(f)) AS x FROM u), tab),
p AS (SELECT r, k, count(*) AS n FROM g JOIN h USING (f) GROUP BY ALL),
c AS (SELECT k, coalesce(sum(n) FILTER (r IS NOT NULL), 0)::BIGINT AS s, coalesce(sum(n) FILTER (r IS NULL), 0)::BIGINT AS t FROM p GROUP BY k),
a AS (SELECT sum(s) + 10000 AS s, sum(t) + 10000 AS t FROM c),
gain AS (SELECT k, floor(1000 * ln((c.t + 1)::DOUBLE * a.s::DOUBLE / ((c.s + 1)::DOUBLE * a.t::DOUBLE)))::BIGINT AS gain FROM c, a),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM p JOIN gain USING (k) WHERE r IS NOT NULL GROUP BY r),
z AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM z),
o AS (SELECT *, n_words >= 20 AS long, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= 5 * n // 100 THEN place END AS rank FROM o
"""

QUERIES = {
    f.__name__: f
    for f in (op1_token_output, op2_exact_dedup, op3_language_id, op4_simhash_near_dedup, op5_suffix_array_dedup, op6_toxicity, op7_token_counts, op8_benchmark_decontamination, op9_secret_scans, op10_bpe_encoding_decoding,
              op11_centroid_clustering, op12_importance_resampling, op13_byte_bpe)
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_importance_resampling": OP12_SQL}
