"""The operators as queries over the given tables, with production parameters, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasemill.llm import (
    chat, decontaminate, exactdedup, hostpaths, importance, langid, licenses, neardup, packing, pii, quality, toxicity, vectorcodes,
)
from leasemill.llm.store import shipped
from leasemill.llm.training import held_out

#: The tests' and queries' key. A deployment passes its own.
PII_KEY = b"leasemill documents"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    docs = _table(spark, sf_dir, "documents")
    return packing.packed(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size=1024, added_tokens=True)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", licenses.scan(docs).alias("f")).select("doc_id", "f.*")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    marked = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_trees(chat.from_turns(given.union(marked))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.identify(docs, langid.train(docs)).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), "f.score", "f.ambiguous")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.pseudonymise(docs, PII_KEY).alias("f"))
    return found.select("doc_id", "f.text", F.size("f.found").cast("long").alias("n_found"), "f.found")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every usable vector, their errors, and the digest of the trained codebooks."""
    return vectorcodes.digest(_table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return hostpaths.digest(_table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's texts, and the rank of those drawn."""
    return importance.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_license_scans, op3_benchmark_decontamination, op4_toxicity, op5_minhash_near_dedup, op6_chat_formatting,
        op7_language_id, op8_pii, op9_exact_dedup, op10_quality_classifier, op11_vector_codes, op12_html_extraction,
        op13_importance_resampling)}


_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS.format('text')} AS w FROM benchmark),
wins AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS win
  FROM item WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (
  SELECT r, n, unnest(range(len(w) - n + 1)) AS i, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS win
  FROM doc, sizes WHERE len(w) >= n),
hits AS (
  SELECT DISTINCT r, i, n, item_id FROM runs JOIN wins USING (n, win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(points) AS most, count(*) AS group_size FROM d GROUP BY text_sha256),
k AS (SELECT text_sha256, min(doc_id) AS keep_id FROM d JOIN g USING (text_sha256) WHERE points = most GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND points = most AS kept, text_sha256
FROM d JOIN g USING (text_sha256) JOIN k USING (text_sha256)
"""

_ROUND = """
d{0} AS MATERIALIZED (
  SELECT r, v.p, min(16 * d + e) % 16 AS e, min(16 * d + e) // 16 AS d
  FROM (SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM part v JOIN b{0} b ON v.p = b.p AND v.i = b.i GROUP BY v.r, v.p, b.e) v
  GROUP BY r, v.p),"""
_BOOK = """
b{1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM b{0} b LEFT JOIN (
    SELECT p, e, i, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT v.p, a.e, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM part v JOIN d{0} a ON v.r = a.r AND v.p = a.p GROUP BY v.p, a.e, v.i)) m
  ON b.p = m.p AND b.e = m.e AND b.i = m.i),"""

OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT r, (i - 1) // (len // 8) AS p, (i - 1) % (len // 8) AS i, floor(4096 * x::DOUBLE)::BIGINT AS x
  FROM (SELECT r, len(v) AS len, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM part WHERE r <= 16),{"".join(_ROUND.format(i) + _BOOK.format(i, i + 1) for i in range(6))}{_ROUND.format(6)}
coded AS (
  SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM d6 GROUP BY r),
total AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN coded USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM b6) AS codebooks_sha256
FROM kept JOIN coded USING (r) JOIN total ON kept.label IS NOT DISTINCT FROM total.label
"""

# The CRC table comes from its polynomial; c is the register over the feature's bytes so far.
OP13_SQL = f"""
WITH poly AS MATERIALIZED (
  SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
text AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, TRUE AS source, {_WORDS.format('text')} AS w FROM documents
  UNION ALL SELECT NULL, NULL, FALSE, {_WORDS.format('text')} FROM benchmark),
runs AS MATERIALIZED (
  SELECT r, source, unnest(list_transform(range(greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS feature
  FROM text, (SELECT unnest([1, 2, 3]) AS n)),
bytes AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)),
hashed AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i:
      16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, poly),
counts AS (SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM runs JOIN hashed USING (feature) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (feature) JOIN gain USING (bucket) WHERE source GROUP BY r),
noise AS (SELECT r, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM text WHERE source),
scored AS (
  SELECT r, doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM text JOIN noise USING (r) LEFT JOIN weights USING (r) WHERE source),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE enough)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op13_importance_resampling": OP13_SQL}
