"""One query per corpus operator, over its whole table with production parameters, and SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, divergence, exactdedup, htmltext, licenses, linededup, packing, pieces, pii, quality, resample, simhash, spotsigs
from wardline.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary file: ``WARDLINE_TOKENIZER``, or the one that the installed package has."""
    if path := os.environ.get("WARDLINE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    """The piece model: ``WARDLINE_PIECES``, or the one that the installed package has."""
    if path := os.environ.get("WARDLINE_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, "documents"))


def op1_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_chars=1, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(table(sf_dir, "pages")).select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit_from(documents, spark.read.parquet(table(sf_dir, "labels")))
    return quality.scored(documents, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir).select("doc_id", "text"), width=3).select("doc_id", "fingerprint", "component_id")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encoded(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(table(sf_dir, "benchmark")).select("text")
    drawn = resample.resampled(_documents(spark, sf_dir).select("doc_id", "text"), benchmark, share=(10, 100), max_words=1, buckets=10_000, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir).select("lang", "source", "text"), min_docs=3, top_terms=200)


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encoded(_documents(spark, sf_dir).select("doc_id", "text"), pieces_path())
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return coded.select("doc_id", "n_tokens", F.sha2(spelled, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spotsigs_fingerprints,
        op2_line_dedup,
        op3_html_text,
        op4_quality,
        op5_simhash_groups,
        op6_pack_sequences,
        op7_license_scan,
        op8_bpe_round_trip,
        op9_pii_pseudonyms,
        op10_exact_dedup,
        op11_importance_resample,
        op12_source_divergence,
        op13_piece_round_trip,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, n, lines[n] AS raw,
         translate(regexp_replace(regexp_replace(lines[n], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM cut)),
gone AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM gone)) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE key NOT IN (SELECT key FROM gone)), '')) AS kept_sha256
FROM line GROUP BY doc_id
""",
    "op10_exact_dedup": """
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM low
""",
    # Checksums bit by bit: shifts of the register for each byte of each different word.
    "op11_importance_resample": r"""
WITH low AS (
  SELECT true AS own, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT false, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
word AS (SELECT own, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) AS r(i)),
spelled AS (
  SELECT w, list_transform(range(CAST(octet_length(encode(w)) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(w)), 2 * i + 1, 2)) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT w FROM word)),
hashed AS (
  SELECT w, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc_table),
feature AS (SELECT own, doc_id, bucket FROM word JOIN hashed USING (w)),
bucket_n AS (
  SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t,
         (SELECT count(*) FROM feature WHERE own) AS all_s, (SELECT count(*) FROM feature WHERE NOT own) AS all_t
  FROM feature GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM bucket_n),
scored AS (
  SELECT doc_id, count(gain) AS n_features, CAST(coalesce(floor(sum(gain)::DOUBLE / count(gain)), 0) AS BIGINT) AS weight
  FROM documents LEFT JOIN (SELECT doc_id, gain FROM feature JOIN gain USING (bucket) WHERE own) AS f USING (doc_id) GROUP BY doc_id),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM scored),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (10 * count(*) OVER ()) // 100 AS drawn
  FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM noisy LEFT JOIN placed USING (doc_id)
""",
    "op12_source_divergence": r"""
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
counted AS (SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
group_n AS (SELECT lang, source, sum(c) AS total FROM counted GROUP BY lang, source),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.total, 0)::HUGEINT + s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total::HUGEINT + s.v) AS q
  FROM grp AS g JOIN kept AS k USING (lang) JOIN sizes AS s USING (lang) LEFT JOIN counted AS c USING (lang, source, term) LEFT JOIN group_n AS n USING (lang, source)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM share AS a JOIN share AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
both_parts AS (
  SELECT * FROM all_pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM share WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 200
""",
}
