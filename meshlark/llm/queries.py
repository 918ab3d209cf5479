"""The registered queries op1_ to op10_ and their SQL; each is thin over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, lm, ngram_join, packing, pii, quality, suffix_dedup, token_codec, warc
from ._shared import Tables


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    files = token_codec.write_token_files(
        _table(spark, sf_dir, "documents"), f"{tables.root}/tokens", tokenizer_file("byte_bpe_50k.json"), "byte", 2, 50257, tables
    )
    return token_codec.read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Only for the registered query; a corpus gets a key of its own.
DEMONSTRATION_KEY = "demonstration"


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.pseudonymise(_table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)
    return masked.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), "found")


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = quality.STRICT_2
    book = quality.ledger(_table(spark, sf_dir, "documents"))
    base = quality.apply_policy(book, quality.BASE).withColumn("base_failed", ~F.col("kept"))
    judged = quality.apply_policy(base, policy)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("kept")).alias("kept"), F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("fail_bits"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_passages(docs, _table(spark, sf_dir, "benchmark"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    index = warc.write(_table(spark, sf_dir, "pages"), f"{tables.root}/warc", tables)
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), "word", 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_spread_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_token_codec, op3_feistel_pseudonyms, op4_quality_ledger, op5_decontamination,
        op6_deleted_interpolation, op7_warc_index, op8_suffix_array_dedup, op9_best_fit_packing, op10_line_dedup,
    )}


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT e.y, r.r FROM r JOIN e ON e.x = r.v WHERE e.y > r.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(r) AS component_id FROM r GROUP BY v) m USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS k FROM documents),
g AS (SELECT k, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
p AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM r CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) + length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS n_letters, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN p USING (k) LEFT JOIN l USING (k)),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 50)::BIGINT + 4 * (n_symbols * 1000 > n_words * 800)::BIGINT
         + 8 * (n_dup_lines * 1000 > n_lines * 500)::BIGINT + 16 * (word_chars < n_words * 2)::BIGINT + 32 * (word_chars > n_words * 20)::BIGINT
         + 64 * (n_letters * 10 < word_chars * 6)::BIGINT + 128 * (n_distinct * 20 < least(n_words, 2000))::BIGINT
         + 256 * (n_symbols * 1000 > n_words * 100)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
t AS (SELECT digest, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN t.top > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN t.top > d.page_id THEN t.top END AS refers_to
FROM d LEFT JOIN t ON d.digest = t.digest AND d.n >= 1000
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, text
  FROM documents),
s AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 10),
m AS (SELECT l.*, s.line IS NOT NULL AS bad FROM l LEFT JOIN s ON l.line = s.line),
c AS (SELECT text AS copied FROM documents GROUP BY text HAVING count(DISTINCT coalesce(source, chr(1))) >= 2),
w AS (
  SELECT doc_id, text, text IN (SELECT copied FROM c WHERE copied IS NOT NULL) AND 2 * coalesce(sum(strlen(line)) FILTER (bad), 0) > strlen(coalesce(text, '')) AS whole,
         count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS rest
  FROM m GROUP BY doc_id, text)
SELECT doc_id, n_lines, CASE WHEN whole THEN 0 ELSE n_bad END AS n_removed,
       md5(CASE WHEN whole OR n_bad = 0 THEN text ELSE coalesce(rest, '') END) AS kept_md5
FROM w
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op4_quality_ledger": OP4_SQL, "op7_warc_index": OP7_SQL, "op10_line_dedup": OP10_SQL}
