"""Registered queries of the subpackage: thin callers of the operators.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame`` over whole tables;
``SQL`` holds the DuckDB twin where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackml.llm import (alignment, html_text, minhash, packing, pii, quality_model, repeats,
                         rules, spelling, tiling, toxicity, urls, warc)
from trackml.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The public sentencepiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back by byte ranges."""
    folder = Scratch(spark, "warc").folder("archives")
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    read = warc.read_warc(manifest)
    return read.select(
        F.nullif(warc.page_id("record_id"), F.lit("")).cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.expr("substr(payload_digest, length('sha256:') + 1)").alias("payload_digest"),
        "record_type",
        F.nullif(warc.page_id("refers_to"), F.lit("")).cast("long").alias("refers_to"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pii.replaced(_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "row.text", "n_entities")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in 1024-token sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: three-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"),
                                   minhash.Params(words=3, percent=85))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.score(_table(spark, sf_dir, "documents"),
                               _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into each document."""
    return tiling.decontaminate(_table(spark, sf_dir, "documents"),
                                _table(spark, sf_dir, "benchmark"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that occur earlier."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return rules.judge(_table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars", "n_good")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' ids of every document."""
    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(),
                           piece_model_path())


QUERIES = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_tiling": op7_tiling,
    "op8_repeats": op8_repeats,
    "op9_rules": op9_rules,
    "op10_urls": op10_urls,
    "op11_html_text": op11_html_text,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS d FROM pages),
m AS (
  SELECT *, octet_length(encode(payload)) AS n,
         min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m""",
    "op9_rules": rules.judge_sql(),
    "op10_urls": urls.judge_sql(),
    # exact for the pages' own markup: what the article element holds, block by block
    "op11_html_text": r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(
    regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), '<[^>]*\z', '') AS h
  FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_replace(h, '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(
      regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp(;|\z)', '&', 'g'),
      '\s+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM a),
c AS (
  SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text,
         coalesce(len(parts), 0) AS n_good FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars, n_good FROM c""",
}
