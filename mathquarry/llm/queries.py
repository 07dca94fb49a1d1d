"""The registered queries of this subpackage and the SQL that their rows can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathquarry.llm.bpe import bpe_digests
from mathquarry.llm.common import table
from mathquarry.llm.exact_dedup import exact_groups
from mathquarry.llm.html_text import extract_pages
from mathquarry.llm.media import media_features
from mathquarry.llm.mixing import mix_plan
from mathquarry.llm.quality import score_quality, train_quality
from mathquarry.llm.simhash import EXACT, simhash_groups
from mathquarry.llm.substring_dedup import substring_dedup
from mathquarry.llm.token_store import new_path, read_store, write_store
from mathquarry.llm.toxicity import score_toxicity, train_toxicity


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and three bits here, as the query fixes; the operator's own defaults are wider."""
    found = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, scheme=EXACT)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(words[s : s + 19], ' ') AS k FROM split, unnest(range(1, len(words) - 18)) AS u(s)
), later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT s + d) AS places FROM later, unnest(range(20)) AS u(d) GROUP BY doc_id
), kept AS (
  SELECT doc_id, words, CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS rest
  FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words) AS n_words, len(words) - len(rest) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_store(write_store(docs, tokenizer_path(), new_path(docs)))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), running AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources WINDOW o AS (ORDER BY 3 * source_size * 6 // weight, source NULLS LAST)
), decided AS (SELECT *, 3 * source_size::HUGEINT * open <= weight * (total - filled) AS capped FROM running),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
    (weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target
  FROM decided
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) AS taken FROM rated
"""


def op8_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_simhash_near_dedup, op2_media_columns, op3_toxicity, op4_exact_dedup, op5_substring_dedup, op6_token_id_output, op7_mixing_sources, op8_bpe_encoding_decoding, op9_html_extraction, op10_quality_classifier)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_mixing_sources": OP7_SQL}
