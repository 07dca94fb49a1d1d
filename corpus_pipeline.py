"""A training-data pipeline over ``documents``: five stages, each an operator of mathquarry.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in
the shared folder and reads it back as the next stage's documents. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mathquarry.llm.bpe import bpe_digests
from mathquarry.llm.common import table, written
from mathquarry.llm.exact_dedup import exact_groups, rows_of, rows_with_id
from mathquarry.llm.mixing import mixed
from mathquarry.llm.quality import ACCEPT, quality_column, train_quality
from mathquarry.llm.queries import tokenizer_path
from mathquarry.llm.simhash import simhash_groups


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go.

    Every row is judged by its own text; null and empty texts are one empty line and are judged too, repeated
    rows stay or go together, very long texts are scored whole. An empty table stays empty. Columns beyond
    those of documents are carried along, whatever their names.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_column(model) >= ACCEPT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays.

    Null and empty texts are equal; of rows that repeat id and text one stays; a null id stays only where its
    text has no other. Texts of any length are compared by their chunks. An empty table stays empty; further
    columns are carried along.
    """
    return rows_of(docs, exact_groups(docs).where("kept").select("doc_id", "text_sha256"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays.

    Documents of one id stay or go together; those without an id stay if all of their group lack one. Null texts
    are empty, and texts without words are alike to each other only; very long texts count with all their shingles.
    An empty table stays empty; further columns are carried along.
    """
    groups = simhash_groups(docs.select("doc_id", "text"))
    return rows_with_id(docs, groups.where("doc_id <=> component_id").select("doc_id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents are repeated or left out accordingly.

    A null source is a source of its own, the last; null and empty texts have no words and follow their source's
    rate; rows of one id are taken alike. An empty table stays empty; further columns are carried along.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is encoded and decoded: a row for every row, repeated ones too.

    Null and empty texts have no tokens and the digest of the empty text; very long texts are encoded whole. An
    empty table stays empty; other columns are not looked at.
    """
    return bpe_digests(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("BPE encoding and decoding", tokens)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
