"""Batches of payloads for a converter that runs elsewhere, and the counts of such a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathquarry.operators.risk import natural_number, stem


def to_convert(payloads: DataFrame, done: DataFrame | None, by: str = "doc_id", start: int = 0, end: int = 0, limit: int = 0) -> DataFrame:
    """``payloads``: a group column and name. In natural order of their names: the ``start``-th to ``end``-th of each
    group (0: open), without names that are ``done``, at most ``limit`` (0: all). Copies ("__" in the name) are left out.
    """
    rows = payloads.where(~F.col("name").contains("__")).withColumn("position", natural_number(stem(F.col("name"))))
    if start or end:
        n = F.row_number().over(Window.partitionBy(by).orderBy("position", "name"))
        rows = rows.withColumn("n", n).where((F.col("n") >= max(start, 1)) & ((F.col("n") <= end) | F.lit(not end))).drop("n")
    if done is not None:
        rows = rows.join(done.select("name"), "name", "left_anti")
    rows = rows.orderBy("position", "name")
    return rows.limit(limit) if limit else rows


def accepted(summary: DataFrame) -> DataFrame:
    """Conversions that went well and have their OMML."""
    return summary.where("status = 'ok' AND omml_exists = 'True'")


def run_counts(summary: DataFrame, by: str) -> DataFrame:
    """total, converted (with a status), ok, failed, accepted of each group."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return summary.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count("status").alias("converted"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col("status").isNotNull() & ~ok).alias("failed"),
        F.count_if(ok & (F.col("omml_exists") == "True")).alias("accepted"),
    )
