"""Readers and writers of the engine's own tables: conversion summaries, object maps, plans, manifests, reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = ("name", "status", "xml_exists", "mathml_exists", "omml_exists", "tex_exists", "skipped_existing", "latex_preview", "mathml_preview", "error")
PLAN = (
    "document_id string, input_path string, detector_version string, formula_count long, recommended_sequence array<string>, "
    "steps array<struct<source_family:string, formula_count:long, route_kind:string, confidence_policy:string, requires_manual_review:boolean, provider:string, next_action:string, "
    "actions:array<struct<action_id:string, description:string, blocking:boolean>>, notes:array<string>>>"
)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A conversion summary (CSV with a header, a byte order mark or none): all columns are text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def write_summary(rows: DataFrame, path: str) -> None:
    rows.select(*SUMMARY).write.csv(path, header=True, escape='"')


def read_object_map(spark: SparkSession, path: str) -> DataFrame:
    """The items of object maps in JSON, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("items"))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Execution plans in JSON, one row per action (steps without actions keep one)."""
    plans = spark.read.option("multiLine", True).schema(PLAN).json(path)
    steps = plans.select(F.col("document_id").alias("doc_id"), "input_path", F.posexplode("steps").alias("step_order", "step"))
    acts = steps.select("doc_id", "input_path", "step_order", "step.*").withColumn("action", F.explode_outer("actions"))
    return acts.select("doc_id", "input_path", "step_order", "source_family", "formula_count", "route_kind", "confidence_policy", "requires_manual_review", "provider", "next_action", "action.*")


def write_json(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Manifests, routing reports, plans, blockers and evidence: one JSON object a line."""
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).json(path)


def summary_text(counts: DataFrame, by: str = "doc_id") -> DataFrame:
    """A short text per document: its total and its families in order."""
    line = F.concat(F.lit("  "), "source_family", F.lit(": "), F.col("formula_count").cast("string"))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return counts.groupBy(by).agg(F.concat(F.lit("formula_count: "), F.sum("formula_count").cast("string"), F.lit("\nsource_counts:\n"), lines).alias("summary"))


def validation_target(direct: Column, metadata: Column) -> Column:
    """The document to validate: given directly, else the first path that the JSON metadata names."""
    paths = ("$.validation_target_docx", "$.target_docx", "$.artifacts.validation_target.validation_target_docx")
    return F.coalesce(F.nullif(direct, F.lit("")), *(F.nullif(F.get_json_object(metadata, p), F.lit("")) for p in paths))


def resolved_input(input_path: str, plan_path: str, root: str) -> str:
    """Where a plan's document is: an absolute path as it stands, else beside the plan if it is there, else below ``root``."""
    if os.path.isabs(input_path):
        return input_path
    if plan_path:
        beside = os.path.join(os.path.dirname(os.path.join(root, plan_path)), input_path)
        if os.path.exists(beside):
            return os.path.realpath(beside)
    return os.path.realpath(os.path.join(root, input_path))


def slug(name: Column) -> Column:
    """A file-name-safe form of a stream name."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt out evenly to two tasks a core (or shuffle.partitions, if that is more).

    For narrow rows that much work follows from: a file is split by its bytes, so a million keys may be one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that several uses don't make them anew.

    The folder is spark.checkpoint.dir, or one in the warehouse where that is unset; a warehouse without a file
    system's name may lie on one machine only, so on a cluster it is refused.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and (":" not in folder or folder.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder += "/_checkpoints"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
