"""What a document of native equations leaves for an outer validation: the document, its metadata, a plan of checks, and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILY = "omml-native"
# Checks of the validation plan, their status before anything has run, and whether they need an outer program.
CHECKS = (("word-open", "not-run", True), ("word-export-pdf", "not-run", True), ("render-parity", "not-run", True), ("formula-count", "planned", False))


def evidence(formulas: DataFrame, canonical: DataFrame, docs: DataFrame) -> DataFrame:
    """For every document of ``docs`` what the tables tell: manifest_present, formula_count, canonicalization_present, canonical_mathml_count, unsupported_fragment_count.

    ``formulas``: the formula table; ``canonical``: canonical rows. What is missing is told as not present, with null counts.
    """
    counted = formulas.where(F.col("source_family") == FAMILY).groupBy("doc_id").agg(F.count("*").alias("formula_count"))
    accepted = F.col("status") == "accepted"
    made = canonical.where(F.col("source_family") == FAMILY).groupBy("doc_id").agg(F.count_if(accepted).alias("canonical_mathml_count"), F.count_if(~accepted).alias("unsupported_fragment_count"))
    found = docs.select("doc_id").join(counted, "doc_id", "left").join(made, "doc_id", "left")
    return found.withColumns({"manifest_present": F.col("formula_count").isNotNull(), "canonicalization_present": F.col("canonical_mathml_count").isNotNull()})


def validation_plan(manual: Column) -> Column:
    """The plan of checks: its status, how it is reviewed, and the checks."""
    checks = [F.struct(F.lit(i).alias("id"), F.lit(s).alias("status"), F.lit(x).alias("requires_external_application")) for i, s, x in CHECKS]
    return F.struct(
        F.when(manual, "manual-review-required").otherwise("pending-external-validation").alias("status"),
        F.when(manual, "required").otherwise("spot-check").alias("review_mode"),
        F.array(*checks).alias("planned_checks"),
    )


def packages(files: DataFrame, plan: DataFrame, formulas: DataFrame, canonical: DataFrame) -> DataFrame:
    """``files``: doc_id, content. ``plan``: routes per document and family. A row for each document with native equations.

    doc_id, validation_target (the document as it is), target_sha256, metadata (JSON of route, counts and names), plan (see
    :func:`validation_plan`), and the columns of :func:`evidence`. Documents without a route to this family leave nothing.
    """
    steps = plan.where(F.col("source_family") == FAMILY).select("doc_id", "route_kind", "next_action", F.coalesce("requires_manual_review", F.lit(False)).alias("manual"))
    found = files.select("doc_id", F.col("content").alias("validation_target")).join(steps, "doc_id").join(evidence(formulas, canonical, steps), "doc_id")
    told = ("next_action", "route_kind", "formula_count", "canonical_mathml_count", "unsupported_fragment_count")
    metadata = F.to_json(F.struct(F.lit(FAMILY).alias("source_family"), F.lit("omml").alias("provider"), *told, F.col("doc_id").alias("input_path"), F.lit("validation-target.docx").alias("validation_target_docx")))
    return found.withColumns({"target_sha256": F.sha2("validation_target", 256), "metadata": metadata, "plan": validation_plan(F.col("manual"))}).drop("route_kind", "next_action", "manual")
