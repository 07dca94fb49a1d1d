"""Reductions of statuses: actions to steps, steps to plans, checks to a validation's conclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gates of the page comparison: a value above is an excess.
MAX_CHANGED_RATIO, MAX_UNMATCHED_PAGES = 0.02, 0


def step_status(status: Column, supported: Column) -> Column:
    """Aggregate of a step's actions, by fixed precedence; over no action (null status) it is manual-only."""
    has = lambda s: F.coalesce(F.bool_or(status == s), F.lit(False))
    only_gates = F.coalesce(F.bool_and(status == "manual-gate"), F.lit(True))
    return (
        F.when(F.count(status) == 0, "manual-only")
        .when(has("failed"), "failed")
        .when(has("blocked-external-tool"), "blocked")
        .when(only_gates | F.bool_or(~supported), "manual-only")
        .when(has("validation-gated"), "validation-gated")
        .when(has("review-gated"), "review-gated")
        .when(F.bool_or(status.startswith("skipped")), "completed-with-skips")
        .otherwise("completed")
    )


def dry_run_status(supported: Column) -> Column:
    return F.when((F.count(supported) > 0) & F.bool_and(supported), "runnable").otherwise("manual-only")


def plan_counters(steps: DataFrame, by: str = "doc_id") -> DataFrame:
    """``steps``: status. Whatever is neither completed nor manual-only counts as blocked."""
    done = F.col("status").isin("completed", "completed-with-skips")
    manual = F.col("status") == "manual-only"
    return steps.groupBy(by).agg(F.count("*").alias("step_count"), F.count_if(done).alias("completed_step_count"), F.count_if(manual).alias("manual_only_step_count"), F.count_if(~done & ~manual).alias("blocked_step_count"))


def parity(expected: Column, accepted: Column, unsupported: Column, family: Column | str) -> Column:
    """Whether as many formulas came out as went in; families name a failed parity in their own way."""
    family = F.lit(family) if isinstance(family, str) else family
    right = (expected == accepted) & (unsupported == 0)
    other = F.when(family == "equation-editor-3-ole", "failed").when((family == "mathtype-ole") & (expected == accepted), "unsupported-fragments").otherwise("mismatch")
    return F.when(right, "passed").otherwise(other)


def canonical_gate(accepted: Column, parity_status: Column, family: Column | str) -> Column:
    family = F.lit(family) if isinstance(family, str) else family
    passed = F.when(family == "equation-editor-3-ole", "passed-limited").otherwise("passed")
    return F.when((accepted > 0) & (parity_status == "passed"), passed).otherwise("blocked-canonical-artifact")


def matched_pages(original: DataFrame, converted: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pages matched by position (``page``), unmatched ones on either side kept: metrics of both sides by prefix."""
    a = original.select(by, "page", F.struct(*[c for c in original.columns if c not in (by, "page")]).alias("original"))
    b = converted.select(by, "page", F.struct(*[c for c in converted.columns if c not in (by, "page")]).alias("converted"))
    return a.join(b, [by, "page"], "full")


def visual_gate(metrics: DataFrame, by: str = "doc_id", max_ratio: float = MAX_CHANGED_RATIO, max_unmatched: int = MAX_UNMATCHED_PAGES) -> DataFrame:
    """``metrics``: changed_ratio (null on an unmatched page), side counts per page. Strictly greater is an excess."""
    found = metrics.groupBy(by).agg(
        F.coalesce(F.max("changed_ratio"), F.lit(0.0)).alias("max_changed_ratio"),
        F.coalesce(F.avg("changed_ratio"), F.lit(0.0)).alias("average_changed_ratio"),
        F.count("changed_ratio").alias("page_count_compared"),
        F.count_if(F.col("changed_ratio").isNull()).alias("unmatched_pages_total"),
    )
    pages = F.format_string(f"Unmatched page count %d exceeds threshold {max_unmatched}.", "unmatched_pages_total")
    ratio = F.format_string(f"Max changed ratio %.6f exceeds threshold {max_ratio:.6f}.", "max_changed_ratio")
    reasons = F.array_compact(F.array(F.when(F.col("unmatched_pages_total") > max_unmatched, pages), F.when(F.col("max_changed_ratio") > max_ratio, ratio)))
    return found.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "passed").otherwise("review-gated"))


def validation(rows: DataFrame) -> DataFrame:
    """Conclusion of a document's validation, from what was asked and what the outer tools reported.

    Columns: target_exists, export_requested, export_status, visual_requested, has_reference boolean or
    string, visual_status, visual_reasons array. Export and comparison run elsewhere; their status is input.
    """
    exported = F.col("export_requested") & (F.col("export_status") == "passed")
    compared = F.col("visual_requested") & F.col("has_reference") & exported
    conclusion = (
        F.when(~F.col("target_exists"), "blocked")
        .when(compared & (F.col("visual_status") == "failed"), "blocked")
        .when(compared & (F.col("visual_status") == "review-gated"), "review-gated")
        .when(F.col("export_requested") & ~F.coalesce(exported, F.lit(False)), "blocked")
        .when(F.col("export_requested"), "deliverable-ready")
        .otherwise("research-only")
    )
    none = F.array().cast("array<string>")
    gate = F.when(compared & (F.col("visual_status") == "review-gated"), F.transform(F.coalesce("visual_reasons", none), lambda r: F.concat(F.lit("Visual compare gate: "), r))).otherwise(none)
    risks = F.when(~F.col("target_exists"), F.array(F.lit("Target DOCX does not exist."))).otherwise(
        F.concat(
            F.array_compact(
                F.array(
                    F.when(~F.col("export_requested"), "Word export not run; current result is research-only.").when(~exported, "Word PDF export failed; output is not deliverable-ready."),
                    F.when(~F.col("visual_requested"), "Visual PDF comparison not run.")
                    .when(~F.col("has_reference"), "Visual comparison requested without reference PDF.")
                    .when(compared & (F.col("visual_status") == "failed"), "Visual PDF comparison failed; inspect logs before claiming visual parity."),
                )
            ),
            gate,
        )
    )
    return rows.withColumns({"conclusion": conclusion, "residual_risks": risks})
