"""From the formula table to routes, reports and execution plans: joins with literal dimensions, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathquarry.plans import dimensions as dim


def source_counts(formulas: DataFrame, by: str = "doc_id") -> DataFrame:
    return formulas.groupBy(by, "source_family").agg(F.count("*").alias("formula_count"))


def route_plan(counts: DataFrame) -> DataFrame:
    """Each family's count with its route. A family without a route stops the job: no count is silently lost."""
    routes = F.broadcast(dim.routes(counts.sparkSession))
    joined = counts.join(routes, "source_family", "left")
    known = F.when(F.col("priority").isNull(), F.raise_error(F.concat(F.lit("unknown source family: "), F.coalesce("source_family", F.lit("null"))))).otherwise(F.col("priority"))
    return joined.withColumn("priority", known.cast("int"))


def routing_report(plan: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row per document: total, families in the order of their routes, and which need manual review."""
    step = F.struct("priority", "source_family", "formula_count", "route_kind", "next_action", "confidence_policy", "requires_manual_review")
    ordered = F.array_sort(F.collect_list(step))
    review = F.filter(ordered, lambda s: s["requires_manual_review"])
    return plan.groupBy(by).agg(
        F.sum("formula_count").alias("formula_count"),
        F.transform(ordered, lambda s: s["source_family"]).alias("recommended_sequence"),
        ordered.alias("route_plan"),
        F.bool_or("requires_manual_review").alias("manual_review_required"),
        F.transform(review, lambda s: s["source_family"]).alias("manual_review_reasons"),
    )


def default_contract(families: DataFrame) -> DataFrame:
    """Any family with its canonical MathML contract; families without one go to manual triage."""
    line, status, claim, binding = dim.NO_CONTRACT
    joined = families.join(F.broadcast(dim.contracts(families.sparkSession)), "source_family", "left")
    filled = {"source_line": F.lit(line), "contract_status": F.lit(status), "conversion_claim": F.lit(claim), "binding": F.lit(binding)}
    return joined.withColumns({name: F.coalesce(name, value) for name, value in filled.items()}).withColumn("target_format", F.lit("canonical-mathml"))


def review_signal(value: Column, default: bool) -> Column:
    """A lenient boolean: true, 1 and yes; false, 0 and no; anything else is the default."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true", "yes"), True).when(text.isin("0", "false", "no"), False).otherwise(F.lit(default))


def execution_plan(plan: DataFrame) -> DataFrame:
    """The route plan exploded onto its families' actions: provider, action_order, action_id, blocking.

    A family without a provider has the default step: one blocking action, manual triage.
    """
    known = F.broadcast(dim.actions(plan.sparkSession))
    joined = plan.join(known, "source_family", "left")
    action, blocks = dim.DEFAULT_ACTION
    without = F.col("provider").isNull()
    return joined.withColumns(
        {
            "blocking": F.when(without, F.lit(blocks)).otherwise(F.coalesce("blocking", "requires_manual_review")),
            "action_id": F.coalesce("action_id", F.lit(action)),
            "action_order": F.coalesce("action_order", F.lit(1)),
            "provider": F.coalesce("provider", F.lit("default")),
        }
    )


def manifest(formulas: DataFrame, documents: DataFrame, by: str = "doc_id") -> DataFrame:
    """One JSON document per file: its record and its formulas in order. ``documents`` has a row per file."""
    listed = formulas.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("source_family", "object_sequence", F.struct(*[c for c in formulas.columns if c != by]).alias("formula")))).alias("f"))
    rows = documents.join(listed, by, "left")
    found = F.coalesce(F.transform("f", lambda x: x["formula"]), F.array())
    return rows.select(by, F.to_json(F.struct(F.struct(*documents.columns).alias("document"), found.alias("formulas"))).alias("manifest"))
