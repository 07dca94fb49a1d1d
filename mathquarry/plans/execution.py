"""Statuses of a plan's actions, planned or carried out, as a rule table joined to the plan.

Work happens in the transforms of ``operators``; what they found per document and family (facts) decides
each action's status. External tools never run here: their outcome is a fact too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathquarry.plans.status import dry_run_status, step_status

# Fixed values: (provider, action, fact, status if the fact holds, if not, whether each is supported).
# Facts: extracted, converted (the canonical gate passed), external_allowed, manual; "always" holds.
RULES = [
    ("mathtype", "extract-equation-native", "converted", "validation-gated", "blocked-external-tool", True, True),
    *(("mathtype", a, "converted", "covered-by-document-pipeline", "skipped-after-failure", True, True) for a in ("mtef-to-mathml", "normalize-mathml", "mathml-to-omml", "replace-ole-with-omml")),
    ("mathtype", "validate-word-output", "converted", "validation-gated", "skipped-after-failure", True, True),
    ("omml", "extract-omml", "extracted", "completed", "failed", True, True),
    *(("omml", a, "extracted", "completed", "skipped-after-failure", True, True) for a in ("normalize-omml", "omml-to-canonical-mathml", "package-omml-output")),
    ("omml", "render-check", "manual", "review-gated", "skipped", True, True),
    ("equation3", "probe-header-and-classid", "converted", "completed", "review-gated", True, True),
    ("equation3", "attempt-mtef-conversion", "converted", "completed", "manual-gate", True, False),
    ("equation3", "fallback-manual-triage", "converted", "skipped-not-needed", "manual-gate", True, False),
    ("equation3", "word-roundtrip-validation", "converted", "skipped-downstream", "review-gated", True, False),
    ("axmath", "classify-axmath-object", "always", "export-gate", "export-gate", True, True),
    ("axmath", "export-assisted-conversion", "external_allowed", "validation-gated", "blocked-external-tool", True, True),
    ("axmath", "import-converted-math", "always", "skipped-until-export-artifacts", "skipped-until-export-artifacts", True, True),
    ("axmath", "manual-spot-check", "manual", "review-gated", "validation-gated", True, True),
    ("odf", "extract-odf-formula", "opened", "completed", "failed", True, True),
    ("odf", "emit-target-format", "opened", "validation-gated", "skipped-after-failure", True, True),
    *(("odf", a, "always", "review-gated", "review-gated", True, True) for a in ("inspect-transform-chain", "bridge-review", "decide-reconvert-or-accept")),
]
#: What a dry run says where it isn't "ready".
DRY = {"render-check": "validation-gated", "fallback-manual-triage": "skipped-until-needed", "word-roundtrip-validation": "skipped-downstream", "emit-target-format": "validation-gated"}
_COLUMNS = "provider string, action_id string, fact string, holds string, otherwise string, supported_if boolean, supported_else boolean"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, _COLUMNS)


def action_reports(plan: DataFrame, facts: DataFrame, external_allowed: bool = False) -> DataFrame:
    """``plan``: exploded actions; ``facts``: doc_id, source_family, opened, extracted, converted booleans.

    Adds status and supported. Without external tools MathType's actions are all blocked; an action
    without a rule is a manual gate.
    """
    joined = plan.join(facts, ["doc_id", "source_family"], "left").join(F.broadcast(rules(plan.sparkSession)), ["provider", "action_id"], "left")
    no = F.lit(False)
    said = {n: F.coalesce(n, no) for n in ("opened", "extracted", "converted")} | {"manual": F.col("requires_manual_review"), "external_allowed": F.lit(external_allowed), "always": F.lit(True)}
    holds: Column = no
    for name, value in said.items():
        holds = F.when(F.col("fact") == name, value).otherwise(holds)
    empty = (F.col("action_id") == "convert-odf-mathml") & (F.col("provider") == "odf")
    converted = F.when(~said["opened"], "skipped-after-failure").when(~said["extracted"], "skipped-empty").otherwise("completed")
    blocked = (F.col("provider") == "mathtype") & F.lit(not external_allowed)
    status = F.when(blocked, "blocked-external-tool").when(empty, converted).when(F.col("fact").isNull(), "manual-gate").when(holds, F.col("holds")).otherwise(F.col("otherwise"))
    supported = F.when(blocked | empty, True).when(F.col("fact").isNull(), False).when(holds, F.col("supported_if")).otherwise(F.col("supported_else"))
    return joined.withColumns({"status": status, "supported": supported}).drop("fact", "holds", "otherwise", "supported_if", "supported_else", "opened", "extracted", "converted")


def dry_run(plan: DataFrame) -> DataFrame:
    """Planned actions: ready, or what a dry run says instead; those without a rule are manual gates."""
    joined = plan.join(F.broadcast(rules(plan.sparkSession).select("provider", "action_id", F.lit(True).alias("known"))), ["provider", "action_id"], "left")
    known = F.coalesce("known", F.lit(False)) | ((F.col("provider") == "odf") & (F.col("action_id") == "convert-odf-mathml"))
    other = F.element_at(F.create_map(*[F.lit(x) for pair in DRY.items() for x in pair]), F.col("action_id"))
    gates = F.when(F.col("provider") == "axmath", F.when(F.col("action_id").isin("classify-axmath-object", "export-assisted-conversion"), "export-gate").otherwise("validation-gated"))
    return joined.withColumns({"status": F.when(~known, "manual-gate").otherwise(F.coalesce(other, gates, F.lit("ready"))), "supported": known}).drop("known")


def step_reports(actions: DataFrame) -> DataFrame:
    """A step per document and family, from its actions' statuses."""
    return actions.groupBy("doc_id", "source_family", "provider").agg(step_status(F.col("status"), F.col("supported")).alias("status"), dry_run_status(F.col("supported")).alias("dry_run_status"), F.count("*").alias("action_count"))


def blockers(actions: DataFrame) -> DataFrame:
    """Actions that hold a document back: blocked, failed, gated, or without support."""
    return actions.where(~F.col("supported") | F.col("status").isin("blocked-external-tool", "failed", "review-gated", "manual-gate", "export-gate"))
