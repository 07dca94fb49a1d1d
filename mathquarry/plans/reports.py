"""Reports as lines of text: of a risk classification, and of a document's validation."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def risk_lines(classified: DataFrame, most: int = 30) -> DataFrame:
    """(position, line) of the text report: counts, reasons of manual review by name, the items for manual review, the first spot checks.

    ``classified``: rows of :func:`mathquarry.operators.risk.records`. Lines are ordered by position, a pair of
    section and number, so the report is written in parallel.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kinds = classified.sparkSession.createDataFrame([("auto_replace", 0), ("spot_check", 1), ("manual_review", 2)], "category string, k int")
    counts = kinds.join(classified.groupBy("category").count(), "category", "left").select(F.lit(0).alias("section"), F.col("k").cast("long").alias("item"), F.array(F.concat("category", F.lit("="), F.coalesce("count", F.lit(0)).cast("string"))).alias("lines"))
    manual = classified.where("category = 'manual_review'")
    reasons = manual.select(F.explode("reasons").alias("reason")).groupBy("reason").count()
    by_name = reasons.select(F.lit(2).alias("section"), F.row_number().over(Window.orderBy("reason")).cast("long").alias("item"), F.array(F.concat("reason", F.lit("="), F.col("count").cast("string"))).alias("lines"))

    def items(rows: DataFrame, section: int, *fields: str) -> DataFrame:
        shown = [F.concat(F.lit("- "), said("name"))]
        for f in fields:
            shown.append(F.concat(F.lit(f"  {f}="), F.array_join("reasons", "; ") if f == "reasons" else said(f)))
        return rows.select(F.lit(section).alias("section"), F.col("position").cast("long").alias("item"), F.array(*shown).alias("lines"))

    spots = classified.where("category = 'spot_check'").orderBy("position", "stem").limit(most)
    heads = classified.sparkSession.createDataFrame([(1, 0, ["", "[manual_reason_counts]"]), (3, 0, ["", "[manual_review]"]), (5, 0, ["", f"[spot_check_top{most}]"])], "section int, item long, lines array<string>")
    parts = [heads, by_name, items(manual, 4, "category", "reasons", "paragraph_index", "latex_preview", "text_before", "text_after"), items(spots, 6, "reasons", "paragraph_index", "latex_preview")]
    whole = counts
    for part in parts:
        whole = whole.unionByName(part)
    return whole.select(F.struct("section", "item").alias("position"), F.posexplode("lines").alias("k", "line")).select(F.struct("position.section", "position.item", "k").alias("position"), "line")


def validation_text(rows: DataFrame) -> DataFrame:
    """Adds ``report`` to validated rows: doc_id, provider, source_family, reference_pdf, target_exists, export_requested, export_status, visual_requested, visual_status, conclusion, residual_risks."""
    line = lambda name, value: F.concat(F.lit(name + "="), F.coalesce(value, F.lit("")))
    head: list[Column] = [
        line("artifact_type", F.lit("docx-validation-report")), line("conclusion", F.col("conclusion")), line("target_docx", F.col("doc_id")), line("provider", F.col("provider")), line("source_family", F.col("source_family")),
        line("target_exists", F.when(F.col("target_exists"), "passed").otherwise("failed")), line("word_export", F.when(F.col("export_requested"), F.col("export_status")).otherwise("not-run")),
        line("visual_compare", F.when(F.col("visual_requested"), F.col("visual_status")).otherwise("not-run")),
    ]
    reference = F.when(F.coalesce("reference_pdf", F.lit("")) != "", line("reference_pdf", F.col("reference_pdf")))
    risks = F.transform("residual_risks", lambda r: F.concat(F.lit("- "), r))
    lines = F.concat(F.array_compact(F.array(*head, reference)), F.array(F.lit(""), F.lit("residual_risks:")), risks)
    return rows.withColumn("report", F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def decoded_output(data: bytes | str | None) -> str:
    """What an outer tool printed: UTF-8, else GBK, else with replacement characters."""
    if data is None or isinstance(data, str):
        return data or ""
    for encoding in ("utf-8", "gbk", "cp936"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", errors="replace")


def command_line(arguments: list[str] | tuple[str, ...]) -> str:
    """Arguments as one line that an outer tool's shell takes apart again."""
    return subprocess.list2cmdline(list(arguments))
