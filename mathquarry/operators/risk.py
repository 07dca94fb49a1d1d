"""Risk of converted formulas, from their LaTeX preview: column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What needs a look by hand, and what a spot check.
TAIL = r"(?:=|\+|-|/|\\leq|\\geq|<|>|//)\s*(?:\\\]|\\\)|$)"
MANUAL = (
    (r"\\frac\{\}\{", "empty_numerator"),
    (r"\\frac\{[^}]*\}\{\}", "empty_denominator"),
    (r"\{\}\^\{\}", "empty_superscript"),
    (r"\^\{\}", "empty_superscript"),
    (r"_\{\}", "empty_subscript"),
    (r"\\left\{\s*\\right\.", "suspicious_empty_piecewise"),
    (r"\\left\{\s*\{\s*\}\s*\\right\.", "empty_piecewise_body"),
    (r"[=+\-*/]\s*\)", "operator_missing_rhs"),
    (r"\(\s*[+\-*/=]", "operator_missing_lhs"),
    (TAIL, "trailing_operator_or_relation"),
)
WITHOUT_SPACES = ((("{}^{}",), "empty_superscript"), (("_{}",), "empty_subscript"), (("x+)", "x-)"), "missing_operand_inside_parentheses"), (("\\left\\{{}\\right.",), "empty_piecewise_body"))
COMMANDS = (
    "\\left", "\\right", "\\overrightarrow", "\\bigtriangleup", "\\cup", "\\cap", "\\subset", "\\lbrack", "\\rbrack", "\\alpha", "\\beta", "\\Omega",
    "\\log", "\\sin", "\\cos", "\\tan", "\\parallel", "\\perp", "\\sum", "\\prod", "\\int",
)
LONG = 28
LAST = 10**9


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def classified(rows: DataFrame) -> DataFrame:
    """``rows``: status, omml_exists, tex_exists, latex_preview, text_after (all text). Adds category and reasons.

    Reasons are sorted and distinct. A formula that ends in an operator before a blank to fill in is a
    spot check whatever else is wrong with it.
    """
    # columns of their own, so that no test works them out anew
    rows = rows.withColumns({"risk_preview": _trimmed(F.col("latex_preview")), "risk_after": _trimmed(F.col("text_after"))})
    rows = rows.withColumn("risk_bare", F.replace("risk_preview", F.lit(" "), F.lit("")))
    preview, bare = F.col("risk_preview"), F.col("risk_bare")
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    tests: list[tuple[Column, str]] = [(differs("status", "ok"), "status_not_ok"), (differs("omml_exists", "True"), "missing_omml"), (differs("tex_exists", "True"), "missing_latex"), (preview == "", "empty_latex_preview")]
    tests += [(preview.rlike(pattern), reason) for pattern, reason in MANUAL]
    tests += [(_any(bare.contains(t) for t in texts), reason) for texts, reason in WITHOUT_SPACES]
    flagged = lambda ts: F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(t, F.lit(r)) for t, r in ts)))))
    checks = [
        (F.length(preview) >= LONG, "long_formula"),
        (_any(preview.contains(c) for c in COMMANDS), "has_complex_commands"),
        (preview.contains("_") | preview.contains("^"), "has_scripts"),
        (preview.contains("|") | preview.contains("//"), "has_set_or_geometry_relation"),
    ]
    before_blank = F.col("risk_after").rlike(r"^_{3,}[.]*$") & preview.rlike(TAIL)
    one = lambda r: F.array(F.lit(r))
    found = rows.withColumns({"manual": flagged(tests), "spot": flagged(checks)})
    is_manual, is_spot = F.size("manual") > 0, F.size("spot") > 0
    grouped = preview.startswith("{") & preview.endswith("}")
    return found.withColumns(
        {
            "category": F.when(is_manual & ~before_blank, "manual_review").when(is_manual | is_spot | grouped, "spot_check").otherwise("auto_replace"),
            "reasons": F.when(is_manual, F.when(before_blank, one("formula_followed_by_blank")).otherwise(F.col("manual"))).when(is_spot, F.col("spot")).when(grouped, one("grouped_output_needs_review")).otherwise(F.array().cast("array<string>")),
        }
    ).drop("manual", "spot", "risk_preview", "risk_bare", "risk_after")


def one_line(text: Column, most: int = 120) -> Column:
    """A preview: white space made one blank, trimmed, at most so many characters."""
    return F.left(F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " ")), F.lit(most))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def natural_number(text: Column) -> Column:
    """The first integer in a name; names without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"([0-9]+)", 1), F.lit("")).try_cast("bigint"), F.lit(LAST))


def records(summary: DataFrame, objects: DataFrame) -> DataFrame:
    """The conversion summary with its place in the document (by file stem, the last object of a stem counts), classified."""
    from pyspark.sql import Window

    keyed = objects.where("coalesce(ole_target, '') <> ''").withColumn("stem", stem(F.col("ole_target")))
    last = keyed.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("sequence")))).where("k = 1")
    joined = summary.withColumn("stem", stem(F.col("name"))).join(last.select("stem", "paragraph_index", "run_index", "text_before", "text_after"), "stem", "left")
    return classified(joined).withColumn("position", natural_number(F.col("stem")))


def reason_ranking(classified_rows: DataFrame) -> DataFrame:
    """How often each reason sends a formula to manual review, most frequent first."""
    # no filter, which would be pushed below the classes and work them out once more
    reasons = classified_rows.select(F.explode(F.when(F.col("category") == "manual_review", F.col("reasons"))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def spot_checks(classified_rows: DataFrame, most: int = 30) -> DataFrame:
    """The first items for a spot check, in natural order."""
    return classified_rows.where("category = 'spot_check'").orderBy("position", "stem").limit(most)
