"""Lenient reading of route entries and options, as column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mathquarry.functions.docx import FACTOR

_TRUE, _FALSE = ("1", "true", "yes"), ("0", "false", "no")


def boolean(value: Column, default: bool = False, letters: bool = False) -> Column:
    """1, true, yes / 0, false, no in any case; with ``letters`` also y and n. Anything else is the default."""
    text = F.lower(F.trim(value.cast("string")))
    yes, no = (_TRUE + ("y",), _FALSE + ("n",)) if letters else (_TRUE, _FALSE)
    return F.when(text.isin(*yes), True).when(text.isin(*no), False).otherwise(F.lit(default))


def integer(value: Column, default: int = 0) -> Column:
    """Whole numbers as text with blanks around them; anything else is the default."""
    text = F.trim(value.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")), F.lit(default))


def real(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("double"), F.lit(default))


def mathtype_options(options: Column) -> Column:
    """A map of options, normalized: booleans, the layout factor (only where layout is kept or it is given), indexes from 0."""
    has = lambda k: F.map_contains_key(options, k)
    at = lambda k: F.element_at(options, F.lit(k))
    keep = boolean(at("preserve_mathtype_layout"))
    return F.struct(
        F.when(has("preserve_mathtype_layout"), keep).alias("preserve_mathtype_layout"),
        F.when(keep | has("mathtype_layout_factor"), real(at("mathtype_layout_factor"), FACTOR)).alias("mathtype_layout_factor"),
        F.when(has("resume_mathtype_pipeline"), boolean(at("resume_mathtype_pipeline"))).alias("resume_mathtype_pipeline"),
        *(F.when(has(k), F.greatest(F.lit(0), integer(at(k)))).alias(k) for k in ("mathtype_start_index", "mathtype_end_index")),
    )


def mathtype_arguments(options: Column, script: bool = True) -> Column:
    """The converter's arguments that a map of options asks for, as an array: layout first, then resuming and the range.

    ``script``: as parameters of the script; else as options of the layout tool, which knows the layout only.
    """
    at = lambda k: F.element_at(options, F.lit(k))
    none = F.array().cast("array<string>")
    factor = real(at("mathtype_layout_factor"), FACTOR)
    # up to six significant digits, without zeros at the end
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(factor, F.lit(5))), "0+$", ""), "[.]$", "")
    layout = F.when(boolean(at("preserve_mathtype_layout")), F.array(F.lit("-PreserveMathTypeLayout" if script else "--preserve-mathtype-layout"), F.lit("-MathTypeLayoutFactor" if script else "--mathtype-layout-factor"), shown)).otherwise(none)
    if not script:
        return layout
    resume = F.when(boolean(at("resume_mathtype_pipeline")), F.array(F.lit("-Resume"))).otherwise(none)
    ends = [F.when(integer(at(k)) > 0, F.array(F.lit(flag), integer(at(k)).cast("string"))).otherwise(none) for flag, k in (("-StartIndex", "mathtype_start_index"), ("-EndIndex", "mathtype_end_index"))]
    return F.concat(layout, resume, *ends)


def equation3_review(entry: Column) -> Column:
    """Of four signals in a map any true one wins; without any signal review is needed."""
    keys = ("requires_manual_review", "manual_review_required", "manual_review_signal", "manual_review")
    any_true = F.lit(False)
    any_key = F.lit(False)
    for key in keys:
        any_key = any_key | F.map_contains_key(entry, key)
        any_true = any_true | boolean(F.element_at(entry, F.lit(key)))
    return F.when(any_key, any_true).otherwise(F.lit(True))


def odf_review(entry: Column, signals: Column, default: bool) -> Column:
    """The first of two keys that is there decides, else a list of signals, else the default."""
    said = F.lit(default)
    told = F.exists(F.coalesce(signals, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)).isin("manual-review", "manual_review"))
    said = F.when(told, True).otherwise(said)
    for key in ("manual_review_required", "requires_manual_review"):
        said = F.when(F.map_contains_key(entry, key), boolean(F.element_at(entry, F.lit(key)), default, letters=True)).otherwise(said)
    return said
