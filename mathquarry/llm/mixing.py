"""Mixing sources to target weights.

Words are summed per source, targets are filled up to a cap by weight, and each document is emitted
floor(rate) times plus once more with the fraction's probability, by a coin hashed from seed and id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathquarry.llm.common import written

#: Sources up to this many are joined by broadcast (a name and three numbers each), more by a shuffle.
SOURCE_BROADCAST = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(id_col: Column, seed: int) -> Column:
    """Uniform in [0, 1), the same in every run: the first 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes``: source, source_size. Adds weight and target.

    Weights repeat along the sources in code point order, null last. Targets share the sum of all
    sizes by weight and stop at ``most`` times the source's size; what is cut off is shared again
    until none is above. In order of cap by weight the capped sources are a prefix, so one running
    sum finds them all; integers keep the comparison exact. The running sums are one task's work: a
    name and a few numbers for each source, however many documents it has.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((number - 1) % len(weights) + 1).cast("int")).cast("long"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.orderBy(exact("cap") * F.lit(math.lcm(*weights)) / exact("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    filled = (
        listed.withColumn("cap", F.col("source_size") * most)
        .withColumns({"total": F.sum("source_size").over(every), "filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(onward)})
        .withColumn("capped", exact("cap") * exact("open") <= exact("weight") * (F.col("total") - F.col("filled")).cast("decimal(38,0)"))
    )
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / open_.cast("double"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: row (a struct of all its columns), doc_id, size, source_size, target, copies.

    Null text has size 0; null is a source of its own, the last. Rows of one id have one coin, so
    repeated rows are taken alike. A source without words takes nothing. No document is taken more
    than ``most`` times. An empty table stays empty; other columns keep their names, whatever they are.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    side = targets.withColumnRenamed("source", "of")
    side = F.broadcast(side) if targets.count() <= SOURCE_BROADCAST else side
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (coin(F.col("doc_id"), seed) < rate - whole).cast("long")).alias("copies")
    return sized.join(side, sized["source"].eqNullSafe(side["of"])).select("row", "doc_id", "size", "source_size", "target", copies)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns that the table has."""
    return mix_plan(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
