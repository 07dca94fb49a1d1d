"""Labelled rows that a model may learn from, as a sample with a bound."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import held_out, texts_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label int) of at most ``rows`` labelled documents, the first in order of a hash of the id.

    Ids held out (see :func:`held_out`) never come, and labels without a document don't count; null labels don't
    come; of an id labelled twice the higher label counts, of several texts of an id one comes. Texts are
    whole, however long. The ids are at most ``rows`` longs, so they are broadcast.
    """
    known = labels.select(F.col(id_col).cast("long").alias("labelled"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("labelled").isNotNull() & ~held_out("labelled")).groupBy("labelled").agg(F.max("label").alias("label"))
    plain = texts_of(docs, id_col, text_col)
    there = known.join(plain.select(F.col("doc_id").alias("labelled")), "labelled", "left_semi")
    some = there.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    found = plain.join(F.broadcast(some), plain.doc_id == some.labelled)
    return found.groupBy("doc_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


def scorer(score) -> Column:
    """An Arrow function of a text column; ``score`` maps an array of texts (of any bytes) to doubles."""
    from mathquarry.llm.common import sliced

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [pa.array(score(batch.column("text")), pa.float64()) for batch in sliced(iter([whole]), "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    return run
