"""Documents with their OLE equations replaced by OMML, and layout lines as relational expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathquarry.functions import docx
from mathquarry.functions.word import relationships


def replacements(equations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``equations``: doc_id, stem, omml. ``wanted``: doc_id, stem of the objects to replace; without it, all that have an equation.

    (doc_id, stem, omml): what is wanted and has no equation has a null one, which stops its document.
    """
    return equations if wanted is None else wanted.select("doc_id", "stem").distinct().join(equations, ["doc_id", "stem"], "left")


def replaced(containers: DataFrame, equations: DataFrame, keep_layout: bool = False, factor: float = docx.FACTOR) -> DataFrame:
    """``containers``: doc_id, content. ``equations``: doc_id, stem, omml (see :func:`replacements`). (doc_id, content, replaced_count, error).

    Documents without equations come back unchanged; what can't be rewritten, or lacks an equation that is
    wanted, comes back with its error.
    """
    per_doc = equations.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "omml"))).alias("omml"))
    rows = containers.select("doc_id", "content").join(per_doc, "doc_id", "left").select("doc_id", "content", F.to_json("omml", {"ignoreNullFields": "false"}).alias("omml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import json
        import zipfile

        for batch in batches:
            out = []
            for doc, content, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = json.loads(told) if told else {}
                    with zipfile.ZipFile(io.BytesIO(content)) as file:
                        document = file.read("word/document.xml").decode()
                        rels = file.read("word/_rels/document.xml.rels") if "word/_rels/document.xml.rels" in file.namelist() else None
                    targets = {r["rid"]: r["target"] for r in relationships("word/document.xml", rels)} if rels else {}
                    text, done = docx.replace_objects(document, targets, found)
                    if keep_layout:
                        text, _ = docx.keep_layout(text, docx.paragraph_heights(document), {d["paragraph_index"] for d in done}, factor)
                    made = docx.rezipped(content, {"word/document.xml": ('<?xml version="1.0" encoding="UTF-8"?>\n' + text).encode()}) if done else content
                    out.append((doc, made, len(done), None))
                except Exception as problem:  # one document's fault is a row
                    out.append((doc, content, 0, f"{type(problem).__name__}: {problem}"))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int32(), pa.string()), strict=True)], ["doc_id", "content", "replaced_count", "error"])

    return rows.mapInArrow(run, "doc_id string, content binary, replaced_count int, error string")


def style_points(style: Column, key: str) -> Column:
    """A length in points from an inline style."""
    return F.nullif(F.regexp_extract(style, rf"(?i)(?:^|;)\s*{key}\s*:\s*([0-9.]+)\s*pt\b", 1), F.lit("")).try_cast("double")


def adjusted_line(height: Column, previous: Column, factor: float = docx.FACTOR) -> Column:
    """Line height in twentieths of a point; halves round to even."""
    if factor < 1:
        raise ValueError(f"a layout factor below 1 would cut lines: {factor!r}")
    floor = F.lit(docx.LINE_FLOOR)
    base = F.greatest(floor, previous, F.bround(height * 20).cast("int"))
    return F.when(base > floor, F.greatest(floor, F.bround(base * factor).cast("int"))).otherwise(base)


def layout_summary(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """``rows``: adjusted_line per replaced paragraph. An empty document has the floor everywhere."""
    floor = F.lit(docx.LINE_FLOOR)
    return rows.groupBy(by).agg(
        F.count("adjusted_line").alias("adjusted_paragraph_count"),
        F.coalesce(F.min("adjusted_line"), floor).alias("line_min"),
        F.coalesce(F.max("adjusted_line"), floor).alias("line_max"),
        F.coalesce(F.avg("adjusted_line"), floor.cast("double")).alias("line_mean"),
    )
