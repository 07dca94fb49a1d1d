"""Rendered pages of a document and of its conversion, compared page by page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mathquarry.functions import raster
from mathquarry.plans.status import matched_pages

METRICS = "width int, height int, changed_pixels long, changed_ratio double, mean_abs_diff double, rms_diff double, diff_box struct<left int, top int, right int, bottom int>"


def page_metrics(original: DataFrame, converted: DataFrame, by: str = "doc_id", pictures: bool = False) -> DataFrame:
    """``original`` and ``converted``: a document column (text), page, picture (binary PPM).

    Pages match by number. A page without its other has no metrics, and so has one that can't be read, with
    its error. With ``pictures`` the marked page is there too. The result feeds ``visual_gate``.
    """
    from pyspark.sql import functions as F

    both = matched_pages(original.select(by, "page", "picture"), converted.select(by, "page", "picture"), by)
    rows = both.select(F.col(by).cast("string").alias(by), F.col("page").cast("int").alias("page"), F.col("original.picture").alias("a"), F.col("converted.picture").alias("b"))
    ddl = f"{by} string, page int, {METRICS}, marked binary, error string"
    schema = original.sparkSession.createDataFrame([], ddl).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a page at a time: pictures are large
                doc, page, a, b = (c[k].as_py() for c in batch.columns)
                out = {by: doc, "page": page}
                try:
                    if a is not None and b is not None:
                        out |= raster.metrics(a, b) | ({"marked": raster.marked(a, b)} if pictures else {})
                except ValueError as problem:
                    out["error"] = str(problem)
                yield pa.RecordBatch.from_arrays([pa.array([out.get(f.name)], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)
