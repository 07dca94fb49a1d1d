"""Containers that arrive in a folder, as a stream that stops when it has caught up.

An extension: each new file goes through the same batch transform once, remembered by the query's
checkpoint, so a rerun takes only what has come since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mathquarry.operators.detect import detect_all
from mathquarry.sources.containers import described, entries_of


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def catch_up(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = detect_all) -> None:
    """Process all files that are new since the last run, and append the transform's rows as Parquet.

    A batch that is repeated after a failure replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        entries = entries_of(described(batch.withColumnRenamed("path", "doc_id")))
        transform(entries).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
