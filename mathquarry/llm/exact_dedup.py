"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling gear hash of its bytes says so, so equal passages give equal chunks.
Every chunk gets a 64-bit identifier; the identifiers are verified against the chunks' SHA-256, and
those that stand for two different chunks carry the digest along. A document is then its ordered
list of identifiers, and only these short lists are compared and moved, never the texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import as_bytes, forget, joined, sliced, texts_of, written

#: Cut where the top bits of the gear hash are zero: every 2**CUT_BITS bytes on average, within these lengths.
CUT_BITS, SHORTEST, LONGEST = 10, 256, 16384
#: Identifiers with two chunks up to this many are joined by broadcast (48 bytes each), more by a shuffle.
CLASH_BROADCAST = 50_000

#: Rows that one array stands for when repeated rows are given back.
REPEATS = 4096

_GEAR = np.random.default_rng(20260101).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places that end a chunk: the gear hash of the 32 bytes up to there has its top bits zero."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunks(values: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(row, position in the recipe, chunk) of every text; an empty text is one empty chunk."""
    data, starts = joined(values)
    places = cuts(data).tolist()
    for row, value in enumerate(values):
        begin, at, pos = int(starts[row]), 0, 0
        size = len(value)
        while True:
            k = bisect_left(places, begin + at + SHORTEST)
            to = places[k] - begin if k < len(places) else size
            to = min(to, at + LONGEST, size)
            if size - to < SHORTEST:
                to = size
            yield row, pos, value[at:to]
            at, pos = to, pos + 1
            if at >= size:
                break


def _recipes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        values = as_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        whole = [hashlib.sha256(x).digest() for x in values]
        rows, pos, short, digest = [], [], [], []
        for row, p, chunk in chunks(values):
            rows.append(row)
            pos.append(p)
            short.append(xxhash.xxh3_64_intdigest(chunk) - 2**63)
            digest.append(hashlib.sha256(chunk).digest() if p or len(chunk) < len(values[row]) else whole[row])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[r] for r in rows], pa.int64()),
                pa.array([int.from_bytes(whole[r][:8], "little", signed=True) for r in rows], pa.int64()),
                pa.array([None if p else whole[r] for r, p in zip(rows, pos, strict=True)], pa.binary()),
                pa.array(pos, pa.int32()),
                pa.array(short, pa.int64()),
                pa.array(digest, pa.binary()),
            ],
            ["doc_id", "mark", "sha", "pos", "short", "digest"],
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, keep_id, group_size long, kept, text_sha256, n_chunks int, n_rows long.

    Texts are equal when identical without any change; null counts as empty. Of equal texts the
    largest id stays. Rows that repeat both id and text are told apart by nothing: all of them are kept
    or none, n_rows counts them, and group_size counts rows. A null id is below every other; a group of null
    ids only keeps null. Two texts under one id are two documents. An empty table gives no rows;
    other columns are not looked at.
    """
    parts = written(texts_of(docs, id_col, text_col).mapInArrow(_recipes_of, "doc_id long, mark long, sha binary, pos int, short long, digest binary"), "chunks")
    clash = written(parts.select("short", "digest").distinct().groupBy("short").count().where("count > 1").select("short", F.lit(True).alias("clash")), "clash")
    side = F.broadcast(clash) if clash.count() <= CLASH_BROADCAST else clash
    named = parts.join(side, "short", "left").withColumn("digest", F.when(F.col("clash"), F.col("digest")))
    recipes = written(
        named.groupBy("doc_id", "mark").agg(
            F.sort_array(F.collect_set(F.struct("pos", "short", F.coalesce("digest", F.lit(b"")).alias("more")))).alias("recipe"),
            F.max("sha").alias("sha"),
            F.count("sha").alias("n_rows"),
        ),
        "recipes",
    )
    forget(parts)
    forget(clash)
    groups = written(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size")), "groups")
    # a recipe that repeats gives as many rows, by way of pieces of up to REPEATS, so no array grows with the data
    pieces = F.sequence(F.lit(0).cast("long"), F.expr(f"(n_rows - 1) div {REPEATS}"))
    repeated = recipes.join(groups, "recipe").withColumn("piece", F.explode(pieces)).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS), F.expr(f"n_rows - piece * {REPEATS}")))))
    return repeated.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.size("recipe").alias("n_chunks"),
        "n_rows",
    )


def rows_of(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_sha256) is in ``keep``, one of each; all columns stay as they are.

    The join deals documents by that pair, and repeats are dropped within the same deal.
    """
    key = next(n for n in (f"key{i}" for i in range(10**6)) if n not in docs.columns)
    one = lambda i, digest: F.concat_ws(":", F.coalesce(i.cast("long").cast("string"), F.lit("null")), digest)
    keyed = docs.withColumn(key, one(F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    right = keep.select(one(F.col("doc_id"), F.col("text_sha256")).alias(key))
    return keyed.join(right, key, "left_semi").dropDuplicates([key]).drop(key)


def rows_with_id(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id (null included) is in ``keep``; all columns stay as they are."""
    right = keep.select(F.col("doc_id").alias("keep_a"))
    return docs.join(right, docs[id_col].cast("long").eqNullSafe(right.keep_a), "left_semi")
