"""Repeated passages: Rabin-Karp hashes of every window of words, counted over the whole corpus.

Words get a 128-bit digest, and a window two polynomial hashes of its words' digests, 64 bits each. Windows
are hashed in numpy and dealt into buckets, packed as binary blocks: ten bytes a window, and documents
and starts pressed. Within a slice, where all 128 bits are compared, only the earliest of equal windows is
sent, so a passage that a third of all documents share is pre-aggregated before the shuffle. A bucket tells
which of its windows also start earlier, by the 80 bits sent and those that led to the bucket; these starts
go back, packed by group of documents, merge into maximal intervals, and the words in them are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import SPACE, as_bytes, joined, mixed_hash, sliced, span_hashes, texts_of, word_bounds, written

WINDOW = 20
#: Bytes of text whose windows share a bucket; a bucket is what one task holds at once.
BUCKET_BYTES = 12_000_000
_NULL = np.iinfo(np.int64).min

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB53)


def word_digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each word, as (words, 2). Each distinct word is digested once; a word's bytes can't be chosen to collide."""
    space = SPACE[data]
    kept = ~space
    kept[end] = True
    text = np.where(space, np.uint8(0x20), data)[kept]
    ends = np.append(0, np.cumsum(end - first + 1)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
    found = b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist()))
    return np.frombuffer(found, dtype="<u8").reshape(-1, 2)[words.indices.to_numpy(zero_copy_only=False)]


def windows(values: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes as a row, row, start word) of every window of every text, in that order of rows and starts."""
    data, starts = joined(values)
    first, end = word_bounds(data)
    words = np.diff(np.searchsorted(first, starts))
    count = np.maximum(words - window + 1, 0)
    rows = np.repeat(np.arange(len(values)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = np.empty((len(rows), 2), dtype=np.uint64)
    if len(rows):
        at = (np.cumsum(words) - words)[rows] + start
        for k, digest in enumerate(word_digests(data, first, end).T):
            out[:, k] = mixed_hash(span_hashes(digest, _BASES[k], at, at + window))
    return out, rows, start


def _packed(docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    """Windows in order of (doc, start): runs of documents and starts as differences, pressed; then 80 bits of hashes, if any."""
    new = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    ids = docs[new]
    runs = np.diff(np.append(new, len(docs))).astype(np.int32)
    steps = np.diff(starts, prepend=0)
    steps[new] = starts[new]
    narrow = np.uint16 if steps.max(initial=0) < 65536 else np.uint32
    places = zstandard.ZstdCompressor(level=1).compress(np.diff(ids, prepend=0).tobytes() + runs.tobytes() + steps.astype(narrow).tobytes())
    head = np.array([len(docs), len(ids), np.dtype(narrow).itemsize, len(places)], dtype=np.int64)
    kept = b"" if hashes is None else hashes[:, 0].tobytes() + hashes[:, 1].astype("<u2").tobytes()
    return b"".join([head.tobytes(), places, kept])


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, starts, hashes) of a packed block; hashes are empty if it has none."""
    n, m, width, size = np.frombuffer(block, np.int64, 4).tolist()
    places = zstandard.ZstdDecompressor().decompress(block[32 : 32 + size])
    ids = np.cumsum(np.frombuffer(places, np.int64, m))
    runs = np.frombuffer(places, np.int32, m, 8 * m)
    steps = np.frombuffer(places, np.uint16 if width == 2 else np.uint32, n, 12 * m).astype(np.int64)
    total = np.cumsum(steps)
    begin = np.cumsum(runs) - runs
    starts = total - np.repeat(total[begin] - steps[begin], runs)
    hashes = np.zeros((n if len(block) > 32 + size else 0, 2), dtype=np.uint64)
    hashes[:, 0] = np.frombuffer(block[32 + size :], np.uint64, len(hashes))
    hashes[:, 1] = np.frombuffer(block[32 + size + 8 * len(hashes) :], "<u2", len(hashes))
    return np.repeat(ids, runs), starts, hashes


def _later(docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller (doc, start). Rows come in any order."""
    order = np.argsort(hashes[:, 0], kind="stable")
    short = hashes[order, 0]
    same = short[1:] == short[:-1]
    order = order[np.append(False, same) | np.append(same, False)]
    out = np.zeros(len(hashes), dtype=bool)
    if len(order):
        order = order[np.lexsort((starts[order], docs[order], hashes[order, 1], hashes[order, 0]))]
        h, d, s = hashes[order], docs[order], starts[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(axis=1)))
        lead = np.repeat(first, np.diff(np.append(first, len(h))))
        out[order] = (d != d[lead]) | (s != s[lead])
    return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if len(values):
        cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from zip(cut[:-1], cut[1:], strict=True)


def _grouped(docs: np.ndarray, starts: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Packed starts for each group of documents."""
    group = _group_of(docs, groups)
    order = np.lexsort((starts, docs, group))
    docs, starts, group = docs[order], starts[order], group[order]
    for a, b in _runs(group):
        yield int(group[a]), _packed(docs[a:b], starts[a:b])


def _group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mixed_hash(docs.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_DEALT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("block", pa.binary())])
_BACK = pa.schema([("grp", pa.int32()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("block", pa.binary())])
_BACK_DDL = "grp int, ord long, doc_id long, block binary"


def repeated_starts(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """``docs``: doc_id, text. Rows (grp, block): packed starts of windows that also start earlier, for a group of documents.

    A group's number comes from its documents' ids, and there are as many groups as buckets, and as many
    partitions, so that what a task reads doesn't grow with the input.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            hashes, rows, starts = windows(as_bytes(batch.column("text")), window)
            if not len(hashes):
                continue
            ids = batch.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)[rows]
            later = _later(ids, starts, hashes)
            bucket = ((hashes[:, 1] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)  # bits that are not sent
            # windows with an earlier equal in the slice need no counting: they pass through a bucket on their way back
            out = [(group, group, block) for group, block in _grouped(ids[later], starts[later], buckets)]
            sent = np.flatnonzero(~later)
            sent = sent[np.lexsort((starts[sent], ids[sent], bucket[sent]))]
            for a, b in _runs(bucket[sent]):
                part = sent[a:b]
                out.append((int(bucket[part[0]]), None, _packed(ids[part], starts[part], hashes[part])))
            yield _batch(out, _DEALT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None

        def settled() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*map(_unpacked, held), strict=True)]
            held.clear()
            later = _later(*parts)
            return _batch([(group, None, None, block) for group, block in _grouped(parts[0][later], parts[1][later], buckets)], _BACK)

        for batch in batches:
            done = []
            for bucket, group, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    if held:
                        yield settled()
                    at = bucket
                if group is None:
                    held.append(block)
                else:
                    done.append((group, None, None, block))
            yield _batch(done, _BACK)
        if held:
            yield settled()

    dealt = docs.mapInArrow(deal, "bucket int, grp int, block binary")
    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _BACK_DDL)


def cut_words(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words outside of the maximal intervals that the windows' starts make."""
    inside = np.zeros(len(words) + 1, dtype=np.int32)
    starts = starts[starts + window <= len(words)]
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + window, -1)
    kept = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed long, kept_text string (words joined by one space), kept_sha256.

    Every word covered by a window of ``window`` words that also starts earlier (smaller id, or same
    id and earlier start) is removed; windows are judged on the input. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged; null text has none. A null id is below every other. Rows of
    one id are one document: at equal starts neither is earlier, and a start removed in one is removed
    in the other where its text is long enough. An empty table gives no rows; other columns are not
    looked at. Windows are told apart by 80 bits of hashes and the bucket that 48 further bits lead to:
    at 9e9 windows in 2,500 buckets (30 GB) the chance that any two different ones are taken for equal is about
    1e-8, at 3e13 in 8 million (100 TB) about 1e-4.
    """
    plain = texts_of(docs, id_col, text_col)
    size = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    back = written(repeated_starts(plain, buckets, window), "starts")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, "text"):
            packed = [press.compress(x) for x in as_bytes(batch.column("text"))]
            ids = batch.column("doc_id")
            known = ids.fill_null(_NULL).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_group_of(known, buckets)), pa.array(known), ids, pa.array(packed, pa.binary())], schema=_BACK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        group, blocks, found = None, [], {}
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                ids, n, removed, texts, digests = [], [], [], [], []
                for to, known, doc, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if to != group:
                        group, blocks, found = to, [], {}
                    if known is None:  # a group's blocks come before its documents
                        blocks.append(packed)
                        continue
                    if blocks:
                        at, starts, _ = (np.concatenate(x) for x in zip(*map(_unpacked, blocks), strict=True))
                        order = np.argsort(at, kind="stable")
                        found, blocks = {int(at[order[a]]): starts[order[a:b]] for a, b in _runs(at[order])}, []
                    words = press.decompress(packed).split()
                    kept = cut_words(words, found[known], window) if known in found else words
                    text = b" ".join(kept)
                    ids.append(doc)
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    texts.append(text)
                    digests.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    dealt = plain.mapInArrow(shrink, _BACK_DDL).union(back).repartitionById(buckets, "grp").sortWithinPartitions("grp", F.col("ord").asc_nulls_first())
    return dealt.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
