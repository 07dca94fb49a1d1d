"""Token ids in a binary format of fixed width: every id takes the fewest bits that the vocabulary needs.

An image (one file of the format) is little-endian:

    magic "TIDS", version u8, bits u8, block u32 (ids a block), n_docs u32, n_ids u64
    n_docs ids of documents i64, n_docs null flags u8, n_docs ends u64 (ids up to the document's end)
    n_blocks block offsets u64 into the payload, then the payload: blocks, each from a whole byte on

so any range of ids is unpacked by numpy from the blocks that it touches. A store is a Parquet table
of images in ascending order of documents: (shard, seq) orders the images, ``first`` counts the ids
of the shard before the image.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathquarry.llm.bpe import byte_letters
from mathquarry.llm.common import shared_dir, sliced, texts_of
from mathquarry.llm.pieces import TEXT_BYTES, Remembering, pieces_of, ragged

MAGIC, HEAD, BLOCK = b"TIDS", "<4sBBIIQ", 4096
#: Pieces whose ids a worker remembers at least (half of what it holds at most), and bytes of text of one partition.
KNOWN, PART_BYTES = 250_000, 32_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :bits] = spread
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def write_image(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    parts = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.zeros(0)
    head = struct.pack(HEAD, MAGIC, 1, bits, block, len(doc_ids), len(ids))
    known = np.array([x or 0 for x in doc_ids], dtype="<i8")
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
    return b"".join([head, known.tobytes(), nulls.tobytes(), ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class Image:
    """Reads an image; ``ids(a, b)`` touches the blocks from a to b only."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, n, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != 1:
            raise ValueError("no token image")
        at = struct.calcsize(HEAD)
        known = np.frombuffer(data, "<i8", n, at).tolist()
        nulls = np.frombuffer(data, np.uint8, n, at + 8 * n).tolist()
        self.doc_ids = [None if x else k for k, x in zip(known, nulls, strict=True)]
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 17 * n).astype(np.int64)
        self.payload = memoryview(data)[at + 17 * n + 8 * blocks :]

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, dtype=np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        if self.block * self.bits % 8 == 0:  # whole blocks follow each other without padding
            n = min((last + 1) * self.block, self.n_ids) - first * self.block
            found = unpack(self.payload[self.offsets[first] :][: (n * self.bits + 7) // 8], n, self.bits)
        else:
            found = np.concatenate([self._block(k) for k in range(first, last + 1)])
        return found[a - first * self.block : b - first * self.block]

    def _block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpack(self.payload[self.offsets[k] :][: (n * self.bits + 7) // 8], n, self.bits)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


_BYTE_LETTERS = {b: c for b, c in byte_letters().items() if chr(b) != c}


def encode_pieces(library, pieces: list[str]) -> list[bytes]:
    """Packed ids of white-space pieces, by the library.

    A piece of Latin letters only is one pre-split word, so its lower-cased byte letters go to the
    library's model at once; all others take the library's whole way.
    """
    out: list[bytes | None] = []
    other: list[str] = []
    tokens = library.model.tokenize
    for p in pieces:
        if p.isalpha() and (p.isascii() or max(p) < "\u0250" and "\u0130" not in p):
            word = p.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            out.append(array("I", [t.id for t in tokens(word)]).tobytes())
        else:
            out.append(None)
            other.append(p)
    rest = iter(library.encode_batch_fast(other, add_special_tokens=False))
    return [array("I", next(rest).ids).tobytes() if x is None else x for x in out]


def by_pieces(path: str) -> bool:
    """Whether a tokenizer file encodes a text as its white-space pieces one after the other, as :func:`pieces_of` cuts it.

    That is known of files that lower-case, drop white space and take runs of letters as words; for all others texts are encoded whole.
    """
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    normal, split = data.get("normalizer") or {}, data.get("pre_tokenizer") or {}
    first, *rest = split.get("pretokenizers") or [{}]
    return (
        [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and first.get("pattern") == {"Regex": WORDS}
        and (first["behavior"], first["invert"]) == ("Removed", True)
        and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
        and all(x["content"].startswith("<|") for x in data["added_tokens"])
    )


# Fixed value: the words of the tokenizer file that texts are cut for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with a ``tokenizers`` file, append ``end_id``, and write images in ascending order of ids.

    Null text is empty. Null ids come first; rows of one id are ordered by a hash of their text, so one id
    may fill many partitions; repeated rows are all stored. An empty table writes an empty store. Other
    columns are not looked at.
    """
    plain = texts_of(docs, id_col, text_col)
    total = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    schema = "shard int, seq int, first long, n_ids long, image binary"
    cut = by_pieces(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.no_padding()
        library.no_truncation()
        bits = bits_for(library.get_vocab_size())
        coded = Remembering(lambda pieces: encode_pieces(library, pieces), KNOWN)
        shard, first = TaskContext.get().partitionId(), 0
        for seq, batch in enumerate(sliced(batches, "text", TEXT_BYTES)):
            if cut:
                pieces, which, starts = pieces_of(batch.column("text"))
                ids, bounds = ragged(coded(pieces), which, starts)
                ends = bounds[1:]
            else:
                whole = [np.array(x.ids, dtype=np.uint32) for x in library.encode_batch_fast([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)]
                ids, ends = np.concatenate(whole), np.cumsum([len(x) for x in whole])
            if end_id is not None:
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
            image = write_image(batch.column("doc_id").to_pylist(), ends, ids, bits)
            row = (shard, seq, first, len(ids), image)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "seq", "first", "n_ids", "image"])
            first += len(ids)

    tied = plain.withColumn("tie", F.xxhash64("text"))
    ordered = tied.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def read_store(store: DataFrame) -> DataFrame:
    """Per document, from the images: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each shard, so as many as the writing job had partitions
    placed = store.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("at"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("image"), strict=True):
                image = Image(data.as_py())
                ids = image.ids().astype("<u4")
                begins = np.append(0, image.ends[:-1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), image.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(image.doc_ids, pa.int64()), pa.array(begins + at, pa.int64()), pa.array(image.ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(docs: DataFrame) -> str:
    import uuid

    return f"{shared_dir(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
