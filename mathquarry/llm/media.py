"""Media columns: what a binary value really is, and what is embedded in it.

One Aho-Corasick pass over the bytes finds every magic number; a validator of that format then walks
its structure and gives the length, or refuses. The value's own type is the one confirmed at offset
zero, whatever was declared, and confirmed media further in are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import as_bytes, sliced, texts_of, written

#: Payloads are padded with this byte to a positive multiple of the frame.
FRAME, PAD, RATE = 576, 255, 8000


def _png(b: bytes, at: int) -> int | None:
    to = at + 8
    while to + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, to)
        end = to + 12 + size
        if end > len(b) or not kind.isalpha() or zlib.crc32(b[to + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if to == at + 8 and (kind, size) != (b"IHDR", 13):
            return None
        if kind == b"IEND":
            return end - at
        to = end
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags, to = b[at + 10], at + 13
    to += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(to: int) -> int:
        while to < len(b) and b[to]:
            to += b[to] + 1
        return to + 1

    while to < len(b):
        if b[to] == 0x3B:
            return to + 1 - at
        if b[to] == 0x21:
            to = blocks(to + 2)
        elif b[to] == 0x2C and to + 10 <= len(b):
            local = b[to + 9]
            to = blocks(to + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    to, scan = at + 2, False
    while to + 4 <= len(b):
        if b[to] != 0xFF:
            return None
        mark = b[to + 1]
        if mark == 0xFF:
            to += 1
            continue
        if mark == 0xD9:
            return to + 2 - at if scan else None
        if 0xD0 <= mark <= 0xD8 or mark < 0xC0:
            return None
        to += 2 + int.from_bytes(b[to + 2 : to + 4], "big")
        if mark == 0xDA:
            scan = True
            while to + 1 < len(b) and not (b[to] == 0xFF and b[to + 1] != 0 and not 0xD0 <= b[to + 1] <= 0xD7):
                found = b.find(b"\xff", to + 1)
                to = found if found >= 0 else len(b)
    return to + 2 - at if scan and b[to : to + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, zero, pixels, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    right = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return size if right and 14 + header <= pixels <= size <= len(b) - at else None


def riff_chunks(b: bytes, at: int) -> list[tuple[bytes, int, int]] | None:
    """(name, begin, end) of the chunks of a RIFF file, if they fill its length exactly."""
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    to, found = at + 12, []
    if end > len(b) or end < to:
        return None
    while to + 8 <= end:
        size = int.from_bytes(b[to + 4 : to + 8], "little")
        found.append((b[to : to + 4], to + 8, to + 8 + size))
        to += 8 + size + size % 2
    return found if found and end <= to <= end + 1 and found[-1][2] <= end else None


def _riff(form: bytes, need: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if b[at + 8 : at + 12] != form or not (chunks := riff_chunks(b, at)) or all(not c[0].startswith(need) for c in chunks):
            return None
        return 8 + int.from_bytes(b[at + 4 : at + 8], "little")

    return check


def _flac(b: bytes, at: int) -> int | None:
    to, first = at + 4, True
    while to + 4 <= len(b):
        kind, size = b[to] & 0x7F, int.from_bytes(b[to + 1 : to + 4], "big")
        if first and (kind, size) != (0, 34) or kind == 127 or to + 4 + size > len(b):
            return None
        last, first, to = b[to] & 0x80, False, to + 4 + size
        if last:
            least = int.from_bytes(b[at + 12 : at + 15], "big")
            total = int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
            return _flac_frames(b, to, least, total) - at
    return None


def _crc(width: int, polynomial: int) -> list[int]:
    """Table of a CRC that takes the highest bit first."""
    top, mask = 1 << width - 1, (1 << width) - 1
    table = []
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & top else value << 1) & mask
        table.append(value)
    return table


_CRC8, _CRC16 = _crc(8, 0x07), _crc(16, 0x8005)


def _flac_header(b: bytes, to: int) -> int | None:
    """Samples of the frame whose header stands there, confirmed by its CRC-8."""
    if b[to : to + 2] not in (b"\xff\xf8", b"\xff\xf9") or to + 6 > len(b):
        return None
    size, rate = b[to + 2] >> 4, b[to + 2] & 15
    lead = b[to + 4]
    number = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()  # bytes of the frame's number, coded like UTF-8
    if not size or rate == 15 or number > 7 or lead & 0xC0 == 0x80:
        return None
    after = to + 4 + number
    samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8 if size > 7 else int.from_bytes(b[after : after + size - 5], "big") + 1
    end = after + (size - 5 if size in (6, 7) else 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[to:end]:
        crc = _CRC8[crc ^ x]
    return samples if b[end : end + 1] == bytes([crc]) else None


def _flac_frames(b: bytes, to: int, least: int, total: int) -> int:
    """Where the frames end that follow each other: each is confirmed by its CRC-16, up to the stream's number of samples if that is told."""
    done = 0
    while (samples := _flac_header(b, to)) and not (total and done >= total):
        crc, at, end = 0, to, None
        while at < len(b):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[at]]
            at += 1
            # the CRC of a whole frame and its footer is zero; what follows tells a chance zero from the frame's end
            if not crc and at - to >= max(least, 8) and (_flac_header(b, at) or total and done + samples >= total or at == len(b)):
                end = at
                break
        if end is None:
            break
        to, done = end, done + samples
    return to


def _ogg(b: bytes, at: int) -> int | None:
    to = at
    while b[to : to + 4] == b"OggS" and to + 27 <= len(b):
        n = b[to + 26]
        end = to + 27 + n + sum(b[to + 27 : to + 27 + n])
        if b[to + 4] or end > len(b):
            return None
        last, to = b[to + 5] & 4, end
        if last:
            return to - at
    return None


def _id3(b: bytes, at: int) -> int | None:
    h = b[at : at + 10]
    if len(h) < 10 or h[3] not in (2, 3, 4) or h[4] == 0xFF or any(x & 0x80 for x in h[6:]):
        return None
    to = at + 10 + (h[6] << 21 | h[7] << 14 | h[8] << 7 | h[9])
    first = to
    while size := _mpeg_frame(b, to):
        if to + size > len(b):
            break
        to += size
    if to == first:
        return None
    return to - at + (128 if b[to : to + 3] == b"TAG" and to + 128 <= len(b) else 0)


# Fixed values of MPEG audio: kilobits a second by (MPEG 1, layer), and sample rates of MPEG 1.
_BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = (44100, 48000, 32000)


def _mpeg_frame(b: bytes, to: int) -> int:
    """Bytes of the MPEG audio frame whose header stands there; 0 if none does."""
    h = b[to : to + 4]
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return 0
    version, layer, bits, rate = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return 0
    kilobits = _BITRATES[version == 3, layer][bits - 1]
    hertz = _RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    padding = h[2] >> 1 & 1
    if layer == 1:
        return (12_000 * kilobits // hertz + padding) * 4
    return (72_000 if layer == 3 and version != 3 else 144_000) * kilobits // hertz + padding


def _midi(b: bytes, at: int) -> int | None:
    if b[at + 4 : at + 8] != b"\0\0\0\x06" or at + 14 > len(b):
        return None
    to = at + 14
    for _ in range(int.from_bytes(b[at + 10 : at + 12], "big")):
        if b[to : to + 4] != b"MTrk" or to + 8 > len(b):
            return None
        to += 8 + int.from_bytes(b[to + 4 : to + 8], "big")
    return to - at if to <= len(b) and to > at + 14 else None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    end, following = b.find(b"%%EOF", at), b.find(b"%PDF-", at + 5)
    last = b.rfind(b"%%EOF", at, following if following > 0 else len(b))
    return max(end, last) + 5 - at if last > 0 and b.rfind(b"startxref", at, last) > 0 else None


def _zip(b: bytes, at: int) -> int | None:
    tail = b.find(b"PK\x05\x06", at)
    while tail >= 0 and tail + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, tail + 12)
        if at + start + size == tail and (not size or b[at + start : at + start + 4] == b"PK\x01\x02"):
            end = tail + 22 + note
            return end - at if end <= len(b) else None
        tail = b.find(b"PK\x05\x06", tail + 4)
    return None


def _mp4(b: bytes, at: int) -> int | None:
    to, kinds = at, []
    while to + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, to)
        if kind not in _BOXES or size < 8 or to + size > len(b):
            break
        kinds.append(kind)
        to += size
    return to - at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


# Fixed values of the file formats: type, magic, where the file begins before the magic, validator.
_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"moof", b"mfra", b"meta", b"sidx", b"styp"}
FORMATS: list[tuple[str, bytes, int, Callable[[bytes, int], int | None]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP", b"VP8")),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE", b"data")),
    ("video/avi", b"RIFF", 0, _riff(b"AVI ", b"LIST")),
    ("audio/flac", b"fLaC", 0, _flac),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("audio/mpeg", b"ID3", 0, _id3),
    ("audio/midi", b"MThd", 0, _midi),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("video/mp4", b"ftyp", 4, _mp4),
]


class Sniffer:
    def __init__(self):
        self.tree = ahocorasick.Automaton()
        by_magic: dict[bytes, list] = {}
        for kind, magic, back, check in FORMATS:
            by_magic.setdefault(magic, []).append((kind, len(magic) - 1 + back, check))
        for magic, found in by_magic.items():
            self.tree.add_word(magic.decode("latin-1"), found)
        self.tree.make_automaton()

    def __call__(self, data: bytes) -> list[tuple[int, int, str]]:
        """(offset, length, type) of every confirmed medium, also of those in PDF files and in members that a ZIP file stores as they are.

        What stands inside of other media is left to them.
        """
        out: list[tuple[int, int, str]] = []
        free = 0
        for end, found in self.tree.iter(data.decode("latin-1")):
            for kind, back, check in found:
                at = end - back
                if at >= free and (n := check(data, at)):
                    out.append((at, n, kind))
                    free = at + (5 if kind == "application/pdf" else n)
                    if kind == "application/zip":
                        out += [(a + begin, m, inner) for a, size in stored_members(data, at, n) for begin, m, inner in self(data[a : a + size])]
                    break
        return out


def stored_members(b: bytes, at: int, length: int) -> list[tuple[int, int]]:
    """(offset, size) of the members that the ZIP file at ``at`` holds without compression."""
    tail = b.rfind(b"PK\x05\x06", at, at + length)
    found = []
    to = at + struct.unpack_from("<I", b, tail + 16)[0]
    while to + 46 <= tail and b[to : to + 4] == b"PK\x01\x02":
        method, size, n, more, note = struct.unpack_from("<H", b, to + 10)[0], *struct.unpack_from("<I", b, to + 20), *struct.unpack_from("<HHH", b, to + 28)
        local = at + struct.unpack_from("<I", b, to + 42)[0]
        if method == 0 and b[local : local + 4] == b"PK\x03\x04" and local + 30 <= tail:
            begin = local + 30 + sum(struct.unpack_from("<HH", b, local + 26))
            if begin + size <= tail:
                found.append((begin, size))
        to += 46 + n + more + note
    return found


def sniff_media(df: DataFrame, column: str, declared: str | None = None, name: str = "media_info") -> DataFrame:
    """Adds struct ``name``: type, declared, corrected, length, embedded array<struct<at, length, type, data>>.

    type is that of the medium confirmed at offset 0, else null; corrected tells that it differs from
    the declared type (null: not declared). Embedded media are those further in; inside of a WAV,
    its samples are searched too. Null and empty values have type null and nothing embedded. A
    column called ``name`` is replaced, all others stay. Repeated rows each get their row, an empty
    table gives none; a value of any length is searched whole.
    """
    kind = "struct<type string, declared string, corrected boolean, length long, embedded array<struct<at long, length long, type string, data binary>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        place = pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("data", pa.binary())])
        made = pa.struct([("type", pa.string()), ("declared", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()), ("embedded", pa.list_(place))])
        for batch in batches:
            said = batch.column(batch.schema.get_field_index("said")).to_pylist()
            rows = []
            for data, told in zip(batch.column(batch.schema.get_field_index("data")), said, strict=True):
                rows.append(describe(sniffer, data.as_py() or b"", told))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(rows, made)], ["row", "info"])

    kept = df.select(*[c for c in df.columns if c != name])
    asked = kept.select(F.struct("*").alias("row"), F.col(column).cast("binary").alias("data"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("said"))
    out = asked.mapInArrow(run, f"row {kept.schema.simpleString()}, info {kind}")
    return out.select("row.*", F.col("info").alias(name))


def describe(sniffer: Sniffer, data: bytes, told: str | None) -> dict:
    found = sniffer(data)
    own = found[0] if found and found[0][0] == 0 else None
    inner = found[1:] if own else found
    if own and own[2] == "audio/wav":
        for chunk, a, b in riff_chunks(data, 0):
            if chunk == b"data":
                inner = [(a + at, n, kind) for at, n, kind in sniffer(data[a:b])] + inner
    return {
        "type": own and own[2],
        "declared": told,
        "corrected": own is not None and own[2] != told,
        "length": own and own[1],
        "embedded": [{"at": at, "length": n, "type": kind, "data": data[at : at + n]} for at, n, kind in inner],
    }


def as_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as unsigned 8-bit mono samples of a WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def wav_samples(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono WAV whose structure is right; anything else is an error."""
    chunks = {name: media[a:b] for name, a, b in riff_chunks(media, 0) or []}
    if media[8:12] != b"WAVE" or b"fmt " not in chunks or b"data" not in chunks:
        raise ValueError("no WAV file")
    form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    if (form, channels, bits) != (1, 1, 8):
        raise ValueError("not 8-bit mono PCM")
    return rate, chunks[b"data"]


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table of a document table: doc_id, n_bytes long, declared string, media binary (WAV)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values = as_bytes(batch.column("text"))
            sizes = pa.array([len(x) for x in values], pa.int64())
            media = pa.array([as_wav(padded(x)) for x in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(["application/octet-stream"] * len(values)), media], ["doc_id", "n_bytes", "declared", "media"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def features(info: dict, rate: int, samples: bytes) -> str:
    """Whole numbers only, so equal samples give equal strings everywhere."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    above = x >= 0
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    inner = ",".join(f"{e['type']}@{e['at']}+{e['length']}" for e in info["embedded"]) or "none"
    return f"{info['type']};rate={rate};samples={len(x)};low={x.min()};high={x.max()};sum={x.sum()};power={(x * x).sum()};crossings={crossings};embedded={inner}"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read the stored bytes back, and describe them.

    Each text's UTF-8 is padded with bytes 255 to a positive multiple of 576 and stored as a WAV of
    8-bit samples in a table in the shared folder; null is empty. From the table: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes), media_bytes,
    media_sha256, feature. One row per row, repeated ids too; an empty table gives none. Other
    columns are not looked at.
    """
    stored = written(store_texts(docs, id_col, text_col), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for value, told in zip(batch.column("media"), batch.column("declared").to_pylist(), strict=True):
                media = value.as_py()
                info = describe(sniffer, media, told)
                rate, samples = wav_samples(media)
                made = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(info, rate, samples))
                for column, x in zip(out.values(), made, strict=True):
                    column.append(x)
            kinds = [pa.string() if k.endswith("sha256") or k == "feature" else pa.int64() for k in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", "n_bytes", *out])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
