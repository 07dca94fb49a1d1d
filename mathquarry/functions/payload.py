"""What an embedded payload shows to each detector."""

from __future__ import annotations

import hashlib
import re

from mathquarry.functions.mtef import HEADER
from mathquarry.sources.cfb import Compound, is_compound

# Markers that are looked for.
_VERSION = re.compile(rb"MTEF\s*([0-9]+)")
_KEY = re.compile(rb"DSMT[0-9]+")
_PRODUCT = re.compile(rb"ProductVersion=([0-9]+)")
_SUBPRODUCT = re.compile(rb"ProductSubVersion=([0-9]+)")
_PRINTABLE = re.compile(rb"[ -~]{6,}")
_VENDORS = ("equation", "mathtype", "axmath", "mtef", "dsmt")
CONTROL_STREAMS = {"\x01CompObj", "\x01Ole", "\x03ObjInfo"}
MOST_SEGMENTS = 12


def segments(data: bytes, most: int = MOST_SEGMENTS) -> list[str]:
    found = (m.group().decode("ascii").strip()[:200] for m in _PRINTABLE.finditer(data))
    return [s for s, _ in zip((s for s in found if s), range(most), strict=False)]


def vendor_markers(data: bytes) -> list[str]:
    found = (m.group().decode("ascii").strip() for m in _PRINTABLE.finditer(data))
    return [s[:120] for s, _ in zip((s for s in found if any(v in s.lower() for v in _VENDORS)), range(MOST_SEGMENTS), strict=False)]


def header_fields(data: bytes) -> dict:
    if len(data) < HEADER + 5:
        return {"header_size": None, "version": None, "platform": None, "product": None, "product_version": None, "product_subversion": None, "detected": False}
    version, platform, product, major, minor = data[HEADER : HEADER + 5]
    return {"header_size": HEADER, "version": version, "platform": platform, "product": product, "product_version": major, "product_subversion": minor, "detected": version in (2, 3) and product == 1}


def _number(pattern: re.Pattern[bytes], data: bytes) -> int | None:
    found = pattern.search(data)
    return int(found[1]) if found else None


def probe(data: bytes | None) -> dict:
    """One record for all detectors; a payload that can't be read is "corrupt" and says why."""
    data = data or b""
    error, streams = None, {}
    compound = is_compound(data)
    if compound:
        try:
            file = Compound(data)
            streams = {name: file.read(name) for name in file.names()}
        except Exception as problem:  # any damage is a finding, not a failure
            error, streams = str(problem), {}
    native = next((n for n in streams if n.rpartition("/")[2].lower() == "equation native"), None)
    described = next((n for n in streams if n.lower().endswith("compobj")), None)
    marked = streams[native] if native else data[:8192]
    if described:
        marked += b"\0" + streams[described][:1024]
    version, key = _number(_VERSION, marked), _KEY.search(marked)
    hits = [text for text in ("Equation Native", "MathType EF") if text.encode() in marked]
    hits += [f"MTEF{version}"] if version is not None else []
    hits += [key[0].decode()] if key else []
    # the first stream with a known header, else the first that is not a control stream, else the bytes themselves
    own = [n for n in streams if n not in CONTROL_STREAMS]
    chosen = next((n for n in own if header_fields(streams[n])["detected"]), own[0] if own else None)
    body = streams[chosen] if chosen else data
    markers = vendor_markers(data)
    for stream in streams.values():
        markers += vendor_markers(stream)
    return {
        "sha256": hashlib.sha256(data).hexdigest(),
        "size": len(data),
        "is_ole": compound,
        "intact": compound and error is None,
        "damage": error,
        "streams": list(streams),
        "native_exists": native is not None,
        "native_size": len(streams[native]) if native else None,
        "mtef_version": version,
        "application_key": key[0].decode() if key else None,
        "product_version": _number(_PRODUCT, marked),
        "product_subversion": _number(_SUBPRODUCT, marked),
        "marker_hits": list(dict.fromkeys(hits)),
        "segments": segments(data),
        "header": header_fields(body),
        "payload_stream": chosen,
        "payload": body,
        "markers": list(dict.fromkeys(markers)),
    }
