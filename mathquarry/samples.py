"""Literal fixtures: LaTeX previews, OMML, MathML, equation streams, and small containers built in memory."""

from __future__ import annotations

import io
import struct
import zipfile

LATEX = (
    r"x+1", r"\frac{}{2}", r"\frac{a}{}", r"x^{}", r"{}^{}", r"y_{}", r"\left\{ \right.", r"\left\{ { } \right.", r"(a+)", r"(-x)", r"a=", r"\alpha + \beta", r"x^2", r"a|b", r"{a}", r"", r"x -)",
    r"\left\{{}\right.", r"a \leq \]", r"abcdefghijklmnopqrstuvwxyzabcd",
)

_M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
_T = lambda s: f"<m:r><m:t>{s}</m:t></m:r>"
OMML = {
    "fraction": f"<m:oMath {_M}><m:f><m:fPr><m:type m:val='skw'/></m:fPr><m:num>{_T('a')}</m:num><m:den>{_T('2')}</m:den></m:f></m:oMath>",
    "scripts": f"<m:oMath {_M}><m:sSubSup><m:e>{_T('x')}</m:e><m:sub>{_T('i')}</m:sub><m:sup>{_T('2')}</m:sup></m:sSubSup></m:oMath>",
    "sum": f"<m:oMath {_M}><m:nary><m:naryPr><m:chr m:val='∫'/><m:limLoc m:val='subSup'/></m:naryPr><m:sub>{_T('0')}</m:sub><m:sup>{_T('1')}</m:sup><m:e>{_T('x')}</m:e></m:nary></m:oMath>",
    "matrix": f"<m:oMath {_M}><m:m><m:mr><m:e>{_T('1')}</m:e><m:e>{_T('0')}</m:e></m:mr></m:m></m:oMath>",
    "fence": f"<m:oMath {_M}><m:d><m:dPr><m:begChr m:val='['/></m:dPr><m:e>{_T('y')}</m:e></m:d></m:oMath>",
    "unknown": f"<m:oMath {_M}><m:strange>{_T('z')}</m:strange></m:oMath>",
}
_X = 'xmlns="http://www.w3.org/1998/Math/MathML"'
MATHML = {
    "lost base": f"<math {_X}><mi>x</mi><msup><mrow/><mn>2</mn></msup></math>",
    "sub": f"<math {_X}><mi>a</mi><msub><mi>i</mi><mrow/></msub></math>",
    "functions": f"<math {_X}><mi>s</mi><mi>i</mi><mi>n</mi><mi>x</mi><mi>l</mi><mi>o</mi><msub><mi>g</mi><mn>2</mn></msub></math>",
}

_HEAD = bytes(28)


def char(text: str, typeface: int = 3) -> bytes:
    return b"".join(b"\x02" + bytes([(typeface - 128) % 256]) + struct.pack("<H", ord(c)) for c in text)


def line(*records: bytes) -> bytes:
    return b"\x01" + b"".join(records) + b"\x00"


def template(selector: int, variation: int, *slots: bytes) -> bytes:
    return bytes([3, selector, variation, 0]) + b"".join(slots) + b"\x00"


def stream(*records: bytes, version: int = 3) -> bytes:
    return _HEAD + bytes([version, 1, 1, 3, 0]) + b"".join(records) + b"\x00"


STREAMS = {
    "fraction": stream(line(template(14, 0, line(char("a")), line(char("b"))))),
    "power": stream(line(char("x"), template(15, 0, b"\x11", line(char("2", 8))))),
    "unsupported": stream(line(template(43, 2))),
    "cut off": stream(line(char("x")))[:-3],
}

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_NS = f'{_W} {_M} xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_OLE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/oleObject"


def packed(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, data in members.items():
            file.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def document(*paragraphs: str, root: str = "document") -> str:
    inner = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    return f"<w:{root} {_NS}>" + (f"<w:body>{inner}</w:body>" if root == "document" else inner) + f"</w:{root}>"


def run(text: str) -> str:
    return f"<w:r><w:t>{text}</w:t></w:r>"


def ole(prog_id: str, rid: str = "rId1") -> str:
    return f'<w:r><w:object><v:shape style="width:20pt;height:18pt"/><o:OLEObject ProgID="{prog_id}" r:id="{rid}"/></w:object></w:r>'


def rels(**targets: str) -> str:
    inner = "".join(f'<Relationship Id="{k}" Type="{_OLE}" Target="{v}"/>' for k, v in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams in the root, each in sectors of its own (padded to the small-stream limit)."""
    size, names = 512, sorted(streams)
    padded = {n: streams[n].ljust(4096, b"\0") for n in names}
    sectors = [padded[n].ljust(-(-len(padded[n]) // size) * size, b"\0") for n in names]
    entries = 1 + len(names)
    n_dir = -(-entries * 128 // size)
    begin, starts = 1 + n_dir, []
    fat = [0xFFFFFFFD] + [k + 2 for k in range(n_dir - 1)] + [0xFFFFFFFE]
    for data in sectors:
        n = len(data) // size
        starts.append(begin)
        fat += [begin + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
        begin += n
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head = (head + struct.pack("<I", 0)).ljust(size, b"\xff")

    def entry(name: str, kind: int, child: int, right: int, start: int, length: int) -> bytes:
        said = name.encode("utf-16-le")
        return said.ljust(64, b"\0") + struct.pack("<HBBIII", len(said) + 2, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, length)

    folder = entry("Root Entry", 5, 1 if names else 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFE, 0)
    for k, name in enumerate(names):
        folder += entry(name, 2, 0xFFFFFFFF, k + 2 if k + 1 < len(names) else 0xFFFFFFFF, starts[k], len(padded[name]))
    return head + table + folder.ljust(n_dir * size, b"\0") + b"".join(sectors)


_CONTENT = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:xlink="http://www.w3.org/1999/xlink"'
_MATH = "<math:math xmlns:math='http://www.w3.org/1998/Math/MathML'><math:mi>x</math:mi></math:math>"
_META = (
    '<office:document-meta xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:meta="urn:oasis:names:tc:opendocument:xmlns:meta:1.0"><office:meta>'
    '<meta:generator>LibreOffice/25.2.0.3$Linux</meta:generator><meta:user-defined meta:name="AG Original Origin">omml</meta:user-defined></office:meta></office:document-meta>'
)


def containers() -> dict[str, bytes]:
    native = stream(line(template(14, 0, line(char("a")), line(char("b")))))
    mathtype = compound({"Equation Native": b"MathType EF MTEF5 DSMT7 ProductVersion=7"})
    inline = OMML["fraction"]
    display = f"<m:oMathPara {_M}><m:oMath>{_T('x')}</m:oMath><m:oMath>{_T('y')}</m:oMath></m:oMathPara>"
    content = f"<office:document-content {_CONTENT}><office:body><draw:object xlink:href='./Object 1'/>{_MATH}</office:body></office:document-content>"
    one = {"word/_rels/document.xml.rels": rels(rId1="embeddings/oleObject1.bin")}
    return {
        "omml.docx": packed({"word/document.xml": document(run("a") + f"<w:r>{inline}</w:r>", display), "word/settings.xml": f"<w:settings {_NS}><m:mathPr/></w:settings>", "word/comments.xml": document(f"<w:r>{inline}</w:r>", root="comments")}),
        "mathtype.docx": packed({"word/document.xml": document(run("Before ") + ole("Equation.DSMT4") + run("After")), "word/embeddings/oleObject1.bin": mathtype, **one}),
        "equation3.docx": packed({"word/document.xml": document(ole("Equation.3")), "word/embeddings/oleObject1.bin": native, **one}),
        "axmath.docx": packed({"word/document.xml": document(ole("Equation.AxMath")), "word/embeddings/oleObject1.bin": b"AxMath payload with custom symbol", **one}),
        "legacy.doc": compound({"ObjectPool/_1/Equation Native": native, "ObjectPool/_1/\x01CompObj": b"Microsoft Equation 3.0 Equation.3"}),
        "native.odt": packed({"content.xml": content, "Object 1/content.xml": _MATH}),
        "bridge.odt": packed({"content.xml": content, "Object 1/content.xml": _MATH, "meta.xml": _META}),
        "flat.fodt": content.encode(),
        "broken.docx": b"no zip",
    }
