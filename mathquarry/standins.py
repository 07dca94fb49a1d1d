"""Formulas and containers made from rows of the supplied tables, which hold none themselves.

Every row gives a fragment, a stream or a whole container whose shape follows from its key, so the
queries over them grow with the tables, and SQL can say from the same rows what must come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathquarry import samples
from mathquarry.sources.tables import spread

_R = lambda s: f"<m:r><m:t>{s}</m:t></m:r>"
X, N = _R("{x}"), _R("{n}")
#: One shape of OMML for each remainder of the key; {x} is a letter, {n} a number.
OMML = (
    f"<m:f><m:fPr><m:type m:val='skw'/></m:fPr><m:num>{X}</m:num><m:den>{N}</m:den></m:f>",
    f"<m:f><m:fPr><m:type m:val='noBar'/></m:fPr><m:num>{X}</m:num><m:den>{N}</m:den></m:f>",
    f"<m:sSubSup><m:e>{X}</m:e><m:sub>{_R('i')}</m:sub><m:sup>{N}</m:sup></m:sSubSup>",
    f"<m:nary><m:naryPr><m:chr m:val='∫'/><m:limLoc m:val='undOvr'/></m:naryPr><m:sub>{_R('0')}</m:sub><m:sup>{N}</m:sup><m:e>{X}</m:e></m:nary>",
    f"<m:rad><m:deg>{N}</m:deg><m:e>{X}</m:e></m:rad>",
    f"<m:d><m:dPr><m:begChr m:val='['/><m:sepChr m:val=';'/></m:dPr><m:e>{X}</m:e></m:d>",
    f"<m:acc><m:e>{X}</m:e></m:acc>",
    f"<m:bar><m:barPr><m:pos m:val='bot'/></m:barPr><m:e>{X}</m:e></m:bar>",
    f"<m:m><m:mr><m:e>{X}</m:e><m:e>{N}</m:e></m:mr><m:mr><m:e>{N}</m:e><m:e>{X}</m:e></m:mr></m:m>",
    f"<m:func><m:fName>{_R('sin')}</m:fName><m:e>{X}</m:e></m:func>",
    "<m:r><m:rPr><m:sty m:val='b'/></m:rPr><m:t>{x}</m:t></m:r>",
    f"<m:strange>{N}</m:strange>",
    f"<m:borderBox><m:borderBoxPr><m:hideTop m:val='1'/></m:borderBoxPr><m:e>{X}</m:e></m:borderBox>",
    f"<m:limLow><m:e>{_R('lim')}</m:e><m:lim>{X}</m:lim></m:limLow>",
)
#: MathML that has to be repaired; {letters} are tokens that spell a function's name.
BROKEN = (
    "<mi>{x}</mi><msup><mrow/><mn>{n}</mn></msup>",
    "<mi>{x}</mi><msub><mi>i</mi><mrow/></msub>",
    "{letters}<mi>{x}</mi>",
    "<mi>{x}</mi><mo>=</mo><mi>l</mi><mi>o</mi><msub><mi>g</mi><mn>{n}</mn></msub>",
)
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "ln")


def letter(key: Column) -> Column:
    return F.char(F.lit(97) + key % 26)


def _filled(templates: tuple[str, ...], key: Column, **values: Column) -> Column:
    out = F.element_at(F.array(*map(F.lit, templates)), (key % len(templates) + 1).cast("int"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def omml_fragments(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key as text, omml) of every row."""
    k = F.col(key)
    inner = _filled(OMML, k, x=letter(k), n=F.col(number).cast("string"))
    return spread(rows.select(key, number)).select(k.cast("string").alias(key), F.concat(F.lit(f"<m:oMath {samples._M}>"), inner, F.lit("</m:oMath>")).alias("omml"))


def broken_mathml(rows: DataFrame, key: str) -> DataFrame:
    """(key as text, mathml) of every row."""
    k = F.col(key)
    name = F.element_at(F.array(*map(F.lit, FUNCTIONS)), (k % len(FUNCTIONS) + 1).cast("int"))
    letters = F.regexp_replace(name, "(.)", "<mi>$1</mi>")
    inner = _filled(BROKEN, k, x=F.char(F.lit(119) + k % 4), n=(k % 90 + 2).cast("string"), letters=letters)
    return spread(rows.select(key)).select(k.cast("string").alias(key), F.concat(F.lit('<math xmlns="http://www.w3.org/1998/Math/MathML">'), inner, F.lit("</math>")).alias("mathml"))


def _stream_hex(*records: Column | str) -> Column:
    return F.concat(F.lit("00" * 28 + "0301010300" + "01"), *(F.lit(r) if isinstance(r, str) else r for r in records), F.lit("0000"))


def _char_hex(code: Column, typeface: str = "83") -> Column:
    return F.concat(F.lit("02" + typeface), F.lpad(F.hex(code), 2, "0"), F.lit("00"))


def equation_streams(rows: DataFrame, key: str) -> DataFrame:
    """(key as text, stream): Equation Native streams; a fraction, a power, an unknown template, a plain letter, or one cut off."""
    k = F.col(key)
    x, y, digit = _char_hex(F.lit(97) + k % 26), _char_hex(F.lit(97) + k % 25), _char_hex(F.lit(48) + k % 10, "88")
    shapes = (
        _stream_hex("030e0000", "01", x, "00", "01", y, "00", "00"),
        _stream_hex(x, "030f0000", "11", "01", digit, "00", "00"),
        _stream_hex("032b020000"),
        _stream_hex(x),
        F.substring(_stream_hex(x), 1, 2 * 35),
    )
    return spread(rows.select(key)).select(k.cast("string").alias(key), F.unhex(F.element_at(F.array(*shapes), (k % len(shapes) + 1).cast("int"))).alias("stream"))


VARIANTS = ("omml.docx", "mathtype.docx", "equation3.docx", "axmath.docx", "legacy.doc", "native.odt", "bridge.odt", "flat.fodt", "broken.docx")


def container(variant: int, n: int, x: str) -> bytes:
    """A small container of the variant: n formulas or objects, with the letter x in them."""
    s = samples
    inline = f"<m:oMath {s._M}><m:f><m:num>{_R(x)}</m:num><m:den>{_R(n)}</m:den></m:f></m:oMath>"
    native = s.stream(s.line(s.template(14, 0, s.line(s.char(x)), s.line(s.char("y")))))
    math = f"<math:math xmlns:math='http://www.w3.org/1998/Math/MathML'><math:mi>{x}</math:mi></math:math>"
    content = f"<office:document-content {s._CONTENT}><office:body><draw:object xlink:href='./Object 1'/>{math * n}</office:body></office:document-content>"

    def with_objects(prog_id: str, payload: bytes) -> bytes:
        rids = {f"rId{k}": f"embeddings/oleObject{k}.bin" for k in range(1, n + 1)}
        paragraphs = [s.run(f"Before {x}{k} ") + s.ole(prog_id, f"rId{k}") + s.run("After") for k in range(1, n + 1)]
        return s.packed({"word/document.xml": s.document(*paragraphs), "word/_rels/document.xml.rels": s.rels(**rids), **{f"word/{t}": payload for t in rids.values()}})

    if variant == 0:
        paragraphs = [s.run("a") + f"<w:r>{inline}</w:r>" for _ in range(n)]
        parts = {"word/document.xml": s.document(*paragraphs), "word/settings.xml": f"<w:settings {s._NS}><m:mathPr/></w:settings>", "word/comments.xml": s.document(f"<w:r>{inline}</w:r>", root="comments")}
        return s.packed(parts)
    if variant == 1:
        return with_objects("Equation.DSMT4", s.compound({"Equation Native": f"MathType EF MTEF5 DSMT7 {x}".encode()}))
    if variant == 2:
        return with_objects("Equation.3", native)
    if variant == 3:
        return with_objects("Equation.AxMath", f"AxMath {x} with a custom symbol".encode())
    if variant == 4:
        return s.compound({"ObjectPool/_1/Equation Native": native, "ObjectPool/_1/\x01CompObj": b"Microsoft Equation 3.0 Equation.3"})
    if variant in (5, 6):
        return s.packed({"content.xml": content, "Object 1/content.xml": math} | ({"meta.xml": s._META} if variant == 6 else {}))
    return content.encode() if variant == 7 else b"no zip"


def container_files(rows: DataFrame, key: str) -> DataFrame:
    """``rows``: a key. (doc_id, content): a container for each; its name tells the variant, its objects are 1 to 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            files = [container(k % 9, 1 + k % 3, chr(97 + k % 26)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}-{VARIANTS[k % 9]}" for k in keys], pa.string()), pa.array(files, pa.binary())], ["doc_id", "content"])

    return spread(rows.select(F.col(key).cast("long"))).mapInArrow(run, "doc_id string, content binary")
