"""Decoders of bytes and trees, against recorded digests and hand-made cases."""

import pytest

from mathquarry import samples
from mathquarry.functions import display_mode, mathml, mtef, omml, repair
from mathquarry.sources.cfb import Compound, CompoundError, is_compound

# Equation Native streams from the public Apache POI test documents (Apache-2.0), and digests of their canonical MathML.
POI_GREEK = bytes.fromhex("1c000000020032c32500000000000000402f17000c95170000000000030101030a0a011283500002863d000284b1031283470002862b0012836b00128347000000")
POI_BRACKETS = bytes.fromhex("1c000000020032c32c00000000000000601e1800bcc7170000000000030101030a0a0103030000010288310002822c0012836e0002861222028831000002965b0002965d00000000")
DIGESTS = {POI_GREEK: "05db442230de132743d5ec6d53c5a54080fd07aed8b27c611ca715d9fdf8bfb7", POI_BRACKETS: "0e37d012cb8e912dfd8e0389bf8a2b21d94ba175b3f8ca03d11f9b560e56e654"}

S, L, C, T = samples.stream, samples.line, samples.char, samples.template


def inner(*records, version=3):
    text = mtef.decode_stream(S(*records, version=version)).mathml
    return text.removeprefix(mathml.DECLARATION).replace("math:", "").replace(' xmlns:math="http://www.w3.org/1998/Math/MathML"', "").strip().removeprefix('<math display="block"><mrow>').removesuffix("</mrow></math>")


@pytest.mark.parametrize("stream", DIGESTS)
def test_public_streams_have_their_digests(stream):
    made = mtef.decode_stream(stream)
    assert mathml.canonical_digest(made.mathml) == DIGESTS[stream]
    assert made.parsed_bytes == made.payload_bytes


def test_templates():
    a, b, c = (L(C(x)) for x in "abc")
    m = lambda x: f"<mrow><mi>{x}</mi></mrow>"
    assert inner(L(C("x"), T(15, 0, b"\x11", b))) == f"<msup><mi>x</mi>{m('b')}</msup>"
    assert inner(L(C("x"), T(15, 1, a))) == f"<msub><mi>x</mi>{m('a')}</msub>"
    assert inner(L(C("x"), T(15, 2, a, b))) == f"<msubsup><mi>x</mi>{m('a')}{m('b')}</msubsup>"
    assert inner(L(T(13, 0, a))) == f"<msqrt>{m('a')}</msqrt>"
    assert inner(L(T(13, 1, a, b))) == f"<mroot>{m('b')}{m('a')}</mroot>"
    assert inner(L(T(14, 1, a, b))) == f'<mfrac data-equation3-fraction-size="small">{m("a")}{m("b")}</mfrac>'
    assert inner(L(T(41, 1, a, b))) == f'<mfrac bevelled="true" data-equation3-slash-fraction-layout="baseline">{m("a")}{m("b")}</mfrac>'
    assert inner(L(T(2, 1, a))) == "<mrow><mo>{</mo><mi>a</mi></mrow>"
    assert inner(L(T(16, 1, a))) == f'<munder accentunder="true" data-equation3-bar-count="2">{m("a")}<mo stretchy="true">__</mo></munder>'
    assert inner(L(T(47, 2, a))) == f'<mover accent="true">{m("a")}<mo stretchy="true">↔</mo></mover>'
    assert inner(L(T(39, 2, a, b, c))) == f"<munderover>{m('a')}{m('b')}{m('c')}</munderover>"
    big = '<mo largeop="true" movablelimits="true">∑</mo>'
    assert inner(L(T(29, 1, a, b, c, L(C("∑"))))) == f"<mrow><munderover>{big}{m('c')}{m('b')}</munderover>{m('a')}</mrow>"
    assert inner(L(T(42, 1, a, b, L(C("∫"))))).startswith('<mrow><msub data-equation3-limit-style="integral">')
    assert inner(L(T(43, 0))) == big
    assert inner(L(C("x"), T(44, 1, a))) == f'<mmultiscripts data-equation3-script-position="leading"><mi>x</mi><none /><none /><mprescripts />{m("a")}<none /></mmultiscripts>'
    assert 'operator-source-codepoint="U+EC07"' in inner(L(T(29, 0, a, b, L(C("")))))
    assert 'missing-limit-slots="both"' in inner(L(T(29, 1, L(C("a∑")))))


def test_characters_piles_and_matrices():
    assert inner(L(C("a", 4), C("G", 5), C("7", 8), C("=", 6), C("…"), C(" ", 24))) == '<mi>α</mi><mi>Γ</mi><mn>7</mn><mo>=</mo><mo>…</mo><mspace data-equation3-mtef-typeface="fnSPACE" data-equation3-mtef-char-code="32" />'
    embellished = b"\x22" + C("x")[1:] + b"\x06\x09\x06\x05\x00"
    assert inner(L(embellished)) == '<msup><mover accent="true"><mi>x</mi><mo>^</mo></mover><mo>′</mo></msup>'
    assert 'pile-rows="2"' in inner(b"\x04\x01\x02" + L(C("a")) + L(C("b")) + b"\x00")
    matrix = inner(b"\x05\x00\x01\x02\x01\x02\x00\x00" + L(C("a")) + L(C("b")) + b"\x00")
    assert matrix.count("<mtd>") == 2 and 'matrix-col-parts="0,0,0"' in matrix
    assert inner(L(b"\x02\x83x", b"\x02\x86="), version=2) == "<mi>x</mi><mo>=</mo>"
    nudged = bytes([0x82, 0x80, 0x80, 1, 0, 2, 0]) + C("x")[1:]
    assert inner(L(nudged)) == "<mi>x</mi>"


def test_trailers_and_refusals():
    good = S(L(C("x")))
    for trailer in (b"\0" * 9, b"\x07", b"\x07\x08", b"\xff\xff\xff", b"\x65\x77\x20", b"\x00\x07\x08", bytes(8) + b"\x05\0\0\0"):
        assert mtef.decode_stream(good + trailer).parsed_bytes == len(good) - mtef.HEADER
    assert "<math:mi>y</math:mi>" in mtef.decode_stream(good + L(C("y")) + b"\x00").mathml
    for stream, said in (
        (S(L(T(43, 2))), "Unsupported template selector=43 variation=2 at offset"), (good[:-3], "Unexpected EOF"), (good + b"\x0f\x0f\x0f\x0f", "trailing bytes"), (bytes(28), "shorter"),
        (S(L(C("x")), version=5), "Expected MTEF version"), (S(b"\x0f"), "Unsupported MTEF record type 15"), (S(b"\x05\0\0\0\0\0"), "outside the supported slice"), (S(L(T(46, 0))), "missing main slot"),
    ):
        with pytest.raises(mtef.MtefError, match=said):
            mtef.decode_stream(stream)


def convert(name):
    return omml.omml_to_mathml(samples.OMML[name]).replace("math:", "").removeprefix('<math xmlns:math="http://www.w3.org/1998/Math/MathML">').removesuffix("</math>")


def test_omml_structures():
    assert convert("fraction") == '<mfrac data-omml-frac-type="skw" bevelled="true"><mi>a</mi><mn>2</mn></mfrac>'
    assert convert("scripts") == "<msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup>"
    assert convert("sum") == '<mrow><munderover><mo data-omml-limLoc="subSup" movablelimits="true">∫</mo><mn>0</mn><mn>1</mn></munderover><mi>x</mi></mrow>'
    assert convert("matrix") == "<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>0</mn></mtd></mtr></mtable>"
    assert convert("fence") == '<mfenced open="["><mi>y</mi></mfenced>'
    assert convert("unknown") == '<mrow data-omml-unsupported="strange"><mi>z</mi></mrow>'


@pytest.mark.parametrize(
    "body, made",
    [
        ("<m:rad><m:deg/><m:e>{x}</m:e></m:rad>", "<msqrt><mi>x</mi></msqrt>"),
        ("<m:rad><m:deg>{x}</m:deg><m:e>{x}</m:e></m:rad>", "<mroot><mi>x</mi><mi>x</mi></mroot>"),
        ("<m:bar><m:barPr><m:pos m:val='bot'/></m:barPr><m:e>{x}</m:e></m:bar>", '<munder accentunder="true"><mi>x</mi><mo>¯</mo></munder>'),
        ("<m:acc><m:e>{x}</m:e></m:acc>", '<mover accent="true"><mi>x</mi><mo>^</mo></mover>'),
        ("<m:func><m:fName>{x}</m:fName><m:e>{x}</m:e></m:func>", "<mrow><mi>x</mi><mo>⁡</mo><mi>x</mi></mrow>"),
        ("<m:limLow><m:e>{x}</m:e><m:lim>{x}</m:lim></m:limLow>", "<munder><mi>x</mi><mi>x</mi></munder>"),
        ("<m:groupChr><m:e>{x}</m:e></m:groupChr>", '<mover accent="true"><mi>x</mi><mo>⏞</mo></mover>'),
        ("<m:phant><m:e>{x}</m:e></m:phant>", "<mphantom><mi>x</mi></mphantom>"),
        ("<m:box><m:e>{x}</m:e></m:box>", '<mrow data-omml-box="true"><mi>x</mi></mrow>'),
        ("<m:borderBox><m:borderBoxPr><m:hideTop/><m:hideBot m:val='1'/><m:hideLeft m:val='off'/></m:borderBoxPr><m:e>{x}</m:e></m:borderBox>", '<menclose notation="left right"><mi>x</mi></menclose>'),
        ("<m:eqArr><m:e>{x}</m:e></m:eqArr>", "<mtable><mtr><mtd><mi>x</mi></mtd></mtr></mtable>"),
        ("<m:r><m:rPr><m:sty m:val='b'/></m:rPr><m:t>3.5</m:t></m:r>", '<mn mathvariant="bold">3.5</mn>'),
        ("<m:r><m:t> </m:t></m:r><m:r><m:t>+=</m:t></m:r>", "<mrow><mtext /><mo>+=</mo></mrow>"),
    ],
)
def test_omml_elements(body, made):
    text = omml.omml_to_mathml(f"<m:oMath {samples._M}>{body.replace('{x}', samples._T('x'))}</m:oMath>")
    assert text.replace("math:", "") == f'<math xmlns:math="http://www.w3.org/1998/Math/MathML">{made}</math>'.replace("math:", "")


def test_repairs():
    fixed = lambda x: repair.repair_xml(f"<math {samples._X}>{x}</math>").removeprefix(f"<math {samples._X}>").removesuffix("</math>")
    assert fixed("<mi>x</mi><msup><mrow/><mn>2</mn></msup>") == "<msup><mi>x</mi><mn>2</mn></msup>"
    assert fixed("<mi>x</mi><msub><mi>i</mi></msub>") == "<msub><mi>x</mi><mi>i</mi></msub>"
    assert fixed("<mi>x</mi><msubsup><mrow/><mi>i</mi><mrow/></msubsup>") == "<msubsup><mi>x</mi><mi>i</mi><mrow /></msubsup>"
    assert fixed("<msup><mrow/><mn>2</mn></msup>") == "<msup><mrow /><mn>2</mn></msup>"
    assert fixed("<mi>S</mi><mi>i</mi><mi>n</mi><mi>x</mi>") == "<mi>sin</mi><mi>x</mi>"
    assert fixed("<mi>l</mi><msub><mi>n</mi><mn>2</mn></msub>") == "<msub><mi>ln</mi><mn>2</mn></msub>"
    assert fixed("<mi>x</mi><msup><mrow/><mn>2</mn></msup><msup><mrow/><mn>3</mn></msup>") == "<msup><msup><mi>x</mi><mn>2</mn></msup><mn>3</mn></msup>"


def test_display_mode():
    xml = "<root><mtef><mtef_version>3</mtef_version><product_subversion>1</product_subversion><slot/></mtef></root>"
    text, changed = display_mode.with_display_mode(xml)
    assert changed and "<product_subversion>1</product_subversion><equation_options>block</equation_options><slot />" in text
    assert display_mode.with_display_mode(text) == (text, False)
    assert not display_mode.with_display_mode(xml.replace(">3<", ">5<"))[1]


def test_signals():
    found = mathml.signals('<math xmlns="http://www.w3.org/1998/Math/MathML" display="block"><mfrac bevelled="true"/><mo movablelimits="false">x</mo></math>')
    assert found["root_display"] == "block" and found["mathml_attribute_count"] == 3 and found["has_mfrac_bevelled"] and found["has_movablelimits"] and not found["has_accent"]


def test_compound_files():
    data = samples.compound({"Equation Native": b"abc", "\x01CompObj": b"x" * 5000})
    file = Compound(data)
    assert set(file.names()) == {"Equation Native", "\x01CompObj"}
    assert file.read("Equation Native")[:4] == b"abc\0" and file.read("\x01CompObj") == b"x" * 5000
    assert is_compound(data) and not is_compound(b"PK") and not is_compound(None)
    for broken in (data[:1000], data[:1536] + b"", data[:512] + b"\0" * (len(data) - 512)):
        with pytest.raises((CompoundError, IndexError)):
            Compound(broken).read("Equation Native")
