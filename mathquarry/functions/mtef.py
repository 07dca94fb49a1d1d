"""MTEF version 2 and 3 equation streams to presentation MathML.

The byte stream is read into lists of nodes, line by line; a template record becomes a node at once,
by the shape that a table gives for its name. Whatever lies outside of the known records is an error
that names the offset.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from mathquarry.functions.mathml import DECLARATION, Mark, mark, row, to_xml

HEADER = 28  # bytes of the OLE header before the MTEF payload

# Fixed values of the format -----------------------------------------------------------------------
END, LINE, CHAR, TEMPLATE, PILE, MATRIX, EMBELLISH, RULER, FONT, SIZE = range(10)
SIZE_MARKS = range(10, 15)
NULL_LINE, RULED, SPACED, NUDGED = 1, 2, 4, 8  # option bits of a tag

_BOTH = ("", "_LEFT", "_RIGHT")
# selector: name of each variation
SELECTORS: dict[int, tuple[str, ...]] = {
    **{k: tuple(f"tm{name}{side}" for side in _BOTH) for k, name in enumerate(("ANGLE", "PAREN", "BRACE", "BRACK", "BAR", "DBAR", "FLOOR", "CEILING"))},
    8: ("tmLBLB",),
    9: ("tmRBRB",),
    10: ("tmRBLB",),
    11: ("tmLBRP",),
    12: ("tmLPRB",),
    13: ("tmROOT", "tmNTHROOT"),
    14: ("tmFRACT", "tmFRACT_SMALL"),
    15: ("tmSUP", "tmSUB", "tmSUBSUP"),
    16: ("tmUBAR", "tmUBAR_DOUBLE"),
    17: ("tmOBAR", "tmOBAR_DOUBLE"),
    21: ("tmSINT_NO_LIMITS", "tmSINT_LOWER", "tmSINT_BOTH"),
    29: ("tmSUM_LOWER", "tmSUM_BOTH", "tmSUM_NO_LIMITS"),
    30: ("tmISUM_LOWER", "tmISUM_BOTH"),
    31: ("tmPROD_LOWER", "tmPROD_BOTH", "tmPROD_NO_LIMITS"),
    32: ("tmIPROD_LOWER", "tmIPROD_BOTH"),
    33: ("tmCOPROD_LOWER", "tmCOPROD_BOTH", "tmCOPROD_NO_LIMITS"),
    39: ("tmLIM_UPPER", "tmLIM_LOWER", "tmLIM_BOTH"),
    41: ("tmSLFRACT", "tmSLFRACT_BASELINE", "tmSLFRACT_SMALL"),
    42: ("tmINTOP_UPPER", "tmINTOP_LOWER", "tmINTOP_BOTH"),
    43: ("tmSUMOP",),
    44: ("tmLSUPER", "tmLSUB", "tmLSUBSUP"),
    46: ("tmUARROW_LEFT", "tmUARROW_RIGHT", "tmUARROW_BOTH"),
    47: ("tmOARROW_LEFT", "tmOARROW_RIGHT", "tmOARROW_BOTH"),
    48: ("tmOARC",),
}
_PAIRS = {"ANGLE": "⟨⟩", "PAREN": "()", "BRACE": "{}", "BRACK": "[]", "BAR": "||", "DBAR": "‖‖", "FLOOR": "⌊⌋", "CEILING": "⌈⌉"}
FENCES = {f"tm{name}{side}": (a if side != "_RIGHT" else "", b if side != "_LEFT" else "") for name, (a, b) in _PAIRS.items() for side in _BOTH}
FENCES |= {"tmLBLB": ("{", "{"), "tmRBRB": ("}", "}"), "tmRBLB": ("}", "{"), "tmLBRP": ("{", ")"), "tmLPRB": ("(", "}")}
ARROWS = {"LEFT": "←", "RIGHT": "→", "BOTH": "↔"}
SCRIPTS = {"tmSUP", "tmSUB", "tmSUBSUP", "tmLSUPER", "tmLSUB", "tmLSUBSUP"}
SUM_SIGNS = {"\u2211", "\uec07", "\uec08"}
TYPEFACES = {
    1: "fnTEXT", 2: "fnFUNCTION", 3: "fnVARIABLE", 4: "fnLCGREEK", 5: "fnUCGREEK", 6: "fnSYMBOL", 7: "fnVECTOR", 8: "fnNUMBER",
    9: "fnUSER1", 10: "fnUSER2", 11: "fnMTEXTRA", 12: "fnTEXT_FE", 22: "fnEXPAND", 23: "fnMARKER", 24: "fnSPACE",
}
GREEK = dict(zip("abcdefghijklmnopqrstuvwxyz", "αβχδεφγηιϑκλμνοπθρστυϖωξψζ", strict=True))
OPERATORS = set("=+-*/(),[]{}") | set("→∑∫∏∐…")
# embellishment: accent character, whether it stretches
ACCENTS = {
    2: ("˙", False), 3: ("¨", False), 8: ("~", False), 9: ("^", False), 11: ("→", True), 12: ("←", True),
    13: ("↔", True), 14: ("⇀", True), 15: ("↼", True), 17: ("‾", True), 19: ("⌢", True), 20: ("⌣", True),
}
PRIMES = {18: "‴", 6: "″", 5: "′"}  # the first that is there counts
FOOTERS = {bytes.fromhex(x) for x in ("ffffff", "efefef", "060007", "040201", "830fa0", "657720", "0a0103", "0a1a06")}
# --------------------------------------------------------------------------------------------------

Slot = list[Mark]


class MtefError(ValueError):
    """A stream outside of what is supported."""


@dataclass(frozen=True)
class Decoded:
    mathml: str
    version: int
    platform: int
    product: int
    product_version: int
    product_subversion: int
    record_counts: dict[str, int]
    template_counts: dict[str, int]
    typeface_counts: dict[str, int]
    parsed_bytes: int
    payload_bytes: int
    payload_sha256: str


class _Stream:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.records: Counter[int] = Counter()
        self.templates: Counter[str] = Counter()
        self.typefaces: Counter[str] = Counter()
        self.version = 0

    # -- bytes
    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            where = f"Unexpected EOF at offset {self.at}"
            raise MtefError(where + "." if n == 1 else f"{where} while reading {n} bytes (available={len(self.data) - self.at}).")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def word(self) -> int:
        low = self.byte()
        return low | self.byte() << 8

    def skip(self, kind: int) -> None:
        if kind == EMBELLISH:
            self.byte()
        elif kind == RULER:
            for _ in range(self.byte()):
                self.byte()
                self.word()
        elif kind == FONT:
            self.take(1)
            self.byte()
            while self.byte():
                pass
        elif kind == SIZE:
            how = self.byte()
            if how != 101:
                self.byte()
            if how in (100, 101):
                self.word()

    # -- records
    def tags(self) -> Iterator[tuple[int, int]]:
        """(kind, options) of the records up to END; size marks are passed over, nudges skipped."""
        while True:
            tag = self.byte()
            kind, options = tag & 15, tag >> 4
            self.records[kind] += 1
            if kind == END:
                return
            if kind in SIZE_MARKS:
                continue
            if options & NUDGED and self.take(1) + self.take(1) == b"\x80\x80":
                self.word()
                self.word()
            yield kind, options

    def objects(self) -> Slot:
        """A list of objects up to its END."""
        out: Slot = []
        for kind, options in self.tags():
            if kind == LINE:
                out += self.line(options)
            elif kind == TEMPLATE:
                name, slots = self.template()
                base = out.pop() if name in SCRIPTS and out else row([])
                out.append(shaped(name, base, slots))
            elif kind in (EMBELLISH, RULER, FONT, SIZE):
                self.skip(kind)
            else:
                out.append(self.thing(kind, options, "Unsupported MTEF record type"))
        return out

    def thing(self, kind: int, options: int, otherwise: str) -> Mark:
        if kind == CHAR:
            return self.char(options)
        if kind == PILE:
            return self.pile(options)
        if kind == MATRIX:
            return self.matrix()
        raise MtefError(f"{otherwise} {kind} at offset {self.at - 1}.")

    def line(self, options: int) -> Slot:
        if options & SPACED:
            self.word()
        if options & RULED:
            self.skip(RULER)
        return [] if options & NULL_LINE else self.objects()

    def char(self, options: int) -> Mark:
        typeface = (self.byte() + 128) % 256
        self.typefaces[f"{typeface}:{TYPEFACES.get(typeface, 'explicit-or-unknown')}"] += 1
        code = self.byte() if self.version == 2 else self.word()
        node = character(code, typeface)
        if options & RULED:
            found = []
            for kind, _ in self.tags():
                if kind != EMBELLISH:
                    raise MtefError(f"Unsupported embellishment record type {kind} at offset {self.at - 1}.")
                found.append(self.byte())
            node = embellished(node, found)
        return node

    def template(self) -> tuple[str, list[Slot]]:
        begin = self.at
        selector, variation, _ = self.byte(), self.byte(), self.byte()
        names = SELECTORS.get(selector, ())
        if variation >= len(names):
            raise MtefError(f"Unsupported template selector={selector} variation={variation} at offset {begin}.")
        name = names[variation]
        self.templates[f"{selector}:{variation}:{name}"] += 1
        slots: list[Slot] = []
        for kind, options in self.tags():
            if kind == LINE:
                slots.append(self.line(options))
            elif kind == TEMPLATE:
                inner, its_slots = self.template()
                slots.append([shaped(inner, row([]), its_slots)])
            elif kind in (EMBELLISH, RULER, FONT, SIZE):
                self.skip(kind)
            else:
                slots.append([self.thing(kind, options, "Unsupported template child record type")])
        return name, slots

    def pile(self, options: int) -> Mark:
        across, down = self.byte(), self.byte()
        if options & RULED:
            self.skip(RULER)
        rows: list[Slot] = []
        while True:
            begin, tag = self.at, self.byte()
            kind = tag & 15
            if kind not in (END, LINE, *SIZE_MARKS):  # a last row without a line of its own
                self.at = begin
                rows.append(self.objects())
                break
            self.records[kind] += 1
            if kind == END:
                break
            if kind == LINE:
                self.at, self.records[kind] = begin, self.records[kind] - 1
                rows.append(self.line(self.next_options()))
        lines = [mark("mtr", mark("mtd", row(r))) for r in rows]
        return Mark("mtable", lines, None, {"data-equation3-pile-rows": str(len(rows)), "data-equation3-pile-hjust": str(across), "data-equation3-pile-vjust": str(down)})

    def next_options(self) -> int:
        return next(self.tags())[1]

    def matrix(self) -> Mark:
        align, across, down, rows, columns = (self.byte() for _ in range(5))
        if not rows or not columns:
            raise MtefError(f"Matrix records with rows={rows} cols={columns} are outside the supported slice.")
        # two bits for each rule between rows and columns, lowest first
        rules = [[x >> 2 * k & 3 for x in self.take((n + 4) // 4) for k in range(4)][: n + 1] for n in (rows, columns)]
        cells: list[Slot] = []
        for kind, options in self.tags():
            if len(cells) == rows * columns:
                raise MtefError(f"Unexpected trailing matrix object record type {kind} at offset {self.at - 1}.")
            if kind != LINE:
                raise MtefError(f"Unsupported matrix object record type {kind} at offset {self.at - 1}.")
            cells.append(self.line(options))
        if len(cells) < rows * columns:
            raise MtefError(f"Matrix object list ended early after {len(cells)} cells (expected={rows * columns}).")
        said = {"rows": rows, "cols": columns, "valign": align, "hjust": across, "vjust": down, "row-parts": ",".join(map(str, rules[0])), "col-parts": ",".join(map(str, rules[1]))}
        grid = [mark("mtr", *(mark("mtd", row(c)) for c in cells[k : k + columns])) for k in range(0, len(cells), columns)]
        return Mark("mtable", grid, None, {f"data-equation3-matrix-{k}": str(v) for k, v in said.items()})


def character(code: int, typeface: int) -> Mark:
    if typeface == 24:
        return Mark("mspace", [], None, {"data-equation3-mtef-typeface": TYPEFACES[24], "data-equation3-mtef-char-code": str(code)})
    said = chr(code)
    if typeface == 4:
        said = GREEK.get(said, said)
    elif typeface == 5 and said.isascii() and said.isupper():
        said = GREEK[said.lower()].upper()
    return Mark("mn" if said.isdecimal() else "mo" if said in OPERATORS else "mi", text=said)


def embellished(node: Mark, found: list[int]) -> Mark:
    for k in dict.fromkeys(found):
        if k in ACCENTS:
            sign, stretches = ACCENTS[k]
            node = mark("mover", node, Mark("mo", [], sign, {"stretchy": "true"} if stretches else {}), accent="true")
    prime = next((PRIMES[k] for k in PRIMES if k in found), None)
    return node if prime is None else mark("msup", node, Mark("mo", text=prime))


def _slot(slots: list[Slot], k: int) -> Slot:
    return slots[k] if k < len(slots) else []


def _need(name: str, what: str, wanted: object) -> None:
    if not wanted:
        raise MtefError(f"Unsupported {name} template with {what}.")


def _fence(name: str, base: Mark, slots: list[Slot]) -> Mark:
    left, right = FENCES[name]
    return row([*([Mark("mo", text=left)] if left else []), *_slot(slots, 0), *([Mark("mo", text=right)] if right else [])])


def _script(name: str, base: Mark, slots: list[Slot]) -> Mark:
    sub, sup = row(_slot(slots, 0)), row(_slot(slots, 1))
    if name == "tmSUP":
        return mark("msup", base, sup)
    if name == "tmSUB":
        return mark("msub", base, sub)
    return mark("msubsup", base, sub, sup)


def _leading(name: str, base: Mark, slots: list[Slot]) -> Mark:
    none = lambda: Mark("none")
    sub = none() if name == "tmLSUPER" else row(_slot(slots, 0))
    sup = none() if name == "tmLSUB" else row(_slot(slots, 1))
    return Mark("mmultiscripts", [base, none(), none(), Mark("mprescripts"), sub, sup], None, {"data-equation3-script-position": "leading"})


def _root(name: str, base: Mark, slots: list[Slot]) -> Mark:
    if name == "tmROOT":
        return mark("msqrt", row(slots[-1] if slots else []))
    index = _slot(slots, 0)
    return mark("mroot", row(slots[1] if len(slots) > 1 else list(index)), row(list(index)))


def _fraction(name: str, base: Mark, slots: list[Slot]) -> Mark:
    made = mark("mfrac", row(_slot(slots, 0)), row(_slot(slots, 1)))
    if name.startswith("tmSL"):
        made.attrs["bevelled"] = "true"
    if name.endswith("_BASELINE"):
        made.attrs["data-equation3-slash-fraction-layout"] = "baseline"
    if name.endswith("_SMALL"):
        made.attrs["data-equation3-fraction-size"] = "small"
    return made


def _beside(under: bool, body: Slot, sign: str, **attrs: str) -> Mark:
    """A stretching sign under or over its body."""
    return Mark("munder" if under else "mover", [row(body), mark("mo", text=sign, stretchy="true")], None, {"accentunder" if under else "accent": "true", **attrs})


def _bar(name: str, base: Mark, slots: list[Slot]) -> Mark:
    under, twice = name.startswith("tmU"), name.endswith("DOUBLE")
    return _beside(under, _slot(slots, 0), ("_" if under else "‾") * (1 + twice), **({"data-equation3-bar-count": "2"} if twice else {}))


def _arrow(name: str, base: Mark, slots: list[Slot]) -> Mark:
    _need(name, "missing main slot", slots)
    return _beside(name.startswith("tmU"), slots[0], "⌒" if name == "tmOARC" else ARROWS[name.rpartition("_")[2]])


def _limit(name: str, base: Mark, slots: list[Slot]) -> Mark:
    _need(name, "missing main slot", slots)
    main, lower, upper = row(slots[0]), _slot(slots, 1), _slot(slots, 2)
    if name.endswith("_BOTH"):
        _need(name, "missing limit slots", lower and upper)
        return mark("munderover", main, row(lower), row(upper))
    if name.endswith("_LOWER"):
        _need(name, "missing lower limit slot", lower)
        return mark("munder", main, row(lower))
    _need(name, "missing upper limit slot", upper)
    return mark("mover", main, row(upper))


def _sum_sign(name: str, base: Mark, slots: list[Slot]) -> Mark:
    sign = mark("mo", text="∑", largeop="true", movablelimits="true")
    filled = [row(s) for s in slots if s]
    return row([sign, *filled]) if filled else sign


def _big(name: str, base: Mark, slots: list[Slot]) -> Mark:
    """Main, upper, lower and, last, the operator; a sum without limits may have its sign at its line's end."""
    _need(name, "empty subobject list", slots)
    *parts, sign = slots
    inside = name == "tmSUM_BOTH" and len(slots) == 1 and len(sign) > 1 and sign[-1].said() in SUM_SIGNS
    if inside:
        parts, sign = [sign[:-1]], sign[-1:]
    _need(name, "missing operator character", sign)
    said = sign[0].said()
    shown = "∑" if "SUM" in name and said in SUM_SIGNS else said
    operator = mark("mo", text=shown, largeop="true", movablelimits="true")
    if said != shown:
        operator.attrs["data-equation3-operator-source-codepoint"] = ",".join(f"U+{ord(c):04X}" for c in said)
    if inside:
        operator.attrs["data-equation3-operator-slot-shape"] = "embedded-in-main-line"
    _need(name, "missing main slot", parts)
    aside = name.startswith(("tmISUM", "tmIPROD", "tmINTOP"))  # limits at the sign's side
    ending = name.rpartition("_")[2]
    made = operator
    if ending == "BOTH":
        if len(parts) >= 3:
            made = mark("msubsup" if aside else "munderover", operator, row(parts[2]), row(parts[1]))
        else:
            _need(name, "missing limit slots", name == "tmSUM_BOTH" and len(parts) == 1)
            operator.attrs["data-equation3-missing-limit-slots"] = "both"
    elif ending == "UPPER":
        _need(name, "missing upper limit slot", len(parts) > 1 and parts[1])
        made = mark("msup", operator, row(parts[1]))
    elif ending == "LOWER":
        _need(name, "missing lower limit slot", len(parts) > 1)
        made = mark("msub" if aside else "munder", operator, row(parts[2] if len(parts) > 2 else parts[1]))
    if aside:
        made.attrs["data-equation3-limit-style"] = "integral"
    return row([made, row(parts[0])])


_SHAPES: list[tuple[tuple[str, ...], Callable[[str, Mark, list[Slot]], Mark]]] = [
    (("tmSUP", "tmSUB", "tmSUBSUP"), _script),
    (("tmLSUPER", "tmLSUB", "tmLSUBSUP"), _leading),
    (("tmROOT", "tmNTHROOT"), _root),
    (SELECTORS[14] + SELECTORS[41], _fraction),
    (SELECTORS[16] + SELECTORS[17], _bar),
    (SELECTORS[46] + SELECTORS[47] + SELECTORS[48], _arrow),
    (SELECTORS[39], _limit),
    (SELECTORS[43], _sum_sign),
    (SELECTORS[21] + SELECTORS[29] + SELECTORS[30] + SELECTORS[31] + SELECTORS[32] + SELECTORS[33] + SELECTORS[42], _big),
    (tuple(FENCES), _fence),
]
_SHAPE_OF = {name: shape for names, shape in _SHAPES for name in names}


def shaped(name: str, base: Mark, slots: list[Slot]) -> Mark:
    return _SHAPE_OF[name](name, base, slots)


def _is_footer(rest: bytes) -> bool:
    n = len(rest)
    return not any(rest) or n in (1, 2) or rest in FOOTERS or n == 3 and not (rest[0] and rest[2]) or n == 12 and not any(rest[:8] + rest[9:])


def decode_payload(payload: bytes) -> Decoded:
    stream = _Stream(payload)
    version, platform, product, product_version, product_subversion = (stream.byte() for _ in range(5))
    if version not in (2, 3):
        raise MtefError(f"Expected MTEF version 2 or 3, got {version}.")
    stream.version = version
    out = stream.objects()
    while stream.at != len(payload) and not _is_footer(rest := payload[stream.at :]):
        try:
            out += stream.objects()
        except MtefError as error:
            raise MtefError(f"Parser stopped with {len(rest)} trailing bytes.") from error
    text = DECLARATION + to_xml(Mark("math", [row(out)], None, {"display": "block"})) + "\n"
    ordered = lambda c: {str(k): c[k] for k in sorted(c)}
    return Decoded(
        text, version, platform, product, product_version, product_subversion, ordered(stream.records), ordered(stream.templates), ordered(stream.typefaces),
        stream.at, len(payload), hashlib.sha256(payload).hexdigest(),
    )


def decode_stream(stream: bytes) -> Decoded:
    """An Equation Native stream: header, then payload."""
    if len(stream) <= HEADER:
        raise MtefError("Equation Native stream is shorter than its header.")
    return decode_payload(stream[HEADER:])


def has_header(stream: bytes) -> bool:
    return len(stream) >= HEADER + 5 and stream[HEADER] in (2, 3) and stream[HEADER + 2] == 1
