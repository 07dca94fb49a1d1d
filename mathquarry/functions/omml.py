"""OMML to presentation MathML.

One table says for each OMML element which MathML element it becomes and from which arguments; only
runs, delimiters, n-ary operators, border boxes and tables need a rule of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree

from mathquarry.functions.mathml import Mark, local, mark, row, to_xml

OMML = "http://schemas.openxmlformats.org/officeDocument/2006/math"
UNSUPPORTED = "data-omml-unsupported"

# Characters that make a text an operator, run styles, and elements that only group.
_OPERATORS = frozenset("+-=*/^_()[]{}<>|,.;:!?")
_VARIANTS = {"b": "bold", "i": "italic", "bi": "bold-italic", "p": "normal"}
_GROUPS = frozenset("oMath oMathPara num den e sup sub deg fName lim".split())


def _val(element, default: str = "") -> str:
    return default if element is None else element.attrib.get(f"{{{OMML}}}val", default)


def _property(element, name: str):
    return element.find(f".//{{{OMML}}}{name}")


def _setting(element, name: str, default: str) -> str:
    return _val(_property(element, name), default)


def _is_on(element, name: str) -> bool:
    found = _property(element, name)
    return found is not None and _val(found, "true").lower() not in ("0", "false", "off")


def _child(element, name: str):
    return next((c for c in element if local(c.tag) == name), None)


def _single(parts: list[Mark]) -> Mark:
    return parts[0] if len(parts) == 1 else row(parts)


def _content(element) -> Mark:
    return _single([m for m in map(convert, element) if m is not None])


def _argument(element, name: str) -> Mark:
    found = _child(element, name)
    return row([]) if found is None else _content(found)


def _token(text: str) -> Mark:
    text = text.strip()
    if not text:
        return Mark("mtext", text="")
    if text.replace(".", "", 1).isdigit():
        return Mark("mn", text=text)
    return Mark("mo" if _OPERATORS.issuperset(text) else "mi", text=text)


def _run(element) -> Mark | None:
    properties = _child(element, "rPr")
    variant = None if properties is None else _VARIANTS.get(_setting(properties, "sty", ""))
    parts = []
    for child in element:
        name = local(child.tag)
        made = None if name == "rPr" else (_token(child.text) if child.text else None) if name == "t" else convert(child)
        if made is not None:
            parts.append(_styled(made, variant))
    return _single(parts) if parts else None


def _styled(node: Mark, variant: str | None) -> Mark:
    if variant and node.tag in ("mi", "mn", "mo", "mtext"):
        node.attrs["mathvariant"] = variant
    elif variant:
        for kid in node.kids:
            _styled(kid, variant)
    return node


def _fraction(element) -> Mark:
    made = mark("mfrac", _argument(element, "num"), _argument(element, "den"))
    properties = _child(element, "fPr")
    kind = "bar" if properties is None else _setting(properties, "type", "bar")
    if kind != "bar":
        made.attrs["data-omml-frac-type"] = kind
    made.attrs |= {"noBar": {"linethickness": "0"}, "skw": {"bevelled": "true"}}.get(kind, {})
    return made


def _radical(element) -> Mark:
    degree = _child(element, "deg")
    base = _argument(element, "e")
    return mark("msqrt", base) if degree is None or not len(degree) else mark("mroot", base, _content(degree))


def _delimiter(element) -> Mark:
    made = mark("mfenced", _argument(element, "e"))
    properties = _child(element, "dPr")
    for name, attribute in (("begChr", "open"), ("endChr", "close"), ("sepChr", "separators")) if properties is not None else ():
        if value := _setting(properties, name, ""):
            made.attrs[attribute] = value
    return made


def _nary(element) -> Mark:
    properties = _child(element, "naryPr")
    operator, place = "∑", ""
    if properties is not None:
        operator, place = _setting(properties, "chr", operator), _setting(properties, "limLoc", "")
    made = Mark("mo", text=operator)
    if place:
        made.attrs["data-omml-limLoc"] = place
        made.attrs |= {"subSup": {"movablelimits": "true"}, "undOvr": {"movablelimits": "false"}}.get(place, {})
    below, above, body = (_child(element, x) for x in ("sub", "sup", "e"))
    limits = [_content(x) for x in (below, above) if x is not None]
    if limits:
        tag = "munderover" if len(limits) == 2 else "munder" if below is not None else "mover"
        made = mark(tag, made, *limits)
    return _single([made] if body is None else [made, _content(body)])


def _table(element, rows: str | None) -> Mark:
    """Rows of a matrix ("mr" elements of "e"), or of an equation array (each "e" a row)."""
    lines = [[e] for e in element if local(e.tag) == "e"] if rows is None else [[e for e in r if local(e.tag) == "e"] for r in element if local(r.tag) == rows]
    return mark("mtable", *(mark("mtr", *(mark("mtd", _content(cell)) for cell in line)) for line in lines if line))


def _over_or_under(element, operator: str, position: str) -> Mark:
    under = position == "bot"
    return mark("munder" if under else "mover", _argument(element, "e"), Mark("mo", text=operator), **{"accentunder" if under else "accent": "true"})


def _group_character(element) -> Mark:
    position = _setting(element, "pos", "top")
    return _over_or_under(element, _setting(element, "chr", "⏟" if position == "bot" else "⏞"), position)


def _border_box(element) -> Mark:
    properties = _child(element, "borderBoxPr")
    sides = [side for side, flag in (("top", "hideTop"), ("bottom", "hideBot"), ("left", "hideLeft"), ("right", "hideRight")) if properties is None or not _is_on(properties, flag)]
    if not sides:
        return _argument(element, "e")
    return mark("menclose", _argument(element, "e"), notation="box" if len(sides) == 4 else " ".join(sides))


def _of(tag: str, *arguments: str, **attrs: str) -> Callable[[object], Mark]:
    return lambda element: mark(tag, *(_argument(element, a) for a in arguments), **attrs)


_RULES: dict[str, Callable[[object], Mark | None]] = {
    **dict.fromkeys(_GROUPS, _content),
    "r": _run,
    "t": lambda e: _token(e.text or ""),
    "f": _fraction,
    "sSup": _of("msup", "e", "sup"),
    "sSub": _of("msub", "e", "sub"),
    "sSubSup": _of("msubsup", "e", "sub", "sup"),
    "rad": _radical,
    "d": _delimiter,
    "nary": _nary,
    "eqArr": lambda e: _table(e, None),
    "m": lambda e: _table(e, "mr"),
    "acc": lambda e: _over_or_under(e, _setting(e, "chr", "^"), "top"),
    "bar": lambda e: _over_or_under(e, "¯", _setting(e, "pos", "top")),
    "func": lambda e: row([_argument(e, "fName"), Mark("mo", text="\u2061"), _argument(e, "e")]),
    "limLow": _of("munder", "e", "lim"),
    "limUpp": _of("mover", "e", "lim"),
    "groupChr": _group_character,
    "phant": _of("mphantom", "e"),
    "box": _of("mrow", "e", data_omml_box="true"),
    "borderBox": _border_box,
}


def convert(element) -> Mark | None:
    name = local(element.tag)
    if rule := _RULES.get(name):
        return rule(element)
    if name.endswith("Pr"):
        return None
    if not len(element):
        return _token(element.text) if element.text else None
    parts = [m for m in map(convert, element) if m is not None]
    return Mark("mrow", parts, None, {UNSUPPORTED: name})


def omml_to_mathml(fragment: str | bytes) -> str:
    made = convert(ElementTree.fromstring(fragment))
    return to_xml(Mark("math", [] if made is None else [made]))
