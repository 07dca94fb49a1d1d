"""Repairs of converted MathML: scripts that lost their base, and function names spelled letter by letter."""

from __future__ import annotations

from mathquarry.functions.mathml import Mark, from_xml, row, to_xml

# Function names that are put together.
NAMES = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "ln")
_BY_LENGTH = sorted(NAMES, key=len, reverse=True)
_BY_FIRST = {name[0]: [n for n in _BY_LENGTH if n[0] == name[0]] for name in NAMES}
_BY_LAST = {name[-1]: [n for n in _BY_LENGTH if n[-1] == name[-1]] for name in NAMES}
_SCRIPTS = {"msup": 2, "msub": 2, "msubsup": 3}


def _is_empty(node: Mark) -> bool:
    return not node.kids and not (node.text or "").strip()


def _letter(node: Mark | None) -> str:
    """The one ASCII letter that a token says, in lower case; else nothing."""
    said = (node.text or "").strip() if node is not None and node.tag in ("mi", "mn") and not node.kids else ""
    return said.lower() if len(said) == 1 and said.isascii() and said.isalpha() else ""


def _lost(node: Mark) -> list[Mark] | None:
    """The script arguments of a script whose base is the element before it; None if it has its own."""
    need = _SCRIPTS.get(node.tag)
    if not need:
        return None
    while len(node.kids) < need:
        node.kids.append(row([]))
    first, second, *rest = node.kids[:need]
    if node.tag == "msub":  # the script stands first, and the second argument is void
        return [first] if not _is_empty(first) and _is_empty(second) else None
    others = [second, *rest]
    return others if _is_empty(first) and not all(map(_is_empty, others)) else None


def _scripts(kids: list[Mark]) -> None:
    at = 0
    while at < len(kids):
        found = _lost(kids[at]) if kids[at].tag in _SCRIPTS and at else None
        if found is None:
            at += 1
            continue
        script = kids[at]
        script.kids = [kids.pop(at - 1), *found]
        at -= 1  # where the script stands now


def _functions(kids: list[Mark]) -> None:
    at = 0
    while at < len(kids):
        node = kids[at]
        base = _letter(node.kids[0]) if node.tag in _SCRIPTS and node.kids else ""
        fused = False
        for name in _BY_LAST.get(base, ()):
            begin = at - len(name) + 1
            if begin >= 0 and "".join(map(_letter, kids[begin:at])) + base == name and all(map(_letter, kids[begin:at])):
                node.kids[0] = Mark("mi", text=name)
                del kids[begin:at]
                fused = True
                break
        for name in () if fused else _BY_FIRST.get(_letter(node), ()):
            part = kids[at : at + len(name)]
            if len(part) == len(name) and all(map(_letter, part)) and "".join(map(_letter, part)) == name:
                kids[at : at + len(name)] = [Mark("mi", text=name)]
                fused = True
                break
        at = max(0, at - 1) if fused else at + 1


def repair(node: Mark) -> Mark:
    for kid in node.kids:
        repair(kid)
    _scripts(node.kids)
    _functions(node.kids)
    return node


def repair_xml(text: str | bytes) -> str:
    return to_xml(repair(from_xml(text)), prefix="")
