"""Formulas and provenance of ODF packages."""

from __future__ import annotations

from xml.etree import ElementTree

from mathquarry.functions.mathml import NAMESPACE, local

MATH = f"{{{NAMESPACE}}}math"
DRAW_OBJECT = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}object"
HREF = "{http://www.w3.org/1999/xlink}href"
META_NAME = "{urn:oasis:names:tc:opendocument:xmlns:meta:1.0}name"


def normal_href(href: str) -> str:
    out = href.replace("\\", "/").partition("#")[0].strip()
    while out.startswith("./"):
        out = out[2:]
    return out.rstrip("/")


def member_of(href: str | None) -> str | None:
    path = normal_href(href or "")
    return (path if path.endswith(".xml") else path + "/content.xml") if path else None


def has_math_root(xml: bytes) -> bool:
    return ElementTree.fromstring(xml).tag == MATH


def content_formulas(xml: bytes) -> list[dict]:
    """Of a main content.xml: kind, href, member. Subdocuments are candidates until their root is known.

    A formula document gives one row. Else come inline formulas outside of drawn objects, then the
    drawn objects in document order.
    """
    root = ElementTree.fromstring(xml)
    if root.tag == MATH:
        return [{"kind": "odf-formula-root", "href": None, "member": None}]
    inline, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == MATH:
            inline.append({"kind": "odf-content-inline-mathml", "href": None, "member": None})
        elif node.tag != DRAW_OBJECT:
            todo += reversed(list(node))
    drawn = []
    for node in root.iter(DRAW_OBJECT):
        href = node.attrib.get(HREF, "")
        if node.find(f".//{MATH}") is not None:
            drawn.append({"kind": "odf-draw-object-inline", "href": href or None, "member": None})
        elif member := member_of(href):
            drawn.append({"kind": "odf-draw-object-subdocument", "href": href, "member": member})
    return inline + drawn


def mathml_nodes(xml: bytes) -> list[str]:
    """Every math element of a content part, serialized."""
    return [ElementTree.tostring(n, encoding="unicode") for n in ElementTree.fromstring(xml).iter(MATH)]


def office_meta(xml: bytes) -> dict:
    """The first generator, and user-defined values by normalized name (the last of a name counts)."""
    generator, values = "", {}
    for node in ElementTree.fromstring(xml).iter():
        if local(node.tag) == "generator":
            generator = generator or (node.text or "").strip()
        elif local(node.tag) == "user-defined":
            name = node.attrib.get(META_NAME) or node.attrib.get("name") or ""
            if name:
                values[normal_meta_name(name)] = (node.text or "").strip()
    return {"generator": generator, "values": values}


def normal_meta_name(name: str) -> str:
    return "".join(c.lower() if c.isalnum() else "_" for c in name.strip()).strip("_")
