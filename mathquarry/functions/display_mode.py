"""MTEF3 XML without equation options gets them, right after the product's subversion."""

from __future__ import annotations

from xml.etree import ElementTree


def with_display_mode(xml: str | bytes, default: str = "block") -> tuple[str, bool]:
    """(the XML, whether it was changed)."""
    root = ElementTree.fromstring(xml)
    kept = xml.decode() if isinstance(xml, bytes) else xml
    mtef = root.find(".//mtef")
    if mtef is None or mtef.find("equation_options") is not None or (mtef.findtext("mtef_version") or "").strip() != "3":
        return kept, False
    tags = [child.tag for child in mtef]
    place = tags.index("product_subversion") + 1 if "product_subversion" in tags else len(tags)
    options = ElementTree.Element("equation_options")
    options.text = default
    mtef.insert(place, options)
    return ElementTree.tostring(root, encoding="unicode"), True
