"""Equations and embedded objects of one WordprocessingML part, and its relationships."""

from __future__ import annotations

import hashlib
import posixpath
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

from mathquarry.functions.mathml import local

# Namespaces, and how parts are named and ordered.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS = {"w": W, "o": "urn:schemas-microsoft-com:office:office", "v": "urn:schemas-microsoft-com:vml", "m": "http://schemas.openxmlformats.org/officeDocument/2006/math"}
OLE_RELATION = R + "/oleObject"
_PREFIX = {
    "omml": {W: "w", NS["m"]: "m"},
    "ole": {W: "w", R: "r", NS["o"]: "o", NS["v"]: "v", "http://schemas.openxmlformats.org/package/2006/relationships": "rel"},
}


def _named(tag: str, prefixes: dict[str, str]) -> str:
    space, _, name = tag.rpartition("}")
    prefix = prefixes.get(space[1:])
    return f"{prefix}:{name}" if prefix else name


def _numbered(node, prefixes: dict[str, str], by_local: bool) -> Iterator[tuple[object, str]]:
    """Children with their step of the path: name[ordinal], ordinals counting local or qualified names."""
    seen: Counter[str] = Counter()
    for child in node:
        name = _named(child.tag, prefixes)
        key = local(child.tag) if by_local else name
        seen[key] += 1
        yield child, f"/{name}[{seen[key]}]"


def equations(xml: bytes) -> list[dict]:
    """Outermost oMath and oMathPara elements in document order.

    Paragraphs are counted from 1 where they are children of the body or of the root; what stands
    between them has the number of the paragraph before. Runs are counted within a paragraph.
    """
    root = ElementTree.fromstring(xml)
    prefixes = _PREFIX["omml"]
    top = f"/{_named(root.tag, prefixes)}[1]"
    found: list[dict] = []
    blocks: list[tuple[object, str]] = []
    for child, step in _numbered(root, prefixes, True):
        if local(child.tag) == "body":
            blocks += [(b, top + step + s) for b, s in _numbered(child, prefixes, True)]
        else:
            blocks.append((child, top + step))
    paragraph = 0
    for block, path in blocks:
        paragraph += local(block.tag) == "p"
        runs = 0
        # depth first; a run's number holds for what is inside of it
        todo = [(c, path + s, None) for c, s in reversed(list(_numbered(block, prefixes, True)))]
        while todo:
            node, at, run = todo.pop()
            name = local(node.tag)
            if name in ("oMath", "oMathPara"):
                display = name == "oMathPara"
                found.append(
                    {
                        "paragraph_index": paragraph or None,
                        "run_index": run,
                        "xpath": at,
                        "element": _named(node.tag, prefixes),
                        "sha256": hashlib.sha256(ElementTree.tostring(node, encoding="utf-8")).hexdigest(),
                        "math_children": len(node.findall(".//m:oMath", NS)) if display else 1,
                        "omml": ElementTree.tostring(node, encoding="unicode"),
                    }
                )
                continue
            if name == "r":
                runs += 1
                run = runs
            todo += [(c, at + s, run) for c, s in reversed(list(_numbered(node, prefixes, True)))]
    return found


def fragments(xml: bytes) -> list[str]:
    """Every oMath and oMathPara in document order, nested ones too."""
    return [ElementTree.tostring(n, encoding="unicode") for n in ElementTree.fromstring(xml).iter() if local(n.tag) in ("oMath", "oMathPara")]


def _attribute(node, name: str) -> str | None:
    return None if node is None else node.attrib.get(f"{{{R}}}{name}")


def _object(node, ole) -> dict:
    return {"rid": _attribute(ole, "id"), "preview_rid": _attribute(node.find(".//v:imagedata", NS), "id"), "prog_id": None if ole is None else ole.attrib.get("ProgID"), "object_id": None if ole is None else ole.attrib.get("ObjectID"), "shape_id": None if ole is None else ole.attrib.get("ShapeID")}


def run_text(run) -> str:
    said = {"tab": "\t", "br": "\n", "object": "[OLE]"}
    return "".join((n.text or "") if local(n.tag) == "t" else said.get(local(n.tag), "") for n in run.iter())


def mathtype_objects(xml: bytes) -> list[dict]:
    """Objects that are children of a run that is a child of a paragraph; paragraphs and runs count from 1."""
    root = ElementTree.fromstring(xml)
    steps: dict[int, str] = {id(root): f"/{_named(root.tag, _PREFIX['ole'])}[1]"}
    for node in root.iter():
        for child, step in _numbered(node, _PREFIX["ole"], False):
            steps[id(child)] = steps[id(node)] + step
    found = []
    for number, paragraph in enumerate((n for n in root.iter() if local(n.tag) == "p"), 1):
        runs = [c for c in paragraph if local(c.tag) == "r"]
        said = [run_text(r) for r in runs]
        field = " ".join(t.strip() for n in paragraph.iter() if local(n.tag) == "instrText" and (t := n.text) and t.strip()).strip() or None
        for k, run in enumerate(runs):
            for node in (c for c in run if local(c.tag) == "object"):
                ole = node.find("o:OLEObject", NS)
                ole = node.find(".//o:OLEObject", NS) if ole is None else ole
                if ole is None:
                    continue
                before, after = "".join(said[:k])[-60:], "".join(said[k + 1 :])[:60]
                found.append({"paragraph_index": number, "run_index": k + 1, "xpath": steps[id(ole)], "field_code": field, "paragraph_text": "".join(said), "run_text": said[k], "text_before": before, "text_after": after, **_object(node, ole)})
    return found


def axmath_objects(xml: bytes) -> list[dict]:
    """Every object element, with the paragraph (from 1) and run that it stands in."""
    root = ElementTree.fromstring(xml)
    found: list[dict] = []
    paragraphs = 0
    here = {"paragraph_index": None, "fields": [], "style": None, "runs": [0], "run_index": None}
    todo = [(c, f"/{_named(root.tag, _PREFIX['ole'])}[1]" + s, here) for c, s in reversed(list(_numbered(root, _PREFIX["ole"], True)))]
    while todo:
        node, path, at = todo.pop()
        name = local(node.tag)
        if name == "p":
            paragraphs += 1
            style = node.find("w:pPr/w:pStyle", NS)
            fields = [t for n in node.findall(".//w:instrText", NS) if (t := (n.text or "").strip())]
            at = {"paragraph_index": paragraphs, "fields": fields, "style": None if style is None else style.attrib.get(f"{{{W}}}val"), "runs": [0], "run_index": None}
        elif name == "r":
            at["runs"][0] += 1
            at = {**at, "run_index": at["runs"][0]}
        elif name == "object":
            field = next((f for f in at["fields"] if "embed equation.axmath" in f.casefold()), None)
            found.append({"paragraph_index": at["paragraph_index"], "run_index": at["run_index"], "xpath": path, "field_code": field, "style": at["style"], **_object(node, node.find("o:OLEObject", NS))})
        todo += [(c, path + s, at) for c, s in reversed(list(_numbered(node, _PREFIX["ole"], True)))]
    return found


def equation3_objects(xml: bytes) -> list[dict]:
    """Objects of runs anywhere in a paragraph; paragraphs and runs count from 0."""
    found = []
    for number, paragraph in enumerate(ElementTree.fromstring(xml).findall(".//w:p", NS)):
        said = [f.attrib["instr"] for f in paragraph.findall(".//w:fldSimple", NS) if f.attrib.get("instr")] + [n.text for n in paragraph.findall(".//w:instrText", NS) if n.text]
        field = " ".join(" ".join(said).split()) or None
        for k, run in enumerate(paragraph.findall(".//w:r", NS)):
            for node in run.findall("./w:object", NS):
                ole = node.find(".//o:OLEObject", NS)
                if ole is not None:
                    found.append({"paragraph_index": number, "run_index": k, "field_code": field, **_object(node, ole)})
    return found


WALKS = {"omml-native": equations, "mathtype-ole": mathtype_objects, "axmath-ole": axmath_objects, "equation-editor-3-ole": equation3_objects}


def part_of_relationships(name: str) -> str | None:
    """The part that a .rels entry belongs to."""
    folder, leaf = posixpath.split(name)
    parent, last = posixpath.split(folder)
    return posixpath.join(parent, leaf[: -len(".rels")]) if last == "_rels" and leaf.endswith(".rels") else None


def relationships(part: str, xml: bytes) -> list[dict]:
    """Id, type and target; the three detectors resolve a target against its part by three rules."""
    found: dict[str, dict] = {}
    for rel in ElementTree.fromstring(xml).findall("{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"):
        rid, target = rel.attrib.get("Id", ""), rel.attrib.get("Target", "")
        parent = posixpath.dirname(part)
        whole = posixpath.normpath(posixpath.join(parent, target)) if target else None
        plain = target.lstrip("/") if target.startswith("/") else posixpath.join(parent, *[s for s in target.split("/") if s not in ("", ".")]) if target else None
        found[rid] = {"rid": rid, "type": rel.attrib.get("Type", ""), "target": target, "normal": target if "://" in target else whole and whole.lstrip("./"), "plain": plain, "rooted": whole and whole.lstrip("/")}
    return list(found.values())
