"""Canonical MathML of detected formulas, its evidence, and the parity of what went in and what came out."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mathquarry.functions import display_mode, mathml, mtef, odf, omml, payload, repair, word
from mathquarry.operators.detect import parsed
from mathquarry.plans.routing import default_contract, source_counts
from mathquarry.plans.status import canonical_gate, parity
from mathquarry.sources.cfb import Compound, is_compound
from mathquarry.sources.containers import is_story

SIGNALS = "root_display string, mathml_attribute_count int, " + ", ".join(
    f"{s} boolean" for s in ("has_semantics", "has_annotation", "has_mfrac_linethickness", "has_mfrac_bevelled", "has_mfenced_separators", "has_movablelimits", "has_mathvariant", "has_accent", "has_accentunder")
)
#: One row per fragment: status is accepted, unsupported or failed; only accepted ones have MathML that counts. storage_kind is told of ODF formulas.
CANONICAL = f"part_index int, storage_kind string, status string, mathml string, canonical_sha256 string, problem string, signals struct<{SIGNALS.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>"


def _record(text: str, status: str = "accepted", problem: str | None = None, tree: mathml.Mark | None = None) -> dict:
    """``tree``: what the text was written from, if it is at hand. Names with a namespace make a text that can't be read, so it is read to say why."""
    known = tree is not None and not any("{" in name for node in tree.walk() for name in node.attrs)
    return {"status": status, "mathml": text, "canonical_sha256": mathml.canonical_digest(text), "problem": problem, "signals": mathml.signals_of(tree) if known else mathml.signals(text)}


def _failed(problem: str) -> dict:
    return {"status": "failed", "mathml": None, "canonical_sha256": None, "problem": problem, "signals": None}


def _attempt(make, *args) -> dict:
    try:
        return make(*args)
    except Exception as problem:  # data that can't be converted is a row
        return _failed(str(problem))


def _omml_record(fragment: str) -> dict:
    text = omml.omml_to_mathml(fragment)
    missing = omml.UNSUPPORTED in text
    return _record(text, "unsupported" if missing else "accepted", "unsupported OMML structure" if missing else None)


def omml_canonical(entries: DataFrame) -> DataFrame:
    """Every oMath and oMathPara of the story parts, nested ones too, parts in alphabetical order."""
    stories = entries.where((F.col("suffix") == ".docx") & is_story(F.col("entry"))).select("doc_id", F.col("entry").alias("part"), "data")

    def read(doc: str, part: str, data: bytes | None) -> list[dict]:
        return [{"part_index": k, **_attempt(_omml_record, f)} for k, f in enumerate(word.fragments(data or b""), 1)]

    return _sequenced(parsed(stories, "doc_id part", read, CANONICAL), "omml-native")


def odf_canonical(entries: DataFrame) -> DataFrame:
    """Every math element of every content.xml is kept as it stands."""
    content = entries.where(F.col("suffix").isin(".odt", ".odf", ".fodt") & (F.col("entry").rlike(r"(^|/)content\.xml$") | (F.col("suffix") == ".fodt"))).select("doc_id", F.col("entry").alias("part"), "data")

    def read(doc: str, part: str, data: bytes | None) -> list[dict]:
        rooted = odf.has_math_root(data or b"")
        kind = lambda k: "odf-draw-object-subdocument" if part.endswith("/content.xml") else "odf-formula-root" if rooted and k == 1 else "odf-content-inline-mathml"
        return [{"part_index": k, "storage_kind": kind(k), **_record(text)} for k, text in enumerate(odf.mathml_nodes(data or b""), 1)]

    return _sequenced(parsed(content, "doc_id part", read, CANONICAL), "odf-native")


def native_stream(data: bytes, preferred: str | None = None) -> bytes:
    """The Equation Native stream of a payload: the preferred or first stream with a known header, else the preferred one."""
    if not is_compound(data):
        return data
    file = Compound(data)
    names = ([preferred] if preferred in file.streams else []) + [n for n in file.names() if n not in payload.CONTROL_STREAMS and n != preferred]
    for name in names:
        if mtef.has_header(stream := file.read(name)):
            return stream
    if preferred in file.streams:
        return file.read(preferred)
    raise mtef.MtefError("No supported Equation Native stream was found in the OLE object.")


def equation3_canonical(entries: DataFrame, formulas: DataFrame) -> DataFrame:
    """Streams of the Equation 3.0 rows of the formula table, decoded; what isn't supported says why."""
    wanted = formulas.where("source_family = 'equation-editor-3-ole'").select("doc_id", F.col("embedding_target").alias("entry"), F.col("doc_part_path").alias("part"), "object_sequence")
    rows = wanted.join(entries.select("doc_id", "entry", "data"), ["doc_id", "entry"], "left").select("doc_id", "part", F.col("object_sequence").cast("string").alias("seq"), "data")

    def decode(data: bytes | None) -> dict:
        if data is None:
            raise mtef.MtefError("missing payload")
        return _record(mtef.decode_stream(native_stream(data, "Equation Native")).mathml)

    read = lambda doc, part, seq, data: [{"part_index": int(seq), **_attempt(decode, data)}]
    return _sequenced(parsed(rows, "doc_id part seq", read, CANONICAL).drop("seq"), "equation-editor-3-ole")


def mathtype_canonical(converted: DataFrame) -> DataFrame:
    """``converted``: doc_id, part (the object's file), mathml — what an external converter made.

    Scripts and function names are repaired; empty, malformed or non-math texts are unsupported.
    """

    def accept(text: str | None) -> dict:
        text = (text or "").lstrip("﻿")
        if not text.strip():
            return _failed("empty MathML")
        made = repair.repair(mathml.from_xml(text))
        if made.tag != "math":
            return {**_failed(f"root element is {made.tag}, not math"), "status": "unsupported"}
        return _record(mathml.DECLARATION + mathml.to_xml(made) + "\n", tree=made)

    read = lambda doc, part, text: [{"part_index": 1, **_attempt(accept, text)}]
    return _sequenced(parsed(converted.select("doc_id", "part", "mathml"), "doc_id part", read, CANONICAL), "mathtype-ole")


def _sequenced(rows: DataFrame, family: str) -> DataFrame:
    """canonical_id counts a document's accepted rows only, in order of part and place."""
    rows = rows.withColumn("status", F.coalesce("status", F.lit("failed"))).withColumn("problem", F.coalesce("problem", "error")).drop("error")
    accepted = F.when(F.col("status") == "accepted", 1)
    number = F.count(accepted).over(Window.partitionBy("doc_id").orderBy("part", "part_index").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("canonical_id", F.when(accepted == 1, F.format_string(f"{family}-%04d", number))).withColumn("source_family", F.lit(family))


def property_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Sums and counts of the signals of accepted rows."""
    flags = [s.split()[0] for s in SIGNALS.split(", ") if s.endswith("boolean")]
    return rows.where("status = 'accepted'").groupBy(*by).agg(
        F.sum("signals.mathml_attribute_count").alias("mathml_attribute_count"),
        F.array_sort(F.collect_set(F.nullif("signals.root_display", F.lit("")))).alias("root_display_values"),
        *(F.count_if(F.col(f"signals.{f}")).alias(f) for f in flags),
    )


def canonical_summary(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document and family: expected, accepted, unsupported, parity, gate. ``expected``: doc_id, source_family, formula_count."""
    counts = rows.groupBy("doc_id", "source_family").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") != "accepted").alias("unsupported"))
    joined = expected.join(counts, ["doc_id", "source_family"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    filled = joined.withColumns({"expected": zero("formula_count"), "accepted": zero("accepted"), "unsupported": zero("unsupported")}).drop("formula_count")
    status = parity(F.col("expected"), F.col("accepted"), F.col("unsupported"), F.col("source_family"))
    return filled.withColumn("formula_count_parity", status).withColumn("gate_status", canonical_gate(F.col("accepted"), F.col("formula_count_parity"), F.col("source_family")))


def all_canonical(entries: DataFrame, formulas: DataFrame) -> DataFrame:
    """The families that are converted here."""
    return omml_canonical(entries).unionByName(odf_canonical(entries)).unionByName(equation3_canonical(entries, formulas))


def evidence(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """The summary with the signals of what was accepted, and the contract of the family."""
    return default_contract(canonical_summary(rows, expected).join(property_summary(rows, "doc_id", "source_family"), ["doc_id", "source_family"], "left"))


def document_facts(entries: DataFrame, formulas: DataFrame) -> DataFrame:
    """What the converters found, per document and family: whether it opened, gave fragments, and passed its gate."""
    summary = canonical_summary(all_canonical(entries, formulas), source_counts(formulas))
    opened = entries.groupBy("doc_id").agg(F.bool_or(F.col("entry").isNotNull()).alias("opened"))
    facts = summary.join(opened, "doc_id", "left")
    return facts.select("doc_id", "source_family", "opened", (F.col("accepted") + F.col("unsupported") > 0).alias("extracted"), F.col("gate_status").startswith("passed").alias("converted"))


def with_display_mode(df: DataFrame, xml: str, default: str = "block") -> DataFrame:
    """Adds ``xml_with_display`` and ``display_added``; XML that can't be parsed stays as it is."""

    kind = pa.struct([("xml", pa.string()), ("changed", pa.bool_())])

    def one(text: str | None) -> dict:
        try:
            made, changed = display_mode.with_display_mode(text, default)
        except (ElementTree.ParseError, TypeError):
            made, changed = text, False
        return {"xml": made, "changed": changed}

    @F.arrow_udf("struct<xml:string,changed:boolean>")
    def add(texts: pa.Array) -> pa.Array:
        return pa.array(map(one, texts.to_pylist()), kind)

    return df.withColumn("d", add(xml)).withColumns({"xml_with_display": F.col("d.xml"), "display_added": F.col("d.changed")}).drop("d")
