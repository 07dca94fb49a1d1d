"""Detection, routing, statuses, risk and rewriting over small containers."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from mathquarry import catalog, samples, standins
from mathquarry.functions import docx, mathml, repair, word
from mathquarry.operators import canonical, detect, rewrite, risk
from mathquarry.plans import routing, status
from mathquarry.sources import containers


@pytest.fixture(scope="module")
def entries(sample_entries):
    return sample_entries


@pytest.fixture(scope="module")
def formulas(entries):
    return {(r.doc_id, r.formula_id): r for r in detect.detect_all(entries).collect()}


def test_families(formulas):
    assert sorted(formulas) == sorted(
        [
            ("omml.docx", "omml-native-0001"), ("omml.docx", "omml-native-0002"), ("omml.docx", "omml-native-0003"), ("mathtype.docx", "mathtype-ole-0001"), ("equation3.docx", "equation-editor-3-ole-0001"),
            ("axmath.docx", "axmath-ole-0001"), ("legacy.doc", "equation-editor-3-ole-0001"), ("native.odt", "odf-native-0001"), ("native.odt", "odf-native-0002"),
            ("bridge.odt", "libreoffice-transformed-0001"), ("bridge.odt", "libreoffice-transformed-0002"), ("flat.fodt", "odf-native-0001"),
        ]
    )


def test_omml_rows(formulas):
    inline, display, comment = (formulas["omml.docx", f"omml-native-000{k}"] for k in (1, 2, 3))
    assert (inline.storage_kind, inline.paragraph_index, inline.run_index, inline.risk_level, inline.confidence) == ("omml-inline", 1, 2, "low", 0.99)
    assert (display.storage_kind, display.paragraph_index, display.run_index) == ("omml-display", 2, None)
    assert '"math_child_count":2' in display.source_specific and display.provenance.evidence_sources == ["word/document.xml", "word/settings.xml"]
    assert (comment.story_type, comment.risk_level, comment.risk_flags) == ("comment", "medium", ["story-part-nonmain"])


def test_ole_rows(formulas):
    m = formulas["mathtype.docx", "mathtype-ole-0001"]
    assert (m.paragraph_index, m.run_index, m.confidence, m.risk_level, m.embedding_target) == (1, 2, 0.97, "low", "word/embeddings/oleObject1.bin")
    assert '"text_before":"Before "' in m.source_specific and '"mtef_version":5' in m.source_specific and '"application_key":"DSMT7"' in m.source_specific
    e = formulas["equation3.docx", "equation-editor-3-ole-0001"]
    assert (e.paragraph_index, e.run_index, e.confidence, e.risk_level, e.risk_flags) == (0, 0, 0.75, "low", ["eq3-prog-id", "eqnolefilehdr-present"])
    a = formulas["axmath.docx", "axmath-ole-0001"]
    assert (a.confidence, a.risk_level) == (0.99, "medium") and "custom-symbols-present" in a.risk_flags
    d = formulas["legacy.doc", "equation-editor-3-ole-0001"]
    assert (d.storage_kind, d.doc_part_path, d.confidence) == ("ole-cfb-stream", "legacy-doc:ObjectPool/_1/Equation Native", 0.75)


def test_odf_rows(formulas):
    kinds = {k: v.storage_kind for k, v in formulas.items()}
    assert kinds["native.odt", "odf-native-0001"] == "odf-content-inline-mathml" and kinds["native.odt", "odf-native-0002"] == "odf-draw-object-subdocument"
    bridge = formulas["bridge.odt", "libreoffice-transformed-0001"]
    assert bridge.risk_flags == ["transformed-source", "libreoffice-bridge", "original-origin:omml"] and '"producer_version":"25.2.0.3"' in bridge.source_specific


def test_vendor_rules(spark):
    one = {"word/_rels/document.xml.rels": samples.rels(rId1="embeddings/x.bin")}
    field = lambda code: f"<w:r><w:instrText>{code}</w:instrText></w:r>"
    files = {
        "preview.docx": {"word/document.xml": samples.document(samples.ole("Equation.3").replace("<o:OLE", '<v:imagedata r:id="rId2"/><o:OLE')), "word/_rels/document.xml.rels": samples.rels(rId1="embeddings/gone.bin", rId2="media/i.wmf")},
        "field.docx": {"word/document.xml": samples.document(field("EMBED Equation \\* x") + samples.ole("Other")), "word/embeddings/x.bin": b"none", **one},
        "vendor.docx": {"word/document.xml": samples.document(field("EMBED Equation.DSMT4") + samples.ole("Package")), "word/embeddings/x.bin": b"none", **one},
        "numbered.docx": {"word/document.xml": samples.document(samples.ole("Package"), samples.ole("Equation.3")), "word/embeddings/x.bin": samples.STREAMS["power"], **one},
        "headers.docx": {f"word/{n}.xml": samples.document(samples.ole("Equation.DSMT4"), root="hdr") for n in ("header2", "header1", "footnotes")},
    }
    frame = spark.createDataFrame([(n, bytearray(samples.packed(m))) for n, m in files.items()], "doc_id string, content binary")
    found = {(r.doc_id, r.formula_id): r for r in detect.detect_all(containers.entries_of(containers.described(frame))).collect()}
    preview = found["preview.docx", "equation-editor-3-ole-0001"]
    assert (preview.source_role, preview.risk_level, preview.failure_mode, preview.preview_target) == ("preview-only", "manual-review", "missing-native-payload", "word/media/i.wmf")
    assert found["field.docx", "equation-editor-3-ole-0001"].confidence == 0.2
    assert ("vendor.docx", "mathtype-ole-0001") in found and ("vendor.docx", "equation-editor-3-ole-0001") not in found
    assert ("numbered.docx", "equation-editor-3-ole-0002") in found
    assert [found["headers.docx", f"mathtype-ole-000{k}"].doc_part_path for k in (1, 2, 3)] == ["word/footnotes.xml", "word/header1.xml", "word/header2.xml"]
    assert found["headers.docx", "mathtype-ole-0001"].failure_mode == "invalid-ole-payload"


def test_scan_and_failures(entries):
    rows = {r.doc_id: r for r in containers.scan(entries).collect()}
    assert (rows["omml.docx"].container_format, rows["omml.docx"].package_kind, rows["omml.docx"].entry_count) == ("docx", "ooxml-zip", 3)
    assert rows["legacy.doc"].embedding_targets == ["ObjectPool/_1/Equation Native"] and rows["native.odt"].object_parts == ["Object 1/content.xml"]
    assert [r.doc_id for r in detect.failures(entries).collect()] == ["broken.docx"]
    parts = {(r.doc_id, r.part_path): r for r in containers.story_parts(entries).collect()}
    assert parts["omml.docx", "word/document.xml"].omml_count == 5  # an oMathPara also counts as an oMath
    assert ("flat.fodt", "flat.fodt") in parts


def test_resolved_targets():
    rel = lambda target: word.relationships("word/document.xml", samples.rels(a=target).encode())[0]
    assert [rel("../x/y.bin")[k] for k in ("normal", "plain", "rooted")] == ["x/y.bin", "word/../x/y.bin", "x/y.bin"]
    assert [rel("/word/e.bin")[k] for k in ("normal", "plain", "rooted")] == ["word/e.bin"] * 3
    assert rel("http://x/y")["normal"] == "http://x/y"


def test_unknown_family_stops(spark):
    counts = spark.createDataFrame([("d", "nonsense", 1)], "doc_id string, source_family string, formula_count long")
    with pytest.raises(Exception, match="unknown source family"):
        routing.route_plan(counts).collect()
    assert routing.default_contract(counts).first().contract_status == "manual-triage"


def test_canonical_rows(entries, spark):
    found = detect.detect_all(entries)
    made = canonical.all_canonical(entries, found)
    rows = made.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.canonical_id for r in sorted(by["omml.docx"], key=lambda r: (r.part, r.part_index))] == [f"omml-native-000{k}" for k in range(1, 6)]
    assert by["equation3.docx"][0].status == "accepted" and by["legacy.doc"][0].mathml == by["equation3.docx"][0].mathml
    summary = {(r.doc_id, r.source_family): r for r in canonical.canonical_summary(made, routing.source_counts(found)).collect()}
    assert summary["equation3.docx", "equation-editor-3-ole"].gate_status == "passed-limited"
    assert summary["omml.docx", "omml-native"].formula_count_parity == "mismatch"  # nested equations are converted too
    props = canonical.property_summary(made, "source_family").collect()
    assert {p.source_family: p.has_mfrac_bevelled for p in props}["omml-native"] == 2


def test_mathtype_conversions_are_accepted_or_say_why(spark):
    ok = f"<math {samples._X}><mi>x</mi><msup><mrow/><mn>2</mn></msup></math>"
    rows = spark.createDataFrame([("d", "1.bin", ok), ("d", "2.bin", ""), ("d", "3.bin", "<a/>"), ("d", "4.bin", "<"), ("d", "5.bin", "﻿" + ok)], "doc_id string, part string, mathml string")
    found = {r.part: r for r in canonical.mathtype_canonical(rows).collect()}
    assert [found[f"{k}.bin"].status for k in range(1, 6)] == ["accepted", "failed", "unsupported", "failed", "accepted"]
    assert [found[f"{k}.bin"].canonical_id for k in (1, 5)] == ["mathtype-ole-0001", "mathtype-ole-0002"]
    assert "<math:msup><math:mi>x</math:mi>" in found["1.bin"].mathml


def test_step_status(spark):
    cases = {
        "a": [("succeeded", True)], "b": [("succeeded", True), ("failed", True), ("blocked-external-tool", True)], "c": [("blocked-external-tool", False), ("manual-gate", False)], "d": [("manual-gate", True)],
        "e": [("succeeded", False)], "f": [("validation-gated", True), ("review-gated", True)], "g": [("review-gated", True), ("skipped-existing", True)], "h": [("skipped", True), ("succeeded", True)],
    }
    rows = spark.createDataFrame([(k, s, u) for k, v in cases.items() for s, u in v] + [("z", None, None)], "step string, s string, u boolean")
    got = {r.step: r.status for r in rows.groupBy("step").agg(status.step_status(F.col("s"), F.col("u")).alias("status")).collect()}
    assert got == {"a": "completed", "b": "failed", "c": "blocked", "d": "manual-only", "e": "manual-only", "f": "validation-gated", "g": "review-gated", "h": "completed-with-skips", "z": "manual-only"}


def test_visual_gate_is_strict(spark):
    rows = spark.createDataFrame([("a", 0.02), ("b", 0.0201), ("c", None), ("c", 0.0)], "doc_id string, changed_ratio double")
    got = {r.doc_id: (r.status, r.reasons) for r in status.visual_gate(rows).collect()}
    assert got["a"] == ("passed", []) and got["b"][1] == ["Max changed ratio 0.020100 exceeds threshold 0.020000."] and got["c"][1] == ["Unmatched page count 1 exceeds threshold 0."]


def test_risk_cascade(spark):
    good = ("ok", "True", "True")
    cases = [
        ("x+1", "", *good, "auto_replace", []), ("a=", "____.", *good, "spot_check", ["formula_followed_by_blank"]), ("a=", "__", *good, "manual_review", ["trailing_operator_or_relation"]),
        ("{a}", "", *good, "spot_check", ["grouped_output_needs_review"]), ("x^2", None, *good, "spot_check", ["has_scripts"]), ("(-x)", "", *good, "manual_review", ["operator_missing_lhs"]),
        (None, "", "error", "False", None, "manual_review", ["empty_latex_preview", "missing_latex", "missing_omml", "status_not_ok", "trailing_operator_or_relation"][:4]),
    ]
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k int, latex_preview string, text_after string, status string, omml_exists string, tex_exists string")
    got = {r.k: (r.category, r.reasons) for r in risk.classified(rows).collect()}
    for k, c in enumerate(cases):
        assert got[k] == (c[5], c[6]), c


def test_risk_records_join_the_last_object_of_a_stem(spark):
    summary = spark.createDataFrame([("oleObject2.bin", "ok", "True", "True", "x"), ("plain.bin", "ok", "True", "True", "x")], "name string, status string, omml_exists string, tex_exists string, latex_preview string")
    objects = spark.createDataFrame([(1, "embeddings/oleObject2.bin", 1, 1, "", "a"), (2, "embeddings/oleObject2.bin", 5, 1, "", "b"), (3, "", 9, 9, "", "")], "sequence int, ole_target string, paragraph_index int, run_index int, text_before string, text_after string")
    got = {r.name: (r.paragraph_index, r.position) for r in risk.records(summary, objects).collect()}
    assert got == {"oleObject2.bin": (5, 2), "plain.bin": (None, 10**9)}


def test_layout():
    assert [docx.line_for(h, p) for h, p in ((18, 360), (24, 360), (18, 390))] == [360, 487, 395]
    with pytest.raises(ValueError):
        docx.line_for(20, 360, 0.9)
    with pytest.raises(ValueError):
        rewrite.adjusted_line(F.lit(1), F.lit(1), 0.9)


def test_rewriting(spark):
    def container(body):
        return samples.packed({"word/document.xml": samples.document(*body), "word/_rels/document.xml.rels": samples.rels(rId1="embeddings/oleObject1.bin")})

    omml = samples.OMML["scripts"]
    bodies = {"inline": [samples.run("a") + samples.ole("Equation.DSMT4")], "alone": [samples.ole("Equation.DSMT4")], "mixed": [samples.ole("Equation.DSMT4").replace("<w:object>", "<w:t>x</w:t><w:object>")], "none": [samples.run("x")]}
    files = spark.createDataFrame([(n, bytearray(container(b))) for n, b in bodies.items()] + [("bad", bytearray(b"x"))], "doc_id string, content binary")
    equations = spark.createDataFrame([(n, "oleObject1", omml) for n in [*bodies, "bad"]], "doc_id string, stem string, omml string")
    got = {r.doc_id: r for r in rewrite.replaced(files, equations, keep_layout=True).collect()}
    read = lambda n: zipfile.ZipFile(io.BytesIO(got[n].content)).read("word/document.xml").decode()
    assert got["inline"].replaced_count == 1 and "OLEObject" not in read("inline") and "oMathPara" not in read("inline")
    assert "oMathPara" in read("alone") and 'w:lineRule="auto"' in read("alone")
    assert "mixed content" in got["mixed"].error and got["none"].replaced_count == 0 and got["bad"].error


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_hold_against_sql(spark, name, request):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "conversations", "lineitem", "labels", "part", "customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf).toArrow()
    want = con.sql(catalog.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns))))
    assert rows(got) == rows(want)


def test_context_of_long_paragraphs_and_empty_runs(spark):
    from mathquarry.operators.object_map import neighbours

    texts = ["", "a" * 70, "", "b", None, "c" * 59, "", "d e"] + ["x"] * 200
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "alone"), (3, 0, None)], "p int, k int, text string")
    got = {(r.p, r.k): r for r in neighbours(rows, "p", ["k"]).collect()}
    for k in range(len(texts)):
        before, after = "".join(t or "" for t in texts[:k])[-60:], "".join(t or "" for t in texts[k + 1 :])[:60]
        assert (got[1, k].text_before, got[1, k].text_after, got[1, k].inline_context) == (before, after, bool(before.strip(" ") or after.strip(" ")))
    assert not got[2, 0].inline_context and not got[3, 0].inline_context


def test_stand_ins_reach_every_arm(spark):
    sf = "/root/testdata/sf0.01"
    assert {r.status for r in catalog.step_status(spark, sf).collect()} >= {"failed", "blocked", "manual-only", "validation-gated", "review-gated", "completed-with-skips", "completed"}
    assert {r.reasons for r in catalog.risk_classify(spark, sf).collect()} >= {"formula_followed_by_blank", "", "long_formula"}
    assert {(r.parity, r.gate) for r in catalog.parity_gate(spark, sf).collect()} >= {("passed", "passed"), ("passed", "passed-limited"), ("failed", "blocked-canonical-artifact"), ("mismatch", "blocked-canonical-artifact")}


def _rows_a_task(rows):
    return [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def test_mathml_of_one_small_file_is_dealt_to_all_tasks(spark):
    found = _rows_a_task(standins.broken_mathml(spark.range(0, 2000, 1, 1), "id"))
    assert sum(found) == 2000 and len(found) >= 2 * spark.sparkContext.defaultParallelism and max(found) <= 2000 / len(found) + 1


def test_signals_of_a_repaired_tree_are_those_of_its_text(spark, monkeypatch):
    inner = '<mfrac bevelled="true" linethickness="0"><mi mathvariant="bold">s</mi><mrow/></mfrac><mi>x</mi><msup><mrow/><mo accent="true" q="&#10;&quot;">^</mo></msup>'
    made = mathml.from_xml(f'<math {samples._X} display="block">{inner}</math>')
    text = mathml.DECLARATION + mathml.to_xml(made)
    want = mathml.signals(text)
    assert mathml.signals_of(made) == want and want["mathml_attribute_count"] == 6
    monkeypatch.setattr(mathml, "from_xml", None)  # the text is not read again
    assert canonical._record(text, tree=made)["signals"] == want
    monkeypatch.undo()
    named = f'<math {samples._X} xml:lang="en"><mi>x</mi></math>'  # can't be written without a prefix
    rows = spark.createDataFrame([("d", "1.bin", named)], "doc_id string, part string, mathml string")
    assert canonical.mathtype_canonical(rows).first().status == "failed"


def test_other_stand_ins_of_one_small_file_are_dealt_to_all_tasks(spark):
    keys = spark.range(0, 2000, 1, 1).select("id", F.col("id").alias("n"))
    for made in (standins.omml_fragments(keys, "id", "n"), standins.equation_streams(keys, "id")):
        found = _rows_a_task(made)
        assert sum(found) == 2000 and len(found) >= 2 * spark.sparkContext.defaultParallelism and max(found) <= 2000 / len(found) + 1
    assert len(_rows_a_task(catalog.display_mode(spark, "/root/testdata/sf0.001"))) >= 2 * spark.sparkContext.defaultParallelism


def test_function_names_are_looked_up_by_their_first_letter(monkeypatch):
    asked = []
    letter = repair._letter
    monkeypatch.setattr(repair, "_letter", lambda node: asked.append(node) or letter(node))
    assert repair.repair_xml(f"<math {samples._X}>" + "<mi>x</mi>" * 300 + "</math>").count("<mi>x</mi>") == 300
    assert len(asked) <= 2 * 300
    letters = lambda *names: "".join(f"<mi>{c}</mi>" for name in names for c in name)
    made = repair.from_xml(repair.repair_xml(f"<math {samples._X}>" + letters(*repair.NAMES, "SEC", "co") + "</math>"))
    assert [k.text for k in made.kids] == [*repair.NAMES, "sec", "c", "o"]
    for name in repair.NAMES:
        broken = f"<math {samples._X}>{letters('x', name[:-1])}<msub><mi>{name[-1]}</mi><mn>2</mn></msub></math>"
        assert [k.tag for k in repair.from_xml(repair.repair_xml(broken)).kids] == ["mi", "msub"], name
