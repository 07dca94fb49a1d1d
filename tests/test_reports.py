"""Registration of detectors, replacements that are missing, arguments, reports and their commands."""

import json

import pytest
from mathquarry import __main__, samples
from mathquarry.operators import detect, rewrite
from mathquarry.plans import options, reports
from mathquarry.sources import tables
from pyspark.sql import functions as F


def test_registry_orders_and_isolates(sample_entries):
    registry = detect.default_registry()
    assert registry.families() == ["axmath-ole", "equation-editor-3-ole", "libreoffice-transformed", "mathtype-ole", "odf-native", "omml-native"]
    with pytest.raises(ValueError, match="already"):
        registry.register(detect.Detector("odf-native", detect.odf_native, (".odt",)))

    def broken(entries):
        raise RuntimeError("no such thing")

    registry = detect.Registry(detect.Detector("odf-native", detect.odf_native, (".odt",)), detect.Detector("broken", broken, (".odt",), priority=1))
    found = registry.run(sample_entries)
    assert [d.family for d in registry.ordered()] == ["broken", "odf-native"] and registry.warnings == ["broken: no such thing"]
    assert {r.doc_id for r in found.collect()} == {"native.odt"}  # not flat.fodt, which it was not told to support


def test_legacy_objects_tell_their_storage(sample_entries):
    rows = detect.detect_all(sample_entries).where("doc_id = 'legacy.doc'").collect()
    assert [json.loads(r.source_specific)["equation_editor_3"]["object_storage"] for r in rows] == ["ObjectPool/_1"]


def test_missing_replacements_are_errors(spark):
    files = spark.createDataFrame([("a", bytearray(samples.containers()["mathtype.docx"]))], "doc_id string, content binary")
    equations = spark.createDataFrame([("a", "other", samples.OMML["fraction"])], "doc_id string, stem string, omml string")
    wanted = spark.createDataFrame([("a", "oleObject1")], "doc_id string, stem string")
    plain = rewrite.replaced(files, rewrite.replacements(equations)).first()
    assert (plain.replaced_count, plain.error) == (0, None)
    missing = rewrite.replaced(files, rewrite.replacements(equations, wanted)).first()
    assert missing.replaced_count == 0 and "no OMML for embeddings/oleObject1.bin" in missing.error


def test_arguments(spark):
    rows = [
        ({}, [], []),
        ({"preserve_mathtype_layout": "yes"}, ["-PreserveMathTypeLayout", "-MathTypeLayoutFactor", "1.01375"], ["--preserve-mathtype-layout", "--mathtype-layout-factor", "1.01375"]),
        ({"preserve_mathtype_layout": "1", "mathtype_layout_factor": "2.0", "resume_mathtype_pipeline": "true", "mathtype_start_index": "3", "mathtype_end_index": "-1"}, ["-PreserveMathTypeLayout", "-MathTypeLayoutFactor", "2", "-Resume", "-StartIndex", "3"], ["--preserve-mathtype-layout", "--mathtype-layout-factor", "2"]),
        ({"mathtype_layout_factor": "2", "mathtype_end_index": " 9 "}, ["-EndIndex", "9"], []),
    ]
    df = spark.createDataFrame([(k, o) for k, (o, _, _) in enumerate(rows)], "k int, o map<string,string>")
    got = df.select("k", options.mathtype_arguments(F.col("o")).alias("a"), options.mathtype_arguments(F.col("o"), script=False).alias("b")).orderBy("k").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in rows]
    assert reports.command_line(["tool", "a b", ""]) == 'tool "a b" ""' and reports.command_line([]) == ""
    assert [reports.decoded_output(x) for x in (None, "x", "é".encode(), "数".encode("gbk"), b"\xff")] == ["", "x", "é", "数", "\ufffd"]


def test_inputs_of_plans_are_found(tmp_path):
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "a.docx").write_text("")
    root = str(tmp_path.resolve())
    assert tables.resolved_input("/x/a.docx", "plans/p.json", root) == "/x/a.docx"
    assert tables.resolved_input("a.docx", "plans/p.json", root) == f"{root}/plans/a.docx"
    assert tables.resolved_input("b.docx", "plans/p.json", root) == f"{root}/b.docx" == tables.resolved_input("b.docx", "", root)


def test_validate_and_risk_commands(spark, tmp_path):
    checks = [{"doc_id": "a.docx", "provider": "p", "source_family": "f", "target_exists": True, "export_requested": False, "visual_requested": False}, {"doc_id": "b.docx", "target_exists": False, "reference_pdf": "r.pdf"}]
    (tmp_path / "checks.json").write_text("\n".join(map(json.dumps, checks)))
    __main__.main(["validate", str(tmp_path / "checks.json"), str(tmp_path / "out")])
    found = {r.doc_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert found["a.docx"].conclusion == "research-only" and "word_export=not-run\n" in found["a.docx"].report and found["a.docx"].report.endswith("- Visual PDF comparison not run.\n")
    assert "reference_pdf=r.pdf\n\nresidual_risks:\n- Target DOCX does not exist.\n" in found["b.docx"].report
    (tmp_path / "s.csv").write_text("name,status,omml_exists,tex_exists,latex_preview\noleObject2.bin,ok,True,True,a=\noleObject1.bin,ok,True,True,x^2\noleObject3.bin,ok,True,True,x\n")
    (tmp_path / "m.json").write_text(json.dumps({"items": [{"sequence": 1, "ole_target": "embeddings/oleObject2.bin", "paragraph_index": 4, "run_index": 1, "text_before": "b", "text_after": "c"}]}))
    __main__.main(["risk", str(tmp_path / "s.csv"), str(tmp_path / "risk"), "--objects", str(tmp_path / "m.json")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "risk" / "report")).collect()]
    assert lines == [
        "auto_replace=1", "spot_check=1", "manual_review=1", "", "[manual_reason_counts]", "trailing_operator_or_relation=1", "", "[manual_review]", "- oleObject2.bin", "  category=manual_review",
        "  reasons=trailing_operator_or_relation", "  paragraph_index=4", "  latex_preview=a=", "  text_before=b", "  text_after=c", "", "[spot_check_top30]", "- oleObject1.bin", "  reasons=has_scripts", "  paragraph_index=", "  latex_preview=x^2",
    ]
