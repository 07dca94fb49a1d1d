"""Readers, writers, options, statuses of a plan, the object map, the stream of arriving files, and the command line."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from mathquarry import catalog, samples, standins
from mathquarry.__main__ import main
from mathquarry.operators import batches, detect, object_map
from mathquarry.operators.canonical import document_facts
from mathquarry.plans import execution, options, routing
from mathquarry.sources import containers, tables
from mathquarry.streaming import watch


def test_summary_csv(spark, tmp_path):
    path = tmp_path / "summary.csv"
    path.write_bytes(b"\xef\xbb\xbfname,status,omml_exists\r\noleObject1.bin,ok,True\r\n\"a,\"\"b\",error,\r\n")
    rows = tables.read_summary(spark, str(path)).collect()
    assert [(r.name, r.status, r.omml_exists) for r in rows] == [("oleObject1.bin", "ok", "True"), ('a,"b', "error", None)]


def test_plan_and_map_json(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps({"document_id": "d", "steps": [{"source_family": "omml-native", "formula_count": 2, "actions": [{"action_id": "x", "blocking": True}, {"action_id": "y"}]}, {"source_family": "z", "actions": []}]}, indent=1))
    rows = tables.read_plan(spark, str(tmp_path / "plan.json")).orderBy("step_order", "action_id").collect()
    assert [(r.source_family, r.action_id, r.blocking) for r in rows] == [("omml-native", "x", True), ("omml-native", "y", None), ("z", None, None)]
    (tmp_path / "map.json").write_text(json.dumps({"items": [{"sequence": 1, "ole_target": "a"}, {"sequence": 2, "ole_target": ""}]}))
    assert tables.read_object_map(spark, str(tmp_path / "map.json")).count() == 2


def test_lenient_options(spark):
    cases = [("1", True, 1), (" TRUE ", True, 7), ("no", False, 7), ("0", False, 0), ("maybe", None, 7), ("", None, 7), (None, None, 7), (" -3 ", None, -3), ("1.5", None, 7), ("y", None, 7)]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, v string")
    got = rows.select("k", options.boolean(F.col("v"), False).alias("no"), options.boolean(F.col("v"), True).alias("yes"), options.integer(F.col("v"), 7).alias("n"), options.boolean(F.col("v"), False, letters=True).alias("l")).orderBy("k").collect()
    for r, (_, b, n) in zip(got, cases):
        assert (r.no, r.yes, r.n) == ((False, True, n) if b is None else (b, b, n))
    assert got[9].l
    maps = spark.createDataFrame([({"preserve_mathtype_layout": "yes", "mathtype_start_index": "-4"},), ({"mathtype_layout_factor": "x"},), ({},)], "m map<string,string>")
    found = [r.o for r in maps.select(options.mathtype_options(F.col("m")).alias("o")).collect()]
    assert (found[0].preserve_mathtype_layout, found[0].mathtype_layout_factor, found[0].mathtype_start_index, found[0].mathtype_end_index) == (True, 1.01375, 0, None)
    assert found[1].mathtype_layout_factor == 1.01375 and found[2].mathtype_layout_factor is None
    review = spark.createDataFrame([({"manual_review": "true", "requires_manual_review": "false"}, None), ({"requires_manual_review": "n"}, ["manual-review"]), ({}, [" Manual_Review "]), ({}, None)], "m map<string,string>, s array<string>")
    got = review.select(options.equation3_review(F.col("m")).alias("e"), options.odf_review(F.col("m"), F.col("s"), False).alias("o")).collect()
    assert [(r.e, r.o) for r in got] == [(True, False), (False, False), (True, True), (True, False)]


def test_validation_target(spark):
    rows = [("x", None), ("", '{"target_docx": "b"}'), (None, '{"validation_target_docx": "a", "target_docx": "b"}'), (None, '{"artifacts": {"validation_target": {"validation_target_docx": "c"}}}'), (None, "{}")]
    got = spark.createDataFrame(rows, "d string, m string").select(tables.validation_target(F.col("d"), F.col("m")).alias("t")).collect()
    assert [r.t for r in got] == ["x", "b", "a", "c", None]


def test_action_statuses(spark, sample_entries):
    entries = sample_entries
    formulas = detect.detect_all(entries).cache()
    plan = routing.execution_plan(routing.route_plan(routing.source_counts(formulas)))
    facts = document_facts(entries, formulas)
    steps = {(r.doc_id, r.source_family): r.status for r in execution.step_reports(execution.action_reports(plan, facts)).collect()}
    assert steps["mathtype.docx", "mathtype-ole"] == "blocked" and steps["equation3.docx", "equation-editor-3-ole"] == "completed-with-skips"
    assert steps["axmath.docx", "axmath-ole"] == "blocked" and steps["native.odt", "odf-native"] == "validation-gated" and steps["bridge.odt", "libreoffice-transformed"] == "review-gated"
    assert steps["omml.docx", "omml-native"] == "completed-with-skips"
    allowed = {(r.doc_id, r.action_id): r.status for r in execution.action_reports(plan, facts, external_allowed=True).collect()}
    assert allowed["axmath.docx", "export-assisted-conversion"] == "validation-gated"
    dry = {r.source_family: r.dry_run_status for r in execution.step_reports(execution.dry_run(plan)).collect()}
    assert set(dry.values()) == {"runnable"}
    unknown = routing.execution_plan(spark.createDataFrame([("d", "unknown-ole", 1, True)], "doc_id string, source_family string, formula_count long, requires_manual_review boolean"))
    assert [(r.provider, r.action_id, r.blocking, r.status) for r in execution.action_reports(unknown, facts).collect()] == [("default", "manual-triage", True, "manual-gate")]


def test_object_map(spark, sample_entries):
    entries = sample_entries
    rows = {r.doc_id: r for r in object_map.object_map(entries, detect.relationships(entries)).collect()}
    m = rows["mathtype.docx"]
    assert (m.sequence, m.run_text, m.paragraph_text, m.text_before, m.text_after, m.ole_target) == (1, "[OLE]", "Before [OLE]After", "Before ", "After", "embeddings/oleObject1.bin")
    assert (rows["omml.docx"].sequence, rows["omml.docx"].omml_run_child_count, rows["omml.docx"].omml_paragraph_child_count) == (None, 1, 1)
    inside = object_map.streams(entries).first()
    assert (inside.name, inside.size_bytes, inside.ascii_preview[:11]) == ("Equation Native", 4096, "MathType EF")


def test_arriving_files_are_taken_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    files = samples.containers()
    (tmp_path / "in" / "omml.docx").write_bytes(files["omml.docx"])
    watch.catch_up(spark, folder, out, checkpoint)
    (tmp_path / "in" / "native.odt").write_bytes(files["native.odt"])
    watch.catch_up(spark, folder, out, checkpoint)
    assert {r[0]: r[1] for r in spark.read.parquet(out).groupBy("source_family").count().collect()} == {"odf-native": 2, "omml-native": 3}


def test_command_line(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in samples.containers().items():
        (folder / name).write_bytes(data)
    main(["run-plan", str(folder), str(tmp_path / "out")])
    assert spark.read.parquet(f"{tmp_path}/out/formulas").count() == 12
    assert spark.read.json(f"{tmp_path}/out/manifest").count() == 9
    assert spark.read.json(f"{tmp_path}/out/blockers").where("source_family = 'mathtype-ole'").count() == 6
    assert containers.KINDS[".docx"] == ("docx", "ooxml-zip")


def test_batches(spark):
    rows = spark.createDataFrame([("d", n) for n in ("oleObject10.bin", "oleObject2.bin", "x.bin", "oleObject1.bin", "oleObject1__copy.bin")], "doc_id string, name string")
    done = spark.createDataFrame([("oleObject2.bin",)], "name string")
    assert [r.name for r in batches.to_convert(rows, done).collect()] == ["oleObject1.bin", "oleObject10.bin", "x.bin"]
    assert [r.name for r in batches.to_convert(rows, None, start=2, end=3).collect()] == ["oleObject2.bin", "oleObject10.bin"]
    assert [r.name for r in batches.to_convert(rows, None, limit=1).collect()] == ["oleObject1.bin"]


def test_entries_beyond_the_bound_are_errors(spark):
    files = spark.createDataFrame([("a.docx", bytearray(samples.packed({"word/document.xml": "x" * 5000, "small.xml": "y"})))], "doc_id string, content binary")
    cut = {r.entry: r for r in containers.entries_of(containers.described(files), largest=1000).collect()}
    assert (cut["word/document.xml"].data, cut["word/document.xml"].error) == (None, "entry too large") and bytes(cut["small.xml"].data) == b"y"
    assert all(r.error is None for r in containers.entries_of(containers.described(files), largest=None).collect())


def test_containers_of_one_small_file_are_dealt_to_all_tasks(spark):
    files = standins.container_files(spark.range(0, 900, 1, 1), "id")
    found = [r["count"] for r in files.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(found) == 900 and len(found) >= 2 * spark.sparkContext.defaultParallelism and max(found) <= 900 / len(found) + 1


def test_entries_of_small_files_go_on_together(spark, monkeypatch):
    """By rows or bytes, whatever they are; nothing is lost or out of its order, and a large file goes on alone."""
    made = []
    monkeypatch.setattr(containers, "TOGETHER_ROWS", 4)
    monkeypatch.setattr(containers, "TOGETHER_BYTES", 300)

    class Files:  # stands in for a table, so that the batches can be counted
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            made.append(run)

    containers.entries_of(Files())
    docs = [("a.docx", samples.packed({"x": "1", "y": "2"})), ("b.docx", samples.packed({"z": "3"})), ("c.docx", b"no zip"), ("d.docx", samples.packed({"w": "4" * 1000})), ("e.docx", None), ("f.docx", samples.packed({}))]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([".docx"] * len(docs)), pa.array([b for _, b in docs], pa.binary())], ["doc_id", "suffix", "content"])
    out = list(made[0](iter([batch.slice(0, 2), batch.slice(2)])))
    assert [b.column(2).to_pylist() for b in out] == [["x", "y", "z", None], ["w"], [None]]
    assert [b.column(0).to_pylist() for b in out] == [["a.docx", "a.docx", "b.docx", "c.docx"], ["d.docx"], ["e.docx"]]
    assert list(made[0](iter([]))) == []
