"""Command line: scan a folder of documents, or write the plan of a scan.

    python -m mathquarry scan FOLDER OUT [--glob '*.docx']
    python -m mathquarry run-plan FOLDER OUT [--allow-external-tools]
    python -m mathquarry validate CHECKS.json OUT
    python -m mathquarry risk SUMMARY.csv OUT --objects MAP.json
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from mathquarry.operators import canonical, detect, risk
from mathquarry.plans import execution, reports, routing, status
from mathquarry.sources import containers, tables


CHECKS = (
    "doc_id string, provider string, source_family string, reference_pdf string, target_exists boolean, export_requested boolean, export_status string, "
    "visual_requested boolean, has_reference boolean, visual_status string, visual_reasons array<string>"
)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mathquarry", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "run-plan"):
        command = commands.add_parser(name)
        command.add_argument("folder")
        command.add_argument("out")
        command.add_argument("--glob")
        command.add_argument("--allow-external-tools", action="store_true")
    for name, what in (("validate", "JSON lines: what was asked of each document, and what export and comparison reported"), ("risk", "a conversion summary in CSV")):
        command = commands.add_parser(name)
        command.add_argument("input", help=what)
        command.add_argument("out")
    commands.choices["risk"].add_argument("--objects", required=True, help="object maps in JSON")
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "validate":
        found = reports.validation_text(status.validation(spark.read.schema(CHECKS).json(asked.input)))
        tables.write_json(found, asked.out)
        return
    if asked.command == "risk":
        records = tables.kept(risk.records(tables.read_summary(spark, asked.input), tables.read_object_map(spark, asked.objects)), "risk")
        tables.write_json(records, f"{asked.out}/records", "category")
        reports.risk_lines(records).orderBy("position").select("line").write.text(f"{asked.out}/report")
        return

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{asked.out}/{name}")
        return spark.read.parquet(f"{asked.out}/{name}")

    entries = keep(containers.entries_of(containers.read_containers(spark, asked.folder, asked.glob)), "entries")
    formulas = keep(detect.detect_all(entries, keep), "formulas")
    plan = routing.route_plan(routing.source_counts(formulas))
    tables.write_json(routing.manifest(formulas, containers.scan(entries)), f"{asked.out}/manifest")
    tables.write_json(routing.routing_report(plan), f"{asked.out}/routing")
    tables.write_json(detect.failures(entries), f"{asked.out}/failures")
    if asked.command == "run-plan":
        actions = execution.action_reports(routing.execution_plan(plan), canonical.document_facts(entries, formulas), asked.allow_external_tools)
        tables.write_json(actions, f"{asked.out}/actions")
        tables.write_json(execution.step_reports(actions), f"{asked.out}/steps")
        tables.write_json(execution.blockers(actions), f"{asked.out}/blockers")


if __name__ == "__main__":
    main()
