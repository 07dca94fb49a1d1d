"""Literal dimensions: routes, canonical contracts and actions of every equation family.

They have at most a few rows for each family, so joins with them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values ---------------------------------------------------------------------------------------
FAMILIES = ("mathtype-ole", "omml-native", "equation-editor-3-ole", "axmath-ole", "odf-native", "libreoffice-transformed", "graphic-fallback", "unknown-ole")
GROUPS = {
    "primary": ("mathtype-ole", "omml-native", "equation-editor-3-ole", "odf-native"),
    "bridge": ("axmath-ole", "libreoffice-transformed"),
    "fallback": ("graphic-fallback", "unknown-ole"),
}
ROLES = ("native-source", "transformed-source", "generated-output", "preview-only")

ROUTE_COLUMNS = "source_family string, route_kind string, priority int, next_action string, confidence_policy string, requires_manual_review boolean"
ROUTES = [
    ("mathtype-ole", "primary-source-first", 10, "run-mathtype-source-first-pipeline", "high", False),
    ("omml-native", "primary-source-first", 20, "run-omml-native-pipeline", "high", False),
    ("equation-editor-3-ole", "primary-candidate", 30, "run-equation3-probe-and-conversion", "medium", True),
    ("odf-native", "primary-source-first", 40, "run-odf-native-pipeline", "medium", False),
    ("axmath-ole", "export-assisted", 50, "run-axmath-export-assisted-pipeline", "medium", True),
    ("libreoffice-transformed", "bridge-source", 60, "run-libreoffice-bridge-review-pipeline", "low", True),
    ("graphic-fallback", "fallback", 70, "manual-review-or-ocr-fallback", "low", True),
    ("unknown-ole", "manual-classification", 80, "manual-classification-required", "low", True),
]

_CANONICAL_FILES = ["canonical-mathml/*.xml", "canonicalization-summary.json", "validation-evidence.json"]
_BLOCKER_FILE = ["blocker-record.json"]
#: what a family's conversion leaves behind
ARTIFACTS = {
    "mathtype-ole": ["converted/*.mml", "converted/*.mathml", *_CANONICAL_FILES],
    "omml-native": _CANONICAL_FILES,
    "equation-editor-3-ole": _CANONICAL_FILES,
    "axmath-ole": _BLOCKER_FILE,
    "odf-native": _CANONICAL_FILES,
    "libreoffice-transformed": _BLOCKER_FILE,
}
CONTRACT_COLUMNS = "source_family string, source_line string, contract_status string, conversion_claim boolean, binding string"
CONTRACTS = [
    ("mathtype-ole", "mathtype", "external-tool-gated", False, "equation-native-mtef-to-normalized-mathml"),
    ("omml-native", "omml", "implemented-basic", True, "internal-omml-to-canonical-mathml"),
    ("equation-editor-3-ole", "equation-editor-3", "implemented-limited", True, "internal-equation3-mtef-v2v3-to-canonical-mathml-limited"),
    ("axmath-ole", "axmath", "export-gated", False, "approved-axmath-export-to-canonical-mathml"),
    ("odf-native", "libreoffice-odf", "implemented", True, "preserve-existing-odf-mathml"),
    ("libreoffice-transformed", "libreoffice-odf", "bridge-review-gated", False, "bridge-provenance-review-before-canonical-mathml"),
]
NO_CONTRACT = ("unknown", "manual-triage", False, "unregistered-source-to-canonical-mathml")

PROVIDERS = {"mathtype-ole": "mathtype", "omml-native": "omml", "equation-editor-3-ole": "equation3", "axmath-ole": "axmath", "odf-native": "odf", "libreoffice-transformed": "odf"}
#: action, whether it blocks (None: as the step's manual review says), what a run without external tools makes of it
ACTIONS = {
    "mathtype-ole": [("extract-equation-native", True), ("mtef-to-mathml", True), ("normalize-mathml", True), ("mathml-to-omml", True), ("replace-ole-with-omml", True), ("validate-word-output", False)],
    "omml-native": [("extract-omml", False), ("normalize-omml", False), ("omml-to-canonical-mathml", False), ("render-check", None), ("package-omml-output", False)],
    "equation-editor-3-ole": [("probe-header-and-classid", False), ("attempt-mtef-conversion", True), ("fallback-manual-triage", True), ("word-roundtrip-validation", True)],
    "axmath-ole": [("classify-axmath-object", True), ("export-assisted-conversion", True), ("import-converted-math", True), ("manual-spot-check", None)],
    "odf-native": [("extract-odf-formula", True), ("convert-odf-mathml", True), ("emit-target-format", False)],
    "libreoffice-transformed": [("inspect-transform-chain", True), ("bridge-review", True), ("decide-reconvert-or-accept", True)],
}
DEFAULT_ACTION = ("manual-triage", True)
# ----------------------------------------------------------------------------------------------------


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, ROUTE_COLUMNS)


def artifacts(spark: SparkSession) -> DataFrame:
    """(source_family, expected_artifacts); families that are not here leave a blocker record."""
    return spark.createDataFrame(list(ARTIFACTS.items()), "source_family string, expected_artifacts array<string>")


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTS, CONTRACT_COLUMNS)


def actions(spark: SparkSession) -> DataFrame:
    """(source_family, provider, action_order, action_id, blocking; null where manual review decides)."""
    rows = [(family, PROVIDERS[family], k, action, blocks) for family, found in ACTIONS.items() for k, (action, blocks) in enumerate(found, 1)]
    return spark.createDataFrame(rows, "source_family string, provider string, action_order int, action_id string, blocking boolean")
