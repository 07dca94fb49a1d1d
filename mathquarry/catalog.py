"""Queries over the equation engine's own operators.

The supplied tables hold no equations, so most queries here run an operator over a stand-in of the
same shape (events for formulas, conversations for runs of a paragraph, line items for shapes), or over
formulas, streams and containers made from the tables' rows. Each has SQL to be held against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathquarry import samples, standins
from mathquarry.functions import mtef, omml, repair
from mathquarry.operators import batches, canonical, detect, object_map, package, pages, rewrite, risk
from mathquarry.plans import execution, options, routing, status
from mathquarry.sources import containers, tables

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], *names: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else _text(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


# Events stand in for formulas: each type is a family, the user is the document.
_FAMILY_OF = {"view": "mathtype-ole", "click": "omml-native", "purchase": "equation-editor-3-ole", "signup": "axmath-ole", "error": "unknown-ole"}
_FAMILY_SQL = f"(SELECT e.*, v.source_family FROM events e JOIN {_values(list(_FAMILY_OF.items()), 'event_type', 'source_family')} ON e.event_type = v.event_type)"
_ROUTES_SQL = """(SELECT * FROM (VALUES
    ('mathtype-ole', 'primary-source-first', 10, 'run-mathtype-source-first-pipeline', 'high', FALSE), ('omml-native', 'primary-source-first', 20, 'run-omml-native-pipeline', 'high', FALSE),
    ('equation-editor-3-ole', 'primary-candidate', 30, 'run-equation3-probe-and-conversion', 'medium', TRUE), ('odf-native', 'primary-source-first', 40, 'run-odf-native-pipeline', 'medium', FALSE),
    ('axmath-ole', 'export-assisted', 50, 'run-axmath-export-assisted-pipeline', 'medium', TRUE), ('libreoffice-transformed', 'bridge-source', 60, 'run-libreoffice-bridge-review-pipeline', 'low', TRUE),
    ('graphic-fallback', 'fallback', 70, 'manual-review-or-ocr-fallback', 'low', TRUE), ('unknown-ole', 'manual-classification', 80, 'manual-classification-required', 'low', TRUE)
    ) v(source_family, route_kind, priority, next_action, confidence_policy, requires_manual_review))"""
_CONTRACTS_SQL = """(SELECT * FROM (VALUES
    ('mathtype-ole', 'mathtype', 'external-tool-gated', FALSE, 'equation-native-mtef-to-normalized-mathml'), ('omml-native', 'omml', 'implemented-basic', TRUE, 'internal-omml-to-canonical-mathml'),
    ('equation-editor-3-ole', 'equation-editor-3', 'implemented-limited', TRUE, 'internal-equation3-mtef-v2v3-to-canonical-mathml-limited'),
    ('axmath-ole', 'axmath', 'export-gated', FALSE, 'approved-axmath-export-to-canonical-mathml'), ('odf-native', 'libreoffice-odf', 'implemented', TRUE, 'preserve-existing-odf-mathml'),
    ('libreoffice-transformed', 'libreoffice-odf', 'bridge-review-gated', FALSE, 'bridge-provenance-review-before-canonical-mathml')
    ) v(source_family, source_line, contract_status, conversion_claim, binding))"""
_ACTIONS_SQL = """(SELECT * FROM (VALUES
    ('mathtype-ole', 'mathtype', 1, 'extract-equation-native', TRUE), ('mathtype-ole', 'mathtype', 2, 'mtef-to-mathml', TRUE), ('mathtype-ole', 'mathtype', 3, 'normalize-mathml', TRUE),
    ('mathtype-ole', 'mathtype', 4, 'mathml-to-omml', TRUE), ('mathtype-ole', 'mathtype', 5, 'replace-ole-with-omml', TRUE), ('mathtype-ole', 'mathtype', 6, 'validate-word-output', FALSE),
    ('omml-native', 'omml', 1, 'extract-omml', FALSE), ('omml-native', 'omml', 2, 'normalize-omml', FALSE), ('omml-native', 'omml', 3, 'omml-to-canonical-mathml', FALSE),
    ('omml-native', 'omml', 4, 'render-check', NULL), ('omml-native', 'omml', 5, 'package-omml-output', FALSE),
    ('equation-editor-3-ole', 'equation3', 1, 'probe-header-and-classid', FALSE), ('equation-editor-3-ole', 'equation3', 2, 'attempt-mtef-conversion', TRUE),
    ('equation-editor-3-ole', 'equation3', 3, 'fallback-manual-triage', TRUE), ('equation-editor-3-ole', 'equation3', 4, 'word-roundtrip-validation', TRUE),
    ('axmath-ole', 'axmath', 1, 'classify-axmath-object', TRUE), ('axmath-ole', 'axmath', 2, 'export-assisted-conversion', TRUE), ('axmath-ole', 'axmath', 3, 'import-converted-math', TRUE), ('axmath-ole', 'axmath', 4, 'manual-spot-check', NULL),
    ('odf-native', 'odf', 1, 'extract-odf-formula', TRUE), ('odf-native', 'odf', 2, 'convert-odf-mathml', TRUE), ('odf-native', 'odf', 3, 'emit-target-format', FALSE),
    ('libreoffice-transformed', 'odf', 1, 'inspect-transform-chain', TRUE), ('libreoffice-transformed', 'odf', 2, 'bridge-review', TRUE), ('libreoffice-transformed', 'odf', 3, 'decide-reconvert-or-accept', TRUE)
    ) v(source_family, provider, action_order, action_id, blocking))"""


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.element_at(F.create_map(*[F.lit(x) for pair in _FAMILY_OF.items() for x in pair]), F.col("event_type"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), family.alias("source_family"), "event_id", "value")


@query("SELECT 'document' || doc_id || '.TXT' AS doc_id, '.txt' AS suffix, strlen(text) AS length, sha256(text) AS sha256 FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's suffix, size and hash."""
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("document"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("doc_id"), F.encode("text", "UTF-8").alias("content"))
    return containers.described(files).drop("content")


@query(
    """SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs, (length(html) - length(replace(html, '<a href', ''))) // 7 AS links,
    (length(html) - length(replace(html, '.*', ''))) // 2 AS odd FROM pages WHERE contains(html, '<p>') OR contains(html, '<a href') OR contains(html, '.*')"""
)
def part_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal byte patterns counted in parts; parts without any are left out."""
    data = F.encode("html", "UTF-8")
    counts = {"paragraphs": "<p>", "links": "<a href", "odd": ".*"}
    rows = _table(spark, sf_dir, "pages").select("page_id", *(containers.occurrences(data, t).cast("long").alias(n) for n, t in counts.items()))
    return rows.where("paragraphs + links + odd > 0")


@query(f"SELECT user_id AS doc_id, source_family, count(*) AS formula_count FROM {_FAMILY_SQL} GROUP BY ALL")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: formulas per document and family."""
    return routing.source_counts(_formulas(spark, sf_dir))


@query(
    f"""SELECT c.source_family, formula_count, route_kind, priority, next_action, confidence_policy, requires_manual_review
    FROM (SELECT source_family, count(*) AS formula_count FROM {_FAMILY_SQL} GROUP BY ALL) c JOIN {_ROUTES_SQL} r ON c.source_family = r.source_family"""
)
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family's count with its route; a family without one stops the job."""
    counts = _formulas(spark, sf_dir).groupBy("source_family").agg(F.count("*").alias("formula_count"))
    return routing.route_plan(counts).select("source_family", "formula_count", "route_kind", "priority", "next_action", "confidence_policy", "requires_manual_review")


@query(
    f"""SELECT doc_id, sum(n)::BIGINT AS formula_count, string_agg(source_family, '>' ORDER BY priority, source_family) AS recommended_sequence, bool_or(requires_manual_review) AS manual_review_required,
    coalesce(string_agg(source_family, '>' ORDER BY priority, source_family) FILTER (requires_manual_review), '') AS manual_review_reasons
    FROM (SELECT user_id AS doc_id, f.source_family, count(*) AS n, any_value(priority) AS priority, any_value(requires_manual_review) AS requires_manual_review
      FROM {_FAMILY_SQL} f JOIN {_ROUTES_SQL} r ON f.source_family = r.source_family GROUP BY ALL) GROUP BY doc_id"""
)
def routing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per document."""
    report = routing.routing_report(routing.route_plan(routing.source_counts(_formulas(spark, sf_dir))))
    joined = [F.array_join(c, ">").alias(c) for c in ("recommended_sequence", "manual_review_reasons")]
    return report.select("doc_id", "formula_count", "manual_review_required", *joined)


@query(
    f"""SELECT e.event_type AS source_family, coalesce(source_line, 'unknown') AS source_line, coalesce(contract_status, 'manual-triage') AS contract_status, coalesce(conversion_claim, FALSE) AS conversion_claim,
    coalesce(binding, 'unregistered-source-to-canonical-mathml') AS binding, 'canonical-mathml' AS target_format
    FROM (SELECT DISTINCT source_family AS event_type FROM {_FAMILY_SQL} UNION SELECT DISTINCT event_type FROM events) e LEFT JOIN {_CONTRACTS_SQL} c ON e.event_type = c.source_family"""
)
def canonical_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their contract, unregistered ones with the default."""
    families = _formulas(spark, sf_dir).select("source_family").union(_table(spark, sf_dir, "events").select("event_type")).distinct()
    return routing.default_contract(families)


@query(
    f"""SELECT doc_id, p.source_family, formula_count, coalesce(provider, 'default') AS provider, coalesce(action_order, 1) AS action_order, coalesce(action_id, 'manual-triage') AS action_id,
    CASE WHEN provider IS NULL THEN TRUE ELSE coalesce(blocking, requires_manual_review) END AS blocking
    FROM (SELECT user_id AS doc_id, source_family, count(*) AS formula_count FROM {_FAMILY_SQL} GROUP BY ALL) p JOIN {_ROUTES_SQL} r ON p.source_family = r.source_family
    LEFT JOIN {_ACTIONS_SQL} a ON p.source_family = a.source_family"""
)
def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes exploded onto actions, manual triage for families without a provider."""
    plan = routing.execution_plan(routing.route_plan(routing.source_counts(_formulas(spark, sf_dir))))
    return plan.select("doc_id", "source_family", "formula_count", "provider", "action_order", "action_id", "blocking")


@query(
    """SELECT conv_id, turn, role, right(coalesce(string_agg(text, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 60) AS text_before,
    left(coalesce(string_agg(text, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), 60) AS text_after,
    count(*) OVER (PARTITION BY conv_id) > 1 AS inline_context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 characters before and the first 60 after, over all other runs of a paragraph."""
    found = object_map.neighbours(_table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])
    return found.select("conv_id", "turn", "role", "text_before", "text_after", "inline_context")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS object_sequence,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS sibling_ordinal FROM lineitem"""
)
def object_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running numbers of a document and of siblings with the same name."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = detect.numbered(_table(spark, sf_dir, "lineitem"), "object_sequence", ["l_orderkey"], *order)
    rows = detect.numbered(rows, "sibling_ordinal", ["l_orderkey", "l_returnflag"], *order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "object_sequence", "sibling_ordinal")


@query("SELECT doc_id, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that have no output yet."""
    named = lambda t: _table(spark, sf_dir, t).withColumn("name", F.concat(F.lit("oleObject"), F.col("doc_id").cast("string"), F.lit(".bin")))
    return batches.to_convert(named("documents"), named("labels")).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, source, n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) q USING (doc_id)")
def replace_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are in a set."""
    chosen = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _table(spark, sf_dir, "documents").join(chosen, "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query(
    """SELECT source, lang, expected, accepted, unsupported, CASE WHEN expected = accepted AND unsupported = 0 THEN 'passed' WHEN family = 'equation-editor-3-ole' THEN 'failed'
      WHEN family = 'mathtype-ole' AND expected = accepted THEN 'unsupported-fragments' ELSE 'mismatch' END AS parity,
    CASE WHEN accepted = 0 OR expected <> accepted OR unsupported > 0 THEN 'blocked-canonical-artifact' WHEN family = 'equation-editor-3-ole' THEN 'passed-limited' ELSE 'passed' END AS gate
    FROM (SELECT source, lang, ['mathtype-ole', 'equation-editor-3-ole', 'omml-native'][(length(source) + length(lang) + ascii(lang)) % 3 + 1] AS family, count(*) AS expected, count(*) FILTER (doc_id % 7 < 6 OR length(source) % 2 = 0) AS accepted,
      count(*) FILTER (quality = 0 AND toxic = 1) AS unsupported FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang)"""
)
def parity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many out as in, and whether anything came out, by the rule of each family."""
    joined = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    accepted = (F.col("doc_id") % 7 < 6) | (F.length("source") % 2 == 0)
    counts = joined.groupBy("source", "lang").agg(F.count("*").alias("expected"), F.count_if(accepted).alias("accepted"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("unsupported"))
    kind = F.element_at(F.array(*map(F.lit, ("mathtype-ole", "equation-editor-3-ole", "omml-native"))), (F.length("source") + F.length("lang") + F.ascii("lang")) % 3 + 1)
    parity = status.parity(F.col("expected"), F.col("accepted"), F.col("unsupported"), kind)
    found = counts.withColumn("parity", parity)
    return found.withColumn("gate", status.canonical_gate(F.col("accepted"), F.col("parity"), kind)).select("source", "lang", "expected", "accepted", "unsupported", "parity", "gate")


_STEPS_SQL = """(SELECT user_id, hour, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'blocked-external-tool') THEN 'blocked' WHEN bool_and(s = 'manual-gate') OR bool_or(value < 0.05) THEN 'manual-only'
    WHEN bool_or(s = 'validation-gated') THEN 'validation-gated' WHEN bool_or(s = 'review-gated') THEN 'review-gated' WHEN bool_or(starts_with(s, 'skipped')) THEN 'completed-with-skips' ELSE 'completed' END AS status,
    CASE WHEN bool_and(value >= 0.05) THEN 'runnable' ELSE 'manual-only' END AS dry_run FROM (SELECT user_id, date_trunc('day', ts) AS hour, value, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' WHEN event_type = 'error' THEN 'blocked-external-tool' WHEN event_type = 'signup' THEN 'manual-gate'
      WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'validation-gated' WHEN event_type = 'purchase' THEN 'review-gated' WHEN event_type = 'click' THEN 'skipped-existing' ELSE 'completed' END AS s FROM events) GROUP BY ALL)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id")
    said = (
        F.when((kind == "error") & (k % 3 == 0), "failed").when(kind == "error", "blocked-external-tool").when(kind == "signup", "manual-gate")
        .when((kind == "purchase") & (k % 2 == 0), "validation-gated").when(kind == "purchase", "review-gated").when(kind == "click", "skipped-existing").otherwise("completed")
    )
    rows = _table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), said.alias("s"), (F.col("value") >= 0.05).alias("supported"))
    return rows.groupBy("user_id", "day").agg(status.step_status(F.col("s"), F.col("supported")).alias("status"), status.dry_run_status(F.col("supported")).alias("dry_run"))


@query(f"SELECT user_id, status, dry_run, count(*) AS steps FROM {_STEPS_SQL} GROUP BY ALL")
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions reduced to a step's status by fixed precedence, and its dry run."""
    return _steps(spark, sf_dir).groupBy("user_id", "status", "dry_run").agg(F.count("*").alias("steps"))


@query(
    f"""SELECT user_id, count(*) AS step_count, count(*) FILTER (status LIKE 'completed%') AS completed_step_count, count(*) FILTER (status = 'manual-only') AS manual_only_step_count,
    count(*) FILTER (status NOT LIKE 'completed%' AND status <> 'manual-only') AS blocked_step_count FROM {_STEPS_SQL} GROUP BY user_id"""
)
def plan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's counters of step statuses."""
    return status.plan_counters(_steps(spark, sf_dir), "user_id")


_TRIM = lambda c: rf"regexp_replace(coalesce({c}, ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
_RISK_ROWS_SQL = f"""(SELECT d.doc_id, {_TRIM('text')} AS p, CASE WHEN quality = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN toxic = 1 THEN 'False' ELSE 'True' END AS omml_exists, '' AS after FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT id - 100 * blank, {_TRIM('latex')}, 'ok', 'True', CASE WHEN blank = 1 THEN '____.' ELSE '' END FROM {_values(list(enumerate(samples.LATEX, -len(samples.LATEX))), 'id', 'latex')}, range(2) AS b(blank))"""
_MANUAL_SQL = r"""CASE WHEN status <> 'ok' THEN 'status_not_ok' END, CASE WHEN omml_exists <> 'True' THEN 'missing_omml' END, CASE WHEN p = '' THEN 'empty_latex_preview' END,
    CASE WHEN contains(p, '\frac{}{') THEN 'empty_numerator' END, CASE WHEN regexp_matches(p, '\\frac\{[^}]*\}\{\}') THEN 'empty_denominator' END,
    CASE WHEN contains(p, '^{}') OR contains(replace(p, ' ', ''), '{}^{}') THEN 'empty_superscript' END, CASE WHEN contains(p, '_{}') OR contains(replace(p, ' ', ''), '_{}') THEN 'empty_subscript' END,
    CASE WHEN regexp_matches(p, '\\left\{[ \t\n\x0b\f\r]*\\right\.') THEN 'suspicious_empty_piecewise' END,
    CASE WHEN regexp_matches(p, '\\left\{[ \t\n\x0b\f\r]*\{[ \t\n\x0b\f\r]*\}[ \t\n\x0b\f\r]*\\right\.') OR contains(replace(p, ' ', ''), '\left\{{}\right.') THEN 'empty_piecewise_body' END,
    CASE WHEN regexp_matches(p, '[=+\-*/][ \t\n\x0b\f\r]*\)') THEN 'operator_missing_rhs' END, CASE WHEN regexp_matches(p, '\([ \t\n\x0b\f\r]*[+\-*/=]') THEN 'operator_missing_lhs' END,
    CASE WHEN tail THEN 'trailing_operator_or_relation' END, CASE WHEN contains(replace(p, ' ', ''), 'x+)') OR contains(replace(p, ' ', ''), 'x-)') THEN 'missing_operand_inside_parentheses' END"""
_SPOT_SQL = r"""CASE WHEN length(p) >= 28 THEN 'long_formula' END, CASE WHEN contains(p, '_') OR contains(p, '^') THEN 'has_scripts' END, CASE WHEN contains(p, '|') OR contains(p, '//') THEN 'has_set_or_geometry_relation' END,
    CASE WHEN regexp_matches(p, '\\(left|right|overrightarrow|bigtriangleup|cup|cap|subset|lbrack|rbrack|alpha|beta|Omega|log|sin|cos|tan|parallel|perp|sum|prod|int)') THEN 'has_complex_commands' END"""
_SORTED = lambda items: f"list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL)))"
_RISK_SQL = rf"""(SELECT doc_id, CASE WHEN len(m) > 0 AND NOT blank THEN 'manual_review' WHEN len(m) > 0 OR len(s) > 0 OR (starts_with(p, '{{') AND ends_with(p, '}}')) THEN 'spot_check' ELSE 'auto_replace' END AS category,
    CASE WHEN len(m) > 0 AND blank THEN ['formula_followed_by_blank'] WHEN len(m) > 0 THEN m WHEN len(s) > 0 THEN s WHEN starts_with(p, '{{') AND ends_with(p, '}}') THEN ['grouped_output_needs_review'] ELSE [] END AS reasons
    FROM (SELECT doc_id, p, {_SORTED(_MANUAL_SQL)} AS m, {_SORTED(_SPOT_SQL)} AS s, tail AND regexp_matches(after, '^_{{3,}}[.]*$') AS blank
      FROM (SELECT *, regexp_matches(p, '(=|\+|-|/|\\leq|\\geq|<|>|//)[ \t\n\x0b\f\r]*(\\\]|\\\)|$)') AS tail FROM {_RISK_ROWS_SQL})))"""


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    said = joined.select("doc_id", F.when(F.col("quality") == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("toxic") == 1, "False").otherwise("True").alias("omml_exists"), F.col("text").alias("latex_preview"), F.lit("").alias("text_after"))
    fixed = [(k - 100 * blank, "ok", "True", t, "____." if blank else "") for k, t in enumerate(samples.LATEX, -len(samples.LATEX)) for blank in (0, 1)]
    literal = spark.createDataFrame(fixed, "doc_id long, status string, omml_exists string, latex_preview string, text_after string")
    return risk.classified(said.union(literal).withColumn("tex_exists", F.lit("True")))


@query(f"SELECT doc_id, category, array_to_string(reasons, ',') AS reasons FROM {_RISK_SQL}")
def risk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts and literal LaTeX as previews, classified."""
    return _risks(spark, sf_dir).select("doc_id", "category", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM {_RISK_SQL} WHERE category = 'manual_review') GROUP BY reason ORDER BY n DESC, reason")
def reason_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of manual review, most frequent first."""
    return risk.reason_ranking(_risks(spark, sf_dir))


_LINE_SQL = """CASE WHEN greatest(360, l_linenumber * 100, round_even(l_quantity * 20, 0)::INT) > 360
    THEN greatest(360, round_even(greatest(360, l_linenumber * 100, round_even(l_quantity * 20, 0)::INT) * 1.01375::DOUBLE, 0)::INT) ELSE 360 END"""


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, {_LINE_SQL} AS adjusted_line FROM lineitem")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as heights, line numbers times 100 as previous lines."""
    line = rewrite.adjusted_line(F.col("l_quantity"), F.col("l_linenumber") * 100)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", line.alias("adjusted_line"))


@query(f"SELECT l_orderkey, count(*) AS adjusted_paragraph_count, min(a)::INT AS line_min, max(a)::INT AS line_max, sum(a)::DOUBLE / count(*) AS line_mean FROM (SELECT l_orderkey, {_LINE_SQL} AS a FROM lineitem) GROUP BY l_orderkey")
def layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a document's lines."""
    return rewrite.layout_summary(layout_lines(spark, sf_dir), "l_orderkey")


@query(
    """SELECT event_type, sum(k)::BIGINT AS mathml_attribute_count, array_to_string(list_sort(list(DISTINCT user_id::VARCHAR) FILTER (k > 90)), ',') AS root_display_values, count(*) FILTER (k % 2 = 0) AS has_accent
    FROM (SELECT event_type, user_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events) GROUP BY event_type"""
)
def property_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, sorted distinct values and counts of signals."""
    k = F.get_json_object("props", "$.k").cast("int")
    flags = [x.split()[0] for x in canonical.SIGNALS.split(", ") if x.endswith("boolean")]
    signals = F.struct(k.alias("mathml_attribute_count"), F.when(k > 90, F.col("user_id").cast("string")).otherwise("").alias("root_display"), *((k % 2 == 0 if x == "has_accent" else F.lit(False)).alias(x) for x in flags))
    rows = _table(spark, sf_dir, "events").select("event_type", F.lit("accepted").alias("status"), signals.alias("signals"))
    return canonical.property_summary(rows, "event_type").select("event_type", "mathml_attribute_count", F.array_join("root_display_values", ",").alias("root_display_values"), "has_accent")


_PAGES_SQL = """(SELECT user_id AS doc_id, coalesce(a.page, b.page) AS page, a.value AS original, b.value AS converted FROM
    (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events WHERE event_type = 'view') a
    FULL JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events WHERE event_type = 'click') b USING (user_id, page))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _table(spark, sf_dir, "events")
    sides = [rows.where(F.col("event_type") == kind).select(F.col("user_id").alias("doc_id"), page.alias("page"), "value") for kind in ("view", "click")]
    return status.matched_pages(*sides).select("doc_id", "page", F.col("original.value").alias("original"), F.col("converted.value").alias("converted"))


@query(f"SELECT doc_id, page, original, converted FROM {_PAGES_SQL}")
def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages matched by position, unmatched ones kept."""
    return _matched(spark, sf_dir)


@query(
    f"""SELECT doc_id, page_count_compared, unmatched_pages_total, max_changed_ratio, round(average, 6) AS average_changed_ratio, CASE WHEN unmatched_pages_total > 0 OR max_changed_ratio > 0.5 THEN 'review-gated' ELSE 'passed' END AS status,
    (unmatched_pages_total > 0)::INT + (max_changed_ratio > 0.5)::INT AS reason_count
    FROM (SELECT doc_id, count(*) FILTER (original IS NOT NULL AND converted IS NOT NULL) AS page_count_compared, count(*) FILTER (original IS NULL OR converted IS NULL) AS unmatched_pages_total,
      coalesce(max(abs(original - converted) / (abs(original) + abs(converted) + 1)), 0.0) AS max_changed_ratio, coalesce(avg(abs(original - converted) / (abs(original) + abs(converted) + 1)), 0.0) AS average FROM {_PAGES_SQL} GROUP BY doc_id)"""
)
def visual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page comparison's gate."""
    ratio = F.abs(F.col("original") - F.col("converted")) / (F.abs("original") + F.abs("converted") + 1)
    found = status.visual_gate(_matched(spark, sf_dir).withColumn("changed_ratio", ratio), max_ratio=0.5)
    return found.select("doc_id", "page_count_compared", "unmatched_pages_total", "max_changed_ratio", F.round("average_changed_ratio", 6).alias("average_changed_ratio"), "status", F.size("reasons").alias("reason_count"))


@query(
    """SELECT doc_id, CASE WHEN NOT target THEN 'blocked' WHEN export AND passed AND visual AND ref AND vs = 'failed' THEN 'blocked' WHEN export AND passed AND visual AND ref AND vs = 'review-gated' THEN 'review-gated'
    WHEN export AND NOT passed THEN 'blocked' WHEN export THEN 'deliverable-ready' ELSE 'research-only' END AS conclusion,
    CASE WHEN NOT target THEN 'Target DOCX does not exist.' ELSE concat_ws('; ', CASE WHEN NOT export THEN 'Word export not run; current result is research-only.' WHEN NOT passed THEN 'Word PDF export failed; output is not deliverable-ready.' END,
      CASE WHEN NOT visual THEN 'Visual PDF comparison not run.' WHEN NOT ref THEN 'Visual comparison requested without reference PDF.' WHEN export AND passed AND vs = 'failed' THEN 'Visual PDF comparison failed; inspect logs before claiming visual parity.' END,
      CASE WHEN export AND passed AND visual AND ref AND vs = 'review-gated' THEN 'Visual compare gate: too much has changed' END) END AS residual_risks FROM (SELECT doc_id, doc_id % 11 <> 0 AS target, doc_id % 3 <> 0 AS export, doc_id % 5 <> 0 AS passed, doc_id % 2 = 0 AS visual, doc_id % 7 <> 0 AS ref, ['passed', 'failed', 'review-gated'][doc_id % 3 + 1] AS vs FROM documents)"""
)
def validation_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine of a document's validation."""
    d = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("passed", "failed", "review-gated")))
    asked = {
        "target_exists": d % 11 != 0, "export_requested": d % 3 != 0, "export_status": F.when(d % 5 != 0, "passed").otherwise("failed"), "visual_requested": d % 2 == 0, "has_reference": d % 7 != 0,
        "visual_status": F.element_at(kinds, (d % 3 + 1).cast("int")), "visual_reasons": F.array(F.lit("too much has changed")),
    }
    return status.validation(_table(spark, sf_dir, "documents").select("doc_id").withColumns(asked)).select("doc_id", "conclusion", F.array_join("residual_risks", "; ").alias("residual_risks"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), 120) AS preview FROM documents""")
def one_line_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview in one line of at most 120 characters."""
    return _table(spark, sf_dir, "documents").select("doc_id", risk.one_line(F.col("text")).alias("preview"))


@query("SELECT page_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tags FROM (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS t FROM pages)")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value once, in order."""
    found = detect.ordered_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1))
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(found, ",").alias("tags"))


@query(
    """SELECT doc_id, name, position FROM (SELECT doc_id, 'oleObject' || doc_id || '.bin' AS name, doc_id AS position, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
    WHERE n BETWEEN 10 AND 5000 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY position LIMIT 50"""
)
def payload_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in natural order of their names, a range of them, without those done, the first 50 (the feature)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("oleObject"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("name"))
    done = _table(spark, sf_dir, "labels").select(F.concat(F.lit("oleObject"), F.col("doc_id").cast("string"), F.lit(".bin")).alias("name"))
    return batches.to_convert(docs, done, by="lang", start=10, end=5000, limit=50).select("doc_id", "name", "position")


@query(
    """SELECT source, count(*) AS total, count(quality) AS converted, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality = 1 AND toxic = 0) AS accepted
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion run's counts."""
    said = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "error")
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left").select("source", said.alias("status"), F.when(F.col("toxic") == 0, "True").otherwise("False").alias("omml_exists"))
    return batches.run_counts(rows, "source")


# ---- formulas and containers made from rows --------------------------------------------------------

_MATH = '<math:math xmlns:math="http://www.w3.org/1998/Math/MathML"'
_DECLARED = f"""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '{_MATH} display="block">'"""


@query(
    f"""SELECT p_partkey, '{_MATH}>' || replace(replace([
      '<math:mfrac data-omml-frac-type="skw" bevelled="true"><math:mi>X</math:mi><math:mn>N</math:mn></math:mfrac>',
      '<math:mfrac data-omml-frac-type="noBar" linethickness="0"><math:mi>X</math:mi><math:mn>N</math:mn></math:mfrac>',
      '<math:msubsup><math:mi>X</math:mi><math:mi>i</math:mi><math:mn>N</math:mn></math:msubsup>',
      '<math:mrow><math:munderover><math:mo data-omml-limLoc="undOvr" movablelimits="false">∫</math:mo><math:mn>0</math:mn><math:mn>N</math:mn></math:munderover><math:mi>X</math:mi></math:mrow>',
      '<math:mroot><math:mi>X</math:mi><math:mn>N</math:mn></math:mroot>',
      '<math:mfenced open="[" separators=";"><math:mi>X</math:mi></math:mfenced>',
      '<math:mover accent="true"><math:mi>X</math:mi><math:mo>^</math:mo></math:mover>',
      '<math:munder accentunder="true"><math:mi>X</math:mi><math:mo>¯</math:mo></math:munder>',
      '<math:mtable><math:mtr><math:mtd><math:mi>X</math:mi></math:mtd><math:mtd><math:mn>N</math:mn></math:mtd></math:mtr><math:mtr><math:mtd><math:mn>N</math:mn></math:mtd><math:mtd><math:mi>X</math:mi></math:mtd></math:mtr></math:mtable>',
      '<math:mrow><math:mi>sin</math:mi><math:mo>' || chr(8289) || '</math:mo><math:mi>X</math:mi></math:mrow>',
      '<math:mi mathvariant="bold">X</math:mi>',
      '<math:mrow data-omml-unsupported="strange"><math:mn>N</math:mn></math:mrow>',
      '<math:menclose notation="bottom left right"><math:mi>X</math:mi></math:menclose>',
      '<math:munder><math:mi>lim</math:mi><math:mi>X</math:mi></math:munder>'][p_partkey % 14 + 1], '>X<', '>' || chr((97 + p_partkey % 26)::INT) || '<'), '>N<', '>' || p_size || '<') || '</math:math>' AS mathml
    FROM part"""
)
def omml_to_mathml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OMML fragment for each part, in fourteen shapes, to MathML."""
    rows = standins.omml_fragments(_table(spark, sf_dir, "part"), "p_partkey", "p_size")
    made = detect.parsed(rows, "p_partkey", lambda key, text: [{"mathml": omml.omml_to_mathml(text)}], "mathml string")
    return made.select(F.col("p_partkey").cast("long"), "mathml")


@query(
    """SELECT c_custkey, '<math xmlns="http://www.w3.org/1998/Math/MathML">' || CASE c_custkey % 4
      WHEN 0 THEN '<msup><mi>' || x || '</mi><mn>' || n || '</mn></msup>'
      WHEN 1 THEN '<msub><mi>' || x || '</mi><mi>i</mi></msub>'
      WHEN 2 THEN '<mi>' || ['sin', 'cos', 'tan', 'cot', 'sec', 'csc', 'log', 'ln'][c_custkey % 8 + 1] || '</mi><mi>' || x || '</mi>'
      ELSE '<mi>' || x || '</mi><mo>=</mo><msub><mi>log</mi><mn>' || n || '</mn></msub>' END || '</math>' AS repaired
    FROM (SELECT c_custkey, chr((119 + c_custkey % 4)::INT) AS x, c_custkey % 90 + 2 AS n FROM customer)"""
)
def normalize_mathml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts without their base and function names in letters, one for each customer, repaired."""
    rows = standins.broken_mathml(_table(spark, sf_dir, "customer"), "c_custkey")
    made = detect.parsed(rows, "c_custkey", lambda key, text: [{"repaired": repair.repair_xml(text)}], "repaired string")
    return made.select(F.col("c_custkey").cast("long"), "repaired")


@query(
    f"""SELECT p_partkey, CASE k WHEN 0 THEN {_DECLARED} || '<math:mrow><math:mfrac><math:mrow><math:mi>' || x || '</math:mi></math:mrow><math:mrow><math:mi>' || y || '</math:mi></math:mrow></math:mfrac></math:mrow></math:math>' || chr(10)
      WHEN 1 THEN {_DECLARED} || '<math:mrow><math:msup><math:mi>' || x || '</math:mi><math:mrow><math:mn>' || p_partkey % 10 || '</math:mn></math:mrow></math:msup></math:mrow></math:math>' || chr(10)
      WHEN 3 THEN {_DECLARED} || '<math:mrow><math:mi>' || x || '</math:mi></math:mrow></math:math>' || chr(10) END AS mathml,
      CASE WHEN k IN (0, 1, 3) THEN 3 END AS version, [25, 24, NULL, 12, NULL][k + 1] AS parsed_bytes, ['14:0:tmFRACT', '15:0:tmSUP', NULL, '', NULL][k + 1] AS templates,
      ['3:fnVARIABLE=2', '3:fnVARIABLE=1,8:fnNUMBER=1', NULL, '3:fnVARIABLE=1', NULL][k + 1] AS typefaces,
      [NULL, NULL, 'Unsupported template selector=43 variation=2 at offset 7.', NULL, 'Unexpected EOF at offset 7.'][k + 1] AS problem
    FROM (SELECT p_partkey, (p_partkey % 5)::INT AS k, chr((97 + p_partkey % 26)::INT) AS x, chr((97 + p_partkey % 25)::INT) AS y FROM part)"""
)
def mtef_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Equation Native stream for each part decoded; what is not supported says why."""

    def read(key: str, stream: bytes) -> list[dict]:
        try:
            made = mtef.decode_stream(stream)
        except mtef.MtefError as problem:
            return [{"problem": str(problem)}]
        faces = ",".join(f"{k}={n}" for k, n in sorted(made.typeface_counts.items()))
        return [{"mathml": made.mathml, "version": made.version, "parsed_bytes": made.parsed_bytes, "templates": ",".join(sorted(made.template_counts)), "typefaces": faces}]

    rows = standins.equation_streams(_table(spark, sf_dir, "part"), "p_partkey")
    found = detect.parsed(rows, "p_partkey", read, "mathml string, version int, parsed_bytes int, templates string, typefaces string, problem string")
    return found.select(F.col("p_partkey").cast("long"), "mathml", "version", "parsed_bytes", "templates", "typefaces", "problem")


# A container for each supplier: v its variant, n the objects in it, x its letter; o numbers the objects.
_FILES_SQL = """s AS (SELECT s_suppkey % 9 AS v, 1 + s_suppkey % 3 AS n, chr((97 + s_suppkey % 26)::INT) AS x,
      s_suppkey || '-' || ['omml.docx', 'mathtype.docx', 'equation3.docx', 'axmath.docx', 'legacy.doc', 'native.odt', 'bridge.odt', 'flat.fodt', 'broken.docx'][s_suppkey % 9 + 1] AS doc_id FROM supplier),
    o AS (SELECT *, unnest(range(1, n + 1)) AS i FROM s)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.container_files(_table(spark, sf_dir, "supplier"), "s_suppkey")
    return tables.kept(containers.entries_of(containers.described(files)), "entries")


def _formula_table(entries: DataFrame) -> DataFrame:
    return tables.kept(detect.detect_all(entries, tables.kept), "formulas")


_FORMULAS_SQL = f"""WITH {_FILES_SQL},
    f AS (SELECT doc_id, 'omml-native' AS family, 'word/document.xml' AS part, 'main' AS story, 'omml-inline' AS kind, i AS paragraph, 2 AS run, i AS seq, NULL AS target, 'low' AS risk, '' AS flags, 0.99 AS sure FROM o WHERE v = 0
    UNION ALL SELECT doc_id, 'omml-native', 'word/comments.xml', 'comment', 'omml-inline', 1, 1, n + 1, NULL, 'medium', 'story-part-nonmain', 0.99 FROM s WHERE v = 0
    UNION ALL SELECT doc_id, 'mathtype-ole', 'word/document.xml', 'main', 'ole-embedded', i, 2, i, 'word/embeddings/oleObject' || i || '.bin', 'low', '', 0.97 FROM o WHERE v = 1
    UNION ALL SELECT doc_id, 'equation-editor-3-ole', 'word/document.xml', 'main', 'ole-embedded', i - 1, 1, i, 'word/embeddings/oleObject' || i || '.bin', 'low', 'eq3-prog-id,eqnolefilehdr-present', 0.75 FROM o WHERE v = 2
    UNION ALL SELECT doc_id, 'axmath-ole', 'word/document.xml', 'main', 'ole-embedded', i, 2, i, 'word/embeddings/oleObject' || i || '.bin', 'medium',
      'export-assisted-route,native-static-parse-unverified,mathml-export-unverified,custom-symbols-present', 0.99 FROM o WHERE v = 3
    UNION ALL SELECT doc_id, 'equation-editor-3-ole', 'legacy-doc:ObjectPool/_1/Equation Native', 'main', 'ole-cfb-stream', 0, 0, 1, 'ObjectPool/_1/Equation Native', 'low', 'eq3-prog-id,eqnolefilehdr-present', 0.75 FROM s WHERE v = 4
    UNION ALL SELECT doc_id, if(v = 6, 'libreoffice-transformed', 'odf-native'), 'content.xml', 'main', 'odf-content-inline-mathml', NULL, NULL, i, NULL, if(v = 6, 'high', 'low'),
      if(v = 6, 'transformed-source,libreoffice-bridge,original-origin:omml', ''), if(v = 6, 0.9, 0.99) FROM o WHERE v IN (5, 6, 7)
    UNION ALL SELECT doc_id, if(v = 6, 'libreoffice-transformed', 'odf-native'), 'Object 1/content.xml', 'main', 'odf-draw-object-subdocument', NULL, NULL, n + 1, './Object 1', if(v = 6, 'high', 'low'),
      if(v = 6, 'transformed-source,libreoffice-bridge,original-origin:omml', ''), if(v = 6, 0.9, 0.99) FROM s WHERE v IN (5, 6))"""


@query(
    f"""{_FORMULAS_SQL} SELECT doc_id, format('{{}}-{{:04d}}', family, seq) AS formula_id, family AS source_family, if(family = 'libreoffice-transformed', 'transformed-source', 'native-source') AS source_role,
    part AS doc_part_path, story AS story_type, kind AS storage_kind, paragraph::INT AS paragraph_index, run::INT AS run_index, target AS embedding_target, risk AS risk_level, flags AS risk_flags, sure::DOUBLE AS confidence FROM f"""
)
def detected_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula table of a container for each supplier, all families."""
    found = _formula_table(_entries(spark, sf_dir))
    plain = ("doc_id", "formula_id", "source_family", "source_role", "doc_part_path", "story_type", "storage_kind", "paragraph_index", "run_index", "embedding_target", "risk_level")
    return found.select(*plain, F.array_join("risk_flags", ",").alias("risk_flags"), "confidence")


@query(
    f"""WITH {_FILES_SQL} SELECT doc_id, split_part(doc_id, '.', -1) AS container_format, ['ooxml-zip', 'ooxml-zip', 'ooxml-zip', 'ooxml-zip', 'ole-cfb', 'odf-zip', 'odf-zip', 'flat-xml', 'ooxml-zip'][v + 1] AS package_kind,
    [3, n + 2, n + 2, n + 2, 2, 2, 3, 1, 0][v + 1]::BIGINT AS entry_count,
    CASE WHEN v IN (1, 2, 3) THEN array_to_string([ 'word/embeddings/oleObject' || i || '.bin' for i in range(1, n + 1)], ',') WHEN v = 4 THEN 'ObjectPool/_1/Equation Native' ELSE '' END AS embedding_targets,
    if(v IN (1, 2, 3), 'word/_rels/document.xml.rels', '') AS relationship_parts, CASE v WHEN 4 THEN 'ObjectPool/_1' WHEN 5 THEN 'Object 1/content.xml' WHEN 6 THEN 'Object 1/content.xml' ELSE '' END AS object_parts,
    if(v = 8, 1, 0)::INT AS notes, part_path, story_type, omml::INT AS omml_count, ole::INT AS ole_object_count, odf::INT AS odf_math_count, drawn::INT AS graphic_reference_count
    FROM s LEFT JOIN (SELECT doc_id AS d, 'word/document.xml' AS part_path, 'main' AS story_type, if(v = 0, n, 0) AS omml, if(v = 0, 0, n) AS ole, 0 AS odf, 0 AS drawn FROM s WHERE v < 4
      UNION ALL SELECT doc_id, 'word/comments.xml', 'comment', 1, 0, 0, 0 FROM s WHERE v = 0 UNION ALL SELECT doc_id, 'WordDocument', 'main', 0, 1, 0, 0 FROM s WHERE v = 4
      UNION ALL SELECT doc_id, if(v = 7, doc_id, 'content.xml'), 'main', 0, 0, n, 1 FROM s WHERE v IN (5, 6, 7) UNION ALL SELECT doc_id, 'Object 1/content.xml', 'object', 0, 0, 1, 0 FROM s WHERE v IN (5, 6)) ON d = doc_id"""
)
def container_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers hold."""
    entries = _entries(spark, sf_dir)
    found = containers.scan(entries).join(containers.story_parts(entries), "doc_id", "left")
    lists = [F.array_join(c, ",").alias(c) for c in ("embedding_targets", "relationship_parts", "object_parts")]
    counts = ("part_path", "story_type", "omml_count", "ole_object_count", "odf_math_count", "graphic_reference_count")
    return found.select("doc_id", "container_format", "package_kind", "entry_count", *lists, F.size("notes").alias("notes"), *counts)


_FRACTION_SQL = f"""{_DECLARED} || '<math:mrow><math:mfrac><math:mrow><math:mi>' || x || '</math:mi></math:mrow><math:mrow><math:mi>y</math:mi></math:mrow></math:mfrac></math:mrow></math:math>' || chr(10)"""
_OMML_SQL = f"""'{_MATH}><math:mfrac><math:mi>' || x || '</math:mi><math:mn>' || n || '</math:mn></math:mfrac></math:math>'"""
_ODF_SQL = """'<ns0:math xmlns:ns0="http://www.w3.org/1998/Math/MathML"><ns0:mi>' || x || '</ns0:mi></ns0:math>'"""
_CANONICAL_SQL = f"""c AS (SELECT doc_id, 'omml-native' AS family, 'word/comments.xml' AS part, 1 AS place, 1 AS number, {_OMML_SQL} AS mathml, 0 AS attributes, '' AS display FROM s WHERE v = 0
    UNION ALL SELECT doc_id, 'omml-native', 'word/document.xml', i, i + 1, {_OMML_SQL}, 0, '' FROM o WHERE v = 0
    UNION ALL SELECT doc_id, 'equation-editor-3-ole', 'word/document.xml', i, i, {_FRACTION_SQL}, 1, 'block' FROM o WHERE v = 2
    UNION ALL SELECT doc_id, 'equation-editor-3-ole', 'legacy-doc:ObjectPool/_1/Equation Native', 1, 1, {_FRACTION_SQL}, 1, 'block' FROM s WHERE v = 4
    UNION ALL SELECT doc_id, 'odf-native', 'Object 1/content.xml', 1, 1, {_ODF_SQL}, 0, '' FROM s WHERE v IN (5, 6)
    UNION ALL SELECT doc_id, 'odf-native', if(v = 7, doc_id, 'content.xml'), i, if(v = 7, i, i + 1), {_ODF_SQL}, 0, '' FROM o WHERE v IN (5, 6, 7))"""


@query(
    f"""WITH {_FILES_SQL}, {_CANONICAL_SQL} SELECT doc_id, family AS source_family, part, place::INT AS part_index, 'accepted' AS status, format('{{}}-{{:04d}}', family, number) AS canonical_id, mathml, sha256(mathml) AS canonical_sha256,
    attributes::INT AS mathml_attribute_count, display AS root_display, CASE WHEN part = 'Object 1/content.xml' THEN 'odf-draw-object-subdocument' WHEN family = 'odf-native' THEN 'odf-content-inline-mathml' END AS storage_kind FROM c"""
)
def canonical_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical MathML of OMML, ODF and Equation 3.0 formulas with its digest and signals."""
    entries = _entries(spark, sf_dir)
    made = canonical.all_canonical(entries, _formula_table(entries))
    return made.select("doc_id", "source_family", "part", "part_index", "status", "canonical_id", "mathml", "canonical_sha256", "signals.mathml_attribute_count", "signals.root_display", "storage_kind")


_PARITY_SQL = f"""{_FORMULAS_SQL}, {_CANONICAL_SQL}, p AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.family, b.family) AS source_family, coalesce(expected, 0) AS expected, coalesce(accepted, 0) AS accepted, attributes, displays
    FROM (SELECT doc_id, family, count(*) AS expected FROM f GROUP BY ALL) a
    FULL JOIN (SELECT doc_id, family, count(*) AS accepted, sum(attributes)::BIGINT AS attributes, coalesce(string_agg(DISTINCT display) FILTER (display <> ''), '') AS displays FROM c GROUP BY ALL) b USING (doc_id, family))"""
_GATES_SQL = """expected, accepted, 0::BIGINT AS unsupported, if(expected = accepted, 'passed', 'mismatch') AS formula_count_parity,
    CASE WHEN expected <> accepted OR accepted = 0 THEN 'blocked-canonical-artifact' WHEN source_family = 'equation-editor-3-ole' THEN 'passed-limited' ELSE 'passed' END AS gate_status"""


@query(f"{_PARITY_SQL} SELECT doc_id, source_family, {_GATES_SQL} FROM p")
def canonical_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows held against the formula table's counts, all families."""
    entries = _entries(spark, sf_dir)
    formulas = _formula_table(entries)
    found = canonical.canonical_summary(canonical.all_canonical(entries, formulas), routing.source_counts(formulas))
    return found.select("doc_id", "source_family", "expected", "accepted", "unsupported", "formula_count_parity", "gate_status")


@query(
    f"""{_PARITY_SQL} SELECT doc_id, source_family, {_GATES_SQL}, attributes AS mathml_attribute_count, displays AS root_display_values, contract_status, conversion_claim, binding
    FROM p JOIN (VALUES ('mathtype-ole', 'external-tool-gated', FALSE, 'equation-native-mtef-to-normalized-mathml'), ('omml-native', 'implemented-basic', TRUE, 'internal-omml-to-canonical-mathml'),
      ('equation-editor-3-ole', 'implemented-limited', TRUE, 'internal-equation3-mtef-v2v3-to-canonical-mathml-limited'), ('axmath-ole', 'export-gated', FALSE, 'approved-axmath-export-to-canonical-mathml'),
      ('odf-native', 'implemented', TRUE, 'preserve-existing-odf-mathml'), ('libreoffice-transformed', 'bridge-review-gated', FALSE, 'bridge-provenance-review-before-canonical-mathml')) k(source_family, contract_status, conversion_claim, binding) USING (source_family)"""
)
def validation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and family, parity, gate, signals and the contract that they serve."""
    entries = _entries(spark, sf_dir)
    formulas = _formula_table(entries)
    found = canonical.evidence(tables.kept(canonical.all_canonical(entries, formulas), "canonical"), routing.source_counts(formulas))
    plain = ("doc_id", "source_family", "expected", "accepted", "unsupported", "formula_count_parity", "gate_status", "mathml_attribute_count")
    return found.select(*plain, F.array_join("root_display_values", ",").alias("root_display_values"), "contract_status", "conversion_claim", "binding")


@query(
    f"""WITH {_FILES_SQL} SELECT doc_id, i::INT AS sequence, i::INT AS paragraph_index, 2::INT AS run_index, '[OLE]' AS run_text, 'Before ' || x || i || ' [OLE]After' AS paragraph_text, 'Before ' || x || i || ' ' AS text_before, 'After' AS text_after,
    ['Equation.DSMT4', 'Equation.3', 'Equation.AxMath'][v] AS prog_id, 'rId' || i AS ole_rid, 'embeddings/oleObject' || i || '.bin' AS ole_target, n::INT AS paragraph_count, 0::INT AS omml_run_child_count FROM o WHERE v IN (1, 2, 3)
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n::INT, n::INT FROM s WHERE v = 0"""
)
def object_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where objects stand in their documents."""
    entries = _entries(spark, sf_dir)
    found = object_map.object_map(entries, detect.relationships(entries))
    return found.select("doc_id", "sequence", "paragraph_index", "run_index", "run_text", "paragraph_text", "text_before", "text_after", "prog_id", "ole_rid", "ole_target", "paragraph_count", "omml_run_child_count")


@query(
    f"""WITH {_FILES_SQL} SELECT doc_id, 'word/embeddings/oleObject' || i || '.bin' AS entry, 'Equation Native' AS name, 4096::BIGINT AS size_bytes, rpad('MathType EF MTEF5 DSMT7 ' || x, 96, '.') AS ascii_preview,
    rpad(lower(hex('MathType EF MTEF5 DSMT7 ' || x)), 64, '0') AS hex_prefix, sha256(rpad('MathType EF MTEF5 DSMT7 ' || x, 4096, chr(0))) AS content_sha256 FROM o WHERE v = 1"""
)
def payload_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of embedded compound files."""
    return object_map.streams(_entries(spark, sf_dir)).select("doc_id", "entry", "name", "size_bytes", "ascii_preview", "hex_prefix", F.sha2("content", 256).alias("content_sha256"))


@query(
    f"""WITH {_FILES_SQL} SELECT doc_id, [3, n + 2, n + 2, n + 2, 2, 2, 3, 1, 0][v + 1]::BIGINT AS entry_count, CASE WHEN v = 0 THEN n WHEN v < 4 THEN 0 END::INT AS omath_count, if(v < 4, 0, NULL)::INT AS omath_para_count,
    CASE WHEN v = 0 THEN 0 WHEN v < 4 THEN n END::INT AS ole_object_count, CASE WHEN v = 0 THEN 0 WHEN v < 4 THEN n END::BIGINT AS embedding_count,
    CASE WHEN v = 0 THEN '' WHEN v < 4 THEN array_to_string(['word/embeddings/oleObject' || i || '.bin|' || [5632, 53, 29][v] || '|' || ['MathType+MTEF', '', ''][v] || '|' || ['MathType EF MTEF5 DSMT7 ' || x, '', 'AxMath ' || x || ' with a custom symbol'][v]
      for i in range(1, n + 1)], ';') END AS first_embeddings FROM s"""
)
def document_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and first embeddings of each document."""
    said = F.transform("first_embeddings", lambda e: F.concat_ws("|", e["name"], e["size_bytes"].cast("string"), F.array_join(e["found_keywords"], "+"), F.array_join(e["ascii_preview"], "+")))
    return object_map.overview(_entries(spark, sf_dir)).select("doc_id", "entry_count", "omath_count", "omath_para_count", "ole_object_count", "embedding_count", F.array_join(said, ";").alias("first_embeddings"))


@query(
    f"""{_FORMULAS_SQL} SELECT doc_id, source_family, formula_count, provider, action_order::INT AS action_order, action_id, blocking, status
    FROM (SELECT doc_id, family AS source_family, count(*) AS formula_count FROM f GROUP BY ALL) JOIN (VALUES
      ('omml-native', 'omml', 1, 'extract-omml', FALSE, 'completed'), ('omml-native', 'omml', 2, 'normalize-omml', FALSE, 'completed'), ('omml-native', 'omml', 3, 'omml-to-canonical-mathml', FALSE, 'completed'),
      ('omml-native', 'omml', 4, 'render-check', FALSE, 'skipped'), ('omml-native', 'omml', 5, 'package-omml-output', FALSE, 'completed'),
      ('mathtype-ole', 'mathtype', 1, 'extract-equation-native', TRUE, 'blocked-external-tool'), ('mathtype-ole', 'mathtype', 2, 'mtef-to-mathml', TRUE, 'blocked-external-tool'),
      ('mathtype-ole', 'mathtype', 3, 'normalize-mathml', TRUE, 'blocked-external-tool'), ('mathtype-ole', 'mathtype', 4, 'mathml-to-omml', TRUE, 'blocked-external-tool'),
      ('mathtype-ole', 'mathtype', 5, 'replace-ole-with-omml', TRUE, 'blocked-external-tool'), ('mathtype-ole', 'mathtype', 6, 'validate-word-output', FALSE, 'blocked-external-tool'),
      ('equation-editor-3-ole', 'equation3', 1, 'probe-header-and-classid', FALSE, 'completed'), ('equation-editor-3-ole', 'equation3', 2, 'attempt-mtef-conversion', TRUE, 'completed'),
      ('equation-editor-3-ole', 'equation3', 3, 'fallback-manual-triage', TRUE, 'skipped-not-needed'), ('equation-editor-3-ole', 'equation3', 4, 'word-roundtrip-validation', TRUE, 'skipped-downstream'),
      ('axmath-ole', 'axmath', 1, 'classify-axmath-object', TRUE, 'export-gate'), ('axmath-ole', 'axmath', 2, 'export-assisted-conversion', TRUE, 'blocked-external-tool'),
      ('axmath-ole', 'axmath', 3, 'import-converted-math', TRUE, 'skipped-until-export-artifacts'), ('axmath-ole', 'axmath', 4, 'manual-spot-check', TRUE, 'review-gated'),
      ('odf-native', 'odf', 1, 'extract-odf-formula', TRUE, 'completed'), ('odf-native', 'odf', 2, 'convert-odf-mathml', TRUE, 'completed'), ('odf-native', 'odf', 3, 'emit-target-format', FALSE, 'validation-gated'),
      ('libreoffice-transformed', 'odf', 1, 'inspect-transform-chain', TRUE, 'review-gated'), ('libreoffice-transformed', 'odf', 2, 'bridge-review', TRUE, 'review-gated'),
      ('libreoffice-transformed', 'odf', 3, 'decide-reconvert-or-accept', TRUE, 'review-gated')) a(source_family, provider, action_order, action_id, blocking, status) USING (source_family)"""
)
def action_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action's status from what the converters found."""
    entries = _entries(spark, sf_dir)
    formulas = _formula_table(entries)
    plan = routing.execution_plan(routing.route_plan(routing.source_counts(formulas)))
    found = execution.action_reports(plan, canonical.document_facts(entries, formulas))
    return found.select("doc_id", "source_family", "formula_count", "provider", "action_order", "action_id", "blocking", "status")


@query(
    f"""WITH {_FILES_SQL} SELECT doc_id, TRUE AS target_is_the_document, 'pending-external-validation' AS status, 'spot-check' AS review_mode, 'word-open=not-run,word-export-pdf=not-run,render-parity=not-run,formula-count=planned' AS planned_checks,
    (n + 1)::BIGINT AS formula_count, (n + 1)::BIGINT AS canonical_mathml_count, 0::BIGINT AS unsupported_fragment_count,
    '{{"source_family":"omml-native","provider":"omml","next_action":"run-omml-native-pipeline","route_kind":"primary-source-first","formula_count":' || (n + 1) || ',"canonical_mathml_count":' || (n + 1) ||
      ',"unsupported_fragment_count":0,"input_path":"' || doc_id || '","validation_target_docx":"validation-target.docx"}}' AS metadata FROM s WHERE v = 0"""
)
def omml_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of native equations packaged for validation, with metadata, plan and evidence."""
    files = tables.kept(standins.container_files(_table(spark, sf_dir, "supplier"), "s_suppkey"), "files")
    described = containers.described(files)
    entries = tables.kept(containers.entries_of(described), "entries")
    formulas = _formula_table(entries)
    made = package.packages(files, routing.route_plan(routing.source_counts(formulas)), formulas, canonical.omml_canonical(entries))
    own = described.select("doc_id", "sha256")
    checks = F.array_join(F.transform("plan.planned_checks", lambda c: F.concat_ws("=", c["id"], c["status"])), ",")
    same = (F.col("target_sha256") == F.col("sha256")).alias("target_is_the_document")
    return made.join(own, "doc_id").select("doc_id", same, "plan.status", "plan.review_mode", checks.alias("planned_checks"), "formula_count", "canonical_mathml_count", "unsupported_fragment_count", "metadata")


# ---- single operators over rows --------------------------------------------------------------------


@query(
    """SELECT c_custkey, 2::INT AS width, 2::INT AS height, (d > 24)::INT::BIGINT AS changed_pixels, (d > 24)::INT / 4::DOUBLE AS changed_ratio, d / 4::DOUBLE AS mean_abs_diff, d / 2::DOUBLE AS rms_diff,
    if(d > 24, '1,1,2,2', '') AS diff_box FROM (SELECT c_custkey, c_custkey % 50 AS d FROM customer)"""
)
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grey pictures of four pixels for each customer, of which the last may differ."""
    k = F.col("c_custkey")
    pixel = lambda grey: F.repeat(F.lpad(F.hex(grey), 2, "0"), 3)
    head = F.hex(F.encode(F.lit("P6\n2 2\n255\n"), "UTF-8"))
    base = k % 200
    picture = lambda last: F.unhex(F.concat(head, pixel(base), pixel(base), pixel(base), pixel(last)))
    rows = _table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), F.lit(1).alias("page"), picture(base).alias("a"), picture(base + k % 50).alias("b"))
    found = pages.page_metrics(rows.withColumnRenamed("a", "picture"), rows.withColumnRenamed("b", "picture"))
    box = F.coalesce(F.concat_ws(",", *(F.col(f"diff_box.{side}").cast("string") for side in ("left", "top", "right", "bottom"))), F.lit(""))
    return found.select(F.col("doc_id").cast("long").alias("c_custkey"), "width", "height", "changed_pixels", "changed_ratio", "mean_abs_diff", "rms_diff", box.alias("diff_box"))


@query(
    f"""WITH {_FILES_SQL} SELECT doc_id, if(k % 2 = 0, n, 0)::INT AS replaced_count, if(k % 2 = 0, NULL, 'LookupError: no OMML for embeddings/oleObject1.bin') AS error, if(k % 2 = 0, n, 0)::INT AS omml_count, if(k % 2 = 0, 0, n)::INT AS ole_object_count
    FROM (SELECT *, split_part(doc_id, '-', 1)::BIGINT AS k FROM s WHERE v = 1)"""
)
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects replaced by equations, layout kept; a document that lacks an equation says so."""
    suppliers = _table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 1")
    files = tables.kept(standins.container_files(suppliers, "s_suppkey"), "files")
    key = F.substring_index("doc_id", "-", 1).cast("long")
    wanted = files.select("doc_id", F.explode(F.sequence(F.lit(1), (key % 3 + 1).cast("int"))).alias("i")).select("doc_id", "i", F.concat(F.lit("oleObject"), F.col("i").cast("string")).alias("stem"))
    there = wanted.where((key % 2 == 0) | (F.col("i") > 1)).select("doc_id", "stem", F.lit(samples.OMML["fraction"]).alias("omml"))
    made = tables.kept(rewrite.replaced(files, rewrite.replacements(there, wanted), keep_layout=True), "replaced")
    parts = containers.story_parts(containers.entries_of(containers.described(made.select("doc_id", "content"))))
    return made.select("doc_id", "replaced_count", "error").join(parts.select("doc_id", "omml_count", "ole_object_count"), "doc_id", "left")


@query(
    f"""SELECT c_custkey, if(c_custkey % 10 = 9, 'failed', 'accepted') AS status, if(c_custkey % 10 = 9, 'empty MathML', NULL) AS problem, CASE WHEN c_custkey % 10 < 9 THEN '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '{_MATH}>' || CASE c_custkey % 4
      WHEN 0 THEN '<math:msup><math:mi>' || x || '</math:mi><math:mn>' || n || '</math:mn></math:msup>' WHEN 1 THEN '<math:msub><math:mi>' || x || '</math:mi><math:mi>i</math:mi></math:msub>'
      WHEN 2 THEN '<math:mi>' || ['sin', 'cos', 'tan', 'cot', 'sec', 'csc', 'log', 'ln'][c_custkey % 8 + 1] || '</math:mi><math:mi>' || x || '</math:mi>'
      ELSE '<math:mi>' || x || '</math:mi><math:mo>=</math:mo><math:msub><math:mi>log</math:mi><math:mn>' || n || '</math:mn></math:msub>' END || '</math:math>' || chr(10) END AS mathml
    FROM (SELECT c_custkey, chr((119 + c_custkey % 4)::INT) AS x, c_custkey % 90 + 2 AS n FROM customer)"""
)
def mathtype_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outer converter made, repaired and accepted, or refused."""
    made = standins.broken_mathml(_table(spark, sf_dir, "customer"), "c_custkey")
    told = F.when(F.col("c_custkey").cast("long") % 10 == 9, " ").otherwise(F.concat(F.lit("\ufeff"), "mathml"))
    found = canonical.mathtype_canonical(made.select(F.col("c_custkey").alias("doc_id"), F.lit("oleObject1.bin").alias("part"), told.alias("mathml")))
    return found.select(F.col("doc_id").cast("long").alias("c_custkey"), "status", "problem", "mathml")


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<root><mtef><mtef_version>3</mtef_version><product_subversion>0</product_subversion><equation_options>block</equation_options><x>' || p_size || '</x></mtef></root>'
      WHEN 1 THEN '<root><mtef><mtef_version>5</mtef_version><product_subversion>0</product_subversion><x>' || p_size || '</x></mtef></root>' ELSE '<root>' || p_size END AS xml, p_partkey % 3 = 0 AS display_added FROM part"""
)
def display_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equation options added where version 3 lacks them."""
    version = F.when(F.col("p_partkey") % 3 == 0, "3").otherwise("5")
    whole = F.concat(F.lit("<root><mtef><mtef_version>"), version, F.lit("</mtef_version><product_subversion>0</product_subversion><x>"), F.col("p_size").cast("string"), F.lit("</x></mtef></root>"))
    xml = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("<root>"), F.col("p_size").cast("string"))).otherwise(whole)
    found = canonical.with_display_mode(tables.spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", xml.alias("xml")), "xml")
    return found.select("p_partkey", F.col("xml_with_display").alias("xml"), "display_added")


@query(
    """SELECT p_partkey, [TRUE, TRUE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE][k] AS yes, [TRUE, TRUE, FALSE, FALSE, TRUE, FALSE, FALSE, FALSE, FALSE][k] AS yes_by_letter, [7, 7, 0, 7, 7, 12, 7, 7, 7][k]::BIGINT AS whole,
    [0.5, 0.5, 0.0, 0.5, 0.5, 12.0, 1.5, 0.5, 0.5][k]::DOUBLE AS decimal_value, if(k = 1, '-PreserveMathTypeLayout -MathTypeLayoutFactor 1.01375', '') || if(k = 2, '-PreserveMathTypeLayout -MathTypeLayoutFactor 1.01375', '') || if(k = 6, '-StartIndex 12', '') AS arguments
    FROM (SELECT p_partkey, (p_partkey % 9 + 1)::INT AS k FROM part)"""
)
def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as text, read leniently, and the arguments that they ask for."""
    texts = (" True ", "YES", "0", "n", "y", "+12", "1.5", "", "abc")
    said = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", said.alias("t"))
    asked = F.create_map(F.lit("preserve_mathtype_layout"), F.col("t"), F.lit("mathtype_start_index"), F.col("t"))
    t = F.col("t")
    return rows.select("p_partkey", options.boolean(t).alias("yes"), options.boolean(t, letters=True).alias("yes_by_letter"), options.integer(t, 7).alias("whole"), options.real(t, 0.5).alias("decimal_value"), F.array_join(options.mathtype_arguments(asked), " ").alias("arguments"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 1 THEN l_quantity END AS height FROM lineitem")
def style_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A height in points out of an inline style."""
    style = F.concat(F.lit("width:"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("pt; HEIGHT : "), F.col("l_quantity").cast("string"), F.lit(" pt"))).otherwise("pt;line-height:2pt"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rewrite.style_points(style, "height").alias("height"))


@query(
    r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'target' WHEN 2 THEN 'first' WHEN 3 THEN 'artifact' END AS target,
    trim(regexp_replace(source || ' / ' || lang || ' é.bin ', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug FROM documents"""
)
def names_and_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document to validate, given or named by metadata, and names that are safe for files."""
    told = ("{}", '{"target_docx": "target"}', '{"target_docx": "target", "validation_target_docx": "first"}', '{"artifacts": {"validation_target": {"validation_target_docx": "artifact"}}}', '{"target_docx": ""}')
    k = F.col("doc_id") % 5
    metadata = F.element_at(F.array(*map(F.lit, told)), (k + 1).cast("int"))
    name = F.concat("source", F.lit(" / "), "lang", F.lit(" é.bin "))
    return _table(spark, sf_dir, "documents").select("doc_id", tables.validation_target(F.when(k == 0, "direct").otherwise(""), metadata).alias("target"), tables.slug(name).alias("slug"))


@query(
    f"""SELECT doc_id, 'formula_count: ' || sum(n)::BIGINT || chr(10) || 'source_counts:' || chr(10) || string_agg('  ' || source_family || ': ' || n, chr(10) ORDER BY source_family) AS summary
    FROM (SELECT user_id AS doc_id, source_family, count(*) AS n FROM {_FAMILY_SQL} GROUP BY ALL) GROUP BY doc_id"""
)
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a document's total and families as text."""
    return tables.summary_text(routing.source_counts(_formulas(spark, sf_dir)))


_RECORDS_SQL = """(SELECT 'oleObject' || doc_id || '.bin' AS name, 'oleObject' || doc_id AS stem, doc_id AS position, event_id % 97 AS paragraph_index, event_type AS text_before, CASE WHEN doc_id % 3 <> 0 THEN 'auto_replace' WHEN event_id % 2 = 1 THEN 'spot_check' ELSE 'manual_review' END AS category
    FROM documents LEFT JOIN (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) ON user_id = doc_id)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = lambda c: F.concat(F.lit("oleObject"), F.col(c).cast("string"), F.lit(".bin"))
    preview = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, " =").otherwise(""))
    summary = _table(spark, sf_dir, "documents").select(file("doc_id").alias("name"), F.lit("ok").alias("status"), F.lit("True").alias("omml_exists"), F.lit("True").alias("tex_exists"), preview.alias("latex_preview"))
    after = F.when(F.col("event_id") % 2 == 1, "___").otherwise("")
    objects = _table(spark, sf_dir, "events").select(F.concat(F.lit("embeddings/"), file("user_id")).alias("ole_target"), F.col("event_id").alias("sequence"), (F.col("event_id") % 97).alias("paragraph_index"), F.lit(1).alias("run_index"), F.col("event_type").alias("text_before"), after.alias("text_after"))
    return risk.records(summary, objects)


@query(f"SELECT name, stem, position, paragraph_index, text_before, category FROM {_RECORDS_SQL}")
def risk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted formulas with their place, the last object of a name counting, classified; blanks override."""
    return _records(spark, sf_dir).select("name", "stem", "position", "paragraph_index", "text_before", "category")


@query(f"SELECT name, position FROM {_RECORDS_SQL} WHERE category = 'spot_check' ORDER BY position LIMIT 30")
def spot_check_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the first 30 spot checks in natural order (the feature)."""
    return risk.spot_checks(_records(spark, sf_dir)).select("name", "position")
