"""The same questions as the registered queries, in SQL for DuckDB over the same tables.

Written from the definitions of the results, per column and per concept, and not from the plans.
"""

from __future__ import annotations

from checks.controls import ALIGNED_RULES, SUGGESTIONS, TEMPLATES
from checks.tables import MISSING, RANGED, TABLES
from covermap import fixed_values as fixed

DUCKDB_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz",
                "FLOAT[]": "array<float>"}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# ---- tables and their columns ----

def _gap_tables() -> list[str]:
    """CTEs that shadow the given tables, with the missing values taken out."""
    empty = {"nan": "'NaN'::DOUBLE", "null": "NULL"}
    parts = []
    for table, gaps in MISSING.items():
        replaced = ", ".join(f"CASE WHEN {condition} THEN {empty[kind]} ELSE {column} END AS {column}"
                             for column, (condition, kind) in gaps.items())
        parts.append(f"{table}_gaps AS (SELECT * REPLACE ({replaced}) FROM {table})")
    return parts


def _name(table: str, gaps: bool) -> str:
    return f"{table}_gaps" if gaps and table in MISSING else table


def _value(column: str, kind: str) -> str:
    return f"CASE WHEN NOT isnan({column}) THEN {column} END" if kind == "double" else column


def _count_lines(tables: dict, gaps: bool) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS source_name, '{column}' AS \"column\","
        f" count(*) AS rows, count(*) - count({_value(column, kind)}) AS nulls,"
        f" count(DISTINCT {_value(column, kind)}) AS distincts FROM {_name(table, gaps)}"
        for table, columns in tables.items() for column, kind in columns.items())


def _type_parts() -> str:
    """Types as the files have them, in Spark's names."""
    described = "\nUNION ALL ".join(
        f"SELECT '{table}' AS source_name, column_name AS \"column\", column_type FROM (DESCRIBE {table})" for table in TABLES)
    names = " ".join(f"WHEN '{duck}' THEN '{spark}'" for duck, spark in DUCKDB_TYPES.items())
    return f"types AS (SELECT source_name, \"column\", CASE column_type {names} ELSE lower(column_type) END AS dtype FROM ({described}))"


def _profile_parts(tables: dict = TABLES, gaps: bool = False) -> list[str]:
    profile = f"""
        SELECT source_name, 'parquet' AS source_type, source_name AS table_name, "column", dtype, distincts,
               round(CASE WHEN rows = 0 THEN 0.0 ELSE nulls / rows END, 3) AS null_ratio,
               round(CASE WHEN rows = 0 THEN 0.0 ELSE distincts / rows END, 3) AS cardinality_ratio,
               dtype LIKE 'timestamp%' OR regexp_matches("column", '{fixed.TIME_NAME}', 'i') AS is_probable_datetime,
               regexp_matches("column", '{fixed.ID_NAME}', 'i')
                   OR (rows > 0 AND distincts / rows > 0.95 AND distincts > 20) AS is_probable_id,
               regexp_matches("column", '{fixed.PII_NAME}', 'i') AS is_probable_pii
        FROM counts JOIN types USING (source_name, "column")"""
    return (_gap_tables() if gaps else []) + [_type_parts(),
        f"counts AS ({_count_lines(tables, gaps)})", f"full_profile AS ({profile})",
        "profile AS (SELECT * EXCLUDE (distincts) FROM full_profile)"]


def _shown(column: str, kind: str) -> str:
    """A value as it is ordered and shown: arrays as whole millionths, in text."""
    if kind.startswith("array"):
        return (f"'[' || array_to_string(list_transform({column}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') || ']'")
    return _value(column, kind)


def _sample_lines(tables: dict, gaps: bool) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS source_name, '{column}' AS \"column\", coalesce((SELECT string_agg(CAST(v AS VARCHAR),"
        f" ' | ' ORDER BY v) FROM (SELECT DISTINCT {_shown(column, kind)} AS v FROM {_name(table, gaps)}"
        f" WHERE {_value(column, kind)} IS NOT NULL ORDER BY v LIMIT 3)), '') AS sample_values"
        for table, columns in tables.items() for column, kind in columns.items())


# ---- concepts and scenarios ----

def _concept_parts(rules: dict = ALIGNED_RULES, suggestions: bool = False) -> list[str]:
    keywords = [(order, concept, keyword)
                for order, (concept, words) in enumerate(rules.items()) for keyword in words]
    offered = SUGGESTIONS if suggestions else [("", "")]
    return _profile_parts(gaps=True) + [
        _values("rules", "rule_order, concept, keyword", keywords),
        _values("offers", "\"column\", concept", offered),
        """by_rule AS (SELECT p."column", arg_min(r.concept, r.rule_order) AS concept
            FROM (SELECT DISTINCT "column" FROM profile) p
            JOIN rules r ON contains(lower(p."column"), lower(r.keyword)) GROUP BY 1)""",
        """by_offer AS (SELECT "column", min(nullif(trim(concept), '')) AS concept FROM offers GROUP BY 1)""",
        """mapped AS (SELECT p.*, coalesce(r.concept, o.concept) AS business_concept,
                CASE WHEN r.concept IS NOT NULL THEN 'rule' WHEN o.concept IS NOT NULL THEN 'suggested'
                     ELSE 'unmatched' END AS matched_by
            FROM profile p LEFT JOIN by_rule r USING ("column") LEFT JOIN by_offer o USING ("column"))""",
    ]


def _score_parts(rules: dict = ALIGNED_RULES, scoped: bool = False, suggestions: bool = False) -> list[str]:
    templates = [(order, name, description) for order, (name, description, _, _) in enumerate(TEMPLATES)]
    needed = [(order, concept, required) for order, (_, _, must, nice) in enumerate(TEMPLATES)
              for required, concepts in (("yes", must), ("no", nice)) for concept in concepts]
    scope = "source_name" if scoped else "'all'"
    readiness = "CASE WHEN coverage >= 100 THEN 'ready' WHEN coverage >= 50 THEN 'partial' ELSE 'insufficient' END"
    label = " ".join(f"WHEN '{code}' THEN {_text(text)}" for code, text in fixed.READINESS.items())
    none, missing = (_text(text).replace("%s", "{}") for text in (fixed.GAP_NONE, fixed.GAP_MISSING))
    return _concept_parts(rules, suggestions) + [
        _values("templates", "template_order, name, description", templates),
        _values("needed", "template_order, concept, required", needed),
        f"""available AS (SELECT {scope} AS scope, business_concept AS concept, count(*) AS columns,
                min(null_ratio) AS null_ratio FROM mapped WHERE business_concept IS NOT NULL GROUP BY 1, 2)""",
        f"""needs AS (SELECT s.scope, t.template_order, t.name, n.concept, n.required, a.columns, a.null_ratio,
                a.concept IS NOT NULL AS have
            FROM (SELECT DISTINCT {scope} AS scope FROM profile) s CROSS JOIN templates t
            JOIN needed n USING (template_order)
            LEFT JOIN available a ON a.scope = s.scope AND a.concept = n.concept)""",
        """tallied AS (SELECT scope, template_order, name,
                count(*) FILTER (WHERE required = 'yes' AND have)
                    / count(*) FILTER (WHERE required = 'yes') * 100 AS coverage,
                coalesce(string_agg(concept, ', ' ORDER BY concept)
                    FILTER (WHERE required = 'yes' AND have), '') AS matched,
                coalesce(string_agg(concept, ', ' ORDER BY concept)
                    FILTER (WHERE required = 'yes' AND NOT have), '') AS missing,
                coalesce(string_agg(concept, ', ' ORDER BY concept)
                    FILTER (WHERE required = 'no' AND have), '') AS nice,
                max(null_ratio) FILTER (WHERE required = 'yes' AND have) AS required_null_ratio
            FROM needs GROUP BY ALL)""",
        f"""scored AS (SELECT *, round(coverage, 1) AS coverage_pct, {readiness} AS readiness,
                CASE {readiness} {label} END AS label,
                CASE WHEN missing = '' THEN format({none}, name) ELSE format({missing}, name, missing) END AS gap
            FROM tallied)""",
    ]


def _ranking(rules: dict) -> str:
    return _with(_score_parts(rules), """
        SELECT row_number() OVER (ORDER BY coverage_pct DESC, template_order) AS place, name, coverage_pct,
               readiness, missing, required_null_ratio FROM scored""")


def _advice() -> str:
    return _with(_score_parts(suggestions=True), """
        SELECT s.name, s.coverage_pct, s.readiness, s.missing, s.gap, e.columns, e.ids, e.samples, e.cardinality
        FROM scored s LEFT JOIN (
            SELECT n.name, sum(p.columns)::BIGINT AS columns, sum(p.ids)::BIGINT AS ids, sum(p.samples)::BIGINT AS samples, max(p.cardinality) AS cardinality
            FROM needs n JOIN (
                SELECT m.business_concept, count(*) AS columns, count(*) FILTER (WHERE m.is_probable_id) AS ids,
                       sum(least(3, f.distincts)) AS samples, max(m.cardinality_ratio) AS cardinality
                FROM mapped m JOIN full_profile f USING (source_name, "column") GROUP BY 1) p ON p.business_concept = n.concept
            WHERE n.required = 'yes' AND n.have GROUP BY 1) e USING (name)""")


def _needs(required: str, have: str) -> str:
    return _with(_score_parts(), f"""
        SELECT name, concept, columns, null_ratio FROM needs WHERE required = '{required}' AND {have}""")


def _flagged(flag: str) -> str:
    return _with(_profile_parts(gaps=True), f"""
        SELECT source_name, "column", null_ratio, cardinality_ratio FROM profile WHERE {flag}""")


def _mapped(kind: str) -> str:
    return _with(_concept_parts(suggestions=kind == "suggested"), f"""
        SELECT source_name, "column", business_concept, null_ratio FROM mapped WHERE matched_by = '{kind}'""")


def _sample_limit() -> str:
    tables = {"orders": TABLES["orders"]}
    capped = "orders_capped AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 2000)"
    parts = [part.replace("FROM orders", "FROM orders_capped") for part in _profile_parts(tables)]
    samples = f"samples AS ({_sample_lines(tables, False).replace('FROM orders', 'FROM orders_capped')})"
    return _with([capped, *parts, samples], """
        SELECT "column", null_ratio, cardinality_ratio, is_probable_id, sample_values
        FROM profile JOIN samples USING (source_name, "column")""")


def _profile_table() -> str:
    tables = {"lineitem": TABLES["lineitem"]}
    return _with([*_profile_parts(tables), f"samples AS ({_sample_lines(tables, False)})"], """
        SELECT profile.*, sample_values FROM profile JOIN samples USING (source_name, "column")""")


def oracle_sql() -> dict[str, str]:
    """One statement per registered query."""
    return {
        "load_report": "\nUNION ALL ".join(
            f"SELECT '{table}' AS source_name, 'parquet' AS source_type, '{table}' AS table_name,"
            f" FALSE AS is_synthetic, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {table})) AS columns FROM {table}"
            for table in TABLES),
        "first_available": f"""
            SELECT 'orders' AS source_name, 'postgres' AS source_type, 'disabled' AS status,
                   NULL::BIGINT AS rows, NULL::INTEGER AS columns
            UNION ALL SELECT 'orders', 'onelake', 'failed', NULL, NULL
            UNION ALL SELECT 'orders', 'parquet', 'loaded', count(*), (SELECT count(*) FROM (DESCRIBE orders)) FROM orders""",
        "equi_depth_ranges": "\nUNION ALL ".join(
            f"SELECT '{table}' AS source_name, '{column}' AS \"column\", count(*) AS rows, TRUE AS whole, TRUE AS even FROM {table}"
            for table, column in RANGED),
        "saved_again": _with(_profile_parts(gaps=True), 'SELECT source_name, "column", null_ratio FROM profile'),
        "sample_limit": _sample_limit(),
        "profile_catalog": _with([*_profile_parts(), f"samples AS ({_sample_lines(TABLES, False)})"], """
            SELECT p.* EXCLUDE (distincts), CASE WHEN dtype = 'array<float>' THEN least(3, distincts) || ' samples'
                   ELSE sample_values END AS sample_values
            FROM full_profile p JOIN samples USING (source_name, "column")"""),
        "profile_table": _profile_table(),
        "distinct_count": _with(_profile_parts(gaps=True),
                                'SELECT source_name, "column", rows, nulls, distincts FROM counts'),
        "null_ratio": _with(_profile_parts(gaps=True), 'SELECT source_name, "column", null_ratio FROM profile'),
        "cardinality_ratio": _with(_profile_parts(gaps=True),
                                   'SELECT source_name, "column", cardinality_ratio FROM profile'),
        "flag_datetime": _flagged("is_probable_datetime"),
        "flag_id": _flagged("is_probable_id"),
        "flag_pii": _flagged("is_probable_pii"),
        "sample_values": _with(_gap_tables(), _sample_lines(TABLES, True)),
        "approx_distinct": _with(_profile_parts(gaps=True),
                                 'SELECT source_name, "column", rows, nulls, TRUE AS within_error FROM counts'),
        "bitmap_samples": _with([*_profile_parts(gaps=True), f"samples AS ({_sample_lines(TABLES, True)})"], """
            SELECT source_name, "column", null_ratio, cardinality_ratio, sample_values
            FROM profile JOIN samples USING (source_name, "column")"""),
        "checked_flags": _with(_profile_parts(gaps=True), 'SELECT source_name, "column", null_ratio, is_probable_id FROM profile'),
        "concept_map": _with([*_concept_parts(suggestions=True), f"samples AS ({_sample_lines(TABLES, True)})"], """
            SELECT mapped.* REPLACE (replace(dtype, 'array<float>', 'array<bigint>') AS dtype), sample_values
            FROM mapped JOIN samples USING (source_name, "column")"""),
        "concept_rules": _mapped("rule"),
        "concept_suggestions": _mapped("suggested"),
        "suggested_by_function": _with(_concept_parts(), """
            SELECT "column", CASE WHEN contains("column", '_') THEN split_part("column", '_', -1) || ':' || least(3, max(distincts)) END AS concept
            FROM mapped JOIN full_profile USING (source_name, "column") WHERE matched_by = 'unmatched' GROUP BY 1"""),
        "available_concepts": _with(_score_parts(), "SELECT concept, columns, null_ratio FROM available"),
        "matched_required": _needs("yes", "have"),
        "missing_required": _needs("yes", "NOT have"),
        "matched_nice": _needs("no", "have"),
        "coverage": _with(_score_parts(), """
            SELECT name, coverage_pct, required_null_ratio, matched, missing, nice FROM scored"""),
        "readiness": _with(_score_parts(), "SELECT name, readiness, label, required_null_ratio FROM scored"),
        "score_by_scope": _with(_score_parts(scoped=True), """
            SELECT scope AS source_name, name, coverage_pct, readiness, required_null_ratio, missing FROM scored
            WHERE matched <> '' OR nice <> ''"""),
        "scopes_without": _with(_score_parts(scoped=True), """
            SELECT name, count(*) FILTER (WHERE matched = '' AND nice = '') AS scopes, 0.0::DOUBLE AS coverage_pct FROM scored GROUP BY name"""),
        "gap_report": _with(_score_parts(), "SELECT name, gap, required_null_ratio FROM scored"),
        "scenario_cards": _with(_score_parts(), """
            SELECT template_order, name, coverage_pct, label AS readiness, description, gap, required_null_ratio
            FROM scored JOIN templates USING (template_order, name)"""),
        "scenario_ranking": _ranking(ALIGNED_RULES),
        "builtin_rules_ranking": _ranking(fixed.CONCEPT_RULES),
        "advice": _advice(),
    }
