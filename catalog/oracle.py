"""SQL building blocks of the oracles, written without the library's operators."""

from __future__ import annotations

from wardbook.plans import head_trauma as study
from wardbook.sources.visits import VISIT_COLUMNS, visits_query

NAMES = {raw: study.NAME_MAPPING.get(raw, raw) for raw in VISIT_COLUMNS}
COLUMNS = list(NAMES.values())
CODED = [c for c in COLUMNS if c != "event_id"]
E, V, M, T = "gcs_eye_score", "gcs_verbal_score", "gcs_motor_score", "gcs_total_score"
FINDINGS = ["ct_finding_epidural_hematoma", "ct_finding_skull_fracture"]
OUTCOME = "has_clinically_important_tbi"


def _replacing(source: str, **changes: str) -> str:
    """SELECT all visit columns from a CTE with some of them computed."""
    columns = ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in COLUMNS)
    return f"SELECT {columns} FROM {source}"


def _int_types(source: str, extra: str = "") -> str:
    columns = ", ".join(
        c if c == "event_id" else f"CAST({c} AS {'BIGINT' if c == 'patient_number' else 'INTEGER'}) AS {c}"
        for c in COLUMNS
    )
    return f"SELECT {columns}{extra} FROM {source}"


IMPUTED = _replacing(
    "nulled",
    **{
        E: f"CASE WHEN {E} IS NULL AND {V} IS NOT NULL AND {M} IS NOT NULL AND {T} IS NOT NULL THEN {T}-{V}-{M} ELSE {E} END",
        V: f"CASE WHEN {V} IS NULL AND {E} IS NOT NULL AND {M} IS NOT NULL AND {T} IS NOT NULL THEN {T}-{E}-{M} ELSE {V} END",
        M: f"CASE WHEN {M} IS NULL AND {E} IS NOT NULL AND {V} IS NOT NULL AND {T} IS NOT NULL THEN {T}-{E}-{V} ELSE {M} END",
    },
)
TOTAL_SQL = f"coalesce({E}+{V}+{M}, {T})"
CATEGORY_SQL = f"CASE WHEN {T} <= 13 THEN 1 WHEN {T} >= 14 THEN 2 ELSE gcs_category END"
PROMOTE_SQL = (
    f"CASE WHEN coalesce(ct_shows_tbi, 0) = 0 AND ({FINDINGS[0]} = 1 OR {FINDINGS[1]} = 1)"
    " AND skull_fracture_depressed = 1 THEN 1 ELSE ct_shows_tbi END"
)
MONTHS_SQL = "CASE WHEN patient_age_months IS NULL AND patient_age_years = 0 THEN 0 ELSE patient_age_months END"
SNAP_SQL = {
    E: f"CASE WHEN {E} = 5 THEN 4 ELSE {E} END",
    V: f"CASE WHEN {V} = 0 THEN 1 WHEN {V} = 6 THEN 5 ELSE {V} END",
    T: f"{T} - CASE WHEN {E} = 5 THEN 1 ELSE 0 END + CASE WHEN {V} = 0 THEN 1 ELSE 0 END - CASE WHEN {V} = 6 THEN 1 ELSE 0 END",
}


def ids_filled(source: str, id_col: str, key: str) -> str:
    """(key, new_id) of the rows without an id."""
    return f"""SELECT m.{key} AS key_value, g.id AS new_id FROM
        (SELECT {key}, row_number() OVER (ORDER BY {key}) AS rn FROM {source} WHERE {id_col} IS NULL) m
        JOIN (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM
              (SELECT unnest(range(lo, hi + 1)) AS id FROM (SELECT min({id_col}) AS lo, max({id_col}) AS hi FROM {source}))
              WHERE id NOT IN (SELECT {id_col} FROM {source} WHERE {id_col} IS NOT NULL)) g USING (rn)"""


CTES = {
    "visits": visits_query("events"),
    "named": "SELECT " + ", ".join(f"{r} AS {n}" for r, n in NAMES.items()) + " FROM visits",
    "nulled": "SELECT event_id, " + ", ".join(f"nullif({c}, 92) AS {c}" for c in CODED) + " FROM named",
    "imputed": IMPUTED,
    "totaled": _replacing("imputed", **{T: TOTAL_SQL}),
    "categorised": _replacing("totaled", gcs_category=CATEGORY_SQL),
    "promoted": _replacing("categorised", ct_shows_tbi=PROMOTE_SQL),
    "aged": _replacing("promoted", patient_age_months=MONTHS_SQL),
    "snapped": _replacing("aged", **SNAP_SQL),
    "cleaned": _int_types("snapped", f", CASE WHEN {T} >= 14 THEN 1 ELSE 0 END AS in_primary_analysis"),
}


def with_ctes(last: str, final: str, **extra: str) -> str:
    """The chain of CTEs up to ``last``, then any extra ones, then the final SELECT."""
    parts = []
    for name, text in CTES.items():
        parts.append(f"{name} AS ({text})")
        if name == last:
            break
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {final}"


def raw_sql(final: str, **extra: str) -> str:
    return with_ctes("visits", final, **extra)


def named_sql(final: str, **extra: str) -> str:
    return with_ctes("named", final, **extra)


def nulled_sql(final: str, **extra: str) -> str:
    return with_ctes("nulled", final, **extra)


def cleaned_sql(final: str, **extra: str) -> str:
    return with_ctes("cleaned", final, **extra)


def pct(num: str, den: str) -> str:
    return f"(CAST(({num}) * 100 AS DOUBLE) / nullif({den}, 0))"


def div(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / nullif({den}, 0))"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def in_list(values) -> str:
    return "(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + ")"


def bins_sql(col: str, edges, labels) -> str:
    whens = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'" for lo, hi, lab in zip(edges, edges[1:], labels))
    return f"CASE {whens} END"


def bands_sql(col: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {lo}{'' if hi is None else f' AND {col} < {hi}'} THEN '{lab}'" for lo, hi, lab in bands) + " END"


def labels_sql(col: str, labels) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {code} THEN '{label}'" for code, label in labels.items()) + " END"


def values_cte(columns: list[str], rows) -> str:
    def cell(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else repr(v) + "e0" if isinstance(v, float) else str(v))

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS given({', '.join(columns)})"


def union_rows(rows: list[dict[str, str]], source: str) -> str:
    """One row per entry, each an aggregate over the same source."""
    return " UNION ALL ".join(
        "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in row.items()) + f" FROM {source}" for row in rows
    )


def sql_rules() -> list[tuple[str, str, str, str]]:
    """(check, rule, column, predicate) of the study's rules over the visit columns."""
    out = []
    for c, codes in study.VALID_CODES.items():
        if c in COLUMNS:
            out.append(("codes", f"{c} in list", c, f"{c} NOT IN {in_list(codes)}"))
    for parent, children in study.DEPENDENTS.items():
        kids = [c for c in children if c in COLUMNS]
        if parent in COLUMNS and kids:
            some = " OR ".join(f"{c} <> 0" for c in kids)
            out.append(("dependents", f"{parent} absent", parent, f"coalesce({parent}, 0) = 0 AND ({some})"))
    out.append(
        ("ratio", "patient_age_months // 12 = patient_age_years", "patient_age_months",
         "floor(patient_age_months / 12) <> patient_age_years")
    )
    out.append(
        ("category", "patient_age_under_2yr by patient_age_years", "patient_age_under_2yr",
         "patient_age_under_2yr <> CASE WHEN patient_age_years < 2 THEN 1 WHEN patient_age_years >= 2 THEN 2 END")
    )
    out.append(
        ("implies", "skull_fracture_depressed needs has_palpable_skull_fracture", "skull_fracture_depressed",
         "skull_fracture_depressed = 1 AND has_palpable_skull_fracture IS DISTINCT FROM 1")
    )
    out.append(
        ("implies",
         "hospitalized_2plus_nights_with_positive_ct needs hospitalized_2plus_nights_head_injury and ct_shows_tbi",
         "hospitalized_2plus_nights_with_positive_ct",
         "hospitalized_2plus_nights_with_positive_ct = 1 AND (hospitalized_2plus_nights_head_injury IS DISTINCT FROM 1"
         " OR ct_shows_tbi IS DISTINCT FROM 1)")
    )
    out.append(
        ("implies", "head_ct_performed_in_ed needs head_ct_performed", "head_ct_performed_in_ed",
         "head_ct_performed_in_ed = 1 AND head_ct_performed IS DISTINCT FROM 1")
    )
    return out


def report_sql(rules, source: str, total: bool = True) -> str:
    rows = [
        {"\"check\"": f"'{k}'", "rule": f"'{n}'", '"column"': f"'{c}'", "n_violations": count_if(p)}
        for k, n, c, p in rules
    ]
    if total:
        everything = " + ".join(count_if(p) for *_, p in rules)
        rows.append(
            {"\"check\"": "'total'", "rule": "'all rules'", '"column"': "CAST(NULL AS VARCHAR)", "n_violations": everything}
        )
    return union_rows(rows, source)


def violations_sql(rules, source: str, key: str = "event_id") -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{k}' AS \"check\", '{n}' AS rule, '{c}' AS \"column\", CAST({c} AS BIGINT) AS \"value\" FROM {source} WHERE {p}"
        for k, n, c, p in rules
    )
