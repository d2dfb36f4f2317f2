"""SQL of queries that build on the loaded delivery records or on several other queries."""

from __future__ import annotations

from fiscalith.functions.text import BUDGET_ACTIVITIES
from fiscalith.plans.listing import LISTED_SQL
from fiscalith.plans.policy import to_elements_sql
from fiscalith.plans.quality_sql import ORACLES as QUALITY
from fiscalith.plans.trends import BASE_SQL, _wide_sql

_ROWS = f"rows AS ({QUALITY['p4_rows']})"
_FIRST = """SELECT pe_number, agency, arg_min(filename, raw_id) AS filename, min_by([TRY_CAST(line_no AS BIGINT)], raw_id)[1] AS line_no,
    min_by([pe_title], raw_id)[1] AS pe_title, min_by([act_code], raw_id)[1] AS act_code, arg_min(is_classified, raw_id) AS is_classified FROM {source} GROUP BY pe_number, agency"""
_SHAPED = f"""WITH {_ROWS}, d AS (SELECT r.raw_id, coalesce(nullif(l.source_file, ''), 'unknown') AS filename, TRY_CAST(r.fiscal_year AS INTEGER) AS fy,
    trim(coalesce(r.component, 'Unknown')) AS agency, r.pe_title, r.line_no, r.act_code, coalesce(r.pe_number = '999999999', false) AS is_classified,
    CASE WHEN r.pe_number = '999999999' THEN '' ELSE r.pe_number END AS pe, r.py_amount, r.cy_amount, r.by_amount
    FROM rows r JOIN raw_r1_lines l USING (raw_id)),
  c AS (SELECT *, CASE WHEN is_classified OR trim(coalesce(pe, '')) = '' THEN concat_ws('_', 'CLASSIFIED', agency, coalesce(trim(act_code), ''), fy)
    ELSE trim(pe) END AS pe_number FROM d WHERE fy IS NOT NULL),
  docs AS (SELECT row_number() OVER (ORDER BY filename) AS id, filename FROM (SELECT DISTINCT filename FROM c)),
  els AS (SELECT row_number() OVER (ORDER BY pe_number, agency) AS id, * FROM ({_FIRST.format(source='c')}))
"""
_ACTIVITY = "CASE act_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BUDGET_ACTIVITIES.items()) + " ELSE 'BA' || act_code END"
_LONG = "UNION ALL ".join(
    f"SELECT {{keep}}, CAST({{fy}} - {back} AS INTEGER) AS fiscal_year, '{kind}' AS funding_type, {c} AS amount_thousands FROM {{source}} "
    f"WHERE {c} IS NOT NULL AND {{fy}} IS NOT NULL "
    for back, kind, c in ((2, "PY Actual", "py_amount"), (1, "CY Request", "cy_amount"), (0, "BY Request", "by_amount"))
)
# A second load: files of odd years first, then the others, everything numbered on.
_TWICE = f""", o AS (SELECT *, CASE WHEN TRY_CAST(nullif(regexp_extract(filename, '([0-9]{{4}})', 1), '') AS INTEGER) % 2 = 1 THEN 1 ELSE 2 END AS round FROM c),
  docs2 AS (SELECT row_number() OVER (ORDER BY round, filename) AS id, round, filename, year FROM (SELECT round, filename, arg_min(fy, raw_id) AS year FROM o GROUP BY ALL)),
  e2 AS (SELECT 1 AS round, * FROM ({_FIRST.format(source='(SELECT * FROM o WHERE round = 1)')}) UNION ALL
    SELECT 2, * FROM ({_FIRST.format(source='(SELECT * FROM o WHERE round = 2)')}) WHERE (pe_number, agency) NOT IN (SELECT (pe_number, agency) FROM o WHERE round = 1)),
  els2 AS (SELECT row_number() OVER (ORDER BY round, pe_number, agency) AS id, * FROM e2)
"""
_ELEMENT = f"""pe_number, CAST(line_no AS VARCHAR) AS line_item_number, trim(coalesce(pe_title, 'Unknown')) AS program_name,
      agency, CAST(NULL AS VARCHAR) AS appropriation, nullif(trim({_ACTIVITY}), '') AS budget_activity, nullif(trim(act_code), '') AS act_code, is_classified"""
_YEARS = range(2018, 2027)

ORACLES = {
    "tvf02_listing_of_records": f"WITH {_ROWS}, {LISTED_SQL}",
    "pvt02_unpivot": f"WITH {_ROWS} " + _LONG.format(keep="raw_id, pe_number", fy="TRY_CAST(fiscal_year AS INTEGER)", source="rows"),
    "tvf03_deduplicated": f"""WITH {_ROWS} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year, component, pe_number, act_code
      ORDER BY (py_amount IS NOT NULL)::INTEGER + (cy_amount IS NOT NULL)::INTEGER + (by_amount IS NOT NULL)::INTEGER DESC, line_no NULLS LAST, raw_id) AS n
      FROM rows) WHERE n = 1""",
    "dml03_elements": _SHAPED + f"SELECT els.id, docs.id AS source_document_id, {_ELEMENT} FROM els JOIN docs USING (filename)",
    "dml03_lines": _SHAPED
    + "SELECT row_number() OVER (ORDER BY raw_id, funding_type) AS id, els.id AS program_element_id, f.fiscal_year, f.funding_type, f.amount_thousands, f.raw_id FROM ("
    + _LONG.format(keep="raw_id, pe_number, agency", fy="fy", source="c")
    + ") f JOIN els USING (pe_number, agency)",
    "dml01_second_load": _SHAPED + _TWICE + f"SELECT els2.id, docs2.id AS source_document_id, {_ELEMENT} FROM els2 JOIN docs2 USING (filename)",
    "dml01_documents": _SHAPED
    + _TWICE
    + "SELECT id, filename, 'R1' AS document_type, year AS publication_year, CASE round WHEN 1 THEN '2026-01-01' ELSE '2026-02-01' END AS processed_date FROM docs2",
    "dml01_lines": _SHAPED
    + _TWICE
    + "SELECT row_number() OVER (ORDER BY round, raw_id, funding_type) AS id, els2.id AS program_element_id, f.fiscal_year, f.funding_type, f.amount_thousands, f.raw_id FROM ("
    + _LONG.format(keep="round, raw_id, pe_number, agency", fy="fy", source="o")
    + ") f JOIN (SELECT id, pe_number, agency FROM els2) els2 USING (pe_number, agency)",
    "ana10_gap_analysis": BASE_SQL
    + f""", {to_elements_sql("doc_type = 'NDAA'")}, w AS (SELECT pe_id, {_wide_sql(2018, 2026, 'FY{}_$M')} FROM facts WHERE funding_type = 'BY Request' AND fiscal_year BETWEEN 2018 AND 2026 GROUP BY pe_id),
      y AS (SELECT min(fiscal_year) AS first_fy, max(fiscal_year) AS last_fy FROM facts WHERE funding_type = 'BY Request' AND fiscal_year BETWEEN 2018 AND 2026),
      t AS (SELECT w.*, CASE first_fy {' '.join(f'WHEN {n} THEN "FY{n}_$M"' for n in _YEARS)} END AS va, CASE last_fy {' '.join(f'WHEN {n} THEN "FY{n}_$M"' for n in _YEARS)} END AS vb FROM w, y)
      SELECT b.query, b.pe_id, e.pe_number, e.program_name, e.agency, e.budget_activity, CAST(round(CAST(score AS DECIMAL(28,8)), 4) AS DOUBLE) AS relevance_score,
        coalesce(policy_context, '') AS policy_context, {', '.join(f'CAST(round(CAST("FY{n}_$M" / 1000 AS DECIMAL(28,8)), 3) AS DOUBLE) AS "FY{n}_$M"' for n in _YEARS)},
        CASE WHEN t.pe_id IS NULL THEN NULL WHEN vb > va * 1.05 THEN '↑ UP' WHEN vb < va * 0.95 THEN '↓ DOWN' ELSE '→ FLAT' END AS funding_trend
      FROM b JOIN elements e USING (pe_id) LEFT JOIN x ON x.query = b.query LEFT JOIN t ON t.pe_id = b.pe_id""",
}
