"""SQL that the queries of ``quality`` are held against, in DuckDB's dialect."""

from __future__ import annotations

from fiscalith.plans.sql_terms import canonical_number


def _folded(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[\\s\\x{{85}}\\x{{1c}}-\\x{{1f}}\\p{{Z}}]+', ' ', 'g'))"


_FIELD = '"(?:[^"]|"")*"|[^",]*'
_NINE = "^" + ",".join([f"({_FIELD})"] * 9) + "$"
_MONEY = r"(|-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?)"


def _value(c: str) -> str:
    return f"""(CASE WHEN starts_with(f.{c}, '"') THEN replace(substr(f.{c}, 2, len(f.{c}) - 2), '""', '"') ELSE f.{c} END)"""


def _bare(c: str) -> str:
    return f"trim({_value(c)}, ' ' || chr(9))"


def _amount(c: str) -> str:
    return f"CAST(nullif(replace({_bare(c)}, ',', ''), '') AS DOUBLE)"


_COLUMNS = ["fiscal_year", "component", "pe_number", "pe_title", "line_no", "act_code", "py_amount", "cy_amount", "by_amount"]

_P4 = f"""
WITH r AS (SELECT raw_id, rtrim(line_text, chr(10) || chr(13)) AS t FROM raw_r1_lines),
s AS (SELECT raw_id, t, regexp_full_match(t, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') AS sound,
    regexp_extract(t, '(?s){_NINE}', {_COLUMNS!r}) AS f, regexp_full_match(t, '(?s){_NINE}') AS nine FROM r),
j AS (SELECT raw_id, f, CASE WHEN NOT sound THEN 'quoting' WHEN t IS NULL OR NOT nine THEN 'columns'
    WHEN NOT regexp_full_match({_bare('pe_number')}, '(|[0-9]{{7,9}}[A-Z0-9]{{0,3}})') THEN 'pe_number'
    WHEN NOT regexp_full_match({_bare('py_amount')}, '{_MONEY}') THEN 'py_amount'
    WHEN NOT regexp_full_match({_bare('cy_amount')}, '{_MONEY}') THEN 'cy_amount'
    WHEN NOT regexp_full_match({_bare('by_amount')}, '{_MONEY}') THEN 'by_amount' END AS reason FROM s)
"""

_P5 = f"""
WITH u AS (SELECT snapshot_id, {canonical_number('pe_number')} AS pe_number, fiscal_year, {_folded('pe_title')} AS title, {_folded('budget_activity')} AS ba, loaded_at
  FROM pe_snapshots),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, pe_number, fiscal_year ORDER BY loaded_at DESC) AS n FROM u) WHERE n = 1),
o AS (SELECT snapshot_id, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS after FROM (SELECT DISTINCT snapshot_id FROM u))
"""

ORACLES = {
    "p4_found": _P4 + "SELECT raw_id, reason FROM j WHERE reason IS NOT NULL",
    "p4_rows": _P4
    + "SELECT raw_id, "
    + ", ".join(
        f"{_amount(c)} AS {c}" if c.endswith("_amount") else f"{'nullif(' + _bare(c) + ', ' + chr(39) * 2 + ')' if c == 'pe_number' else _value(c)} AS {c}"
        for c in _COLUMNS
    )
    + " FROM j WHERE reason IS NULL",
    "p5_found": _P5
    + """, a AS (SELECT o.after AS snapshot_id, d.pe_number, d.fiscal_year, d.title, d.ba FROM d JOIN o USING (snapshot_id) WHERE o.after IS NOT NULL),
b AS (SELECT * FROM d WHERE snapshot_id IN (SELECT after FROM o))
SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(a.pe_number, b.pe_number) AS pe_number,
  coalesce(a.fiscal_year, b.fiscal_year) AS fiscal_year,
  CASE WHEN a.snapshot_id IS NULL THEN 'added' WHEN b.snapshot_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.snapshot_id = b.snapshot_id AND a.pe_number = b.pe_number AND a.fiscal_year = b.fiscal_year
WHERE a.snapshot_id IS NULL OR b.snapshot_id IS NULL OR a.title IS DISTINCT FROM b.title OR a.ba IS DISTINCT FROM b.ba""",
    "p5_intervals": _P5
    + """, n AS (SELECT d.*, p.pos, CASE WHEN lag(p.pos) OVER k = p.pos - 1 AND lag(d.title) OVER k IS NOT DISTINCT FROM d.title
      AND lag(d.ba) OVER k IS NOT DISTINCT FROM d.ba THEN 0 ELSE 1 END AS starts
  FROM d JOIN (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS pos FROM o) p USING (snapshot_id)
  WINDOW k AS (PARTITION BY d.pe_number, d.fiscal_year ORDER BY p.pos)),
m AS (SELECT *, sum(starts) OVER (PARTITION BY pe_number, fiscal_year ORDER BY pos) AS island FROM n)
SELECT pe_number, fiscal_year, min(snapshot_id) AS first_snapshot, max(snapshot_id) AS last_snapshot FROM m GROUP BY pe_number, fiscal_year, island""",
}
