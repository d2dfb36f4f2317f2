"""Terms that the SQL of several queries shares, in DuckDB's dialect."""

from __future__ import annotations


def canonical_number(column: str) -> str:
    """The canonical number of a column; null for a text without digits."""
    bare = f"upper(regexp_replace({column}, '[^0-9A-Za-z]', '', 'g'))"
    digits = f"regexp_extract({bare}, '^[0-9]+')"
    return f"""(CASE WHEN regexp_matches({column}, '[0-9]') THEN lpad({digits}, CAST(greatest(7, len({digits})) AS INTEGER), '0')
  || regexp_extract({bare}, '^[0-9]+(.*)$', 1) END)"""


AGENCY = """CASE lower(regexp_replace(agency, '[^A-Za-z]', '', 'g')) WHEN 'army' THEN 'Army' WHEN 'navy' THEN 'Navy'
  WHEN 'airforce' THEN 'Air Force' WHEN 'af' THEN 'Air Force' WHEN 'spaceforce' THEN 'Space Force' WHEN 'sf' THEN 'Space Force'
  WHEN 'defensewide' THEN 'Defense-Wide' WHEN 'dw' THEN 'Defense-Wide' WHEN 'ote' THEN 'OT&E' ELSE trim(agency) END"""

YEAR = """CAST(CASE WHEN fiscal_year BETWEEN 0 AND 95 THEN fiscal_year + 2000 WHEN fiscal_year BETWEEN 96 AND 99 THEN fiscal_year + 1900
  ELSE fiscal_year END AS INTEGER)"""

FUNDING_TYPE = " ".join(
    ["CASE"]
    + [
        f"WHEN regexp_matches(lower(regexp_replace(funding_type, '[^A-Za-z]', '', 'g')), '^({forms})') THEN '{name}'"
        for forms, name in (("py|prioryear", "PY Actual"), ("cy|currentyear", "CY Request"), ("by|budgetyear", "BY Request"))
    ]
    + ["END"]
)


def words(values: list[str]) -> str:
    """A list of SQL texts."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rounded(value: str, digits: int) -> str:
    """As ``numeric.rounded``."""
    return f"CAST(round(CAST({value} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"


def hashed_vectors(name: str, rows: str, dim: int = 256) -> str:
    """CTEs of ``vectors.hashed_embedding``: ``name`` has id, dim and value of what is not 0, for ``rows`` of id and text."""
    return f"""{name}_w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[{SPACES}]+'), lambda w: w <> '')) AS w FROM ({rows})),
      {name}_g AS (SELECT id, 2 AS weight, w AS g FROM {name}_w UNION ALL
        SELECT id, 1, unnest(list_transform(range(1, len(w) + 1), lambda i: substr('^' || w || '$', CAST(i AS BIGINT), 3))) FROM {name}_w),
      {name}_h AS (SELECT id, weight, CAST('0x' || md5(g)[1:16] AS UBIGINT) AS h FROM {name}_g),
      {name} AS (SELECT id, h % {dim} AS dim, sum(CASE WHEN h >= 9223372036854775808 THEN weight ELSE -weight END)::DOUBLE AS value FROM {name}_h GROUP BY ALL HAVING value <> 0)"""


def cosines(name: str, left: str, right: str) -> str:
    """A CTE ``name`` of query, other and score of all pairs of two CTEs of vectors that share a dimension."""
    return f"""{left}_n AS (SELECT id, sqrt(sum(value * value)) AS n FROM {left} GROUP BY id), {right}_n AS (SELECT id, sqrt(sum(value * value)) AS n FROM {right} GROUP BY id),
      {name} AS (SELECT a.id AS query, b.id AS other, round(sum(a.value * b.value) / any_value(an.n) / any_value(bn.n), 6) AS score FROM {left} a JOIN {right} b USING (dim)
        JOIN {left}_n an ON an.id = a.id JOIN {right}_n bn ON bn.id = b.id GROUP BY a.id, b.id)"""
