"""SQL that the queries of this package are held against, in DuckDB's dialect."""

from __future__ import annotations

import unicodedata

from fiscalith.llm.lookalike import _SIGNS, PROTOTYPE, SPELLINGS
from fiscalith.plans.sql_terms import AGENCY, FUNDING_TYPE, YEAR, canonical_number

_P1 = f"""
WITH usable AS (SELECT DISTINCT id FROM policy_chunks WHERE length(trim(regexp_replace(text, '[\\s\\x{{85}}\\p{{Z}}]', '', 'g'))) > 0),
hits AS (SELECT {canonical_number('pe_number')} AS pe_number, chunk_id, max(relevance_score) AS score
  FROM chunk_hits WHERE relevance_score >= 0 AND relevance_score <= 1 AND NOT isnan(relevance_score)
    AND chunk_id IN (SELECT id FROM usable) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pe_number ORDER BY score DESC, chunk_id) AS position FROM hits)
"""

_P2 = r"""
WITH long AS (SELECT parsed_id, text FROM parsed_chunks WHERE length(text) >= 3204),
units AS (SELECT parsed_id,
  list_max(list_transform(regexp_split_to_array(text, '\s*\n\s*\n\s*'), lambda u: length(u))) AS p,
  list_max(list_transform(regexp_split_to_array(text, '\s*\n\s*'), lambda u: length(u))) AS l,
  list_max(list_transform(regexp_split_to_array(regexp_replace(text, '([.?!])\s+', '\1' || chr(10), 'g'), '\s*\n\s*'), lambda u: length(u))) AS s,
  list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda u: length(u))) AS w
  FROM long)
SELECT parsed_id, CASE WHEN p <= 3203 THEN 'paragraph' WHEN l <= 3203 THEN 'line' WHEN s <= 3203 THEN 'sentence'
  WHEN w <= 3203 THEN 'word' ELSE 'none' END AS boundary FROM units
"""

_WS = "\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}"

# Runs of white space as cuts, then piece by piece: the strongest cut of the window, the rightmost of equals, and back by the overlap.
_PIECES = f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS k, parsed_id, section_id, text FROM parsed_chunks),
tok AS (SELECT k, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT k, regexp_extract_all(text, '[{_WS}]+|[^{_WS}]+') AS ts FROM src WHERE length(text) >= 3204)),
pos AS (SELECT *, CAST(sum(length(t)) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS b, lag(right(t, 1)) OVER (PARTITION BY k ORDER BY i) AS before FROM tok),
cuts AS (SELECT k, b - length(t) AS e, b AS s, CASE WHEN length(t) - length(replace(t, chr(10), '')) >= 2 THEN 4 WHEN contains(t, chr(10)) THEN 3
    WHEN before IN ('.', '?', '!') THEN 2 ELSE 1 END AS strength FROM pos WHERE regexp_matches(t, '^[{_WS}]')),
walk AS (SELECT k, 0 AS idx, 0::BIGINT AS start, 0::BIGINT AS done, NULL::INTEGER AS cut, length(text)::BIGINT AS n FROM src WHERE length(text) >= 3204
  UNION ALL
  SELECT b.k, b.idx + 1, coalesce(min(c.s), b.done - 160), b.done, b.cut, b.n FROM (
      SELECT w.k, w.idx, w.n, coalesce(arg_max(c.e, (c.e >= w.start + 1601, c.strength, c.e)), w.start + 3203) AS done,
        coalesce(arg_max(c.strength, (c.e >= w.start + 1601, c.strength, c.e)), 0)::INTEGER AS cut
      FROM walk w LEFT JOIN cuts c ON c.k = w.k AND c.e > w.done + 160 AND c.e <= w.start + 3203
      WHERE w.n - w.start > 3203 GROUP BY w.k, w.idx, w.n, w.start, w.done) b
    LEFT JOIN cuts c ON c.k = b.k AND c.s >= b.done - 160 AND c.s < b.done GROUP BY b.k, b.idx, b.done, b.cut, b.n),
spans AS (SELECT k, idx, start, coalesce(lead(done) OVER w, n) - start AS size, lead(cut) OVER w AS cut FROM walk WINDOW w AS (PARTITION BY k ORDER BY idx)),
kind AS (SELECT DISTINCT parsed_id, boundary FROM ({_P2}))
SELECT parsed_id, section_id, idx AS piece_index, start, substr(text, start + 1, size) AS text, CAST(greatest(1, size // 4) AS INTEGER) AS token_count,
  ['none', 'word', 'sentence', 'line', 'paragraph'][cut + 1] AS cut, boundary FROM spans JOIN src USING (k) JOIN kind USING (parsed_id)
UNION ALL SELECT parsed_id, section_id, 0, 0, text, CAST(greatest(1, length(text) // 4) AS INTEGER), NULL, NULL FROM src WHERE text IS NULL OR length(text) < 3204"""

_P3 = f"""
WITH RECURSIVE element AS (SELECT id AS row_id, min(id) OVER (PARTITION BY {canonical_number('pe_number')}, {AGENCY}) AS program_element_id,
    TRY_CAST(line_item_number AS BIGINT) AS line_number, TRY_CAST(act_code AS INTEGER) AS activity FROM program_elements),
lines AS (SELECT f.id, e.program_element_id, e.line_number, e.activity,
    f.year AS fiscal_year, f.type AS funding_type,
    CASE WHEN isfinite(f.amount_thousands) THEN f.amount_thousands END AS amount, s.document_type, f.loaded_at
  FROM (SELECT *, {YEAR} AS year, {FUNDING_TYPE} AS type FROM funding_lines) f
  JOIN element e ON e.row_id = f.program_element_id LEFT JOIN source_documents s ON s.id = f.source_document_id),
grouped AS (SELECT *, count(*) OVER (PARTITION BY program_element_id, fiscal_year, funding_type) AS group_size
  FROM lines WHERE fiscal_year IS NOT NULL AND funding_type IS NOT NULL)
"""

_KEYS = "program_element_id, fiscal_year, funding_type"
_BEST = """SELECT program_element_id, fiscal_year, funding_type, id AS survivor_id FROM (SELECT *, row_number() OVER (PARTITION BY program_element_id, fiscal_year,
  funding_type ORDER BY amount IS NULL, coalesce(document_type = 'R1', false) DESC, loaded_at DESC NULLS LAST, id) AS place FROM grouped WHERE group_size > 1) WHERE place = 1"""

# Candidates of each completeness and trust; layers as the longest chain of dominating candidates; values from the first candidate that has them.
_SURVIVORS = f""",
m AS (SELECT *, (amount IS NOT NULL)::INTEGER + (line_number IS NOT NULL)::INTEGER + (activity IS NOT NULL)::INTEGER AS complete,
    CASE document_type WHEN 'R1' THEN 3 WHEN 'R1-AMENDED' THEN 2 WHEN 'R1-OCR' THEN 1 ELSE 0 END AS trust FROM grouped WHERE group_size > 1),
cand AS (SELECT * FROM m WINDOW c AS (PARTITION BY {_KEYS}, complete, trust ORDER BY loaded_at DESC, id)
  QUALIFY row_number() OVER c = 1 OR (amount IS NOT NULL AND row_number() OVER (PARTITION BY {_KEYS}, complete, trust, amount IS NULL ORDER BY loaded_at DESC, id) = 1)
    OR (line_number IS NOT NULL AND row_number() OVER (PARTITION BY {_KEYS}, complete, trust, line_number IS NULL ORDER BY loaded_at DESC, id) = 1)
    OR (activity IS NOT NULL AND row_number() OVER (PARTITION BY {_KEYS}, complete, trust, activity IS NULL ORDER BY loaded_at DESC, id) = 1)),
dom AS (SELECT a.id AS upper, b.id AS lower FROM cand a JOIN cand b USING ({_KEYS}) WHERE a.complete >= b.complete AND a.trust >= b.trust AND a.loaded_at >= b.loaded_at
    AND (a.complete > b.complete OR a.trust > b.trust OR a.loaded_at > b.loaded_at)),
chain AS (SELECT id, 1 AS layer FROM cand UNION SELECT lower, layer + 1 FROM chain JOIN dom ON upper = id),
placed AS (SELECT cand.*, l.layer, row_number() OVER (PARTITION BY {_KEYS} ORDER BY l.layer, complete DESC, trust DESC, loaded_at DESC, cand.id) AS place
  FROM cand JOIN (SELECT id, max(layer) AS layer FROM chain GROUP BY id) l USING (id))
SELECT {_KEYS}, max(group_size) AS group_size, arg_min(id, place) AS survivor_id, CAST(count(*) FILTER (WHERE layer = 1) AS INTEGER) AS skyline_size,
  {', '.join(f"arg_min({c}, place) FILTER (WHERE {c} IS NOT NULL) AS {n}, arg_min(id, place) FILTER (WHERE {c} IS NOT NULL) AS {n}_from" for c, n in (("amount", "amount_thousands"), ("line_number", "line_number"), ("activity", "activity")))}
FROM placed GROUP BY {_KEYS}"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def _alike() -> dict[str, str]:
    """Letters with accents included, and signs, by what they look like, for texts with accents composed."""
    out = dict(PROTOTYPE)
    for ch in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))):
        shown = unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch).translate(str.maketrans(PROTOTYPE)))
        if shown != ch and len(shown) == 1:
            out[ch] = shown
    return out | {chr(code): sign for code, sign in _SIGNS.items()}


_FROM, _TO = ("".join(x) for x in zip(*_alike().items()))


def _look(column: str) -> str:
    """The look of a text as SQL: hidden signs out, one width, accents composed, look-alikes by their Latin letter."""
    x = f"regexp_replace({column}, '[\\x{{ad}}\\x{{34f}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    x = f"translate(nfc_normalize({x}), {_quoted(_WIDE + _FROM + _BLANKS)}, {_quoted(_NARROW + _TO + ' ' * len(_BLANKS))})"
    for joined, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{joined}', '{letters}')"
    return f"nfc_normalize({x})"


def _windows(table: str, key: str) -> str:
    return f"""SELECT {key}, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + 9 AS BIGINT)), ' ') AS k FROM (
      SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (
        SELECT {key}, regexp_extract_all(lower({_look('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL))"""


def _spelled(column: str, script: str) -> str:
    """A look written in ``script``, letters with accents included."""
    to = {p: by[script] for p, by in SPELLINGS.items() if script in by}
    for ch in map(chr, range(0x370, 0x530)):
        shown = unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch).translate(str.maketrans(PROTOTYPE)))
        back = unicodedata.normalize("NFC", unicodedata.normalize("NFD", shown).translate(str.maketrans(to)))
        if shown != ch and len(shown) == len(back) == 1 and back != shown:
            to[shown] = back
    return f"translate({column}, {_quoted(''.join(to))}, {_quoted(''.join(to.values()))})"


_FORMS = f"f AS (SELECT doc_id, text, {_look('text')} AS f FROM documents WHERE text IS NOT NULL)"

# Each token by the scripts that can write all of it, then the script of most tokens that only one can, then each token in its script.
_SCRIPTS = ["LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU"]
_CAN = ", ".join(
    f"CASE WHEN NOT regexp_matches(strip_accents(t), '[^{''.join(p for p, by in SPELLINGS.items() if s in by) if s != 'LATIN' else ''}\\p{{{s.title()}}}\\p{{M}}\\p{{N}}]') THEN '{s}' END" for s in _SCRIPTS
)
_P8_FORMS = f"""WITH {_FORMS},
t AS (SELECT doc_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (SELECT doc_id, regexp_extract_all(f, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') AS ts FROM f)),
k AS (SELECT *, CASE WHEN regexp_matches(t, '^\\p{{L}}') THEN list_filter([{_CAN}], lambda x: x IS NOT NULL) END AS s FROM t),
n AS (SELECT doc_id, s[1] AS script, count(*) AS n FROM k WHERE len(s) = 1 GROUP BY ALL),
m AS (SELECT doc_id, CASE WHEN list_contains(list(script), 'LATIN') THEN 'LATIN' ELSE min(script) END AS main
  FROM (SELECT * FROM n QUALIFY n = max(n) OVER (PARTITION BY doc_id)) GROUP BY doc_id),
w AS (SELECT k.*, CASE WHEN len(s) = 1 THEN s[1] WHEN list_contains(s, coalesce(main, 'LATIN')) THEN coalesce(main, 'LATIN') ELSE 'LATIN' END AS script FROM k LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, string_agg(CASE WHEN s IS NULL THEN t {' '.join(f"WHEN script = '{s}' THEN {_spelled('t', s)}" for s in _SCRIPTS[1:])} ELSE t END, '' ORDER BY i) AS form FROM w GROUP BY doc_id),
a AS (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.form, '') END AS form FROM documents d LEFT JOIN r USING (doc_id))
SELECT doc_id, form, coalesce(regexp_matches(form, '[^\\s\\x{{85}}\\p{{Z}}]'), false) AS shows FROM a"""

ORACLES = {
    "p1_found": _P1 + "SELECT pe_number, chunk_id FROM ranked WHERE position <= 10",
    "p1_top_chunks": _P1 + "SELECT pe_number, CAST(position AS INTEGER) AS position, chunk_id, score FROM ranked WHERE position <= 10",
    "p2_found": _P2,
    "p2_pieces": _PIECES,
    "p3_found": _P3 + _BEST,
    "p3_survivors": _P3 + _SURVIVORS,
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": f"WITH d AS ({_windows('documents', 'doc_id')}), e AS ({_windows('eval_items', 'item_id')}) "
    "SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (k)",
    "p8_found": f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text "
    "WHERE regexp_matches(a.f, '[^\\s\\x{85}\\p{Z}]')",
    "p8_forms": _P8_FORMS,
    "p8_classes": f"""WITH {_FORMS}, c AS (SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS class_size, count(*) OVER w - count(*) OVER (PARTITION BY f, text) AS links, f
        FROM f WHERE regexp_matches(f, '[^\\s\\x{{85}}\\p{{Z}}]') WINDOW w AS (PARTITION BY f))
      SELECT doc_id, class_id, class_size, spellings, links FROM c JOIN (SELECT f, count(DISTINCT text) AS spellings FROM f GROUP BY f) s USING (f) WHERE links > 0""",
}
