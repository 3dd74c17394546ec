"""ANSI SQL of those problem queries that SQL can express."""

from __future__ import annotations

P1_FOUND = """
select example_id from examples
where len(list_filter(words, lambda w: w is not null and trim(w) <> '')) > 254
"""

# By Unicode blocks and composition, not by the operator's own table: what composing
# changes (compatibility ideographs, letter-like signs, loose accents), full-width forms,
# Kangxi radicals, ligatures, Roman numerals, the micro sign, marks, invisible characters,
# other spaces, and Cyrillic and Greek letters but for α, β, γ and μ.
_WIDE, _RADICALS, _LETTERS = r"\x{ff01}-\x{ff5e}", r"\x{2e9f}\x{2ef3}\x{2f00}-\x{2fd5}", r"\x{b5}\x{2160}-\x{217f}\x{fb00}-\x{fb06}"
_UNSEEN = r"\p{Cf}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{180b}-\x{180f}\x{fe00}-\x{fe0f}"
_SPACES = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SCRIPTS = r"\x{300}-\x{36f}\x{370}-\x{3b0}\x{3b4}-\x{3bb}\x{3bd}-\x{52f}"
_variant = f"[{_WIDE}{_RADICALS}{_LETTERS}{_UNSEEN}{_SPACES}{_SCRIPTS}]"

P6_FOUND = f"""
with t as (select 'examples' as src, example_id as row_id, array_to_string(words, '') as t from examples
  union all select 'mentions', mention_id, value from mentions where category = 'Department')
select distinct src, row_id from t where regexp_matches(t, '{_variant}') or nfc_normalize(t) <> t
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p6_found": P6_FOUND}
