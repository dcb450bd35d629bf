"""The base columns of the quality rules, personal data and secrets against SQL over the whole table."""

from __future__ import annotations

import duckdb
import pytest

from token_ledger.llm import queries

SF = "/root/testdata/sf0.01"

#: Words, symbols, repeated lines and words in repeated windows of eight.
OP3_BASE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
again AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM t),
keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(words, i, i + 7)) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS w FROM keyed WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM t LEFT JOIN again ON again.doc_id = t.doc_id LEFT JOIN covered ON covered.doc_id = t.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
"""

#: Matches of each kind, found by marks around them: what lies before a mark is where it starts.
SPANS = r"""
WITH kinds(k, kind, pattern) AS (VALUES {kinds}),
marked AS (
  SELECT doc_id, k, kind, pattern, string_split(regexp_replace(coalesce(text, ''), pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS parts
  FROM documents, kinds),
found AS (SELECT doc_id, k, kind, pattern, parts, unnest(range(2, len(parts) + 1)) AS j FROM marked),
placed AS (
  SELECT doc_id, k, kind, pattern, split_part(parts[j], chr(2), 1) AS m,
    list_sum(list_transform(parts[1:j - 1], lambda p: length(replace(p, chr(2), ''))))::BIGINT AS s
  FROM found),
told AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM placed),
good AS (SELECT doc_id, k, kind, s, s + length(m) AS e FROM told WHERE CASE kind {checks} END)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order_by}), '')) AS base_sha256
FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _spans(kinds: dict[str, tuple[str, str]], order_by: str) -> str:
    return SPANS.format(
        kinds=", ".join(f"({n}, '{k}', '{pattern}')" for n, (k, (pattern, _)) in enumerate(kinds.items())),
        checks=" ".join(f"WHEN '{k}' THEN {check}" for k, (_, check) in kinds.items()),
        counts=", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds),
        order_by=order_by,
    )


_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INT WHEN digits[-i]::INT > 4 THEN 2 * digits[-i]::INT - 9 ELSE 2 * digits[-i]::INT END)) % 10 = 0"
OP9_BASE = _spans(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length(digits) BETWEEN 16 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
    },
    "k, s",
)
_ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP10_BASE = _spans(
    {
        "assign": (_ASSIGN, "length(regexp_extract(m, pattern, 2)) >= 8"),
        "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
        "hex": ("[0-9a-f]+", "length(m) >= 32"),
    },
    "s, k",
)


@pytest.mark.parametrize("name,sql", [("op3_quality_rules", OP3_BASE), ("op9_pii", OP9_BASE), ("op10_secrets", OP10_BASE)])
def test_base_columns(spark, name, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
