"""DuckDB twin of the secret scan: positions from the pieces between matches."""

from __future__ import annotations

from . import secrets as s


def _spans(kind: int, pattern: str, keep: str) -> str:
    """Spans of one kind; ``keep`` tests the match ``m``."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {kind} AS kind, {s.KINDS[kind]!r} AS name, pos AS s, pos + length(m) AS e FROM (
  SELECT doc_id, ms[i] AS m,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM documents WHERE text IS NOT NULL) a) b) c
WHERE {keep}"""


def _group(pattern: str, least: int) -> str:
    """The last group of ``pattern`` (a run at its end) has so many characters."""
    p = pattern.replace("'", "''")
    return f"length(regexp_extract(m, '^(?:{p})$', 1)) >= {least}"


def sql() -> str:
    mixed = "length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    base = " UNION ALL ".join([
        _spans(0, s.ASSIGN, _group(s.ASSIGN, 6)), _spans(1, s.ACCESS, "length(m) >= 20"), _spans(2, s.HEX, "length(m) >= 24")])
    more = " UNION ALL ".join([_spans(3, s.IDENT, _group(s.IDENT, 3)), _spans(4, s.TOKEN, mixed), _spans(5, s.ENDPOINT, "true")])
    return f"""
WITH base AS ({base}),
weak0 AS ({more}),
weak AS (SELECT * FROM weak0 w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT *, CASE WHEN kind IN (0, 2, 4) THEN 1 ELSE 0 END AS secret FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) q),
found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM weak w WHERE EXISTS (
    SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.secret <> (CASE WHEN w.kind = 4 THEN 1 ELSE 0 END)
      AND p.e >= w.s - {s.SCOPE} AND p.s <= w.e + {s.SCOPE})),
b AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
             string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM base GROUP BY doc_id),
f AS (SELECT doc_id, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(f.spans, '') AS spans
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id"""
