"""DuckDB twin of the I-Match query."""

from __future__ import annotations

from pairweave.llm import imatch as I


def _likeness(x: str, y: str, p: str, q: str) -> str:
    groups = range(1, I.SUBSETS + 1, I.PER_RATE)
    either = ["(" + " + ".join(f"({p}[{s}] <> '' OR {q}[{s}] <> '')::INT" for s in range(g, g + I.PER_RATE)) + ")" for g in groups]
    equal = ["(" + " + ".join(f"({p}[{s}] <> '' AND {p}[{s}] = {q}[{s}])::INT" for s in range(g, g + I.PER_RATE)) + ")" for g in groups]
    best = ", ".join(f"CASE WHEN {e} >= 2 THEN {m}::DOUBLE / {e} ELSE 0.0 END" for e, m in zip(either, equal))
    return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN {' + '.join(either)} = 0 THEN 0.0::DOUBLE ELSE greatest({best}, ({' + '.join(equal)})::DOUBLE / ({' + '.join(either)})) END"


def _parts(t: str) -> str:
    def one(s: int) -> str:
        inside = f"list_filter({t}, lambda x: substring(md5(x), {2 * s + 1}, 2) < '{I.RATES[s // I.PER_RATE]}')"
        return f"CASE WHEN len({inside}) > 0 THEN substring(md5(array_to_string({inside}, ' ')), 1, {I.DIGITS}) ELSE '' END"

    return "[" + ", ".join(one(s) for s in range(I.SUBSETS)) + "]"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER w AS r, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, count(*) OVER () AS n FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC)),
e AS (SELECT *, length(text) // 3 AS third, substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS edited FROM o),
v AS (SELECT r, 0 AS v, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e),
w AS (SELECT r, v, unnest(list_distinct(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS term FROM v),
x AS (SELECT term FROM w WHERE v = 0 GROUP BY term HAVING count(*) * {I.LEAST} >= (SELECT count(*) FROM d) AND count(*) * {I.MOST} <= (SELECT count(*) FROM d)),
g AS (SELECT r, v, list(term ORDER BY term) AS terms FROM w JOIN x USING (term) GROUP BY r, v),
p AS (SELECT v.r, v.v, {_parts("coalesce(g.terms, [])")} AS parts, CASE WHEN g.terms IS NULL THEN 'x' || md5(v.t) END AS whole FROM v LEFT JOIN g ON v.r = g.r AND v.v = g.v),
f AS (SELECT r, v, parts, coalesce(whole, array_to_string(parts, ':')) AS fp FROM p)
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  {_likeness("a.fp", "b.fp", "a.parts", "b.parts")} AS near_edited, {_likeness("a.fp", "c.fp", "a.parts", "c.parts")} AS near_next
FROM e JOIN f a ON a.r = e.r AND a.v = 0 JOIN f b ON b.r = e.r AND b.v = 1 JOIN f c ON c.v = 0 AND c.r = e.r % e.n + 1
"""
