"""DuckDB twin of operator 13's query: the cheapest edits by recursion over rows from the end, then the edits applied from the start."""

from __future__ import annotations

SQL = """
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT * EXCLUDE (key), xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS h FROM k, tbl),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
g AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
r AS (SELECT *, left(role, 1) AS c, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT AS t FROM g),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY 1),
dp AS (SELECT conv_id, rows + 1 AS i, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': 4::BIGINT, 'a': 'II'} AS s1, {'c': 2::BIGINT, 'a': 'I'} AS s2, {'c': 0::BIGINT, 'a': ''} AS s3 FROM n
  UNION ALL SELECT conv_id, i, list_min([b0, {'c': t2.c + 2, 'a': 'I' || t2.a}]), list_min([b1, {'c': t2.c + 2, 'a': 'I' || t2.a}]), t2, t3
  FROM (SELECT *, list_min([b2, {'c': b3.c + 2, 'a': 'I' || b3.a}]) AS t2, list_min([b3, {'c': b2.c + 2, 'a': 'I' || b2.a}]) AS t3
  FROM (SELECT dp.conv_id, r.i,
    list_min([{'c': s0.c + 3, 'a': 'D' || s0.a}, CASE WHEN NOT gone THEN {'c': s2.c + 2 + t, 'a': 'R' || s2.a} END, CASE WHEN NOT gone AND r.c = 's' THEN {'c': s1.c + t, 'a': 'K' || s1.a} WHEN NOT gone AND r.c = 'u' THEN {'c': s2.c + t, 'a': 'K' || s2.a} END]) AS b0,
    list_min([{'c': s1.c + 3, 'a': 'D' || s1.a}, CASE WHEN NOT gone THEN {'c': s2.c + 2 + t, 'a': 'R' || s2.a} END, CASE WHEN NOT gone AND r.c = 'u' THEN {'c': s2.c + t, 'a': 'K' || s2.a} END]) AS b1,
    list_min([{'c': s2.c + 3, 'a': 'D' || s2.a}, CASE WHEN NOT gone THEN {'c': s3.c + 2 + t, 'a': 'R' || s3.a} END, CASE WHEN NOT gone AND r.c = 'a' THEN {'c': s3.c + t, 'a': 'K' || s3.a} END]) AS b2,
    list_min([{'c': s3.c + 3, 'a': 'D' || s3.a}, CASE WHEN NOT gone THEN {'c': s2.c + 2 + t, 'a': 'R' || s2.a} END, CASE WHEN NOT gone AND r.c = 'u' THEN {'c': s2.c + t, 'a': 'K' || s2.a} END]) AS b3
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i - 1))),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM dp WHERE i = 1),
w AS (SELECT conv_id, audit, 1 AS p, 1 AS i, 0 AS q, []::VARCHAR[] AS out FROM best
  UNION ALL SELECT w.conv_id, audit, p + 1, w.i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN q WHEN e = 'K' THEN CASE r.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN q = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN out WHEN e = 'K' THEN list_append(out, role || ':' || text) ELSE list_append(out, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (SELECT *, substring(audit, p, 1) AS e FROM w WHERE p <= length(audit)) w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i),
z AS (SELECT conv_id, sha256(array_to_string(out, chr(10))) AS repaired_sha256 FROM w WHERE p = length(audit) + 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
