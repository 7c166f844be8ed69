"""Queries over nested documents and marked sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairweave.functions.nested import json_first
from pairweave.operators import sequences as S
from pairweave.plans.registry import query, table
from pairweave.plans.structure import points

DOC = """CASE o_orderkey % 5
  WHEN 0 THEN '{"meta":{"id":' || o_orderkey || ',"runs":[{"note":"x"},{"iterations":' || o_custkey || '}]},"iterations":-1}'
  WHEN 1 THEN '{"b":{"iterations":' || o_custkey || '},"a":{"iterations":-2}}'
  WHEN 2 THEN '{"text":"{\\"iterations\\":-3}","deep":[{"deep":[{"iterations":"' || o_orderstatus || '"}]}]}'
  WHEN 3 THEN '{"a":{"iterations":null,"b":{"iterations":-4}},"iterations":[' || o_custkey || ',2]}'
  ELSE '{"id":' || o_orderkey || ',"runs":[1,"iterations",null]}' END"""


@query(f"""WITH d AS (SELECT o_orderkey, {DOC} AS doc FROM orders),
t AS (SELECT o_orderkey, t.id, t.path, t.type, t.value FROM d, json_tree(d.doc) t WHERE t.key = 'iterations'),
f AS (SELECT o_orderkey, arg_min(value, id) AS value FROM t WHERE type <> 'NULL' AND NOT EXISTS (SELECT 1 FROM t x WHERE x.o_orderkey = t.o_orderkey AND x.type = 'NULL' AND x.id < t.id AND starts_with(t.path, x.path)) GROUP BY 1)
SELECT o_orderkey, value ->> '$' AS iterations FROM d LEFT JOIN f USING (o_orderkey)""")
def sca4_first_match(spark, d):
    """Run descriptions made of orders, with the number sought at different depths, behind a look-alike, a null, or nowhere."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(DOC.replace("\\", "\\\\")).alias("doc"))
    return rows.select("o_orderkey", json_first(F.col("doc"), "iterations").alias("iterations"))


LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, {LETTERS} AS marked FROM documents),
c AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(marked, '[a-z][a-z]+', '!', 'g') ELSE regexp_replace(marked, '[a-z]+', '!', 'g') END, '[a-z]', '', 'g') AS chain FROM d),
g AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(marked, '^[a-z]+', ''), '[a-z]+$', ''), '[a-z]+', '!', 'g'), '!'), lambda x: length(x)) AS n FROM d),
h AS (SELECT doc_id, list_transform(string_split(chain, '!'), lambda x: length(x)) AS n FROM c),
og AS (SELECT doc_id, sum(x) OVER (PARTITION BY doc_id ORDER BY k) AS at, k, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, unnest(n) AS x, unnest(range(len(n))) AS k FROM g)),
oh AS (SELECT doc_id, sum(x) OVER (PARTITION BY doc_id ORDER BY k) AS at, k, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, unnest(n) AS x, unnest(range(len(n))) AS k FROM h)),
e AS (SELECT doc_id, count(*) AS gaps, count(*) FILTER (NOT EXISTS (SELECT 1 FROM oh WHERE oh.doc_id = og.doc_id AND oh.at = og.at AND oh.k < oh.m - 1)) AS unconfirmed FROM og WHERE k < m - 1 GROUP BY 1)
SELECT doc_id AS protein, CAST(coalesce(gaps, 0) AS INTEGER) AS gaps, CAST(coalesce(unconfirmed, 0) AS INTEGER) AS unconfirmed, coalesce(unconfirmed, 0) = 0 AS valid FROM d LEFT JOIN e USING (doc_id)""")
def win9_gap_validation(spark, d):
    """Letters of a text are the marked sequence. Its chain has a break for each run of small letters, in every third text for runs of two and more only."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    runs = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(marked, "[a-z][a-z]+", "!")).otherwise(F.regexp_replace(marked, "[a-z]+", "!"))
    docs = table(spark, d, "documents")
    return S.gaps_confirmed(docs.select(F.col("doc_id").alias("protein"), marked.alias("marked")), docs.select(F.col("doc_id").alias("protein"), runs.alias("chain")))


@query(f"""WITH p AS (SELECT label AS protein, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS res_no FROM embeddings),
s AS (SELECT doc_id AS protein, regexp_replace({LETTERS}, '[a-z]+$', '') AS s FROM documents),
m AS (SELECT protein, row_number() OVER (PARTITION BY protein ORDER BY place) AS res_no, place AS new_no FROM (SELECT protein, unnest(string_split(s, '')) AS c, unnest(range(1, length(s) + 1)) AS place FROM s WHERE s <> '') WHERE regexp_matches(c, '[A-Z]')
  UNION ALL SELECT protein, length(regexp_replace(s, '[a-z]', '', 'g')) + 1, length(s) FROM s)
SELECT p.protein, p.res_no, CAST(m.new_no AS INTEGER) AS new_no FROM p JOIN s ON s.protein = p.protein LEFT JOIN m ON m.protein = p.protein AND m.res_no = p.res_no""")
def join14_renumbered_residues(spark, d):
    """Chains of embeddings, renumbered by the document of the chain's number."""
    residues = points(spark, d).select("protein", (F.col("pos") + 1).alias("res_no"))
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return S.renumbered(residues, table(spark, d, "documents").select(F.col("doc_id").alias("protein"), marked.alias("marked")))
