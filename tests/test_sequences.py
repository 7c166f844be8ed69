"""Nested look-ups and marked sequences on hand-made cases and against plain re-implementations."""

import json
import random
import re

from pyspark.sql import functions as F

from pairweave.functions.nested import json_first
from pairweave.operators import sequences as S


def first(key, o):
    for k, v in o.items():
        if k == key:
            return v
        for x in [v] if isinstance(v, dict) else [y for y in v if isinstance(y, dict)] if isinstance(v, list) else []:
            found = first(key, x)
            if found is not None:
                return found
    return None


def test_first_match_in_nested_documents(spark):
    r = random.Random(2)

    def make(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([1, "k", None, True, '{"k":9}', "[]", 7])
        if kind < 0.55:
            return [make(depth - 1) for _ in range(r.randint(0, 3))]
        return {k: make(depth - 1) for k in r.sample(["z", "k", "a", "m", "b"], r.randint(0, 4))}

    docs = [x for x in (make(5) for _ in range(300)) if isinstance(x, dict)]
    rows = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(-1, None), (-2, "no json"), (-3, "[1]"), (-4, "")]
    got = {x.i: x.v for x in spark.createDataFrame(rows, "i int, doc string").select("i", json_first(F.col("doc"), "k", 6).alias("v")).collect()}
    assert [got[i] for i in (-1, -2, -3, -4)] == [None] * 4
    for i, x in enumerate(docs):
        want = first("k", x)
        assert got[i] == (None if want is None else want if isinstance(want, str) else json.dumps(want, separators=(",", ":"))), x


def test_a_list_of_lists_is_not_searched_and_depth_ends(spark):
    docs = ['{"a":[[{"k":1}]],"b":{"k":2}}', '{"a":{"a":{"a":{"k":3}}}}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    assert [x.v for x in df.select(json_first(F.col("doc"), "k", 4).alias("v")).collect()] == ["2", "3"]
    assert [x.v for x in df.select(json_first(F.col("doc"), "k", 3).alias("v")).collect()] == ["2", None]


def plain_gaps(marked):
    out, seen, gap = [], 0, False
    for c in marked:
        if c.isupper():
            if gap and seen:
                out.append(seen)
            gap = False
            seen += 1
        else:
            gap = True
    return out


def plain_breaks(chain):
    out, seen = set(), 0
    for c in chain:
        if c == "!":
            out.add(seen)
        seen += c.isupper()
    return out


def test_gaps_against_chain_breaks(spark):
    r = random.Random(3)
    rows = [("ABcdEFgH", "AB!EF!H"), ("abCDefGhi", "CD!G"), ("ABcdEF", "ABEF"), ("ABcD", "AB!!D!"), ("ABcD", "A!B!D"), ("", ""), ("abc", "!"), ("ABC", "A!BC"), ("AbC", "Aa!C"), (None, "A"), ("AbC", None)]
    rows += [("".join(r.choices("ABcd", k=12)), "".join(r.choices("AB!!c", k=12))) for _ in range(200)]
    df = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(rows)], "protein int, marked string, chain string")
    got = {x.protein: (x.gaps, x.unconfirmed, x.valid) for x in S.gaps_confirmed(df.select("protein", "marked"), df.select("protein", "chain")).collect()}
    for i, (m, c) in enumerate(rows):
        gaps, breaks = plain_gaps(m or ""), plain_breaks(c or "")
        missing = [g for g in gaps if g not in breaks]
        assert got[i] == (len(gaps), len(missing), not missing), (m, c)


def plain_map(seq):
    seq = re.sub("[a-z]+$", "", seq)
    at, now = {1: 0}, 1
    for c in seq:
        at[now] += 1
        if not c.islower():
            at[now + 1] = at[now]
            now += 1
    return at


def test_renumbering(spark):
    r = random.Random(4)
    seqs = ["ABC", "abCdE", "AbcDef", "abc", "", "A-bC"] + ["".join(r.choices("ABcde", k=15)) for _ in range(40)]
    residues = [(i, n, "ca") for i in range(len(seqs)) for n in (-1, 0, 1, 2, 3, 5, 30)]
    out = S.renumbered(spark.createDataFrame(residues, "protein int, res_no int, atom string"), spark.createDataFrame(list(enumerate(seqs)), "protein int, marked string"))
    assert out.columns == ["protein", "res_no", "atom", "new_no"]
    for x in out.collect():
        assert x.new_no == plain_map(seqs[x.protein]).get(x.res_no), (seqs[x.protein], x.res_no)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
