import itertools
import random
import re

import numpy as np
import pytest

from pairweave.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (n, component): every pair is compared."""
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(n_groups=12, seed=2):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(3000)]
    passage = [r.choice(voc) for _ in range(60)]
    rows, d = [], 1000
    for g in range(n_groups):
        base = [r.choice(voc) for _ in range(r.choice([30, 90, 200]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(voc)
            rows.append((d, " ".join(w).title() if r.random() < 0.2 else " ".join(w)))
            d -= r.randrange(1, 4)
    return rows


ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (6, "a b c d e"), (7, "a b c d e f"), (8, "x " * 3000), (9, "X " * 2000), (10, "é É")]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_brute_force(spark):
    rows = corpus() + ODD
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, "a b", "n"), rows[0] + ("again",)], "doc_id long, text string, component_id string")
    out = M.near_duplicates(docs)
    assert result(out) == brute(rows)
    got = out.collect()
    assert len(got) == len(rows) + 2 and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_buckets(spark, monkeypatch):
    """Large buckets of several components, and large sets of a hub: compared block by block."""
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 500)
    r = random.Random(4)
    voc = [f"v{i}" for i in range(4000)]
    core = [r.choice(voc) for _ in range(70)]
    rows = []
    for i in range(60):  # share much, yet few are within the similarity
        w = core + [r.choice(voc) for _ in range(r.choice([2, 10, 25, 40]))]
        rows.append((i, " ".join(w)))
    assert result(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_chain_of_links(spark):
    """A long chain needs many rounds of the components."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_keep_one(spark):
    rows = corpus(4) + ODD
    docs = spark.createDataFrame([(d, t, 1) for d, t in [*rows, rows[0], (None, "a b")]], "doc_id long, text string, extra int")
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(d for d, (n, c) in brute(rows).items() if c == d)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.filter("doc_id is null").count() == 1
    assert M.near_duplicates(docs.limit(0)).count() == 0 and M.keep_one(docs.limit(0)).count() == 0


def test_keep_one_judges_rows_of_one_id_by_their_texts(spark):
    r = random.Random(12)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (6, c), (6, c), (7, b + " more"), (7, d), (8, None), (8, ""), (8, "short"), (None, a)]
    docs = spark.createDataFrame([(i, t, "v", "w", "x") for i, t in rows], "doc_id long, text string, _id string, row string, digest string")
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in kept.collect())
    assert got == sorted([(-1, a), (5, a), (5, b), (6, c), (7, d), (8, ""), (8, "short")])


def test_first_choice():
    r = random.Random(3)
    for _ in range(300):
        flags = np.array([[r.random() < 0.6 for _ in range(M.POSITIONS)]])
        want = next((k for k, c in enumerate(M.CHOICES) if all(flags[0, p] for p in c)), len(M.CHOICES))
        assert M.first_choice(flags.astype(np.int64))[0] == want


def test_guarantee():
    """Any two signatures within the bound share the symbols of one choice."""
    r = random.Random(9)
    for _ in range(3000):
        wrong = set(r.sample(range(M.POSITIONS), r.randrange(M.BOUND + 1)))
        assert any(not wrong & set(c) for c in M.CHOICES)


@pytest.mark.parametrize("sf", ["0.001"])
def test_sql(spark, sf):
    import duckdb

    from pairweave.llm.queries import ORACLES, QUERIES

    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{d}/documents.parquet'")
    want = con.sql(ORACLES["op8_near_duplicates"]).df()
    got = QUERIES["op8_near_duplicates"](spark, d).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
