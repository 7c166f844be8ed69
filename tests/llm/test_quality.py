import random
import re

import duckdb
import pytest

from pairweave.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    lcp = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            lcp[i], lcp[j] = max(lcp[i], k), max(lcp[j], k)

    def covered(least):
        return len({p for i in range(n) if lcp[i] >= least for p in range(i, i + lcp[i])})

    failed = n < 50 or 100 * covered(3) > 50 * n
    longest = max([x for x in lcp if x >= 3], default=0)
    kept = not failed and covered(10) <= Q.MAX_COVERED * n and longest <= Q.MAX_REPEAT
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered(3), covered(10), longest, failed, kept)


def cases():
    r = random.Random(5)
    voc = ["a", "bb", "é", "日本", "x|y", "#", "word"]
    out = [None, "", " ", "\n\n", "one", "a b c", "a b c a b c", "a " * 300, "x" * 5000, "l1 a\nl2\nl1 a\n l1 a\n", "  nbsp em"]
    for n in (5, 30, 80, 200, 400):
        for m in (2, 4, 7):
            out.append("".join(r.choice(voc[:m]) + r.choice([" ", "\n", "\t", "  "]) for _ in range(n)))
    base = [str(r.random()) for _ in range(600)]
    out += [" ".join(base), " ".join(base[:300] + base[:250] + base[300:]), " ".join(base[:200] + base[50:70] + base[200:]), " ".join(base[:205] + base[:205])]
    return out


def test_matches_brute_force(spark):
    texts = cases()
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "null id " * 40, "x"), (3, texts[3], "again")]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    want = sorted([(d if d is not None else -1, *brute(t)) for d, t, _ in rows])
    assert sorted((g[0] if g[0] is not None else -1, *g[1:]) for g in got) == want


def test_keep_and_empty(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases())], "doc_id long, text string")
    kept = {r.doc_id for r in Q.quality(docs).collect() if r.kept}
    assert kept and {r.doc_id for r in Q.keep_good(docs).collect()} == kept
    assert Q.quality(docs.limit(0)).count() == 0 and Q.keep_good(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("sf", ["0.001"])
def test_sql(spark, sf):
    from pairweave.llm.queries import ORACLES

    path = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view documents as from '{path}/documents.parquet'")
    want = con.sql(ORACLES["op4_quality_rules"]).df()
    got = Q.quality(spark.read.parquet(f"{path}/documents.parquet")).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
