import math
import random

import duckdb
from pyspark.sql import functions as F

from pairweave.llm import topk
from pairweave.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, row string, label int"


def brute(rows, k, is_query):
    """rows: (vec_id, embedding). One (query_id, rank, vec_id, score) for each rank of each query row."""
    kept = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(min(math.floor(64 * x), topk.MOST), topk.LEAST) for x in v]))
    out = []
    for i, (query, q) in enumerate(kept):
        if query is not None and is_query(query):
            scored = sorted((-max(min(sum(a * b for a, b in zip(q, v)), topk.MOST), topk.LEAST), vec_id is None, vec_id or 0) for j, (vec_id, v) in enumerate(kept) if j != i)
            out += [(query, n + 1, None if null else vec_id, -s) for n, (s, null, vec_id) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def check(spark, rows, k=5, every=3, block=topk.BLOCK):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(4)
    got = topk.top_k(df, k, F.col("vec_id") % every == 0, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, lambda x: x % every == 0)


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [f32(r.gauss(0, 1)) for _ in range(6)]) for i in range(150)]
    check(spark, rows)
    check(spark, rows, block=600)  # several blocks of queries


def test_ties_copies_nulls_and_odd_vectors(spark):
    r = random.Random(4)
    one = [0.5, -0.25, 0.125]
    rows = [(i, one) for i in range(-40, 60)]  # a hot vector
    rows += [(i, [r.choice([0.0, 0.25, 0.5, -0.5]) for _ in range(3)]) for i in range(60, 160)]  # many equal scores
    rows += [(3, one), (3, one), (63, [0.0, 0.0, 0.0]), (None, one), (None, one), (200, None), (201, [1.0, None, 0.0]), (204, [float("nan"), 0.0, 0.0]), (207, [float("inf"), 0.0, 0.0])]
    rows += [(210, []), (213, [1.0]), (216, [0.25, 0.25, 0.25, 8.0]), (219, [0.5, 0.5, 0.5, -8.0])]
    check(spark, rows)
    check(spark, rows, k=20, every=7)


def test_fewer_candidates_than_ranks_and_empty_tables(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [-1.0, 0.0])], k=20)
    check(spark, [(3, [1.0])])
    check(spark, [])
    check(spark, [(1, [1.0]), (2, [1.0])])


def test_large_components(spark):
    r = random.Random(5)
    for size in (1e4, 1e7, 1e12, 3e38):
        check(spark, [(i, [f32(r.gauss(0, 1) * size) if abs(r.gauss(0, 1)) < 9 else 0.0 for _ in range(3)]) if size < 1e38 else (i, [r.choice([size, -size, 1.0])] * 2) for i in range(30)])


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{d}/embeddings.parquet'")
    want = con.sql(ORACLES["op12_exact_top_k"])
    got = QUERIES["op12_exact_top_k"](spark, d)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
