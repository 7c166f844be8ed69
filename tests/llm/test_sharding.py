import itertools
import random
import zlib

from pyspark.sql import functions as F

from pairweave.llm import sharding as S
from pairweave.llm.queries import op10_reshard


def check(rows, texts, shards, slack):
    load, slots = [0] * shards, {}
    for r in rows:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load) - min(load) <= slack
    key = lambda d, t: (-1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(key(d, t) for d, t in texts)
    return load


def test_flow_is_optimal():
    r = random.Random(0)
    for _ in range(60):
        n, m = r.randrange(1, 4), r.randrange(1, 4)
        supply = [r.randrange(4) for _ in range(n)]
        capacity = [0] * m
        for _ in range(sum(supply) + r.randrange(3)):
            capacity[r.randrange(m)] += 1
        cost = [[r.randrange(4) for _ in range(m)] for _ in range(n)]
        flow = S.min_cost_flow(supply, capacity, cost)
        assert [sum(x) for x in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]
        best = min(sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(m)))
        assert sum(f * c for a, b in zip(flow, cost) for f, c in zip(a, b)) == best


def test_levels():
    assert S.even_levels(10, [0, 0, 0]) == [4, 3, 3] and S.even_levels(3, [0, 9, 1]) == [2, 0, 1] and S.even_levels(0, [5, 1]) == [0, 0]


def test_reshard_moves_least(spark):
    r = random.Random(2)
    texts = [(i if i % 50 else None, None if i % 97 == 0 else "é" * r.randrange(60)) for i in range(4000)] + [(7, "same")] * 200 + [(8, "z" * 9000)]
    docs = spark.createDataFrame([(d, t, 0 if k % 3 == 0 else k % 5, "x") for k, (d, t) in enumerate(texts)], "doc_id long, text string, source int, shard string")
    out = S.reshard(docs, F.col("source"), 8).collect()
    load = check(out, texts, 8, 400)
    old = [0] * 8
    for x in out:
        old[x.old_shard] += x.size
    moved = sum(x.size for x in out if x.old_shard != x.shard)
    least = sum(max(0, x - sum(load) // 8) for x in old)
    assert least <= moved + 300 and moved <= least + 300 * 8
    assert S.reshard(docs.limit(0), F.col("source"), 8).count() == 0


def test_large_rows_follow_the_flow():
    r = random.Random(9)
    for _ in range(40):
        olds, shards = list(range(4)), 6
        rows = sorted(((r.randrange(40, 120), r.randrange(4)) for _ in range(r.randrange(1, 30))), reverse=True)
        supply = [sum(s for s, o in rows if o == i) + r.randrange(2000) for i in olds]
        even = S.even_levels(sum(supply), [0] * shards)
        flow = S.min_cost_flow(supply, even, [[int(i != j) for j in range(shards)] for i in olds])
        placed, load = S.place_large([(k, s, o) for k, (s, o) in enumerate(rows)], flow, even, olds)
        assert sorted(k for k, _ in placed) == list(range(len(rows))) and sum(load) == sum(s for s, _ in rows)
        off = [(s, o, j) for (k, j), (s, o) in zip(placed, rows) if not flow[o][j]]
        carried = [[sum(s for (_, j2), (s, o) in zip(placed, rows) if (o, j2) == (i, j)) for j in range(shards)] for i in olds]
        for s, o, j in off:  # no arc could carry it whole any more
            assert all(min(flow[o][x] - carried[o][x], even[x] - load[x]) < s for x in range(shards) if flow[o][x]) or s > min(even)


def test_query_moves_what_the_flow_moves(spark):
    """Moved bytes are those of the flow of all bytes, but for one text a shard."""
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        out = op10_reshard(spark, d).collect()
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32)).alias("old")).collect()
        old = {r.doc_id: r.old for r in docs}
        load = [0] * 40
        for r in out:
            load[old[r.doc_id]] += r.size
        even = sum(load) // 40
        least = sum(max(0, x - even) for x in load)
        moved = sum(r.size for r in out if r.shard != old[r.doc_id])
        largest = max(r.size for r in out)
        assert least - 40 * largest <= moved <= least + 40 * largest
        by_shard = [0] * 40
        for r in out:
            by_shard[r.shard] += r.size
        assert max(by_shard) - min(by_shard) <= largest
        print(sf, "moved", moved, "least", least, "largest", largest, "spread", max(by_shard) - min(by_shard))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(op10_reshard(spark, d).collect(), texts, 40, max(len((t or "").encode()) for _, t in texts) + 16)


def test_rewrite_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    # shard 2 has just what it should have
    rows = [(s, i, "x" * 84) for s, n in ((0, 80), (1, 0), (2, 40)) for i in range(n)]
    spark.createDataFrame(rows, "shard int, doc_id long, text string").repartition("shard").write.partitionBy("shard").parquet(path)
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / "shard=2").iterdir()}
    affected = S.rewrite_affected(path, spark.read.schema("doc_id long, text string, shard int").parquet(path), 3)
    assert affected == [0, 1]
    assert {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / "shard=2").iterdir()} == before
    after = spark.read.parquet(path)
    assert after.count() == 120 and {r.shard: r["count"] for r in after.groupBy("shard").count().collect()} == {0: 40, 1: 40, 2: 40}
