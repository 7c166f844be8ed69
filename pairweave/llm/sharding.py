"""Operator 10, resharding by minimum-cost flow.

Old shards have sizes, new shards have equal capacities, and a byte that
leaves its shard costs 1. The flow of least cost says how many bytes each old
shard gives to each new one. Shards are cut into blocks of bounded numbers of
rows; sizes are added up block by block, so that every row has its place in its
old shard's order of bytes, and the flow's intervals of that order are what
is transferred. Only a table of shards, and the rows larger than a fixed part
of a capacity (whose number is bounded by that part), are seen by the driver.

Cases: a null text has size 16 and the checksum of no bytes; a null ``doc_id``
and repeated rows are rows like others; ties are broken by ``doc_id``, size
and checksum, and rows alike in all of these are interchangeable; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairweave.llm.common import stored

#: Rows of over 1/PART of a capacity are dealt one by one; there are at most PART * shards.
PART = 64
ROWS_PER_BLOCK = 20_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """How much each source gives to each sink, all supplies placed at the least total cost.

    Successive shortest augmenting paths on the residual graph of sources and
    sinks; the tables are of shards, so small.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = [0 if x else None for x in left] + [None] * m  # sources, then sinks
        came: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            x = queue.popleft()
            if x < n:
                steps = [(n + j, cost[x][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][x - n]) for i in range(n) if flow[i][x - n]]
            for y, c in steps:
                if far[y] is None or far[x] + c < far[y]:
                    far[y], came[y] = far[x] + c, x
                    if y not in queue:
                        queue.append(y)
        ends = [j for j in range(m) if room[j] and far[n + j] is not None]
        if not ends:
            raise ValueError("the capacities don't hold the supplies")
        end = min(ends, key=lambda j: (far[n + j], j))
        path, y = [], n + end
        while came[y] is not None:
            path.append((came[y], y))
            y = came[y]
        amount = min([left[y], room[end]] + [flow[b][a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[y] -= amount
        room[end] -= amount
    return flow


def even_levels(total: int, taken: list[int]) -> list[int]:
    """Room in each shard so that ``total`` more bytes make all as even as can be."""
    order = sorted(range(len(taken)), key=lambda j: taken[j])
    used, level = 0, 0
    for k, j in enumerate(order):
        used += taken[j]
        level = (total + used) // (k + 1)
        if k + 1 == len(order) or level <= taken[order[k + 1]]:
            break
    room = [max(0, level - x) for x in taken]
    for j in order[: total - sum(room)]:
        room[j] += 1
    return room


def place_large(rows: list[tuple[int, int, int]], flow: list[list[int]], capacity: list[int], olds: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """((row, shard) of each, bytes in each shard) for rows (row, size, index of the old shard), largest first.

    A row goes along an arc of the flow that still has as many bytes, to a shard
    that has as much room: its own shard's before others, else the widest. Only a
    row that no such arc can carry whole goes where most room is left.
    """
    left, room = [list(x) for x in flow], list(capacity)
    placed = []
    for row, size, i in rows:
        arcs = [j for j in range(len(room)) if min(left[i][j], room[j]) >= size]
        to = min(arcs, key=lambda j: (j != olds[i], -left[i][j], j)) if arcs else min(range(len(room)), key=lambda j: (-room[j], j != olds[i], j))
        left[i][to] -= size
        room[to] -= size
        placed.append((row, to))
    return placed, [c - r for c, r in zip(capacity, room)]


def reshard(docs: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for each row: its new shard, and its place there.

    old_shard: an integer from 0; old shard i < ``shards`` stays in its place as
    new shard i. The law is that of even bytes.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), old_shard.cast("int").alias("old_shard")))
    sizes = {r.old_shard: r for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(r.bytes for r in sizes.values())
    limit = total // (PART * shards)
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]

    olds = sorted(sizes)
    cost = [[0 if i == j else 1 for j in range(shards)] for i in olds]
    even = even_levels(total, [0] * shards)
    large = rows.filter(F.col("size") > limit).withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc(), "old_shard", *order)))  # at most PART * shards rows
    placed, load = place_large([(r.rank, r.size, olds.index(r.old_shard)) for r in large.select("rank", "size", "old_shard").orderBy("rank").collect()], min_cost_flow([sizes[i].bytes for i in olds], even, cost), even, olds)
    large = large.join(F.broadcast(spark.createDataFrame(placed, "rank int, shard int")), "rank").withColumn("block", F.lit(-1).cast("long"))

    small = rows.filter(F.col("size") <= limit)
    supply = dict.fromkeys(olds, 0) | {r.old_shard: r.bytes for r in small.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    flow = min_cost_flow([supply[i] for i in olds], even_levels(sum(supply.values()), load), cost)
    cuts = []
    for i, given in zip(olds, flow):
        to = [j for j in sorted(range(shards), key=lambda j: (j != i, j)) if given[j]]
        at, bounds = 0, []
        for j in to[:-1]:
            at += given[j]
            bounds.append(at)
        cuts.append((i, sizes[i].n // ROWS_PER_BLOCK + 1, bounds, to))
    cuts = F.broadcast(spark.createDataFrame(cuts, "old_shard int, blocks long, bounds array<long>, targets array<int>"))  # a row for each old shard
    small = small.join(cuts, "old_shard").withColumn("block", F.pmod(F.xxhash64(*order), F.col("blocks")))
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = small.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).select("old_shard", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("base") + F.sum("size").over(inside) - F.expr("size div 2")
    small = small.join(blocks, ["old_shard", "block"]).withColumn("middle", middle).withColumn("shard", F.expr("element_at(targets, cast(size(filter(bounds, x -> x <= middle)) + 1 as int))"))

    names = ["doc_id", "size", "text_crc32", "old_shard", "block", "shard"]
    out = small.select(names).union(large.select(names))
    part = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = out.groupBy("shard", "old_shard", "block").count().select("shard", "old_shard", "block", F.coalesce(F.sum("count").over(part), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "old_shard", "block").orderBy(*order))
    return out.withColumn("place", place).join(bases, ["shard", "old_shard", "block"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))


def rewrite_affected(path: str, docs: DataFrame, shards: int) -> list[int]:
    """Reshards the files below ``path`` (Parquet, partitioned by an integer ``shard``) and writes only the shards that gain or lose rows; gives their numbers.

    Rows are found again by (doc_id, size, checksum, old shard) and the number
    among rows alike in these. The new rows are written beside the old ones
    first, so a failure leaves the old files as they are.
    """
    key = ["doc_id", "size", "text_crc32", "old_shard"]
    alike = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    to = reshard(docs, F.col("shard"), shards).withColumn("alike", alike)
    moved = stored(to.filter("old_shard <> shard"))
    affected = sorted({x for r in moved.select("old_shard", "shard").distinct().collect() for x in r})
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.filter(F.col("shard").isin(affected)).withColumnsRenamed({"shard": "old_shard"})
    keyed = keyed.withColumn("size", (F.octet_length(body) + 16).cast("long")).withColumn("text_crc32", F.crc32(body)).withColumn("alike", alike)
    on = [keyed[k].eqNullSafe(moved[k]) for k in [*key, "alike"]]
    new = keyed.join(moved.select(*key, "alike", "shard"), on, "left").select(*[keyed[c] for c in docs.columns if c != "shard"], F.coalesce(moved["shard"], keyed["old_shard"]).alias("shard"))
    stored(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return affected
