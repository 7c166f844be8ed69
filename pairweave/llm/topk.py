"""Operator 12, exact top-k search by distributed histogram selection.

Components are quantised to floor(64 x); a score is the integer inner product.

1.  Queries are taken in blocks of at most about BLOCK bytes of components (a
    documented bound, whatever their number), which are broadcast one after the
    other; every candidate is scored against them where it lies.
2.  A query's scores lie within its norm times the largest candidate's norm.
    That range is cut into BINS bins; each task counts its scores by bin, the
    counts are added over all tasks, and the bin of the k-th score becomes the
    next range, until it is one value. A task leaves out the bins below that of
    its own k-th score, which can't hold the k-th of all.
3.  With the k-th value known, what scores more is kept, and of its equals as
    many as are wanting, by smallest ``vec_id``.

Of candidates with equal vectors only the k + 1 of smallest ``vec_id`` are
scored: whatever the query, the others come after k that are kept. So copies in
any number cost nothing, and no result is lost.

Cases: vectors that are null or hold null or non-finite components take no part;
of vectors of different lengths, the shorter one counts as zero beyond its end;
an empty vector is all zeros; quantised components and scores beyond 64 bits are
held at the ends of that range. Ties go to the smaller ``vec_id``, a null one
last. Rows that repeat a ``vec_id`` are rows like others: each is a candidate,
and a query gets its own ranks for each of its rows; a row is no candidate of
itself. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.llm.common import scratch, stored

#: Bytes of the components of a block of queries, about.
BLOCK = 32 << 20
BINS = 256
#: Scores that are held at a time.
HELD = 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(row, vec_id, vec) of the vectors that take part; ``row`` tells rows apart."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.coalesce(finite, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def matrix(vec: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A row for each vector, zero beyond its end."""
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks()
    offsets = vec.offsets.to_numpy()
    values, size = vec.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    if (size == dim).all():
        return values[offsets[0] : offsets[-1]].reshape(len(size), dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = values[offsets[0] : offsets[-1]]
    return out


class Scorer:
    """Exact inner products of a block of queries with candidates."""

    def __init__(self, queries: np.ndarray):
        self.queries = queries
        self.floats = queries.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))

    def scores(self, i: int, j: int, c: np.ndarray) -> np.ndarray:
        bound = self.largest * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(c.shape[1], 1)
        if bound < 2.0**52:
            return (self.floats[i:j] @ c.T.astype(np.float64)).astype(np.int64)
        if bound < 2.0**62:
            return self.queries[i:j] @ c.T
        exact = np.dot(self.queries[i:j].astype(object), c.T.astype(object))
        return np.clip(exact, LEAST, MOST).astype(np.int64)

    def parts(self, rows: np.ndarray, own: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(first query, end, first candidate, scores, which of them are a query's own row), HELD scores at a time."""
        few = 512
        wide = max(HELD // few, 1)
        for a in range(0, len(c), wide):
            for i in range(0, len(self.queries), few):
                j = min(i + few, len(self.queries))
                yield i, j, a, self.scores(i, j, c[a : a + wide]), own[i:j, None] == rows[None, a : a + wide]


def _counted(candidates: DataFrame, block, dim: int, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray) -> DataFrame:
    """(query, bin, n): scores from ``low`` to ``low + span`` by bin of ``width``, in tasks; without bins that the need-th of these in all can't be in."""
    state = candidates.sparkSession.sparkContext.broadcast((low, span, width, need))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = block.value
        low, span, width, need = state.value
        use, hist = Scorer(queries), np.zeros((len(queries), BINS), np.int64)
        floor = np.zeros(len(queries), np.int64)  # bins below don't matter
        for b in batches:
            rows, c = b.column("row").to_numpy(), matrix(b.column("vec"), dim)
            for i, j, _, s, self_ in use.parts(rows, own, c):
                from_low = (s - low[i:j, None]).view(np.uint64)  # wraps rightly where the score is no less
                least = floor[i:j].astype(np.uint64) * width[i:j]
                q, at = np.nonzero((s >= low[i:j, None]) & (from_low >= least[:, None]) & (from_low <= span[i:j, None]) & ~self_)
                bins = (from_low[q, at] // width[i:j][q]).astype(np.int64)
                hist[i:j] += np.bincount(q * BINS + bins, minlength=(j - i) * BINS).reshape(j - i, BINS)
                upper = np.cumsum(hist[i:j, ::-1], axis=1)[:, ::-1]
                floor[i:j] = np.maximum((upper >= need[i:j, None]).sum(axis=1) - 1, 0)
        q, at = np.nonzero((hist > 0) & (np.arange(BINS) >= floor[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(at, pa.int64()), pa.array(hist[q, at], pa.int64())], ["query", "bin", "n"])

    return candidates.select("row", "vec").mapInArrow(work, "query long, bin long, n long")


def _kept(candidates: DataFrame, block, dim: int, value: np.ndarray, ties: np.ndarray) -> DataFrame:
    """(query_row, row, vec_id, score): what scores more than a query's ``value``; and of the scores equal to it, the ``ties`` of smallest vec_id in a task."""
    state = candidates.sparkSession.sparkContext.broadcast((value, ties))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = block.value
        value, ties = state.value
        use = Scorer(queries)
        tied: list[np.ndarray] = []

        def out(q: np.ndarray, row: np.ndarray, vec: np.ndarray, null: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(own[q], pa.int64()), pa.array(row, pa.int64()), pa.array(vec, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["query_row", "row", "vec_id", "score"])

        def first(found: list[np.ndarray]) -> np.ndarray:
            x = np.concatenate(found, axis=1)  # query, row, vec_id, whether that is null
            x = x[:, np.lexsort((x[1], x[2], x[3], x[0]))]
            begin = np.searchsorted(x[0], x[0])
            return x[:, np.arange(x.shape[1]) - begin < ties[x[0]]]

        for b in batches:
            rows, c = b.column("row").to_numpy(), matrix(b.column("vec"), dim)
            ids = b.column("vec_id")
            null, vec = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            for i, j, a, s, self_ in use.parts(rows, own, c):
                q, at = np.nonzero((s > value[i:j, None]) & ~self_)
                if len(q):
                    yield out(q + i, rows[at + a], vec[at + a], null[at + a], s[q, at])
                q, at = np.nonzero((s == value[i:j, None]) & ~self_)
                if len(q):
                    tied.append(np.stack([q + i, rows[at + a], vec[at + a], null[at + a]]))
            if sum(x.shape[1] for x in tied) > HELD:
                tied = [first(tied)]
        if tied:
            x = first(tied)
            yield out(*x, value[x[0]])

    return candidates.select("row", "vec_id", "vec").mapInArrow(work, "query_row long, row long, vec_id long, score long")


def _select(candidates: DataFrame, block, dim: int, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k-th score of each query, how many of the scores equal to it belong to the first k). A query with fewer candidates gets the least value and all."""
    n = len(reach)
    low, size = -reach, 2 * reach.astype(object) + 1  # the range of each, and how many values it has
    need = np.full(n, k, np.int64)
    fewer = np.zeros(n, bool)
    while any(size > 1):
        width = np.array([max(-(-int(x) // BINS), 1) for x in size], np.uint64)
        counts = _counted(candidates, block, dim, low, np.array([int(x) - 1 for x in size], np.uint64), width, need).groupBy("query", "bin").agg(F.sum("n").alias("n"))
        upper = Window.partitionBy("query").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(upper))
        state = candidates.sparkSession.createDataFrame(pa.table({"query": np.arange(n), "need": need}))
        reached = counts.join(F.broadcast(state), "query").filter("upto >= need AND upto - n < need").select("query", "bin", (F.col("upto") - F.col("n")).alias("above"))
        q, at, above = (c.to_numpy() for c in reached.toArrow().columns)  # one row for each query of the block at most
        found = np.zeros(n, bool)
        found[q] = True
        fewer |= ~found
        low[q] += at * width[q].astype(np.int64)
        size = np.minimum(size, width.astype(object))
        need[q] -= above
        size[fewer] = 1
    low[fewer], need[fewer] = LEAST, k
    return low, need


def top_k(vectors: DataFrame, k: int, is_query: Column, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that ``is_query`` (a condition on vec_id) holds for, the k other rows of highest score."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors))
    of_vector = Window.partitionBy("vec").orderBy(F.asc_nulls_last("vec_id"), "row")
    candidates = stored(rows.withColumn("copy", F.row_number().over(of_vector)).filter(F.col("copy") <= k + 1).drop("copy"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    most = candidates.agg(F.max(F.size("vec")).alias("dim"), F.max(norm).alias("norm")).first()
    queries = rows.filter(is_query)
    path, out = scratch(spark), scratch(spark)
    dim = most.dim or 0
    n = queries.count()
    blocks = max(-(-n * dim * 8 // block), 1)
    queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).write.partitionBy("block").parquet(path)
    found = spark.createDataFrame([], "query_row long, row long, vec_id long, score long")
    found.write.parquet(out)
    for b in range(blocks if n else 0):
        part = spark.read.schema("row long, vec_id long, vec array<long>, block long").parquet(path).filter(F.col("block") == b).select("row", "vec").toArrow()  # BLOCK bytes, about
        if not part.num_rows:
            continue
        q = matrix(part.column("vec"), dim)
        sent = spark.sparkContext.broadcast((q, part.column("row").to_numpy()))
        reach = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * most.norm * (1 + 1e-9) + 1
        value, ties = _select(candidates, sent, dim, np.minimum(reach, 2.0**63 - 2048).astype(np.int64), k)
        _kept(candidates, sent, dim, value, ties).write.mode("append").parquet(out)
        sent.unpersist()
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = spark.read.schema(found.schema).parquet(out).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    ids = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")
