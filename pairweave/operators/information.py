"""Information scores of positions and pairs of positions, and corrections of pair scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairweave.functions.scalars import entropy_term
from pairweave.functions.scratch import stored

# Background frequencies of the residues in the order ARNDCQEGHILKMFPSTWYV.
BACKGROUND = [
    0.07805, 0.05129, 0.04487, 0.05364, 0.01925, 0.04264, 0.06295, 0.07377, 0.02199, 0.05142,
    0.09019, 0.05744, 0.02243, 0.03856, 0.05203, 0.07120, 0.05841, 0.01330, 0.03216, 0.06441,
]


def background(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BACKGROUND)), "a int, f double")


def entropies(counts: DataFrame, keys: list[str], gaps: bool) -> DataFrame:
    """Base-2 entropy of the counts of each key; ``gaps``: with state 20."""
    rows = counts if gaps else counts.filter(" and ".join(f"{s} < 20" for s in ("a", "b") if s in counts.columns))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return rows.withColumn("p", p).groupBy(*keys).agg(F.sum(entropy_term(F.col("p"))).alias("entropy"))


def scaled_by_maximum(entropy: DataFrame) -> DataFrame:
    return entropy.withColumn("scaled", F.col("entropy") / F.max("entropy").over(Window.partitionBy("protein")))


def divergences(freq: DataFrame, back: DataFrame) -> DataFrame:
    """Kullback-Leibler and Jensen-Shannon divergence of each position from the background; all distributions are brought to a sum of 1 first."""
    rows = freq.join(F.broadcast(back.select("a", F.col("f").alias("q"))), "a").withColumn("m", 0.5 * (F.col("f_pc") + F.col("q")))
    over = Window.partitionBy("protein", "i")
    p, q, m = (F.col(c) / F.sum(c).over(over) for c in ("f_pc", "q", "m"))
    rows = rows.withColumns({"p_": p, "q_": q, "m_": m})
    term = lambda x, y: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col(y))).otherwise(0.0)
    return rows.groupBy("protein", "i").agg(F.sum(term("p_", "q_")).alias("kl"), (0.5 * (F.sum(term("p_", "m_")) + F.sum(term("q_", "m_")))).alias("js"))


def mutual_information(freq2: DataFrame) -> DataFrame:
    term = F.when(F.col("f2") > 0, F.col("f2") * F.log2(F.col("f2") / (F.col("pi") * F.col("pj")))).otherwise(0.0)
    return freq2.groupBy("protein", "i", "j").agg(F.sum(term).alias("score"))


def joint_entropies(freq2: DataFrame) -> DataFrame:
    """Of pseudocounted frequencies; terms of shares that aren't positive count as 0."""
    return freq2.groupBy("protein", "i", "j").agg(F.sum(entropy_term(F.col("f2"))).alias("entropy"))


def omes(counts2: DataFrame, single: DataFrame, divisor: str = "pairs") -> DataFrame:
    """(protein, i, j, score), i <= j: squared differences of observed and expected pair counts over the number of pairs ("pairs") or over the expected counts ("expected"). Pairs that don't occur count as 0, so the sparse counts are enough."""
    rows = counts2.filter("a < 20 and b < 20")
    total = rows.groupBy("protein", "i", "j").agg(F.sum("n").alias("residues"))
    x = single.select("protein", "i", "a", F.col("f_pc").alias("fi"))
    y = single.select("protein", F.col("i").alias("j"), F.col("a").alias("b"), F.col("f_pc").alias("fj"))
    rows = rows.join(total, ["protein", "i", "j"]).join(x, ["protein", "i", "a"]).join(y, ["protein", "j", "b"])
    expected = F.col("residues") * F.col("fi") * F.col("fj")
    d = F.col("n") - expected
    return rows.groupBy("protein", "i", "j").agg(F.sum(d * d / (F.col("residues") if divisor == "pairs" else expected)).alias("score"))


def average_product(scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``apc``: the score less the product of its positions' means over the overall mean.

    Means are over the full square of positions; rows with i < j stand for both
    halves, rows with i = j (if there are any) for the diagonal.
    """
    means, overall = position_means(scores, lengths)
    out = scores.join(means.withColumnRenamed("mean", "mean_i"), ["protein", "i"]).join(means.select("protein", F.col("i").alias("j"), F.col("mean").alias("mean_j")), ["protein", "j"]).join(overall, "protein")
    return with_average_product(out)


def with_average_product(scores: DataFrame) -> DataFrame:
    """Adds ``apc_term`` and ``apc`` to scores that have both positions' means, ``mean_i`` and ``mean_j``, and ``overall`` in the row."""
    return scores.withColumn("apc_term", F.col("mean_i") * F.col("mean_j") / F.col("overall")).withColumn("apc", F.col("score") - F.col("apc_term")).drop("mean_i", "mean_j", "overall")


def position_means(scores: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((protein, i, mean), (protein, overall)): means over the full square of positions."""
    half = scores.select("protein", "i", "j", "score")
    full = half.union(half.filter("i < j").select("protein", F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    sums = full.groupBy("protein", "i").agg(F.sum("score").alias("s")).join(lengths.select("protein", "length"), "protein")
    means = sums.select("protein", "i", (F.col("s") / F.col("length")).alias("mean"))
    return means, sums.groupBy("protein").agg((F.sum("s") / F.first("length") / F.first("length")).alias("overall"))


def points_with_means(points: DataFrame, scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """Points (protein, pos, ...) with their ``mean`` score and the protein's ``overall`` one: pairs made of them need no shuffle for a correction. Both are stored, a row for each position."""
    means, _ = position_means(scores, lengths)
    return _with_means(points, means.withColumnRenamed("i", "pos"), lengths)


def points_with_sums(points: DataFrame, sums: DataFrame, lengths: DataFrame) -> DataFrame:
    """``points_with_means`` from (protein, pos, s), the sums of each position's scores."""
    means = sums.join(lengths.select("protein", "length"), "protein").select("protein", "pos", (F.col("s") / F.col("length")).alias("mean"))
    return _with_means(points, means, lengths)


def _with_means(points: DataFrame, means: DataFrame, lengths: DataFrame) -> DataFrame:
    means = stored(means)
    overall = means.join(lengths.select("protein", "length"), "protein").groupBy("protein").agg((F.sum("mean") / F.first("length")).alias("overall"))
    return points.join(means, ["protein", "pos"]).join(overall, "protein")


def expected_property(freq: DataFrame, properties: DataFrame) -> DataFrame:
    """Mean property of each position; ``properties``: (property, a, value)."""
    return freq.join(properties, "a").groupBy("protein", "i", "property").agg(F.sum(F.col("f_pc") * F.col("value")).alias("mean_value"))


def expected_potential(freq2: DataFrame, potential: DataFrame) -> DataFrame:
    """Mean pair potential; ``potential``: (a, b, value)."""
    return freq2.join(potential, ["a", "b"]).groupBy("protein", "i", "j").agg(F.sum(F.col("f2") * F.col("value")).alias("mean_value"))


#: Positions of one tile, and cells (sequences times positions) that one task counts at a time.
TILE, CELLS = 64, 1 << 19


def _tile_counts(long: DataFrame) -> DataFrame:
    """(protein, i, j, a, b, n), i < j: how many sequences have both states. Tiles of positions of a share of the sequences meet in a task, as one product of matrices; what is shuffled grows with the cells, not with pairs of them."""

    def work(table: pa.Table) -> pa.Table:
        seq = table.column("seq_id").combine_chunks().dictionary_encode()
        row, n = seq.indices.to_numpy(), len(seq.dictionary)
        states, state = np.unique(table.column("state").to_numpy(), return_inverse=True)
        pos, (u, v) = table.column("pos").to_numpy(), (table.column(c)[0].as_py() for c in "uv")

        def seen(tile: int) -> np.ndarray:
            out = np.zeros((n, TILE, len(states)), np.float32)  # single precision is exact below 2 to the 24
            own = pos // TILE == tile
            np.add.at(out, (row[own], pos[own] % TILE, state[own]), 1)
            return out.reshape(n, -1)

        counts = seen(u).T @ seen(v)
        x, y = np.nonzero(counts)
        i, j = u * TILE + x // len(states), v * TILE + y // len(states)
        x, y, i, j = (c[i < j] for c in (x, y, i, j))
        ints = {"i": i, "j": j, "a": states[x % len(states)], "b": states[y % len(states)]}
        return pa.table({"protein": pa.repeat(table.column("protein")[0], len(i))} | {k: pa.array(c, pa.int32()) for k, c in ints.items()} | {"n": pa.array(counts[x, y].astype(np.int64))})

    sizes = long.groupBy("protein").agg(F.ceil(F.count(F.lit(1)) / CELLS).alias("shares"), (F.floor(F.max("pos") / TILE) + 1).cast("int").alias("tiles"))
    tile = F.floor(F.col("pos") / TILE).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, tile).alias("u"), F.greatest(k, tile).alias("v")))
    rows = long.join(sizes, "protein").withColumns({"share": F.pmod(F.xxhash64("seq_id"), F.col("shares")), "pair": F.explode(pairs)})
    rows = rows.select("protein", "seq_id", F.col("pos").cast("int").alias("pos"), F.col("state").cast("int").alias("state"), "share", "pair.u", "pair.v")
    schema = f"protein {long.schema['protein'].dataType.simpleString()}, i int, j int, a int, b int, n long"
    return rows.groupBy("protein", "share", "u", "v").applyInArrow(work, schema).groupBy("protein", "i", "j", "a", "b").agg(F.sum("n").alias("n"))


def property_correlation(long: DataFrame, properties: DataFrame) -> DataFrame:
    """Correlation, over sequences without a gap at either, of a property at two positions i < j; null where one of them doesn't vary.

    It depends on how many sequences have which two states: these are counted
    once for all properties, and weigh the values.
    """
    centred = F.col("value") - F.avg("value").over(Window.partitionBy("property"))  # sums of squares of what is far from 0 would cancel
    arrays = properties.select("a", "property", centred.cast("double").alias("value")).filter("value is not null").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("values"))
    names = [r.property for r in properties.select("property").distinct().orderBy("property").collect()]
    arrays = F.broadcast(stored(arrays))  # 20 rows
    known = long.join(arrays.select(F.col("a").alias("state")), "state", "left_semi")
    rows = _tile_counts(known).join(arrays.withColumnRenamed("values", "x"), "a").join(arrays.select(F.col("a").alias("b"), F.col("values").alias("y")), "b")

    def weighted(name) -> Column:
        x, y = F.try_element_at("x", F.lit(name)), F.try_element_at("y", F.lit(name))
        both = x.isNotNull() & y.isNotNull()
        x, y, w = F.when(both, x), F.when(both, y), F.when(both, F.col("n"))
        total = F.sum(w)
        mean_x, mean_y = F.sum(w * x) / total, F.sum(w * y) / total
        spread = lambda v, mean: F.greatest(F.sum(w * v * v) / total - mean * mean, F.lit(0.0))
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies, F.try_divide(F.sum(w * x * y) / total - mean_x * mean_y, F.sqrt(spread(x, mean_x)) * F.sqrt(spread(y, mean_y))))

    return rows.groupBy("protein", "i", "j").agg(*[weighted(n).alias(f"r_{n}") for n in names])


def global_frequencies(freq: DataFrame) -> DataFrame:
    return freq.groupBy("protein", "a").agg(F.avg("f_pc").alias("f"))
