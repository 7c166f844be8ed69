"""Ranking evaluation of scored pairs: any number of methods over any number of groups.

All operators take the names of their key columns. A ranking is by descending
score; ``ties`` are the columns that make it complete. What belongs to one
group meets in one task, so groups are the unit of scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks are shares of a group's length, from 1/steps to 1.
RANK_STEPS = 50


def ranking(keys: list[str], ties: list[str]):
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), *ties)


def ranked(pairs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(ranking(keys, ties)))


def precision_recall(pairs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Adds rank, precision and recall of the pairs up to each; ``truth`` is 0 or 1."""
    upto = ranking(keys, ties).rowsBetween(Window.unboundedPreceding, 0)
    hits = F.sum("truth").over(upto)
    return ranked(pairs, keys, ties).withColumn("precision", hits / F.col("rank")).withColumn("recall", hits / F.sum("truth").over(Window.partitionBy(*keys)))


def mean_error(pairs: DataFrame, keys: list[str], ties: list[str], threshold: float) -> DataFrame:
    """Adds rank and the mean of max(distance - threshold, 0) of the pairs up to each."""
    upto = ranking(keys, ties).rowsBetween(Window.unboundedPreceding, 0)
    return ranked(pairs, keys, ties).withColumn("mean_error", F.avg(F.greatest(F.col("distance") - threshold, F.lit(0.0))).over(upto))


def rank_grid(spark, steps: int = RANK_STEPS) -> DataFrame:
    """(rank_id, ratio), built downwards from 1, as the doubles decide how halves are rounded."""
    return spark.range(steps).select((F.lit(steps) - F.col("id")).cast("int").alias("rank_id"), (F.lit(1.0) - F.col("id") * F.lit(1.0 / steps)).alias("ratio"))


def at_ranks(ranked_pairs: DataFrame, keys: list[str], lengths: DataFrame, values: list[str], steps: int = RANK_STEPS) -> DataFrame:
    """The values at ranks that are shares of each group's length; null beyond the last pair.

    ``lengths`` has the keys that it shares with the pairs and ``length``. The
    share counts from 0 and is rounded half to even, so rank = rint(ratio * length) + 1.
    The wanted ranks, at most ``steps`` of a group, are taken in the pass that ranks.
    """
    shared = [k for k in keys if k in lengths.columns]
    grid = F.array(*[F.struct(F.lit(steps - i).alias("rank_id"), F.lit(1.0 - i * (1.0 / steps)).alias("ratio")) for i in range(steps)])
    rank_of = lambda g: (F.rint(g["ratio"] * F.col("length")) + 1).cast("int")
    rows = ranked_pairs.select(*keys, "rank", *values).join(lengths.select(*shared, "length"), shared)
    rows = rows.filter((F.col("rank") == 1) | F.exists(grid, lambda g: rank_of(g) == F.col("rank")))  # every group has a first rank
    groups = rows.groupBy(*keys, "length").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct(*values).alias("v")))).alias("at"))
    wanted = groups.select(*keys, "length", "at", F.explode(grid).alias("g"))
    found = wanted.select(*keys, "g.rank_id", "g.ratio", F.try_element_at("at", rank_of(F.col("g"))).alias("v"))
    return found.select(*keys, "rank_id", "ratio", *[F.col("v")[c].alias(c) for c in values])


def mean_by_rank(values_at_ranks: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over groups at each rank, and how many groups have one there."""
    return values_at_ranks.groupBy(*by, "rank_id").agg(F.avg(value).alias("mean_value"), F.count(value).alias("size"))


def mean_precision(values_at_ranks: DataFrame, keys: list[str], value: str = "precision") -> DataFrame:
    return values_at_ranks.groupBy(*keys).agg(F.avg(value).alias("mean_precision"))


def quartile_bins(properties: DataFrame, value: str, right_closed: bool = True) -> DataFrame:
    """Adds ``bin`` 1 to 4 by the quartiles of the values and a zero; null outside. Bins are (lower, upper], or [lower, upper)."""
    edges = properties.select(F.col(value).cast("double").alias("v")).union(properties.sparkSession.range(1).select(F.lit(0.0).alias("v")))
    edges = edges.agg(F.percentile("v", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("edges"))
    out = properties.crossJoin(F.broadcast(edges))  # one row
    low, high = (lambda a, b: a > b, lambda a, b: a <= b) if right_closed else (lambda a, b: a >= b, lambda a, b: a < b)
    inside = [F.when(low(F.col(value), F.col("edges")[k]) & high(F.col(value), F.col("edges")[k + 1]), k + 1) for k in range(4)]
    return out.withColumn("bin", F.coalesce(*inside)).drop("edges")


def moving_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Adds the centred moving mean over ``window`` rows, fewer at the ends; an even window reaches one row further back."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window // 2), (window - 1) // 2)
    return rows.withColumn("moving_mean", F.avg(value).over(w))


def separated(pairs: DataFrame, least: int, i: str = "i", j: str = "j", strict: bool = False) -> DataFrame:
    gap = F.col(j) - F.col(i)
    return pairs.filter(gap > least if strict else gap >= least)


def contact(distance: Column, threshold: float, inclusive: bool = True) -> Column:
    return (distance <= threshold if inclusive else distance < threshold).cast("int")


def without_dead_zone(pairs: DataFrame, contact_thr: float, noncontact_thr: float) -> DataFrame:
    """Drops pairs that are neither contacts nor clearly apart."""
    return pairs.filter((F.col("distance") <= contact_thr) | (F.col("distance") > noncontact_thr)) if noncontact_thr > contact_thr else pairs


OPERATIONS = {
    "greater": lambda x, v: x > v, "less": lambda x, v: x < v, "greater_equal": lambda x, v: x >= v,
    "less_equal": lambda x, v: x <= v, "equal": lambda x, v: x == v, "not_equal": lambda x, v: x != v,
}


def groups_passing(meta: DataFrame, group: str, filters: list[tuple[str, str, float]]) -> DataFrame:
    """Groups of which every row's JSON ``meta`` passes all (path, operation, value); a path that lacks fails."""
    passes = F.lit(True)
    for path, operation, value in filters:
        passes = passes & F.coalesce(OPERATIONS[operation](F.get_json_object("meta", path).cast("double"), F.lit(value)), F.lit(False))
    return meta.groupBy(group).agg(F.min(passes).alias("ok")).filter("ok").select(group)


def chosen_methods(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Rows of the methods; all rows if one of them is unknown."""
    known = {r.method for r in scores.select("method").distinct().collect()}
    return scores.filter(F.col("method").isin(methods)) if set(methods) <= known else scores


def groups_with_all_methods(scores: DataFrame, group: str, methods: list[str]) -> DataFrame:
    return scores.filter(F.col("method").isin(methods)).groupBy(group).agg(F.countDistinct("method").alias("k")).filter(F.col("k") == len(methods)).select(group)


def top_share(pairs: DataFrame, keys: list[str], ties: list[str], divisor: int = 2) -> DataFrame:
    """The best length / divisor pairs of each group."""
    return ranked(pairs, keys, ties).filter(F.col("rank") <= F.floor(F.col("length") / divisor))


def rank_changes(pairs: DataFrame, keys: list[str], first: str, second: str, ties: list[str], length: Column) -> DataFrame:
    """Pairs (a row for each, with both methods' scores in columns) among the best ``length`` of either method, with both ranks and the sign of their difference.

    ``length`` may count rows over a window of the keys. A group is shuffled once, and
    pairs are sorted for each method, never grouped: what a task holds is its share of them.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows are packed far closer in the shuffle than in sorts: the number of tasks must not follow their size there.
    rows = pairs.repartition(parts, *keys)
    for name, method in (("rank_1", first), ("rank_2", second)):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(method).desc(), *ties)))
        if name == "rank_1":
            rows = rows.withColumn("length", length)  # in the same order
    rows = rows.filter("rank_1 <= length or rank_2 <= length")
    return rows.select(*keys, *ties, "rank_1", "rank_2", F.signum(F.col("rank_1") - F.col("rank_2")).cast("int").alias("change"))


def classification_report(predictions: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall and F1 of ``score`` against ``truth``."""
    hit, real = F.col("score") >= threshold, F.col("truth") == 1
    n = lambda c: F.sum(c.cast("long"))
    out = predictions.groupBy(*by).agg(n(hit & real).alias("tp"), n(hit & ~real).alias("fp"), n(~hit & real).alias("fn"), n(~hit & ~real).alias("tn"))
    ratio = lambda x, y: F.when(y > 0, x / y)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def area_under_pr(pairs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Average precision: precision at each true pair, averaged."""
    return precision_recall(pairs, keys, ties).filter("truth = 1").groupBy(*keys).agg(F.avg("precision").alias("average_precision"))


def curve_differences(means: DataFrame, first: str, second: str) -> DataFrame:
    """Differences of two methods' mean curves by rank."""
    a = means.filter(F.col("method") == first).select("rank_id", F.col("mean_value").alias("a"))
    b = means.filter(F.col("method") == second).select("rank_id", F.col("mean_value").alias("b"))
    return a.join(b, "rank_id").select("rank_id", (F.col("a") - F.col("b")).alias("difference"))


def fold_summary(scores: DataFrame, option: str, fold: str, value: str, best: int) -> DataFrame:
    """Mean over folds of each option, and whether it is among the ``best``."""
    means = scores.groupBy(option, fold).agg(F.avg(value).alias("m")).groupBy(option).agg(F.avg("m").alias("mean_score"))
    top = means.orderBy(F.col("mean_score").desc(), option).limit(best).select(option, F.lit(True).alias("is_best"))  # a row for each option
    return means.join(F.broadcast(top), option, "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))
