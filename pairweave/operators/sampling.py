"""Samples by an arithmetic hash: the same rows on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_key(x: Column, y: Column, seed: int) -> Column:
    return F.pmod(x * 7919 + y * 104729 + seed, F.lit(1000003))


def capped(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """Up to ``cap`` rows of each key, in the given (shuffled) order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def quota(counts: DataFrame, fold: str, group_order: list[Column], value: str, most: int) -> DataFrame:
    """Groups, in order, until the sum of ``value`` before them reaches ``most``, by fold. ``counts`` has a row for each group, so folds are the unit of scale."""
    before = F.sum(value).over(Window.partitionBy(fold).orderBy(*group_order).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most)


def split_by_group(rows: DataFrame, group: str, fold: str, group_order: list[Column], train: int, test: int) -> DataFrame:
    """Adds ``part``: "train" for the first groups up to ``train`` rows, "test" for the next ones up to ``test`` rows; others go."""
    counts = rows.groupBy(fold, group).agg(F.count(F.lit(1)).alias("n"))
    first = quota(counts, fold, group_order, "n", train).select(fold, group, F.lit("train").alias("part"))
    second = quota(counts.join(first, [fold, group], "left_anti"), fold, group_order, "n", test).select(fold, group, F.lit("test").alias("part"))
    return rows.join(first.union(second), [fold, group])


def balanced(rows: DataFrame, truth: str, order: list[Column], keys: list[str], balance: int, positives: int) -> DataFrame:
    """Up to ``positives`` true rows and ``balance`` times as many others of each key."""
    cap = F.when(F.col(truth) == 1, positives).otherwise(balance * positives)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, truth).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def decoys(rows: DataFrame, group: str, cls: str, key: Column, ties: list[str], per_group: int, per_class: int) -> DataFrame:
    """Up to ``per_group`` rows of each group and class, and of these up to ``per_class`` of each class, by the shuffle ``key`` (0 to 1,000,002) and ``ties``.

    A class has as many rows as it likes: they are counted by range of the key,
    and only the range in which the class is full is ranked, about a thousandth
    of its rows.
    """
    few = capped(rows.withColumn("_key", key), [group, cls], ["_key", *ties], per_group).withColumn("_range", F.floor(F.col("_key") / 1000))
    upto = Window.partitionBy(cls).orderBy("_range")
    counts = few.groupBy(cls, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))  # 1,001 rows for each class
    both = few.join(F.broadcast(counts.drop("_n").filter(F.col("_before") < per_class)), [cls, "_range"])
    full = F.row_number().over(Window.partitionBy(cls, "_range").orderBy("_key", *ties)) + F.col("_before")
    return both.withColumn("_at", full).filter(F.col("_at") <= per_class).drop("_key", "_range", "_before", "_at")
