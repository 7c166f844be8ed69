"""Distributions, agreement of methods, correlations and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both; null where one of them doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def summaries(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, mean and deviation by group, and over all (keys null)."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.rollup(*by).agg(F.count(value).alias("n"), quartiles.alias("q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.select(*by, "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "mean", "sd")


def composition(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Counts and row shares by (row, column), and the same over all rows (``row`` null)."""
    out = rows.groupingSets([[F.col(row), F.col(column)], [F.col(column)]], row, column).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of the value in its group; ties share the mean of their ranks."""
    w = Window.partitionBy(*keys).orderBy(value)
    return rows.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2)


def agreement(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation and the linear fit of y on x by group."""
    both = average_ranks(average_ranks(rows, keys, x, "_rx"), keys, y, "_ry")
    return both.groupBy(*keys).agg(correlation(F.col(x), F.col(y)).alias("pearson"), correlation(F.col("_rx"), F.col("_ry")).alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def kendall(rows: DataFrame, keys: list[str], x: str, y: str, ident: str) -> DataFrame:
    """Kendall's tau-b by group. Counts by sign of all pairs, so the work grows with the square of a group: for groups as large as a chain's methods, not for whole corpora."""
    a = rows.select(*keys, F.col(ident).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = rows.select(*keys, F.col(ident).alias("_j"), F.col(x).alias("_u"), F.col(y).alias("_v"))
    sx, sy = F.signum(F.col("_x") - F.col("_u")), F.signum(F.col("_y") - F.col("_v"))
    out = a.join(b, keys).filter("_i < _j").groupBy(*keys).agg(F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return out.select(*keys, (F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("kendall"))


def ks_distance(rows: DataFrame, keys: list[str], sample: str, value: str) -> DataFrame:
    """Greatest gap of the distribution functions of samples 0 and 1."""
    upto = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    share = lambda s: F.sum((F.col(sample) == s).cast("long")).over(upto) / F.sum((F.col(sample) == s).cast("long")).over(all_)
    return rows.select(*keys, F.abs(share(0) - share(1)).alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def histogram(rows: DataFrame, by: list[str], value: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts of [low + k * width, low + (k + 1) * width), k from 0; values outside are not counted; shares within ``by``."""
    k = F.floor((F.col(value) - low) / width).cast("int")
    counts = rows.withColumn("bin", k).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)


def density_2d(rows: DataFrame, x: str, y: str, width: float, reach: float) -> DataFrame:
    """Counts on a square grid of cells, from -reach to reach."""
    inside = (F.abs(F.col(x)) < reach) & (F.abs(F.col(y)) < reach)
    return rows.filter(inside).groupBy(F.floor(F.col(x) / width).alias("cell_x"), F.floor(F.col(y) / width).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def kernel_density(rows: DataFrame, by: list[str], value: str, low: float, high: float, points: int, bandwidth: float) -> DataFrame:
    """Gaussian kernel density on an even grid. Values beyond 8 bandwidths add nothing to a double and are skipped."""
    step = (high - low) / (points - 1)
    reach = int(8 * bandwidth / step) + 1
    near = F.round((F.col(value) - low) / step).cast("int")
    grid = F.explode(F.expr(f"sequence(greatest(0, _near - {reach}), least({points - 1}, _near + {reach}))"))
    sums = rows.withColumn("_near", near).filter(f"_near + {reach} >= 0 and _near - {reach} <= {points - 1}").select(*by, value, grid.alias("point"))
    z = (F.col(value) - (low + F.col("point") * step)) / bandwidth
    counts = rows.groupBy(*by).agg(F.count(value).alias("_n"))
    sums = sums.groupBy(*by, "point").agg(F.sum(F.exp(-0.5 * z * z)).alias("s"))
    sums = sums.join(counts, by) if by else sums.crossJoin(F.broadcast(counts))  # one row
    return sums.select(*by, "point", (F.col("s") / F.col("_n") / (bandwidth * F.sqrt(2 * F.pi()))).alias("density"))


def bin_samples(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Adds ``bin``: k where bounds[k] < value < bounds[k + 1]; other rows go."""
    inside = [F.when((F.col(value) > a) & (F.col(value) < b), k) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return rows.withColumn("bin", F.coalesce(*inside)).filter("bin is not null")


def spread_by_cell(rows: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Population variance and deviation of values and of their squares."""
    square = F.col(value) * F.col(value)
    return rows.groupBy(*cell).agg(F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("sd"), F.stddev_pop(square).alias("sd_of_squares"))


def correlation_by_cell(rows: DataFrame, cell: list[str], value: str, *others: str) -> DataFrame:
    """Correlation of values, and of their squares, with other columns."""
    square = F.col(value) * F.col(value)
    return rows.groupBy(*cell).agg(*[correlation(F.col(value), F.col(o)).alias(f"r_{o}") for o in others], *[correlation(square, F.col(o)).alias(f"r2_{o}") for o in others])


def outermost(rows: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The n rows of greatest and the n of least ``value`` with their side; equal values by name. Two top-n passes, no full sort."""
    most = rows.orderBy(F.col(value).desc(), name).limit(n).withColumn("side", F.lit("most"))
    least = rows.orderBy(F.col(value).asc(), name).limit(n).withColumn("side", F.lit("least"))
    return most.union(least)


def element_trace(log: DataFrame, step: str, parameter: str, vector: str, element: int) -> DataFrame:
    """(step, parameter, value): one element of a logged vector, counted from 0; None where a vector is too short."""
    return log.select(F.col(step).alias("step"), F.col(parameter).alias("parameter"), F.try_element_at(vector, F.lit(element + 1)).cast("double").alias("value"))
