"""Statistics queries, and the log, growth and summary reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairweave.operators import stats as T
from pairweave.plans.registry import query, r6, rounded, table


@query("SELECT CASE WHEN GROUPING(event_type) = 1 THEN NULL ELSE event_type END AS event_type, count(value) AS n, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS sd FROM events GROUP BY ROLLUP (event_type)")
def agg33_summaries(spark, d):
    return rounded(T.summaries(table(spark, d, "events"), ["event_type"], "value"), "q25", "median", "q75", "mean", "sd")


@query("WITH c AS (SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (n_name))) SELECT r_name, n_name, n, round(n / sum(n) OVER (PARTITION BY r_name), 6) + 0.0 AS share FROM c")
def agg32_composition(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return rounded(T.composition(rows, "r_name", "n_name"), "share").select("r_name", "n_name", "n", "share")


@query("""WITH r AS (SELECT l_suppkey AS protein, l_discount AS x, l_tax AS y, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_suppkey, l_tax) - 1) / 2 AS ry FROM lineitem)
SELECT protein, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept, round(regr_r2(y, x), 6) + 0.0 AS r2 FROM r GROUP BY 1""")
def agg40_agreement(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    return rounded(T.agreement(rows, ["protein"], "x", "y"), "pearson", "spearman", "slope", "intercept", "r2")


@query("""WITH p AS (SELECT m.n_regionkey AS region, sign(a.s_acctbal - b.s_acctbal) AS sx, sign(a.s_suppkey % 17 - b.s_suppkey % 17) AS sy FROM supplier a JOIN nation m ON m.n_nationkey = a.s_nationkey JOIN nation n ON n.n_regionkey = m.n_regionkey JOIN supplier b ON n.n_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT region, round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 6) + 0.0 AS kendall FROM p GROUP BY 1""")
def agg40_kendall(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_regionkey").alias("region"), "s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 17).alias("y"))
    return rounded(T.kendall(rows, ["region"], "x", "y", "s_suppkey"), "kendall")


@query("""WITH t AS (SELECT l_suppkey AS protein, l_extendedprice AS v, (l_returnflag = 'R')::INT AS s FROM lineitem),
g AS (SELECT protein, abs(sum(1 - s) OVER w / sum(1 - s) OVER (PARTITION BY protein) - sum(s) OVER w / sum(s) OVER (PARTITION BY protein)) AS gap FROM t WINDOW w AS (PARTITION BY protein ORDER BY v RANGE UNBOUNDED PRECEDING))
SELECT protein, round(max(gap), 6) + 0.0 AS ks FROM g GROUP BY 1""")
def agg40_ks_distance(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").cast("int").alias("s"))
    return rounded(T.ks_distance(rows, ["protein"], "s", "v"), "ks")


@query("WITH h AS (SELECT event_type, CAST(floor((value - 0) / 0.5::DOUBLE) AS INT) AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) + 0.0 AS share FROM h WHERE bin >= 0 AND bin < 200")
def agg34_histogram(spark, d):
    return rounded(T.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 0.5, 200), "share")


@query("""WITH h AS (SELECT l_returnflag AS f, CAST(floor((l_extendedprice - 0) / 1000.0::DOUBLE) AS INT) AS bin FROM lineitem), c AS (SELECT f, bin, count(*) AS n FROM h WHERE bin >= 0 AND bin < 200 GROUP BY ALL),
p AS (SELECT f, bin, n / sum(n) OVER (PARTITION BY f) AS p FROM c), o AS (SELECT bin, sum(n) / sum(sum(n)) OVER () AS q FROM c GROUP BY bin)
SELECT f, bin, round(ln(p / q), 6) + 0.0 AS log_ratio FROM p JOIN o USING (bin)""")
def agg35_log_ratio(spark, d):
    """Observed against overall shares of each bin."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("v"))
    own = T.histogram(rows, ["f"], "v", 0.0, 1000.0, 200).select("f", "bin", "share")
    everything = own.select("bin").distinct().join(T.histogram(rows, [], "v", 0.0, 1000.0, 200).select("bin", F.col("share").alias("q")), "bin")
    return own.join(everything, "bin").select("f", "bin", r6(F.ln(F.col("share") / F.col("q"))).alias("log_ratio"))


@query("SELECT CAST(floor(embedding[1]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS cell_x, CAST(floor(embedding[2]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS cell_y, count(*) AS n FROM embeddings WHERE abs(embedding[1]) < 1.5 AND abs(embedding[2]) < 1.5 GROUP BY ALL")
def agg53_density_2d(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return T.density_2d(e, "x", "y", 0.05, 1.5)


@query("""WITH g AS (SELECT i AS point, i * (100.0::DOUBLE / 499) AS x FROM range(500) t(i))
SELECT event_type, CAST(point AS INT) AS point, round(sum(CASE WHEN abs(x - value) < 2.6 THEN exp(-0.5::DOUBLE * pow((value - x) / 0.3::DOUBLE, 2)) ELSE 0 END) / n / (0.3::DOUBLE * sqrt(2 * pi())), 6) + 0.0 AS density
FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type), g GROUP BY event_type, point, n HAVING density > 0""")
def agg46_kernel_density(spark, d):
    return rounded(T.kernel_density(table(spark, d, "events"), ["event_type"], "value", 0.0, 100.0, 500, 0.3), "density").filter("density > 0")


@query("SELECT b.bin, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events JOIN (SELECT unnest(range(6)) AS bin, unnest([0, 5, 8, 12, 15, 20]) AS lo, unnest([5, 8, 12, 15, 20, 1e300]) AS hi) b ON value > lo AND value < hi GROUP BY ALL")
def agg38_samples_by_bin(spark, d):
    out = T.bin_samples(table(spark, d, "events"), "value", [0.0, 5.0, 8.0, 12.0, 15.0, 20.0, float("inf")])
    return out.groupBy("bin", "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


C = "WITH c AS (SELECT label, vec_id, unnest(range(64)) AS ab, unnest(embedding)::DOUBLE AS w FROM embeddings)"


def cells(spark, d):
    return table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("ab", "w")).withColumn("w", F.col("w").cast("double"))


@query(C + "SELECT ab, round(var_pop(w), 6) + 0.0 AS variance, round(stddev_pop(w), 6) + 0.0 AS sd, round(stddev_pop(w * w), 6) + 0.0 AS sd_of_squares FROM c GROUP BY 1")
def agg36_spread_by_cell(spark, d):
    return rounded(T.spread_by_cell(cells(spark, d), ["ab"], "w"), "variance", "sd", "sd_of_squares")


@query(C + "SELECT ab, round(corr(w, label), 6) + 0.0 AS r_label, round(corr(w * w, label), 6) + 0.0 AS r2_label FROM c GROUP BY 1")
def agg37_correlation_by_cell(spark, d):
    return rounded(T.correlation_by_cell(cells(spark, d), ["ab"], "w", "label"), "r_label", "r2_label")


@query(C + ", h AS (SELECT label, CAST(floor((w + 0.1::DOUBLE) / 0.005::DOUBLE) AS INT) AS bin, count(*) AS n FROM c GROUP BY ALL) SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label), 6) + 0.0 AS share FROM h WHERE bin >= 0 AND bin < 220")
def agg42_value_histogram(spark, d):
    return rounded(T.histogram(cells(spark, d), ["label"], "w", -0.1, 0.005, 220), "share")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice) / 1000000, 6) + 0.0 AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1")
def agg50_growth_totals(spark, d):
    """Totals by date since 1996, and of three sources side by side."""
    rows = table(spark, d, "orders").filter("o_orderdate >= date '1996-01-01'").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    of = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s.lower())
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice") / 1000000).alias("total"), of("F"), of("O"), of("P"))


@query("""WITH s AS (SELECT event_type AS family, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value FROM events)
SELECT family, (step - 1) // 10 AS pass, round(sqrt(sum(value * value)), 6) + 0.0 AS norm FROM s GROUP BY ALL""")
def agg44_gradient_norms(spark, d):
    """Norms of a log's values by family and pass of ten steps."""
    step = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("family"), step.alias("step"), "value")
    return rows.groupBy("family", F.floor((F.col("step") - 1) / 10).alias("pass")).agg(r6(F.sqrt(F.sum(F.col("value") * F.col("value")))).alias("norm"))


@query("""WITH s AS (SELECT event_type AS family, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value FROM events)
SELECT family, step, value - lag(value) OVER (PARTITION BY family ORDER BY step) AS change, min(value) OVER (PARTITION BY family ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM s QUALIFY step % 10 = 0""")
def bay7_log_every_tenth(spark, d):
    """Every tenth step of a log: its change and the best value so far."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("event_type").alias("family"), F.row_number().over(w).alias("step"), (F.col("value") - F.lag("value").over(w)).alias("change"), F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"))
    return rows.filter("step % 10 = 0")


@query("SELECT event_type, user_id, json_extract_string(props, '$.k')::DOUBLE AS k, coalesce(json_extract_string(props, '$.missing')::DOUBLE, json_extract_string(props, '$.k')::DOUBLE) AS either FROM events")
def sca4_json_lookup(spark, d):
    from pairweave.functions.scalars import json_number

    return table(spark, d, "events").select("event_type", "user_id", json_number(F.col("props"), "$.k").alias("k"), json_number(F.col("props"), "$.missing", "$.k").alias("either"))


FEATURES = "f AS (SELECT p_type AS feature, round(avg(p_retailprice / p_size), 6) + 0.0 AS importance FROM part GROUP BY 1)"


@query("WITH " + FEATURES + ", r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS top, row_number() OVER (ORDER BY importance, feature) AS low FROM f) SELECT feature, importance, 'most' AS side FROM r WHERE top <= 20 UNION ALL SELECT feature, importance, 'least' FROM r WHERE low <= 20")
def top5_outermost_features(spark, d):
    """Kinds of parts stand for features, price by size for importance."""
    features = table(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(r6(F.avg(F.col("p_retailprice") / F.col("p_size"))).alias("importance"))
    return T.outermost(features, "feature", "importance", 20)


@query("SELECT vec_id AS step, label AS parameter, round(embedding[8]::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def agg52_gradient_trace(spark, d):
    """Vectors are logged gradients: one element by step and parameter."""
    return rounded(T.element_trace(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 7), "value")
