"""Long chains and texts: work is dealt over tasks, pairs meet once, and nothing is held for each pair."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pairweave.operators import couplings as K
from pairweave.operators import features as X
from pairweave.operators import information as I
from pairweave.operators import mixture as Q
from pairweave.operators import models as O
from pairweave.operators import sequences as S
from pairweave.operators import store as St
from pairweave.operators import structure as U
from pairweave.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def chain(spark):
    """One chain of several blocks, numbered from below zero and with a hole."""
    r = np.random.default_rng(3)
    rows = [("p", k - 5 if k < 700 else k + 40, *r.normal(0, 9, 3).tolist(), r.normal(0, 1, 4).astype("f4").tolist()) for k in range(1100)]
    return spark.createDataFrame(rows, "protein string, pos int, x double, y double, z double, e array<float>")


def test_one_chain_is_dealt_over_tasks(chain):
    rows = U.distance_map(chain).withColumn("task", F.spark_partition_id())
    got = rows.agg(F.count("*"), F.countDistinct("i", "j"), F.countDistinct("task"), F.sum("d")).first()
    at = np.array([(r.x, r.y, r.z) for r in chain.orderBy("pos").collect()])
    want = sum(float(np.sqrt(((at[k + 1 :] - at[k]) ** 2).sum(1)).sum()) for k in range(len(at)))
    assert got[0] == got[1] == 1100 * 1099 // 2
    assert got[2] > 1
    assert got[3] == pytest.approx(want)


def test_contact_numbers_make_no_row_for_each_cell(spark):
    rows = spark.createDataFrame([("p", 0, 1, 5.0), ("p", 0, 9, 7.0), ("q", 0, 30, 9.0)], "protein string, i int, j int, d double")
    out = U.contact_numbers(rows, [6, 8], [0, 8])
    assert {(r.protein, r.thr, r.sep): r.contacts for r in out.collect()} == {("p", 6, 0): 1, ("p", 6, 8): 0, ("p", 8, 0): 2, ("p", 8, 8): 1, ("q", 6, 0): 0, ("q", 6, 8): 0, ("q", 8, 0): 0, ("q", 8, 8): 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_states_are_on_the_points_before_pairs(spark, chain):
    query = chain.select("protein", "pos", F.when(F.col("pos") % 5 == 0, 20).otherwise(F.pmod("pos", F.lit(7))).cast("int").alias("state"))
    got = X.state_lookup(chain, query)
    n = chain.filter("pos % 5 <> 0").count()
    assert got.count() == n * (n - 1) // 2
    assert got.filter("a <> pmod(i, 7) or b <> pmod(j, 7)").count() == 0


def test_couplings_of_factors(spark, chain):
    some = chain.filter("pos % 40 = 0")
    pairs = U.residue_pairs(some, ["e"])
    w = F.flatten(F.transform("e_i", lambda u: F.transform("e_j", lambda v: u.cast("double") * v.cast("double"))))
    rows = pairs.select("protein", "i", "j", w.alias("w"))
    want = {(r.i, r.j): r.norm for r in K.norms(rows).collect()}
    got = {(r.i, r.j): r.norm for r in K.norms_from_factors(pairs).collect()}
    assert got == pytest.approx(want)
    beta = np.arange(16) / 7
    want = {(r.i, r.j): math.fsum(x * b for x, b in zip(r.w, beta)) for r in rows.collect()}
    assert {(r.i, r.j): r.score for r in K.weighted_from_factors(pairs, beta).collect()} == pytest.approx(want)


def test_average_product_by_points(spark, chain):
    some = chain.filter("pos % 60 = 0")
    lengths = some.groupBy("protein").agg(F.count("*").alias("length"))
    score = lambda df: df.withColumn("score", 1 / (1 + F.col("d")))
    want = {(r.i, r.j): r.apc for r in I.average_product(score(U.distance_map(some)), lengths).collect()}
    p = I.points_with_means(some, score(U.distance_map(some)), lengths)
    out = I.with_average_product(score(U.distance_map(p, both=["mean"], once=["overall"])))
    assert {(r.i, r.j): r.apc for r in out.collect()} == pytest.approx(want)


def test_ranked_pairs_shrink_to_the_rank(spark, monkeypatch):
    monkeypatch.setattr(X, "SORTED", 3)
    monkeypatch.setattr(X, "BINS", 4)
    r = np.random.default_rng(5)
    rows = [(p, 0, k, float(r.integers(0, 30)) if p == "p" else 1.0) for p in "pq" for k in range(80)]
    scores = spark.createDataFrame(rows, "protein string, i int, j int, score double")
    wanted = spark.createDataFrame([("p", 37), ("q", 5)], "protein string, k int")
    got = {x.protein: (x.score, x.i, x.j) for x in X.ranked_pairs(scores, wanted).collect()}
    order = sorted((x for x in rows if x[0] == "p"), key=lambda x: (-x[3], x[1], x[2]))
    assert got == {"p": (order[36][3], *order[36][1:3]), "q": (1.0, 0, 4)}


def test_pair_weights_of_factors(spark, chain):
    pairs = U.distance_map(chain.filter("pos % 30 = 0"), both=["e"]).withColumn("near", (F.col("d") < 12).cast("int"))
    w = F.flatten(F.transform("e_i", lambda u: F.transform("e_j", lambda v: u.cast("double") * v.cast("double"))))
    rows = pairs.select(w.alias("w"), "near")
    got = O.learn_pair_weights(pairs, ["e_i", "e_j"], "near", made=K.products)
    data = rows.select(array_to_vector("w").alias("features"), F.col("near").cast("double").alias("label"))
    want = LogisticRegression(standardization=False, regParam=1 / data.count(), tol=1e-10).fit(data)
    assert got.weights == pytest.approx(want.coefficients.tolist(), abs=2e-3)
    assert got.intercept == pytest.approx(want.intercept, abs=2e-3)


def test_mixture_objective_of_factors(chain):
    pairs = U.residue_pairs(chain.filter("pos % 60 = 0"), ["e"]).selectExpr("e_i", "e_j", "50D as n", "cast(j % 2 as int) as truth", "i", "j")

    def made(part):
        w = K.products(part)
        return K.share_values(w) * 0.9, w

    w = F.flatten(F.transform("e_i", lambda u: F.transform("e_j", lambda v: u.cast("double") * v.cast("double"))))
    rows = pairs.withColumn("w", w).withColumn("q", F.transform(K.shares("w"), lambda x: x * 0.9))
    p = Q.Parameters.start(2, 16, 1)
    value, g = Q.objective(pairs, p, 0.05, made=made)
    want, h = Q.objective(rows, p, 0.05)
    assert value == pytest.approx(want)
    assert g.mean == pytest.approx(h.mean)


@pytest.mark.parametrize("text", ["ab-c--d", "---", "abc", "-a-b", "é1Zz"])
def test_texts_are_read_where_they_lie(spark, text):
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string")
    rows = U.letters(df, "k", "t")
    gap = lambda c="c": ~F.col(c).rlike("^[A-Za-z]$")
    runs = U.gap_runs(rows, "k", gap()).collect()
    out = U.over_texts(df, "k", "t", U.runs_of, "runs long, longest long, close long")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(1, len(runs), max(r.end - r.start + 1 for r in runs), sum(r.close for r in runs))] if runs else []
    assert [tuple(r) for r in out.collect()] == want
    pos = U.running_position(rows, "k", gap()).agg(F.max("pos"), F.sum(F.when(~gap(), F.col("pos")))).first()
    assert [tuple(r) for r in U.over_texts(df, "k", "t", U.positions_of, "last long, total long").collect()] == [(1, *pos)]
    back = rows.join(U.letters(df.withColumn("t", F.reverse("t")), "k", "t").withColumnRenamed("c", "r"), ["k", "at"])
    both = U.position_mapping(back, "k", gap(), gap("r")).collect()
    want = [(1, len(both), sum(abs(r.pos_a - r.pos_b) for r in both))] if both else []
    assert [tuple(r) for r in U.over_texts(df, "k", "t", lambda g: U.mapping_of(g, g[::-1]), "n long, shift long").collect()] == want


def test_only_sequences_with_residues_are_mapped(spark, monkeypatch):
    """Sequences of other proteins, however many, aren't read letter by letter."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    sequences = spark.range(300).select(F.col("id").alias("protein"), F.lit("ABcD").alias("marked"))
    made = S.position_map
    monkeypatch.setattr(S, "position_map", lambda marked: made(counted(marked)))
    out = S.renumbered(spark.createDataFrame([(7, 3), (7, 9), (400, 1)], "protein long, res_no int"), sequences)
    assert [tuple(r) for r in out.orderBy("res_no").collect()] == [(7, 3, 4), (7, 9, None)]
    assert seen.value <= 2  # an expression that is used twice may call it twice


def test_property_correlation_counts_states_once(spark):
    """Against numpy, over several tiles and shares; a property that lacks a residue, and a position that doesn't vary."""
    r = np.random.default_rng(8)
    n, length = 90, 70
    states = r.integers(0, 21, (n, length))
    states[:, 3] = 5
    value = {(p, a): float(r.normal(1000 * p, 1)) for p in range(2) for a in range(20) if (p, a) != (1, 7)}
    long = spark.createDataFrame([("p", k, i, int(s)) for k, row in enumerate(states) for i, s in enumerate(row)], "protein string, seq_id long, pos int, state int")
    props = spark.createDataFrame([(p, a, v) for (p, a), v in value.items()], "property int, a int, value double")
    got = {(x.i, x.j): (x.r_0, x.r_1) for x in I.property_correlation(long, props).collect()}
    assert set(got) == {(i, j) for i in range(length) for j in range(i + 1, length)}
    for i, j in [(0, 1), (2, 69), (3, 10), (63, 64), (1, 68), (65, 69)]:
        for p in range(2):
            xy = [(value[p, a], value[p, b]) for a, b in states[:, [i, j]].tolist() if (p, a) in value and (p, b) in value]
            want = None if 3 in (i, j) else np.corrcoef(np.array(xy).T)[0, 1]
            assert got[i, j][p] == (None if want is None else pytest.approx(want, abs=1e-9)), (i, j, p)
    text = I.property_correlation(long, props)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("covar_pop") == 0


def test_close_pairs_are_not_shuffled(spark, chain):
    """Several atoms of a residue, several blocks, boxes out of reach; a point that lacks a coordinate."""
    r = np.random.default_rng(2)
    rows = [("p", k, *(np.array([k * 0.05, 0, 0]) + r.normal(0, 2, 3)).tolist()) for k in range(1300) for _ in range(2)]
    df = spark.createDataFrame([*rows, ("p", 3, None, 0.0, 0.0), ("p", 4, math.nan, 0.0, 0.0), ("q", 0, 0.0, 0.0, 0.0)], "protein string, pos int, x double, y double, z double")
    out = U.close_pairs(df, 3.0)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text.split("MapInArrow")[0]
    at = np.array([x[2:] for x in rows]).reshape(1300, 2, 3)
    d = np.sqrt(((at[:, None, :, None] - at[None, :, None]) ** 2).sum(-1)).min((2, 3))
    want = {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= 3.0)) if i < j}
    got = {(x.i, x.j): x.d for x in out.collect()}
    assert got == pytest.approx(want) and out.count() == len(want)


def test_features_are_written_by_the_tasks_that_have_them(spark, chain, tmp_path):
    rows = U.distance_map(chain)
    St.write_features(rows, str(tmp_path / "f"))
    assert len(list((tmp_path / "f" / "protein=p").glob("*.parquet"))) > 1
    assert St.read_features(spark, str(tmp_path / "f")).count() == 1100 * 1099 // 2


def test_structures_are_stored_as_points(spark, chain):
    made = St.StructureStore.create(spark, chain, 6)
    want = {(x.i, x.j): x.d for x in U.distance_map(chain).filter("j - i >= 6").collect()}
    again = St.StructureStore(spark, made.path, made.keys).pairs()
    assert {(x.i, x.j): x.distance for x in again.collect()} == want
    assert sum(spark.read.parquet(f).count() for f in again.inputFiles()) == 1100


def test_scores_of_structures(spark, chain, tmp_path):
    """A store of points takes the scores that a store of its pairs takes, in part and again; of new methods, and where all pairs have new scores, nothing is stored on the way."""
    few = chain.filter("pos < 20")
    made = St.StructureStore.create(spark, few, 3)
    plain = St.Store.create(spark, made.pairs(), made.keys)
    score = lambda k: F.array(*[F.struct(F.lit(m).alias("method"), (F.col("i") * k + F.col("j")).cast("double").alias("score")) for m in "ab"])
    rows = lambda df, k: df.select("protein", "i", "j", F.inline(score(k)))
    pairs = U.distance_map(chain.filter("pos < 25"))
    for part, k in ((pairs, 1), (pairs.filter("i < 4"), 2), (pairs, 3)):
        plain.put_methods(rows(part, k))
        made.put_methods(rows(made.known(part), k), ["a", "b"], known=True)
        got, want = ({(x.i, x.j, x.method): x.score for x in s.scores().collect()} for s in (made, plain))
        assert got == want and len(got) == 2 * made.pairs().count()
    plan = made.known(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan


def test_predictions_meet_their_prior_without_a_join(spark, chain):
    from pairweave.operators import prediction as R
    from pairweave.operators.mixture import Parameters

    pairs = U.distance_map(chain.filter("pos < 9")).select("protein", "i", "j", F.lit(0.1).alias("prior"), F.lit(50.0).alias("n"), F.lit([0.2, 0.3]).alias("q"), F.lit([0.1, -0.1]).alias("w"))
    assert "Join" not in R.predictions(pairs, Parameters.start(2, 2, 1).mixture(), 0.05)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_rank_changes_sort_and_never_group(spark, tmp_path):
    """A group is shuffled once, by tasks whose number doesn't follow the size."""
    rows = [(k % 2, k // 6, k % 3, k % 5, float(k % 7), float(k % 11), k % 4 / 10) for k in range(120)]
    table = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["win10_rank_changes"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(ORACLES["win10_rank_changes"]).fetchall())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
