"""Operators on small inputs: hand-made cases, plain re-implementations and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.operators import alignment as A
from pairweave.operators import bayes as B
from pairweave.operators import couplings as K
from pairweave.operators import evaluation as E
from pairweave.operators import information as I
from pairweave.operators import models as O
from pairweave.operators import stats as T
from pairweave.operators import structure as U
from pairweave.operators.store import Store
from pairweave.streaming.registration import register_scores


def msa(spark, rows):
    return spark.createDataFrame([("p", k, list(r)) for k, r in enumerate(rows)], "protein string, seq_id long, states array<int>")


def test_weights_of_a_small_alignment(spark):
    a = msa(spark, [(0, 1, 2), (0, 3, 4), (0, 3, 2), (5, 6, 7)])
    ids = {(r.a, r.b): r.ids for r in A.identities(a).collect()}
    assert ids == {(0, 1): 1, (0, 2): 2, (1, 2): 2, (0, 3): 0, (1, 3): 0, (2, 3): 0}
    w = A.sequence_weights(a, 0.8)
    assert {r.weight for r in w.collect()} == {1.0} and A.effective_number(w).first().neff == 4.0
    loose = {r.seq_id: r.weight for r in A.sequence_weights(a, 0.6).collect()}
    assert loose == {0: 0.5, 1: 0.5, 2: pytest.approx(1 / 3), 3: 1.0}


def test_counts_agree_with_each_other(spark):
    r = np.random.default_rng(3)
    a = msa(spark, r.integers(0, 21, (12, 5)).tolist())
    long, w = A.cells(a), A.sequence_weights(a, 0.3)
    one = {(x.i, x.a): x.n for x in A.single_counts(long, w).collect()}
    two = A.pair_counts(long, w).filter("i < j").groupBy("i", "j", "a").agg(F.sum("n").alias("n")).collect()
    assert all(x.n == pytest.approx(one[x.i, x.a]) for x in two)
    neff = A.effective_number(w)
    single = A.frequencies(A.single_counts(long, w), neff)
    f2 = A.pair_frequencies(A.pair_counts(long, w), single, neff)
    # against dense arrays
    states = np.array([x.states for x in a.orderBy("seq_id").collect()])
    weight = np.array([x.weight for x in w.orderBy("seq_id").collect()])
    hot = np.eye(21)[states]
    n2 = np.einsum("s,sia,sjb->ijab", weight, hot, hot)[:, :, :20, :20]
    n1 = np.einsum("s,sia->ia", weight, hot)[:, :20]
    f1 = n1 / (n1.sum(1, keepdims=True) + 1e-10)
    tau = 1 / (weight.sum() + 1)
    p1 = (1 - tau) * f1 + tau / 21
    full = (1 - tau) ** 2 * (n2 / (n2.sum((2, 3), keepdims=True) + 1e-10) - f1[:, None, :, None] * f1[None, :, None, :]) + p1[:, None, :, None] * p1[None, :, None, :]
    assert all(x.f2 == pytest.approx(full[x.i, x.j, x.a, x.b], abs=1e-12) for x in f2.collect())
    mi = np.einsum("ijab,ijab->ij", full, np.log2(full / (p1[:, None, :, None] * p1[None, :, None, :])))
    assert all(x.score == pytest.approx(mi[x.i, x.j], abs=1e-9) for x in I.mutual_information(f2).collect())


def test_gaps_and_single_sequence(spark):
    a = msa(spark, [(20, 20, 3)])
    assert A.effective_number(A.sequence_weights(a)).first().neff == 1.0
    assert {(r.pos, r.gap_fraction) for r in A.gap_fractions(A.cells(a)).collect()} == {(0, 1.0), (1, 1.0), (2, 0.0)}
    kept, dropped = A.drop_gapped_positions(A.cells(a), 50)
    assert [(r.pos, r.state) for r in kept.collect()] == [(0, 3)] and {r.pos for r in dropped.collect()} == {0, 1}


def test_average_product_has_even_means(spark):
    r = np.random.default_rng(1)
    m = r.random((6, 6))
    m = m + m.T
    rows = [("p", i, j, float(m[i, j])) for i in range(6) for j in range(i, 6)]
    out = I.average_product(spark.createDataFrame(rows, "protein string, i int, j int, score double"), spark.createDataFrame([("p", 6)], "protein string, length int")).collect()
    want = m - np.outer(m.mean(0), m.mean(0)) / m.mean()
    assert all(x.apc == pytest.approx(want[x.i, x.j]) for x in out)


def test_ranking_invariants(spark):
    rows = [("g", i, float(-i % 7), i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "protein string, i int, score double, t boolean").withColumn("truth", F.col("t").cast("int"))
    out = E.precision_recall(df, ["protein"], ["i"]).orderBy("rank").collect()
    assert out[-1].recall == 1.0 and out[-1].precision == pytest.approx(14 / 40)
    assert [r.ratio for r in E.rank_grid(spark).orderBy("rank_id").collect()] == np.linspace(1, 0, 50, endpoint=False)[::-1].tolist()


def test_entropy_correction_is_the_dense_one(spark):
    r = np.random.default_rng(2)
    n = 5
    w = r.normal(size=(n, n, 400))
    f = r.dirichlet(np.ones(20), n)
    norm = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            norm[i, j] = norm[j, i] = np.sqrt((w[i, j] ** 2).sum())
    u = -f * np.log2(f)
    uij = np.einsum("ia,jb->ijab", u, u)
    eta = (norm**2 * uij.sum((2, 3))).sum() / (uij**2).sum()
    want = norm**2 - eta * uij.sum((2, 3))
    pairs = spark.createDataFrame([("p", i, j, w[i, j].tolist()) for i in range(n) for j in range(i + 1, n)], "protein string, i int, j int, w array<double>")
    freq = spark.createDataFrame([("p", i, a, float(f[i, a])) for i in range(n) for a in range(20)], "protein string, i int, a int, f_pc double")
    out = K.entropy_correction(K.norms(pairs), K.entropy_terms(freq)).collect()
    assert all(x.corrected == pytest.approx(want[x.i, x.j]) for x in out)
    cells = K.elementwise_correction(pairs, freq)
    assert cells.count() == 400 * n * (n - 1) // 2


def test_likelihood_against_matrices(spark):
    r = np.random.default_rng(5)
    size, k = 4, 3
    mix = B.Mixture(np.array([[0.6, 0.3, 0.1], [0.2, 0.3, 0.5]]), r.normal(0, 0.2, (k, size)), r.uniform(2, 9, (k, size)))
    rows = [("p", 0, j, float(r.integers(20, 90)), (r.dirichlet(np.ones(size)) * 0.9).tolist(), r.normal(0, 0.3, size).tolist(), int(j % 2)) for j in range(1, 8)]
    df = spark.createDataFrame(rows, "protein string, i int, j int, n double, q array<double>, w array<double>, truth int")
    for x in B.log_likelihoods(df, mix, 0.1).collect():
        _, _, j, n, q, w, _ = rows[x.j - 1]
        q, w = np.array(q), np.array(w)
        h = n * (np.diag(q) - np.outer(q, q)) + 0.1 * np.eye(size)  # curvature at w, with the regulariser
        ll = []
        for m in range(k):
            prec = n * (np.diag(q) - np.outer(q, q)) + np.diag(mix.precision[m])
            b = h @ w + mix.precision[m] * mix.mean[m]
            mean = np.linalg.solve(prec, b)
            ll.append(0.5 * (np.log(mix.precision[m]).sum() - (mix.precision[m] * mix.mean[m] ** 2).sum() - np.linalg.slogdet(prec)[1] + mean @ prec @ mean))
        for c, got in ((0, x.ll_0), (1, x.ll_1)):
            assert got == pytest.approx(np.log((mix.weights[c] * np.exp(ll)).sum()))
    value, g = B.objective(df, mix, 0.1)
    for name, place in (("mean", (1, 2)), ("precision", (2, 0)), ("weights", (1, 1))):
        eps = 1e-5
        sides = []
        for s in (eps, -eps):
            other = B.Mixture(mix.weights.copy(), mix.mean.copy(), mix.precision.copy())
            getattr(other, name)[place] += s
            sides.append(B.objective(df, other, 0.1)[0])
        assert getattr(g, name)[place] == pytest.approx((sides[0] - sides[1]) / (2 * eps), rel=1e-4, abs=1e-7)
    better, log = B.fit(df, mix, 0.1, 3)
    assert log == sorted(log) and log[-1] > value and better.weights.sum(1) == pytest.approx([1, 1])


def test_close_pairs_and_kendall(spark):
    r = np.random.default_rng(4)
    pts = r.uniform(-20, 20, (60, 3))
    df = spark.createDataFrame([("p", i, *map(float, x)) for i, x in enumerate(pts)], "protein string, pos int, x double, y double, z double")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if math.dist(pts[i], pts[j]) <= 8}
    assert {(x.i, x.j) for x in U.close_pairs(df, 8.0).collect()} == want
    assert U.distance_map(df).count() == 60 * 59 // 2
    flat = spark.createDataFrame([("g", i, float(i), 1.0) for i in range(3)], "k string, id int, x double, y double")
    assert T.agreement(flat, ["k"], "x", "y").first().pearson is None


def test_held_out_accuracy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    rows = [(*map(float, v), int(v[0] + 0.3 * e > 0), k % 3) for k, (v, e) in enumerate(zip(x, r.normal(size=600)))]
    df = spark.createDataFrame([*rows, (float("nan"), 0.0, 0.0, 1, 0)], "a double, b double, c double, y int, fold int")
    out = O.leave_one_fold_out(df, ["a", "b", "c"], "y", "fold", [0, 1, 2], numTrees=10, maxDepth=4)
    assert out.count() == 600
    assert out.filter("(score >= 0.5) = (y = 1)").count() > 500
    model = O.train(df, ["a", "b", "c"], "y", numTrees=10, maxDepth=4)
    assert O.importances(model, ["a", "b", "c"])[0][0] == "a" and O.select_features(model, ["a", "b", "c"], 60) == ["a"]


def test_store_and_stream(spark, tmp_path):
    pairs = spark.createDataFrame([("p", i, float(i), i % 2) for i in range(6)], "protein string, i int, distance double, truth int")
    s = Store.create(spark, pairs, ["protein", "i"], str(tmp_path / "store"))
    for k, part in enumerate(([0, 1, 2], [2, 3, 9])):
        spark.createDataFrame([("p", i, "m", float(10 * k + i)) for i in part], "protein string, i int, method string, score double").write.mode("append").parquet(str(tmp_path / "in"))
        register_scores(spark, str(tmp_path / "in"), "protein string, i int, method string, score double", s, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.i, r.score) for r in s.scores(["m"]).collect()) == [(0, 0.0), (1, 1.0), (2, 12.0), (3, 13.0)]
    s.put_method("m", pairs.select("protein", "i", F.lit(5.0).alias("score")))  # is there: stays
    assert s.scores(["m"]).count() == 4
    s.remove_method("m")
    assert s.methods() == []
