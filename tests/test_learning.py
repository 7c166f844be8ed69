"""The mixture's modes, registered predictions, saved forests, selections, feature rows, inputs, decoys and deep alignments."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.operators import alignment as A
from pairweave.operators import bayes as B
from pairweave.operators import couplings as K
from pairweave.operators import features as X
from pairweave.operators import inputs as N
from pairweave.operators import mixture as Q
from pairweave.operators import models as O
from pairweave.operators import prediction as R
from pairweave.operators import sampling as M
from pairweave.operators.store import Store

SIZE = 5


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(8)
    rows = [("p" if k % 2 else "q", 0, k, float(r.integers(20, 90)), (r.dirichlet(np.ones(SIZE)) * 0.9).tolist(), r.normal(0, 0.4, SIZE).tolist(), int(k % 3 == 0), 30 if k % 2 else 70) for k in range(24)]
    rows.append(("q", 1, 2, 0.0, [0.2] * SIZE, [float("nan")] * SIZE, 1, 70))  # adds nothing, but counts
    return spark.createDataFrame(rows, "protein string, i int, j int, n double, q array<double>, w array<double>, truth int, length int").repartition(3).cache()


MODES = [
    dict(),
    dict(of_length=True),
    dict(isotropic=True),
    dict(isotropic=True, of_length=True, fixed=frozenset({"weight_bg_0", "weight_contact_0", "mu_0", "prec_1"})),
]


@pytest.mark.parametrize("mode", MODES)
def test_gradients_by_finite_differences(pairs, mode):
    p = Q.Parameters.start(3, SIZE, 4, **mode)
    spreads = {"spread_mean": 0.3, "spread_precision": 40.0}
    value, g = Q.objective(pairs, p, 0.05, **spreads)
    assert value == pytest.approx(Q.objective(pairs, p, 0.05, gradient=False, **spreads)[0])
    eps = 1e-5
    for name, place in (("logits", (1, 2)), ("mean", (1, 3)), ("log_precision", (2, 1))):
        sides = []
        for s in (eps, -eps):
            x = getattr(p, name).copy()
            x[place[:1] if name == "log_precision" and p.isotropic else place] += s
            sides.append(Q.objective(pairs, replace(p, **{name: x}), 0.05, gradient=False, **spreads)[0])
        assert getattr(g, name)[place] == pytest.approx((sides[0] - sides[1]) / (2 * eps), rel=1e-4, abs=1e-8)


def test_precision_of_length_is_that_of_a_scaled_mixture(pairs):
    p = Q.Parameters.start(2, SIZE, 1, of_length=True)
    own = pairs.filter("protein = 'p'")
    scaled = replace(p, of_length=False, log_precision=p.log_precision + math.log(30))
    assert Q.objective(own, p, 0.05)[0] == pytest.approx(Q.objective(own, scaled, 0.05)[0])


def test_a_fit_leaves_what_is_fixed(pairs):
    fixed = frozenset({"weight_bg_0", "weight_contact_0", "mu_0", "prec_0"})
    p = Q.Parameters.start(3, SIZE, 4, fixed=fixed, isotropic=True)
    assert (p.mean[0] == 0).all() and np.allclose(np.exp(p.log_precision[:, :1]), np.exp(p.log_precision)) and np.exp(p.log_precision[0, 0]) == pytest.approx(200)
    fitted, log = Q.fit(pairs, p, 0.05, 4, 0.3, 40.0, held_out=pairs.filter("protein = 'q'"), every=2)
    assert [x[0] for x in log] == [0, 1, 2, 3, 4] and [x[2] is not None for x in log] == [True, False, True, False, True]
    assert [x[1] for x in log] == sorted(x[1] for x in log) and log[-1][1] > log[0][1]
    assert (fitted.mean[0] == p.mean[0]).all() and (fitted.log_precision[0] == p.log_precision[0]).all() and (fitted.logits[:, 0] == p.logits[:, 0]).all()
    assert not (fitted.mean[1] == p.mean[1]).any() and np.ptp(fitted.log_precision, axis=1).max() < 1e-12
    again = Q.Parameters.from_json(fitted.to_json())
    for x, y in zip((again.mixture().weights, again.mean, again.log_precision), (fitted.mixture().weights, fitted.mean, fitted.log_precision)):
        assert np.allclose(x, y)
    assert (again.fixed, again.isotropic, again.of_length) == (fitted.fixed, True, False)


def test_parameter_table(spark):
    p = Q.Parameters.start(3, SIZE, 2, frozenset({"mu_1"}))
    rows = p.table(spark).orderBy("component").collect()
    assert [r.mu_fixed for r in rows] == [False, True, False] and rows[1].mu == [0.0] * SIZE
    assert sum(r.weight_bg for r in rows) == pytest.approx(1) and [r.weight_contact for r in rows] == sorted((r.weight_contact for r in rows), reverse=True)
    lengths = spark.createDataFrame([("a", 10), ("b", 20)], "protein string, length int")
    out = {(r.protein, r.component): r.prec for r in Q.of_length(p.table(spark), lengths, 3).collect()}
    assert len(out) == 6 and np.allclose(out["b", 2], 20 * np.array(rows[2].prec))


def test_predictions_are_registered_at_once_and_again(spark, pairs, tmp_path):
    mix = Q.Parameters.start(2, SIZE, 3).mixture()
    given = pairs.withColumn("prior", F.lit(0.2))
    s = Store.create(spark, pairs.select("protein", "i", "j", "truth"), ["protein", "i", "j"], str(tmp_path / "store"))
    s.put_method("other", pairs.select("protein", "i", "j", F.lit(1.0).alias("score")))
    first = given.filter("protein = 'p'")
    R.predict_and_register(s, first, mix, 0.05, "mix")
    before = sorted(map(tuple, s.scores().select("protein", "i", "j", "method", "score").collect()))
    R.predict_and_register(s, first, mix, 0.05, "mix")
    assert sorted(map(tuple, s.scores().select("protein", "i", "j", "method", "score").collect())) == before
    R.predict_and_register(s, given.filter("protein = 'q'"), mix, 0.05, "mix")
    assert sorted(s.methods()) == ["contact_prior", "mix", "mix_llik", "mix_logbf", "other"]
    ll = {(r.protein, r.i, r.j): (r.ll_0, r.ll_1) for r in B.log_likelihoods(pairs, mix, 0.05).collect()}
    got = {(r.protein, r.i, r.j, r.method): r.score for r in s.scores().collect()}
    for key, (a, b) in ll.items():
        if a is None:
            assert (*key, "mix") not in got and got[*key, "contact_prior"] == 0.2
            continue
        assert got[*key, "mix_logbf"] == pytest.approx(b - a) and got[*key, "mix_llik"] == pytest.approx(math.exp(b) / (math.exp(a) + math.exp(b)))
        assert got[*key, "mix"] == pytest.approx(0.2 * math.exp(b) / (0.2 * math.exp(b) + 0.8 * math.exp(a)))
    assert s.scores(["other"]).count() == pairs.count()


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4))
    rows = [(k, *map(float, v), int(v[0] - v[1] + 0.3 * e > 0), k % 3) for k, (v, e) in enumerate(zip(x, r.normal(size=300)))]
    return spark.createDataFrame([*rows, (-1, float("nan"), 0.0, 0.0, 0.0, 1, 0)], "id int, a double, b double, c double, d double, y int, fold int").coalesce(2).cache()


def test_a_forest_survives_a_session(spark, labelled, tmp_path):
    forest = O.grow(labelled, ["a", "b", "c"], "y", trees=25, at_once=10, maxDepth=4)
    assert forest.trees == [10, 10, 5] and forest.training["class_0"] != "0"
    O.save_forest(spark, forest, str(tmp_path / "m"))
    other = spark.newSession()
    again = O.load_forest(other, str(tmp_path / "m"))
    assert (again.features, again.trees, again.training) == (forest.features, forest.trees, forest.training)
    score = lambda f: {r.id: r.score for r in O.scored_by(f, labelled).collect()}
    assert score(again) == score(forest) and len(score(forest)) == 300
    meta = other.read.schema(O.RUN_META).json(str(tmp_path / "m" / "run_meta")).first()
    assert meta.importance_mean == pytest.approx([v for _, v, _ in forest.importances()]) and sum(meta.importance_mean) == pytest.approx(1)
    # the parts' mean weighs trees alike
    part = [{r.id: r.score for r in O.scored(p, labelled, ["a", "b", "c"]).collect()} for p in forest.parts]
    assert all(s == pytest.approx((10 * part[0][k] + 10 * part[1][k] + 5 * part[2][k]) / 25) for k, s in score(forest).items())


def test_selections_are_trained_anew(labelled):
    found = O.compare_selections(labelled, ["a", "b", "c", "d"], "y", "fold", [0, 1, 2], [10, 90], numTrees=5, maxDepth=3)
    assert [limit for limit, _, _ in found] == sorted(limit for limit, _, _ in found)
    few, many = found[-1], found[0]
    assert len(few[1]) == 1 and few[1][0] in "ab" and {"a", "b"} <= set(many[1])
    assert many[2] > few[2] > 0.5


def test_projection_of_a_second_alignment(spark):
    r = np.random.default_rng(2)
    first = {p: r.normal(size=(40, 6)) * [5, 3, 1, 1, 1, 0.1] for p in "xy"}
    second = r.normal(size=(5, 6))
    df = spark.createDataFrame([(p, k, v.tolist()) for p, m in first.items() for k, v in enumerate(m)], "protein string, seq_id int, v array<double>").repartition(5)
    axes = O.projections(df, "protein", "v", 3)
    out = O.projected(spark.createDataFrame([("x", k, v.tolist()) for k, v in enumerate(second)], "protein string, seq_id int, v array<double>"), ["protein", "seq_id"], "protein", "v", axes)
    m = first["x"]
    _, _, vt = np.linalg.svd(m - m.mean(0))
    want = (second - m.mean(0)) @ (vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])[:, None]).T
    assert all(x.value == pytest.approx(want[x.seq_id, x.component], abs=1e-9) for x in out.collect()) and out.count() == 15


def test_feature_rows(spark):
    pairs = spark.createDataFrame([("p", 0, 1, 5.0, 1), ("p", 0, 2, 9.0, 0), ("p", 1, 2, 20.0, 0)], "protein string, i int, j int, distance double, contact int")
    w = spark.createDataFrame([("p", 0, 1, [3.0, 4.0]), ("p", 0, 2, [0.0, 1.0]), ("p", 1, 2, [0.0, -2.0])], "protein string, i int, j int, w array<double>")
    lengths = spark.createDataFrame([("p", 3)], "protein string, length int")
    q = w.select("protein", "i", "j", K.shares("w").alias("q"))
    rows = X.assembled(X.coupling_features(pairs, w, lengths, raw=True, probabilities=q), ["norm", "norm_apc"], ["raw", "model"])
    got = {(r.i, r.j): r.features for r in rows.collect()}
    assert got[0, 1][:1] + got[0, 1][2:4] == [5.0, 3.0, 4.0] and sum(got[0, 1][4:]) == pytest.approx(1)
    norms = np.array([[0, 5, 1], [5, 0, 2], [1, 2, 0]])
    apc = norms - np.outer(norms.mean(0), norms.mean(0)) / norms.mean()
    assert all(f[1] == pytest.approx(apc[i, j]) for (i, j), f in got.items())
    features, classes = X.split_features(rows)
    assert classes.columns == ["protein", "i", "j", "distance", "contact"] and set(features.columns) == {"norm", "norm_apc", "raw", "model", "features"}
    some = X.external_score(pairs, spark.createDataFrame([("p", 0, 1, 7.0)], "protein string, i int, j int, score double"), "other")
    assert {(r.i, r.j): r.other for r in some.collect()} == {(0, 1): 7.0, (0, 2): None, (1, 2): None}


def test_inputs_by_normalised_id(spark):
    df = lambda *rows: spark.createDataFrame([(x,) for x in rows], "name string")
    deep = spark.createDataFrame([("a/2j5y_A00.filt.psc", 50), ("b1.psc", 3), ("c1.psc", 12), ("d/c_1.other", 11)], "name string, n long")
    given = {"alignment": deep, "structure": df("2j5yA00.pdb", "c1", None), "couplings": df("x/y/2j5yA00.filt.braw.gz", "b1.braw", "c1.braw")}
    out = N.complete(N.presence(given, "alignment"), list(given), 10)
    assert {(r.protein, r.n, r.reasons, r.kept) for r in out.collect()} == {("2j5yA00", 50, "", True), ("b1", 3, "no structure; few sequences", False), ("c1", 12, "", True)}
    kept = N.with_inputs(given, out)
    assert sorted(r.name for r in kept["couplings"].collect()) == ["c1.braw", "x/y/2j5yA00.filt.braw.gz"] and kept["alignment"].count() == 3


def test_decoys_of_two_levels(spark):
    r = np.random.default_rng(5)
    rows = [(int(g), int(c), k, int(r.integers(0, 50))) for k, (g, c) in enumerate(zip(np.minimum(r.integers(0, 40, 3000), 12), r.integers(0, 2, 3000)))]
    df = spark.createDataFrame(rows, "g int, c int, k int, h int").repartition(4)
    for per_group, per_class in ((5, 40), (100, 10_000), (100, 333)):
        out = {(x.g, x.c, x.k) for x in M.decoys(df, "g", "c", F.col("h") * 20000, ["k"], per_group, per_class).collect()}
        want = set()
        for c in (0, 1):
            few = [x for g in range(13) for x in sorted((x for x in rows if x[:2] == (g, c)), key=lambda x: (x[3], x[2]))[:per_group]]
            want |= {x[:3] for x in sorted(few, key=lambda x: (x[3], x[2]))[:per_class]}
        assert out == want
    plan = M.decoys(df, "g", "c", F.col("h") * 20000, ["k"], 5, 40)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_deep_alignment_is_dealt_over_tasks(spark):
    r = np.random.default_rng(6)
    n = 5000
    base = r.integers(0, 21, (40, 24))
    states = np.where(r.random((n, 24)) < 0.1, r.integers(0, 21, (n, 24)), base[r.integers(0, 40, n)])
    df = spark.createDataFrame([("p", k, row.tolist()) for k, row in enumerate(states)], "protein string, seq_id long, states array<int>")
    blocks = A._block_pairs(df, 512)
    assert blocks.select("u", "v").distinct().count() == 55 and blocks.groupBy("u", "v").count().agg(F.max("count")).first()[0] < 1300
    weights = {x.seq_id: x.weight for x in A.sequence_weights(df, 0.8, ignore_gaps=True).collect()}
    same = lambda k: (states == states[k])
    for k in range(0, n, 613):
        shared = (same(k) & (states == 20)).sum(1)
        near = same(k).sum(1) - shared >= np.ceil(0.8 * (24 - shared))
        assert weights[k] == pytest.approx(1 / near.sum())
    small = df.filter("seq_id < 40")
    got = {(x.a, x.b): (x.ids, x.shared_gaps, x.both_residues, x.length) for x in A.identities(small, block=7).collect()}
    assert got == {(a, b): (int((states[a] == states[b]).sum()), int(((states[a] == 20) & (states[b] == 20)).sum()), int(((states[a] != 20) & (states[b] != 20)).sum()), 24) for a in range(40) for b in range(a + 1, 40)}


def test_features_of_texts_are_made_once(spark):
    """What a query returns reads the stored features, not the texts again for each model."""
    from pairweave.plans.models import ml5_leave_one_fold_out

    assert not any("documents.parquet" in f for f in ml5_leave_one_fold_out(spark, "/root/testdata/sf0.001").inputFiles())


def test_sequences_are_compared_by_products(monkeypatch):
    """Two blocks as products of matrices over stretches of rows and positions; shorter sequences are alike where both are filled up."""
    r = np.random.default_rng(9)
    monkeypatch.setattr(A._Blocks, "ROWS", 4)
    monkeypatch.setattr(A._Blocks, "POSITIONS", 5)
    x, y = np.where(r.random((2, 9, 12)) < 0.3, 20, r.integers(0, 21, (2, 9, 12))).astype(np.int16)
    x[2, 8:] = y[5, 10:] = -1
    for one, other in ((False, y), (True, x)):
        for start, counted, *found in A._Blocks(None, np.arange(9), x, np.arange(9), other, one).counts():
            mine = x[start : start + len(counted), None]
            want = (mine == other).sum(2), ((mine == 20) & (other == 20)).sum(2), ((mine != 20) & (other != 20)).sum(2)
            assert all((f == w).all() for f, w in zip(found, want))
            assert (counted == (np.arange(9) > np.arange(start, start + len(counted))[:, None]) if one else counted).all()
