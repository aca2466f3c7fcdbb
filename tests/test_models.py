"""Linear models, fold machinery and metrics: properties from SURVEY section 5."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import backtest as bt
from mensura.operators import linear as lin
from mensura.operators import metrics as mt


def np_ridge(X, y, alpha):
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1.0
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - y.mean()))
    beta = w / sd
    return y.mean() - beta @ mu, beta


def frame(spark, X, y, sid="s"):
    rows = [(sid, i, [float(v) for v in X[i]], float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "series_id string, t int, x array<double>, y double")


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 4)) * [1, 10, 100, 1e6] + [0, 5, 1e3, 3e7]
    y = X @ [0.5, -0.1, 0.01, 2e-7] + rng.normal(size=60)
    c = lin.fit_ridge(frame(spark, X, y), alpha=5.0).first().coef
    b0, beta = np_ridge(X, y, 5.0)
    assert c[0] == pytest.approx(b0, rel=1e-8)
    assert np.allclose(c[1:5], beta, rtol=1e-7)


def test_ridge_alpha_zero_is_ols(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 3))
    y = X @ [1.0, 2.0, -3.0] + 0.5 + rng.normal(scale=0.1, size=40)
    c = lin.fit_ridge(frame(spark, X, y), alpha=0.0).first().coef
    A = np.column_stack([np.ones(40), X])
    ols = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(c[:4], ols, rtol=1e-8)


def test_flat_feature_is_ignored(spark):
    rng = np.random.default_rng(3)
    X = np.column_stack([rng.normal(size=24), np.full(24, 7.0)])
    y = 2 * X[:, 0] + 1
    c = lin.fit_ridge(frame(spark, X, y), alpha=5.0).first().coef
    assert c[2] == 0.0  # constant column: sigma -> 1, coefficient 0


def test_fold_grams_equal_direct_fits(spark):
    """Bucketed prefix Grams give the same per-fold models as refitting on
    each training slice directly."""
    rng = np.random.default_rng(4)
    n, p = 50, 3
    X = rng.normal(size=(n, p))
    y = X @ [1.0, -2.0, 0.5] + rng.normal(size=n)
    df = frame(spark, X, y).withColumn("eligible", F.lit(True))
    planned = bt.with_plan(df, bt.plan_blocks, ["series_id"], horizon=6, min_train=20, step=5)
    coefs = {r.k: r.coef for r in bt.fold_ridge(planned, ["series_id"]).collect()}
    cutoffs = list(range(20, n - 6 + 1, 5))
    assert sorted(coefs) == list(range(len(cutoffs)))
    for k, cut in enumerate(cutoffs):
        b0, beta = np_ridge(X[:cut], y[:cut], 5.0)
        assert coefs[k][0] == pytest.approx(b0, rel=1e-8, abs=1e-10)
        assert np.allclose(coefs[k][1:p + 1], beta, rtol=1e-7, atol=1e-12)


def test_walk_forward_has_no_leakage(spark):
    """Changing targets at or after a fold's cutoff does not change that
    fold's prediction."""
    rng = np.random.default_rng(5)
    n = 40
    X = rng.normal(size=(n, 2))
    y = X @ [1.0, 1.0] + rng.normal(size=n)
    y2 = y.copy()
    y2[35:] += 100.0
    out = []
    for yy in (y, y2):
        df = frame(spark, X, yy).withColumn("eligible", F.lit(True))
        planned = bt.with_plan(df, bt.plan_walk_forward, ["series_id"], n_test=8)
        sc = bt.ridge_backtest(planned, ["series_id"])
        out.append({r.t: r.pred_target for r in sc.collect()})
    for t in range(32, 36):  # folds whose training ends before row 35
        assert out[0][t] == pytest.approx(out[1][t], rel=1e-12)
    assert out[0][37] != pytest.approx(out[1][37])


def test_identical_series_identical_forecasts(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(30, 2))
    y = X @ [0.3, -0.7] + rng.normal(size=30)
    df = frame(spark, X, y, "a").unionByName(frame(spark, X, y, "b")).withColumn("eligible", F.lit(True))
    planned = bt.with_plan(df, bt.plan_walk_forward, ["series_id"], n_test=5)
    rows = bt.ridge_backtest(planned, ["series_id"]).collect()
    a = {r.t: r.pred_target for r in rows if r.series_id == "a"}
    b = {r.t: r.pred_target for r in rows if r.series_id == "b"}
    assert a == pytest.approx(b)


def test_kfold_plan_layout(spark):
    df = spark.createDataFrame([("s", i) for i in range(23)], "series_id string, t int")
    planned = bt.with_plan(df, bt.plan_kfold, ["series_id"], n_splits=4)
    lay = bt.fold_layout(planned, ["series_id"]).orderBy("k").collect()
    # n_val = 23 // 5 = 4; test blocks start at 7, 11, 15, 19
    assert [r.cutoff for r in lay] == [7, 11, 15, 19]
    assert [r.n_train for r in lay] == [7, 11, 15, 19]
    assert all(r.test_last_t - r.test_first_t == 3 for r in lay)


def test_block_plan_fallback(spark):
    df = spark.createDataFrame([("s", i) for i in range(20)], "series_id string, t int")
    planned = bt.with_plan(df, bt.plan_blocks, ["series_id"], horizon=12, min_train=24, step=6)
    lay = bt.fold_layout(planned, ["series_id"]).collect()
    assert len(lay) == 1 and lay[0].cutoff == 8  # max(1, n - h)


def test_hac_collinear_min_norm(spark):
    rng = np.random.default_rng(7)
    n = 60
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    x3 = x1 + x2
    y = 1.0 + 2 * x1 - x2 + rng.normal(scale=0.3, size=n)
    rows = [("s", dt.date(2000 + i // 12, i % 12 + 1, 1), float(a), float(b), float(c), float(v))
            for i, (a, b, c, v) in enumerate(zip(x1, x2, x3, y))]
    df = spark.createDataFrame(rows, "series_id string, period date, x1 double, x2 double, x3 double, y double")
    res = {r.feature: r for r in lin.hac_ols(df, "y", ["x1", "x2", "x3"]).collect()}
    # fitted values are identified even though the coefficients are not
    b = np.array([res[f].coef for f in ("x1", "x2", "x3")])
    fit = np.column_stack([x1, x2, x3]) @ b
    ols = np.linalg.lstsq(np.column_stack([np.ones(n), x1, x2]), y, rcond=None)[0]
    ref = np.column_stack([x1, x2]) @ ols[1:]
    assert np.allclose(fit - fit.mean(), ref - ref.mean(), atol=1e-8)
    assert all(np.isfinite(res[f].std_err) for f in res)


def test_metrics_against_numpy_and_partitioning(spark):
    rng = np.random.default_rng(8)
    a = rng.uniform(50, 150, 40)
    p = a + rng.normal(scale=5, size=40)
    df = spark.createDataFrame([("s", float(x), float(y)) for x, y in zip(a, p)],
                               "series_id string, actual double, predicted double")
    m1 = mt.forecast_metrics(df).first()
    m8 = mt.forecast_metrics(df.repartition(8)).first()
    err = a - p
    assert m1.RMSE == pytest.approx(np.sqrt(np.mean(err ** 2)))
    assert m1.MAE == pytest.approx(np.mean(np.abs(err)))
    assert m1.MAPE_pct == pytest.approx(np.mean(np.abs(err) / a) * 100)
    assert m1.R2 == pytest.approx(1 - np.sum(err ** 2) / np.sum((a - a.mean()) ** 2))
    assert m1.sMAPE_pct == pytest.approx(np.mean(2 * np.abs(p - a) / (np.abs(a) + np.abs(p) + 1e-9)) * 100)
    for f in ("RMSE", "MAE", "MAPE_pct", "R2"):
        assert m1[f] == pytest.approx(m8[f], rel=1e-12)


def test_metrics_flat_and_zero(spark):
    df = spark.createDataFrame([("s", 5.0, 4.0), ("s", 5.0, 6.0), ("s", 0.0, 1.0)],
                               "series_id string, actual double, predicted double")
    m = mt.forecast_metrics(df.filter("actual = 5.0")).first()
    assert m.R2 is None  # constant actual
    z = mt.forecast_metrics(df).first()
    assert z.MAPE_pct == pytest.approx(20.0)  # the zero actual is not scored (Q9)


def test_select_best_tie_break(spark):
    df = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "c", 2.0)],
                               "series_id string, model string, RMSE double")
    assert mt.select_best(df, "RMSE", "model").first().model == "a"
    assert mt.select_best(df, "RMSE", "model", mode="max").first().model == "c"


def test_pooled_ridge_equals_per_series_form(spark):
    rng = np.random.default_rng(10)
    X = rng.normal(size=(80, 3)) * [1, 50, 0.1] + [2, 1e3, 0]
    y = X @ [0.4, 0.01, -3.0] + rng.normal(size=80)
    b0, beta = lin.fit_ridge_pooled(frame(spark, X, y), alpha=5.0)
    rb0, rbeta = np_ridge(X, y, 5.0)
    assert b0 == pytest.approx(rb0, rel=1e-9)
    assert np.allclose(beta, rbeta, rtol=1e-9)


def test_tree_refit_every_is_out_of_sample(spark):
    rng = np.random.default_rng(13)
    n = 40
    X = rng.normal(size=(n, 2))
    y = X @ [1.0, -1.0] + rng.normal(scale=0.1, size=n)
    y2 = y.copy()
    y2[34:] += 50.0  # change targets from the third of six folds on
    preds = []
    for yy in (y, y2):
        df = frame(spark, X, yy).withColumn("eligible", F.lit(True))
        planned = bt.with_plan(df, bt.plan_walk_forward, ["series_id"], n_test=6)
        sc = bt.tree_backtest(planned, ["series_id"], "forest", refit_every=3, order="t", num_trees=5, max_depth=3)
        preds.append({r.t: r.pred_target for r in sc.collect()})
    assert sorted(preds[0]) == list(range(34, 40))
    # folds 0-2 (t = 34..36) share a model trained on t < 34: unaffected
    for t in (34, 35, 36):
        assert preds[0][t] == pytest.approx(preds[1][t])


def test_nowcast_next_uses_last_level(spark):
    """A series growing exactly 1 % a month with constant covariates: the MoM
    nowcast for the coming month is the last level x 1.01."""
    months = [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rows = [("s", m, 100.0 * 1.01 ** i, 1.0 + (i % 3)) for i, m in enumerate(months)]
    panel = spark.createDataFrame(rows, "series_id string, period date, target double, c double")
    nxt = spark.createDataFrame([("s", dt.date(2018, 5, 1), 2.0)], "series_id string, period date, c double")
    got = bt.nowcast_next(panel, nxt, ["c"], "mom_logdiff", "ridge").collect()
    assert len(got) == 1 and got[0].period == dt.date(2018, 5, 1)
    assert got[0].predicted == pytest.approx(100.0 * 1.01 ** 40, rel=1e-6)


def test_tree_profiles_and_overrides(spark):
    f = bt.tree_model("forest", profile="level")
    assert f.getNumTrees() == 300 and f.getFeatureSubsetStrategy() == "sqrt" and f.getMaxDepth() == 5
    assert bt.tree_model("forest", profile="level", num_trees=20).getNumTrees() == 20
    assert bt.tree_model("forest", profile="level", num_trees=None).getNumTrees() == 300
    g = bt.tree_model("boosting", profile="comparison")
    assert g.getMaxIter() == 200 and g.getSubsamplingRate() == 0.8 and g.getStepSize() == 0.05
    c = bt.tree_model("boosting_colsample", profile="level")
    assert c.getFeatureSubsetStrategy() == "0.7" and c.getMaxDepth() == 2


def _panel(spark, change_from=None, only=None):
    """Two series that end in different months; ``change_from`` alters
    targets and covariates of later months."""
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("a", 40), ("b", 46)):
        for i in range(n):
            m = dt.date(2015 + i // 12, i % 12 + 1, 1)
            y, c = 100 + 10 * rng.random() + i, float(rng.integers(0, 9))
            if change_from and m >= change_from and only in (None, name):
                y, c = y * 3 + 7 * i, c + 100
            rows.append((name, m, y, c))
    return spark.createDataFrame(rows, "series_id string, period date, target double, c double")


@pytest.mark.parametrize("model", ["forest", "boosting"])
def test_trees_do_not_look_ahead(spark, model):
    from mensura.plans.flows import delevel_dataset

    def predictions(panel):
        out = bt.walk_forward(delevel_dataset(panel, ["c"]), ["c"], [model], n_test=6, kinds=["mom_logdiff"],
                              num_trees=3, max_depth=2)
        return {(r.series_id, r.period): r.predicted for r in out.collect()}

    before = predictions(_panel(spark))
    # a's six last months lie before b's last six: b's later months must not reach a's models
    later = predictions(_panel(spark, dt.date(2018, 5, 1), "b"))
    assert {k: v for k, v in before.items() if k[0] == "a"} == {k: v for k, v in later.items() if k[0] == "a"}
    # changed hold-out months leave the predictions of earlier months alone
    cut = dt.date(2018, 3, 1)
    held = predictions(_panel(spark, cut))
    early = [k for k in before if k[1] < cut]
    assert early and all(before[k] == held[k] for k in early)
    assert any(before[k] != held[k] for k in before)


def test_failing_model_keeps_its_rows(spark):
    from mensura.operators.metrics import forecast_metrics, rank_combos
    from mensura.plans.flows import delevel_dataset
    preds = bt.walk_forward(delevel_dataset(_panel(spark), ["c"]), ["c"], ["ridge", "nosuch"], n_test=6)
    m = forecast_metrics(preds, keys=["series_id", "target_kind", "model"], which="B")
    ranked = rank_combos(m.withColumn("combo", F.concat_ws("|", "target_kind", "model"))).collect()
    assert len(ranked) == 2 * 3 * 2
    for r in ranked:
        assert (r.error is None) == (r.model == "ridge") and (r["n"] == 0) == (r.model == "nosuch")
        assert r.model == "ridge" or (r.R2 is None and r["rank"] > 3)


def test_shared_selection_equals_auto_select(spark):
    from mensura.operators import selection as sel
    kw = dict(min_train=12, horizon=6, step=6)
    metrics, allp = sel.candidate_scores(_panel(spark), ["c"], ["ridge"], 6, **kw)
    best, by_split = sel.choose(metrics, allp)
    want = sel.auto_select(_panel(spark), ["c"], ["ridge"], 6, **kw)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want[1].collect()))
    assert sorted(map(tuple, by_split.collect())) == sorted(map(tuple, want[2].collect()))
    data, feats = sel.level_dataset(_panel(spark), ["c"], 6)
    effects = sel.chosen_effects(allp, feats, best).collect()
    assert len(effects) == 2 * len(feats) and {r.model for r in effects} == {"ridge"}
    again = sel.feature_effects(data.filter("split <> 'error'"), feats, "ridge").collect()
    assert {(r.series_id, r.feature): r.importance for r in effects} == pytest.approx(
        {(r.series_id, r.feature): r.importance for r in again})
    effects = sel.feature_effects(data, feats, "forest", num_trees=3).collect()
    assert {(r.series_id, r.model) for r in effects} == {("a", "forest"), ("b", "forest")}
    for name in ("a", "b"):
        assert sum(r.importance for r in effects if r.series_id == name) == pytest.approx(1.0)


# ------------------------------------------------------------ trees per series
def _cart(x, y, depth, least):
    """A plain recursive tree: (feature, threshold, left, right) or a mean."""
    best = None
    for j in range(x.shape[1]):
        o = np.argsort(x[:, j], kind="stable")
        v, r = x[o, j], y[o] - y.mean()
        for i in range(least - 1, len(y) - least):
            if v[i] != v[i + 1]:
                gain = r[:i + 1].sum() ** 2 / (i + 1) + r[i + 1:].sum() ** 2 / (len(y) - i - 1)
                if gain > (best[0] if best else 0) + 1e-9:
                    best = (gain, j, (v[i] + v[i + 1]) / 2)
    if depth == 0 or best is None:
        return y.mean()
    side = x[:, best[1]] <= best[2]
    return best[1], best[2], _cart(x[side], y[side], depth - 1, least), _cart(x[~side], y[~side], depth - 1, least)


def _answer(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_data(n=60, p=6, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)).round(1)
    x[:, -1] = x[:, -1] > 0.5
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, 1.0, -1.0) * x[:, -1] + 0.1 * rng.standard_normal(n)
    cuts = np.arange(40, n, 5)
    return x, y, np.arange(n)[None, :] < cuts[:, None]


@pytest.mark.parametrize("least", [1, 3])
def test_one_tree_equals_plain_recursion(least):
    from mensura.operators.trees import TreeSettings, fitted
    x, y, train = _tree_data()
    out, shares = fitted(x, y, train, TreeSettings(False, 1, 4, least, bootstrap=False))
    for k, rows in enumerate(train):
        tree = _cart(x[rows], y[rows], 4, least)
        np.testing.assert_allclose(out[k], [_answer(tree, v) for v in x], atol=1e-12)
    np.testing.assert_allclose(shares.sum(axis=1), 1)


def test_boosting_equals_plain_rounds():
    from mensura.operators.trees import TreeSettings, fitted
    x, y, train = _tree_data()
    out, _ = fitted(x, y, train, TreeSettings(True, 6, 2, 1, 0.3))
    for k, rows in enumerate(train):
        pred = np.full(len(y), y[rows].mean())
        for _ in range(6):
            tree = _cart(x[rows], (y - pred)[rows], 2, 1)
            pred = pred + 0.3 * np.array([_answer(tree, v) for v in x])
        np.testing.assert_allclose(out[k], pred, atol=1e-9)


def test_leaf_penalty_shrinks_and_sampling_is_per_fold():
    from dataclasses import replace
    from mensura.operators.trees import TreeSettings, fitted
    x, y, train = _tree_data()
    s = TreeSettings(True, 1, 1, 1, 1.0, l2=2.0)
    out, _ = fitted(x, y, train[:1], s)
    rows, mean = train[0], y[train[0]].mean()
    sides = [rows & (out[0] == v) for v in np.unique(out[0])]
    assert len(sides) == 2
    for side in sides:
        assert out[0][side][0] == pytest.approx(mean + (y[side] - mean).sum() / (side.sum() + 2.0))
    for s in (TreeSettings(False, 7, 3, 2, feature_subset="sqrt"), replace(s, num_trees=5, subsample=0.7, feature_subset="0.5")):
        whole, _ = fitted(x, y, train, s)
        part, _ = fitted(x, y, train[:2], s)
        np.testing.assert_allclose(whole[:2], part, atol=1e-12)  # other folds change nothing
        again, _ = fitted(x, y, train, s)
        assert (whole == again).all() and not np.allclose(whole, fitted(x, y, train, replace(s, seed=1))[0])


def test_trees_of_odd_series(spark):
    """Gaps in features, a fold without training rows, a constant label, one row."""
    rows = [("gap", t, [float(t % 5), None if t % 7 == 0 else 1.0], float(t % 3)) for t in range(20)]
    rows += [("flat", t, [float(t), 0.0], 4.0) for t in range(20)]
    rows += [("one", 0, [1.0, 2.0], 3.0), ("late", 0, [1.0, 2.0], None), ("late", 1, [1.0, 2.0], 3.0)]
    df = spark.createDataFrame(rows, "series_id string, t int, x array<double>, y double").withColumn(
        "eligible", F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    planned = bt.with_plan(df, bt.plan_walk_forward, ["series_id"], n_test=1)
    for model in ("forest", "boosting", "boosting_colsample"):
        got = {r.series_id: r for r in bt.series_tree_backtest(planned, ["series_id"], model, num_trees=3).collect()}
        assert set(got) == {"gap", "flat"} and got["flat"].pred_target == pytest.approx(4.0)
        assert 0 <= got["gap"].pred_target <= 2 and sum(got["flat"].importance) == 0


def test_optional_covariates_two_series(spark):
    """A series without the covariate keeps its rows and is fitted as if there
    were none; one that it drives is given the extended model."""
    import datetime as dt

    from mensura.operators import selection as sel
    rng = np.random.default_rng(5)
    rows = []
    for name in ("with", "without"):
        drive = rng.normal(100, 20, 90)
        y = np.empty(90)
        y[0] = 1000.0
        for i in range(1, 90):
            y[i] = 600 + 0.2 * y[i - 1] + 5 * drive[i - 1] + rng.normal(0, 1)
        rows += [(name, dt.date(2012 + i // 12, i % 12 + 1, 1), float(y[i]),
                  float(drive[i]) if name == "with" else None) for i in range(90)]
    panel = spark.createDataFrame(rows, "series_id string, period date, target double, riders double")
    pair = ("target_lag1", "ridership_lag1")
    candidates = {"base": ("ridge", pair[:1]), "extended": ("ridge", pair)}
    optional = {"ridership": ("riders",)}
    metrics, best, _, preds = sel.auto_select(panel, (), candidates, optional=optional)
    rmse = {(r.series_id, r.model): r.RMSE for r in metrics.collect()}
    assert {r.series_id: r.best_model for r in best.collect()}["with"] == "extended"
    # what is left is the shrinkage: 5 in 29 of 100 on the first block
    assert rmse["with", "extended"] < 0.25 * rmse["with", "base"]
    assert rmse["without", "extended"] == pytest.approx(rmse["without", "base"], rel=1e-12)
    assert preds.filter("model = 'base'").groupBy("series_id").count().collect()[0]["count"] == 77
    # the same numbers as a panel that never had the column
    alone, _, _, _ = sel.auto_select(panel.drop("riders").filter("series_id = 'without'"), (), {"base": candidates["base"]})
    assert alone.first().RMSE == pytest.approx(rmse["without", "base"], rel=1e-12)
    _, feats = sel.level_dataset(panel, (), optional=optional)
    effects = {(r.series_id, r.model, r.feature) for r in sel.effects_of(preds, feats).collect()}
    assert effects == {(s, m, "target_lag1") for s in ("with", "without") for m in candidates} | {
        ("with", "extended", "ridership_lag1")}


def test_walk_forward_models_share_one_dataset(spark, monkeypatch):
    from mensura.plans import q_models as q
    built = []

    def dataset(s, sf):
        built.append(sf)
        return s.createDataFrame([("a", 1.0)], "series_id string, y double")

    monkeypatch.setattr(q, "dataset", dataset)
    monkeypatch.setattr(q.bt, "walk_forward", lambda d, covs, models, **kw: d.selectExpr("*", f"'{models[0]}' AS model"))
    got = q.walk_forward_predictions(spark, "tables of this test", ["ridge", "forest", "boosting"])
    assert sorted((r.series_id, r.model) for r in got.collect()) == [("a", "boosting"), ("a", "forest"), ("a", "ridge")]
    assert len(built) == 1


def test_prefix_solve_takes_rows_across_chunks(monkeypatch):
    """Training rows in any order, more than are multiplied at a time, give the models of direct fits."""
    import pyarrow as pa
    monkeypatch.setattr(lin, "PRODUCT_ROWS", 7)
    rng = np.random.default_rng(11)
    sizes, p, folds = (30, 23), 2, 4
    data = [(rng.normal(size=(n, p)), rng.normal(size=n), rng.permutation(n)) for n in sizes]
    z = [np.column_stack([np.ones(len(y)), X, y])[order] for X, y, order in data]
    bucket = [np.clip((order - 10) // 2 + 1, 0, folds - 1) for _, _, order in data]
    batch = pa.RecordBatch.from_pydict({
        "series_id": pa.array(["a", "b"]), "K": pa.array([folds, folds], pa.int32()),
        "t": pa.array([order.tolist() for _, _, order in data], pa.list_(pa.int64())),
        "b": pa.array([b.tolist() for b in bucket], pa.list_(pa.int32())),
        "z": pa.array([v.ravel().tolist() for v in z], pa.list_(pa.float64()))})
    schema = pa.schema([("series_id", pa.string()), ("k", pa.int32()), ("p", pa.int32()), ("coef", pa.list_(pa.float64()))])
    rows = [r for out in lin.prefix_ridge_solve(p, 5.0, schema)(iter([batch])) for r in out.to_pylist()]
    assert [(r["series_id"], r["k"]) for r in rows] == [(s, k) for s in "ab" for k in range(folds)]
    for r in rows:
        X, y, _ = data["ab".index(r["series_id"])]
        cut = 10 + 2 * r["k"] if r["k"] < folds - 1 else len(y)
        b0, beta = np_ridge(X[:cut], y[:cut], 5.0)
        assert r["coef"][0] == pytest.approx(b0) and np.allclose(r["coef"][1:p + 1], beta)


def test_metrics_with_errors_read_their_input_once(spark):
    df = spark.createDataFrame([("s", "ridge", 5.0, 4.0, None), ("s", "ridge", 7.0, None, "late"),
                                ("s", "nosuch", None, None, "unknown"), ("s", "empty", None, None, None)],
                               "series_id string, model string, actual double, predicted double, error string")
    m = mt.forecast_metrics(df, keys=["series_id", "model"])
    assert m._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {r.model: (r["n"], r.error, r.MAE) for r in m.collect()}
    assert got == {"ridge": (1, None, 1.0), "nosuch": (0, "unknown", None)}
