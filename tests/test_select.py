import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.operators import linear as L
from scorewright.operators import model as M
from scorewright.operators import profile as Q
from scorewright.operators import select as S


def data(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    a, b, c = (rng.choice([-0.8, -0.1, 0.3, 0.9], n) for _ in range(3))
    noise = rng.choice([-0.5, 0.5], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a + 0.7 * b - 0.3)))).astype(int)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "noise": noise, "y": y})


def test_gram_paths_agree_with_gaps(spark, monkeypatch):
    p = data()
    p.loc[::5, "a"] = np.nan
    p.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(p).replace(float("nan"), None)
    cols = ["a", "b", "c"]

    def table():
        rows = L.gram(df.withColumn("f", F.col("id") % 3), cols, "f").select("f", "i", "j", *L._SUMS).collect()
        return {(r.f, r.i, r.j): list(r[3:]) for r in rows}

    narrow = table()
    monkeypatch.setattr(L, "_NARROW", 1)
    wide = table()
    assert narrow.keys() == wide.keys() and len(wide) == 18
    assert all(np.allclose(narrow[k], wide[k]) for k in wide)


def test_corr_matches_pandas(spark):
    p = data()
    p["a2"] = p.a * 2 + np.random.default_rng(1).normal(size=len(p)) * 0.1
    p["flat"] = 0.1
    p.loc[::4, "b"] = np.nan
    df = spark.createDataFrame(p).replace(float("nan"), None)
    cols = ["a", "b", "c", "a2", "flat"]
    got = {(r.var_name1, r.var_name2): r.corref for r in L.corr_pairs(df, cols, 0.0).collect()}
    want = p[cols].corr()
    assert all(np.isclose(v, want.loc[k[0], k[1]]) for k, v in got.items())
    assert len(got) == 6  # nothing with the constant


@pytest.mark.parametrize("narrow", [6, 1])
def test_an_outlier_without_partner_touches_no_pair(spark, monkeypatch, narrow):
    monkeypatch.setattr(L, "_NARROW", narrow)
    rows = [(float(i), 2.0 * i, None if i % 3 else 1e9 + i, 0.1) for i in range(999)] + [(1e12, None, None, 0.1), (None, -1e12, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double").repartition(5)
    got = {(r.var_name1, r.var_name2): r.corref for r in L.corr_pairs(df, ["a", "b", "c", "flat"]).collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(v == pytest.approx(1.0, abs=1e-9) for v in got.values())


def test_moments_of_tiles_and_their_merges():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, k = rng.integers(1, 60), rng.integers(1, 8)
        x = rng.normal(size=(n, k)) * 10.0 ** rng.integers(-3, 6, k) + 10.0 ** rng.integers(0, 9, k)
        x[rng.random((n, k)) < 0.3] = np.nan
        x[rng.random((n, k)) < 0.02] = 1e12
        want = np.array([[L._about_pair_means(x[:, i], x[:, j]) for j in range(k)] for i in range(k)]).transpose(2, 0, 1)
        halves = L.merge_moments(L.tile_moments(x[: n // 2], x[: n // 2]), L.tile_moments(x[n // 2 :], x[n // 2 :]))
        spread = np.sqrt(want[3] * want[4])
        own_digits = 1e-14 * np.sqrt(want[0]) * (np.abs(want[1]) * np.sqrt(want[4]) + np.abs(want[2]) * np.sqrt(want[3]))
        for got in (L.tile_moments(x, x), halves):
            assert (got[0] == want[0]).all()
            assert (np.abs(got[5] - want[5]) <= 1e-7 * spread + own_digits).all()


def test_rows_of_a_task_follow_the_tiles(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 4)
    names = [f"v{i}" for i in range(30)]
    df = spark.range(200).select(*[F.rand(i).alias(c) for i, c in enumerate(names)]).repartition(3)
    tasks = df.mapInArrow(L._partial(30, False), L._TILE_ROW).groupBy("task").count().collect()
    assert all(r["count"] == 36 for r in tasks)  # 8 tiles in pairs
    want = df.toPandas().corr()
    got = L.co_moments(df, names).where("i < j").collect()
    assert len(got) == 435
    assert all(r.c / np.sqrt(r.vi * r.vj) == pytest.approx(want.iloc[r.i, r.j], abs=1e-9) for r in got)
    assert L.co_moments(df.limit(0), names).count() == 0


def test_sweep_equals_inverses():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 40))
    g = x.T @ x
    sweep, left = L.Sweep(g), list(range(40))
    for k in (3, 39, 0, 17):
        sweep.drop(k)
        left.remove(k)
        sub = g[np.ix_(left, left)]
        assert np.allclose(sweep.factors()[left], np.diag(sub) * np.diag(np.linalg.inv(sub)))


def test_columns_that_make_each_other_up_go_first(spark):
    df = spark.createDataFrame(data()).withColumns({"sum": F.col("a") + F.col("b"), "none": F.lit(0.0)})
    out = {r.var_name: (r.vif, r.kept, r.step) for r in L.vif_prune(df, ["c", "a", "b", "sum", "none", "noise"]).collect()}
    assert out["a"] == (float("inf"), False, 1) and out["none"] == (float("inf"), False, 2)
    assert all(out[c][1] and out[c][0] < 10 for c in ("c", "b", "sum", "noise"))


def test_a_thousand_columns_in_seconds():
    import time

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 1000))
    start, sweep = time.perf_counter(), L.Sweep(x.T @ x)
    for k in range(300):
        sweep.drop(k)
    assert time.perf_counter() - start < 60 and np.isfinite(sweep.factors()[300:]).all()


def test_corr_prune(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", -0.9)], "var_name1 string, var_name2 string, corref double")
    iv = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.1), ("d", 0.2), ("e", 0.2), ("f", 0.0)], "var_name string, iv double")
    assert sorted(r.var_name for r in L.corr_prune(pairs, iv).collect()) == ["a", "d", "f"]


def test_vif_two_columns_and_prune(spark):
    df = spark.createDataFrame(data()).withColumn("a9", F.col("a") * 1.01 + F.col("noise") * 0.05)
    x, z = (df.toPandas()[c].to_numpy() for c in ("a", "a9"))
    want = 1 / (1 - (x @ z) ** 2 / ((x @ x) * (z @ z)))
    assert all(np.isclose(r.vif, want) for r in L.vif(df, ["a", "a9"]).collect())
    out = {r.var_name: r.kept for r in L.vif_prune(df, ["a", "b", "a9"]).collect()}
    assert sum(out.values()) == 2 and out["b"]


def test_null_stability(spark):
    rows = []
    for m, share in (("1", 1), ("2", 2), ("3", 6)):
        rows += [(m, None if i < share else 1.0) for i in range(10)]
    out = Q.monthly_null_matrix(spark.createDataFrame(rows, "m string, x double"), ["x"], "m").first()
    assert round(out.null_std_over_mean, 6) == 0.720082 and round(out.mean_null_share, 6) == 0.3


def test_quality_flags(spark):
    rows = [(None, 1.0, "s", "2020-01"), (None, float("nan"), "s", "2020-01")] + [(None, None, "s", "2020-02")] * 38
    df = spark.createDataFrame(rows, "dead double, rare double, same string, m string")
    out = {r.var_name: (r.use, r.reason, r.different_values) for r in Q.quality_profile(df, ["dead", "rare", "same"], "m").collect()}
    assert out == {"dead": (False, "all_null", 0), "rare": (False, "mostly_null", 1), "same": (False, "single_value", 1)}
    assert Q.prune_null_columns(df, keep=["m"]).columns == ["same", "m"]


def test_distinct_counts_keep_big_integers_apart(spark):
    df = spark.range(5).select((F.col("id") + 2**60).alias("k"), (F.col("id") % 2).cast("double").alias("x"))
    assert {r.var_name: r.different_values for r in Q.distinct_counts(df, ["k", "x"]).collect()} == {"k": 5, "x": 2}


def newton(x, y, penalty, intercept):
    x = np.column_stack([np.ones(len(x)), x]) if intercept else x
    r = np.full(x.shape[1], penalty)
    if intercept:
        r[0] = 0.0
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(r)
        w -= np.linalg.solve(h, x.T @ (p - y) + r * w)
    return w, h


def test_fit_has_the_summed_loss_penalty(spark):
    p = data()
    cols = ["a", "b", "c"]
    coef, intercept = M.fit_scorecard(spark.createDataFrame(p), cols, "y", C=0.01)
    want, _ = newton(p[cols].to_numpy(), p.y.to_numpy(), 100.0, True)
    assert np.allclose([intercept, *coef.values()], want, atol=1e-3)
    scored = M.score_batch(spark.createDataFrame(p), coef, intercept).first()
    assert scored.score == pytest.approx(1 / (1 + np.exp(-(intercept + sum(coef[c] * p[c][0] for c in cols)))))


def test_patterns_keep_all_weight(spark):
    rows = M.patterns(spark.createDataFrame(data()), ["a", "b"], "y")
    assert rows.agg(F.sum("w")).first()[0] == 1200 and rows.count() <= 32


def test_pvalue_backward_matches_newton(spark):
    p = data()
    cols = ["a", "b", "c", "noise"]
    out = {r.var_name: r for r in S.pvalue_backward(spark.createDataFrame(p), cols, "y").collect()}
    kept = [c for c in cols if out[c].kept]
    assert "a" in kept and "b" in kept
    w, h = newton(p[kept].to_numpy(), p.y.to_numpy(), 0.0, False)
    assert np.allclose([out[c].coef for c in kept], w, atol=1e-4)
    assert all(out[c].p_value <= 0.05 for c in kept)
    assert all(out[c].p_value > 0.05 for c in cols if c not in kept)


def test_sign_filter(spark):
    df = spark.createDataFrame(data()).withColumn("neg", -F.col("b"))
    out = {r.var_name: r.kept for r in S.sign_filter(df, ["a", "neg"], "y").collect()}
    assert out == {"a": True, "neg": False}


def test_rf_importance(spark):
    out = S.rf_importance(spark.createDataFrame(data()), ["a", "b", "noise"], "y").collect()
    assert out[0].var_name in ("a", "b") and sum(r.importance for r in out) == pytest.approx(1.0)


def lasso_r2_rows(p, cols, key, y):
    """Row-level restatement: the same grid, folds and errors on arrays."""
    x, t = p[cols].to_numpy(), p[y].to_numpy(float)
    fold = np.array([int(hashlib.md5(f"fold:{k}".encode()).hexdigest()[:8], 16) % S.FOLDS for k in p[key]])

    def solve(x, t, alphas):
        xm, tm = x.mean(0), t.mean()
        x, t, w, out = x - xm, t - tm, np.zeros(x.shape[1]), []
        for a in alphas:
            for _ in range(2000):
                old = w.copy()
                for j in range(x.shape[1]):
                    rest = t - x @ w + x[:, j] * w[j]
                    z = x[:, j] @ rest / len(t)
                    w[j] = np.sign(z) * max(abs(z) - a, 0) / (x[:, j] @ x[:, j] / len(t))
                if np.abs(w - old).max() < 1e-9:
                    break
            out.append((w.copy(), tm - xm @ w))
        return out

    top = np.abs((x - x.mean(0)).T @ (t - t.mean())).max() / len(t)
    alphas = top * np.logspace(0, -3, S.ALPHAS)
    err = np.zeros(len(alphas))
    for f in range(S.FOLDS):
        for i, (w, c) in enumerate(solve(x[fold != f], t[fold != f], alphas)):
            err[i] += ((t[fold == f] - x[fold == f] @ w - c) ** 2).mean()
    w, c = solve(x, t, alphas[: int(err.argmin()) + 1])[-1]
    return 1 - ((t - x @ w - c) ** 2).sum() / ((t - t.mean()) ** 2).sum()


def test_lasso_from_sums_equals_lasso_on_rows(spark):
    p = data(400)
    cols = ["a", "b", "noise"]
    folds = S.fold_moments(spark.createDataFrame(p), cols, "y", "id")
    for n in (1, 2, 3):
        assert S.lasso_cv_r2(folds, range(n)) == pytest.approx(lasso_r2_rows(p, cols[:n], "id", "y"), abs=1e-4)


def test_lasso_forward_drops_first_decrease(spark, monkeypatch):
    monkeypatch.setattr(S, "lasso_cv_r2", lambda folds, used: {1: 0.2, 2: 0.1 if 1 in used else 0.3}.get(len(used), 0.4))
    out = S.lasso_forward(spark.createDataFrame(data(100)), ["a", "b", "c"], "y", "id").collect()
    assert {r.var_name: r.kept for r in out} == {"a": True, "b": False, "c": True}


def test_cv_backward_semantics(spark):
    """The pass walks the list cumulatively; with noise last nothing that
    helps is deleted, and the first removal can never be chosen."""
    out = S.cv_backward(spark.createDataFrame(data(600)), ["noise", "a", "b"], "y", "id").collect()
    assert {r.var_name for r in out} == {"noise", "a", "b"}
    assert all(r.kept for r in out if r.var_name in ("a", "b"))


def test_split_is_repeatable(spark):
    df = spark.createDataFrame(data())
    train, test = M.split_by_key(df, "id")
    assert train.count() + test.count() == 1200 and 760 < train.count() < 920
    assert S.fold_counts(train, "id", "y").count() == S.FOLDS  # the split leaves rows in every fold
    assert train.repartition(9).select("id").exceptAll(M.split_by_key(df.repartition(3), "id")[0].select("id")).count() == 0
