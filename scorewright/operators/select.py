"""Stepwise variable selection."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.columns import key_slot
from scorewright.operators.evaluate import ks_auc
from scorewright.operators.linear import gram
from scorewright.operators.model import assemble, patterns
from scorewright.operators.newton import Model, fit_all, held_out_scores

FOLDS = 10
# The alpha grid of the usual cross-validated lasso.
ALPHAS = 100
ALPHA_SPAN = 1e-3


def rf_importance(df: DataFrame, cols: Sequence[str], y: str, trees: int = 10, seed: int = 0) -> DataFrame:
    """(job) Random-forest importances, greatest first."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("y")).dropna()
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, seed=seed)
    model = forest.fit(assemble(rows, cols))
    table = sorted(zip(cols, map(float, model.featureImportances.toArray())), key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(table, "var_name string, importance double")


def _with_fold(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_fold", key_slot(F.col(key), FOLDS, "fold"))


def fold_counts(df: DataFrame, key: str, y: str) -> DataFrame:
    """Rows and bads of every fold."""
    return _with_fold(df, key).groupBy(F.col("_fold").alias("fold")).agg(F.count("*").alias("n"), F.sum(y).alias("bad"))


def cv_backward(df: DataFrame, cols: Sequence[str], y: str, key: str, C: float = 1.0) -> DataFrame:
    """(job) Backward pass by cross-validated AUC.

    Variables are taken out one after another, cumulatively; the first one
    whose removal gives a higher AUC than the step before is deleted, and the
    pass starts again until a pass deletes none.  Returns ``(var_name, kept,
    round, auc)`` with the AUC at deletion.

    A pass fits all its removals in all folds together, a job per Newton step,
    from the coefficients of the pass before, and judges all held-out rows in
    one histogram, each under the model of its fold.  A fold without rows
    doesn't count."""
    cols = list(cols)
    rows = patterns(_with_fold(df, key), cols, y, "_fold")
    folds = sorted(r["_fold"] for r in rows.select("_fold").distinct().collect())
    left, deleted = list(range(len(cols))), []
    seen: dict[tuple[int, ...], float] = {}
    last: dict[int, np.ndarray] = {}

    def judge(subsets: list[tuple[int, ...]]) -> None:
        """Mean AUC over the folds of every subset."""
        fits = fit_all(rows, cols, [Model(s, f, last.get(f)) for s in subsets for f in folds], 1.0 / C)
        beta = np.zeros((len(subsets), FOLDS, len(cols) + 1))
        for i in range(len(subsets)):
            for j, f in enumerate(folds):
                beta[i, f] = fits[i * len(folds) + j].beta
        last.update({f: beta[0, f] for f in folds})
        judged = ks_auc(held_out_scores(rows, cols, beta), "score", "y", ["candidate", "_fold"], weight="w")
        for r in judged.groupBy("candidate").agg(F.avg("auc").alias("auc")).collect():
            seen[subsets[r["candidate"]]] = r["auc"]

    while True:
        subsets = [tuple(left[i:]) for i in range(1, len(left))]  # the list without its first, its first two, ...
        if new := [s for s in subsets if s not in seen]:
            judge(new)
        before, drop = 1.0, None
        for name, rest in zip(left, subsets):
            if seen[rest] > before:
                drop = name
                break
            before = seen[rest]
        if drop is None:
            break
        deleted.append((cols[drop], False, len(deleted) + 1, seen[rest]))
        left.remove(drop)
    table = [(cols[i], True, 0, None) for i in left] + deleted
    return df.sparkSession.createDataFrame(table, "var_name string, kept boolean, round int, auc double")


def _lasso(g: np.ndarray, r: np.ndarray, alphas: np.ndarray, sweeps: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Lasso coefficients of several small problems at once, from centred
    moment matrices: ``g[f]`` = X'X/n, ``r[f]`` = X'y/n; one row of ``alphas``
    per step of a warm-started path.  Returns (step, problem, variable)."""
    w = np.zeros_like(r)
    diag = np.maximum(np.einsum("fii->fi", g), 1e-300)
    path = []
    for alpha in alphas:
        for _ in range(sweeps):
            old = w.copy()
            for j in range(r.shape[1]):
                z = r[:, j] - np.einsum("fi,fi->f", g[:, j], w) + diag[:, j] * w[:, j]
                w[:, j] = np.sign(z) * np.maximum(np.abs(z) - alpha, 0.0) / diag[:, j]
            if np.abs(w - old).max() <= tol * max(1.0, np.abs(w).max()):
                break
        else:
            warnings.warn(f"lasso at penalty {alpha:g} has not settled after {sweeps} sweeps", stacklevel=2)
        path.append(w.copy())
    return np.array(path)


class _Moments:
    """Sums of one fold: n, the sums and the products of (X, y)."""

    def __init__(self, k: int):
        self.n, self.s, self.p = 0.0, np.zeros(k), np.zeros((k, k))

    def add(self, other: _Moments, sign: float = 1.0) -> _Moments:
        out = _Moments(len(self.s))
        out.n, out.s, out.p = self.n + sign * other.n, self.s + sign * other.s, self.p + sign * other.p
        return out

    def centred(self, about: np.ndarray) -> np.ndarray:
        cross = np.outer(about, self.s)
        return (self.p - cross - cross.T + self.n * np.outer(about, about)) / self.n


def fold_moments(df: DataFrame, cols: Sequence[str], y: str, key: str) -> list[_Moments]:
    """(job) Sums of products per fold: everything a least-squares fit on any
    subset of the columns needs, from one pass over the data."""
    names = [*cols, y]
    rows = _with_fold(df.dropna(subset=names), key)
    folds = [_Moments(len(names)) for _ in range(FOLDS)]
    for r in gram(rows, names, "_fold").collect():
        m = folds[r["_fold"]]
        m.p[r["i"], r["j"]] = m.p[r["j"], r["i"]] = r["sij"]
        if r["i"] == r["j"]:
            m.n, m.s[r["i"]] = r["n"], r["si"]
    return [m for m in folds if m.n]


def lasso_cv_r2(folds: Sequence[_Moments], subset: Sequence[int]) -> float:
    """In-sample R2 of a lasso whose penalty is chosen by fold errors."""
    pick = [*subset, len(folds[0].s) - 1]
    whole = folds[0]
    for m in folds[1:]:
        whole = whole.add(m)
    full = whole.centred(whole.s / whole.n)[np.ix_(pick, pick)]
    top = np.abs(full[:-1, -1]).max()
    if top == 0 or full[-1, -1] == 0:
        return 0.0
    alphas = top * np.logspace(0, np.log10(ALPHA_SPAN), ALPHAS)
    trains = [whole.add(m, -1.0) for m in folds]
    means = [t.s / t.n for t in trains]
    fits = np.array([t.centred(mu)[np.ix_(pick, pick)] for t, mu in zip(trains, means)])
    path = _lasso(fits[:, :-1, :-1], fits[:, :-1, -1], alphas)
    errors = np.zeros(len(alphas))
    for f, (m, mu) in enumerate(zip(folds, means)):
        c = m.centred(mu)[np.ix_(pick, pick)]
        w = np.hstack([-path[:, f], np.ones((len(alphas), 1))])
        errors += np.einsum("ai,ij,aj->a", w, c, w) / len(folds)
    best = int(np.argmin(errors))
    w = _lasso(full[None, :-1, :-1], full[None, :-1, -1], alphas[: best + 1])[-1, 0]
    residual = np.append(-w, 1.0)
    return float(1.0 - residual @ full @ residual / full[-1, -1])


def lasso_forward(df: DataFrame, cols: Sequence[str], y: str, key: str) -> DataFrame:
    """(job) Forward pass by lasso.

    Variables are added one by one; the first one that lowers the in-sample
    R2 is deleted and the pass starts again, in list order, until a pass
    deletes none.  Returns ``(var_name, kept, round, r2)``."""
    cols = list(cols)
    folds = fold_moments(df, cols, y, key)
    left, rows = list(cols), []
    while True:
        used, before, drop, trail = [], 0.0, None, {}
        for name in left:
            used.append(cols.index(name))
            r2 = lasso_cv_r2(folds, used)
            trail[name] = r2
            if r2 < before:
                drop = name
                break
            before = r2
        if drop is None:
            break
        rows.append((drop, False, len(rows) + 1, trail[drop]))
        left.remove(drop)
    table = [(c, True, 0, trail[c]) for c in left] + rows
    return df.sparkSession.createDataFrame(table, "var_name string, kept boolean, round int, r2 double")


def sign_filter(df: DataFrame, cols: Sequence[str], y: str, C: float = 1.0) -> DataFrame:
    """(job) Coefficients of an L2 logistic fit and whether they are positive."""
    cols = list(cols)
    (fit,) = fit_all(patterns(df, cols, y), cols, [Model(range(len(cols)))], 1.0 / C)
    table = [(c, float(v), bool(v > 0)) for c, v in zip(cols, fit.beta[1:])]
    return df.sparkSession.createDataFrame(table, "var_name string, coef double, kept boolean")


def pvalue_backward(df: DataFrame, cols: Sequence[str], y: str, max_p: float = 0.05) -> DataFrame:
    """(job) Drop the variable with the greatest p-value of a logit without
    intercept until none exceeds the limit.  Each fit starts from the
    coefficients of the one before."""
    cols = list(cols)
    rows = patterns(df, cols, y)
    left, table, start = list(range(len(cols))), [], None
    while left:
        (fit,) = fit_all(rows, cols, [Model(left, start=start)], intercept=False)
        start = fit.beta
        beta = fit.beta[1:][left]
        error = np.sqrt(np.diag(fit.covariance)[1:][left])
        p = [math.erfc(abs(b) / e / math.sqrt(2.0)) if e > 0 else 1.0 for b, e in zip(beta, error)]
        worst = int(np.argmax(p))
        if p[worst] <= max_p:
            table += [(cols[i], float(b), float(v), True) for i, b, v in zip(left, beta, p)]
            break
        table.append((cols[left[worst]], float(beta[worst]), float(p[worst]), False))
        left.pop(worst)
    return df.sparkSession.createDataFrame(table, "var_name string, coef double, p_value double, kept boolean")
