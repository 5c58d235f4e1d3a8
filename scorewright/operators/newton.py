"""Many logistic fits at once by Newton steps.

All models of a call (subsets of the columns, folds left out) take their steps
together: one pass over the rows returns the gradients and Hessians of all of
them, some k * k numbers a model, and the small systems are solved on the
driver.  A step is one job however many models there are, and a fit takes six
to eight of them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

MAX_STEPS = 60
TOLERANCE = 1e-9
_ROWS_AT_ONCE = 4096


@dataclass
class Model:
    """One fit: which columns it uses, which fold it leaves out (-1: none), and
    where it starts."""

    used: Sequence[int]
    fold: int = -1
    start: np.ndarray | None = None  # intercept and one coefficient per column of the table, unused ones 0


@dataclass
class Fit:
    """Intercept and coefficients (0 for unused columns), and the inverse of the Hessian."""

    beta: np.ndarray
    covariance: np.ndarray


def _blocks(batch: pa.RecordBatch, k: int, fold: bool) -> Iterator[tuple[np.ndarray, ...]]:
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
    x = np.column_stack([np.ones(len(batch)), *columns[:k]])
    out = columns[k + 2].astype(int) if fold else np.zeros(len(batch), int)
    for lo in range(0, len(batch), _ROWS_AT_ONCE):
        part = slice(lo, lo + _ROWS_AT_ONCE)
        yield x[part], columns[k][part], columns[k + 1][part], out[part]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _sums(k: int, beta: np.ndarray, left_out: np.ndarray, fold: bool):
    """Loss, gradient and Hessian of every model over the rows of a task."""
    upper = np.triu_indices(k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(beta), 1 + k + 1 + len(upper[0])))
        for batch in batches:
            for x, y, w, own in _blocks(batch, k, fold):
                z = x @ beta.T
                weight = w[:, None] * (own[:, None] != left_out[None, :])
                p = sigmoid(z)
                total[:, 0] += (weight * (np.logaddexp(0.0, z) - y[:, None] * z)).sum(axis=0)
                total[:, 1 : k + 2] += (x.T @ (weight * (y[:, None] - p))).T
                total[:, k + 2 :] += ((x[:, upper[0]] * x[:, upper[1]]).T @ (weight * p * (1.0 - p))).T
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(beta)), pa.int32()), pa.array([task] * len(beta), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["model", "task", "sums"]
        )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks, which come sorted by model and task."""
    now, held = None, None
    done: list[tuple[int, bytes]] = []
    for batch in batches:
        for model, sums in zip(batch.column("model").to_pylist(), batch.column("sums"), strict=True):
            values = np.frombuffer(sums.as_buffer(), float)
            if model == now:
                held = held + values
                continue
            if now is not None:
                done.append((now, held.tobytes()))
            now, held = model, values
    if now is not None:
        done.append((now, held.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in done], pa.int32()), pa.array([s for _, s in done], pa.binary())], ["model", "sums"])


def fit_all(rows: DataFrame, cols: Sequence[str], models: Sequence[Model], penalty: float = 0.0, intercept: bool = True) -> list[Fit]:
    """(job) Coefficients of all models over the rows ``(*cols, y, w[, _fold])``.

    The loss is the weighted sum of the log losses plus ``penalty`` / 2 times
    the squared coefficients, the intercept apart.  A step that would raise a
    model's loss is halved.  One job per step; models that have settled stay
    where they are.  What reaches the driver is k * k numbers per model."""
    k, fold = len(cols), "_fold" in rows.columns
    table = rows.select(*cols, "y", "w", *(["_fold"] if fold else []))
    used = np.zeros((len(models), k + 1), bool)
    used[:, 0] = intercept
    for m, model in enumerate(models):
        used[m, [1 + c for c in model.used]] = True
    beta = np.array([np.zeros(k + 1) if m.start is None else np.where(u, m.start, 0.0) for m, u in zip(models, used, strict=True)])
    left_out = np.array([m.fold if fold else -1 for m in models])
    ridge = np.full(k + 1, penalty)
    ridge[0] = 0.0
    upper = np.triu_indices(k + 1)
    going = np.arange(len(models))
    loss, before = np.full(len(models), np.inf), beta.copy()
    covariance = np.zeros((len(models), k + 1, k + 1))
    for _ in range(MAX_STEPS):
        parts = table.mapInArrow(_sums(k, beta[going], left_out[going], fold), "model int, task int, sums binary")
        summed = parts.repartition("model").sortWithinPartitions("model", "task").mapInArrow(_added, "model int, sums binary").collect()
        still = []
        for r in summed:
            m, values = going[r["model"]], np.frombuffer(bytes(r["sums"]), float)
            u = np.flatnonzero(used[m])
            value = values[0] + 0.5 * (ridge * beta[m] ** 2).sum()
            if value > loss[m] + 1e-12 * abs(loss[m]):
                beta[m] = 0.5 * (beta[m] + before[m])
                if np.abs(beta[m] - before[m]).max() > TOLERANCE:
                    still.append(m)
                continue
            h = np.zeros((k + 1, k + 1))
            h[upper] = values[k + 2 :]
            h = h + h.T - np.diag(np.diag(h)) + np.diag(ridge)
            gradient = values[1 : k + 2] - ridge * beta[m]
            inverse = np.linalg.pinv(h[np.ix_(u, u)], hermitian=True)
            covariance[m][np.ix_(u, u)] = inverse
            step = inverse @ gradient[u]
            loss[m], before[m] = value, beta[m].copy()
            beta[m, u] += step
            if np.abs(step).max(initial=0.0) > TOLERANCE * max(1.0, np.abs(beta[m]).max()):
                still.append(m)
        going = np.array(sorted(still), int)
        if not len(going):
            break
    else:
        warnings.warn(f"{len(going)} of {len(models)} fits have not settled after {MAX_STEPS} steps: the classes may be separable", stacklevel=2)
    return [Fit(b, c) for b, c in zip(beta, covariance, strict=True)]


def held_out_scores(rows: DataFrame, cols: Sequence[str], beta: np.ndarray) -> DataFrame:
    """``(candidate, _fold, score, y, w)``: every row under each candidate's
    model of the row's own fold; ``beta`` is (candidate, fold, coefficient)."""
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, w, own in _blocks(batch, k, True):
                for c in range(len(beta)):
                    p = sigmoid((x * beta[c][own]).sum(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(y), c, np.int32)), pa.array(own.astype(np.int32)), pa.array(p), pa.array(y), pa.array(w)], ["candidate", "_fold", "score", "y", "w"]
                    )

    return rows.select(*cols, "y", "w", "_fold").mapInArrow(run, "candidate int, _fold int, score double, y double, w double")
