"""Correlation and variance inflation from one table of pairwise moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUMS = ("n", "si", "sj", "sii", "sjj", "sij")
_MOMENTS = ("n", "mi", "mj", "vi", "vj", "c")
# Up to this many columns the moments are plain generated expressions.
_NARROW = 6
# Columns of a tile: one row of six square matrices of this size is 200 KB.
TILE = 64
# Where a sum of squares about the batch median is this much greater than the
# variance it leaves, too many digits went and the pair is worked out again.
_LOST = 1e-6


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _about_pair_means(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two columns over the rows where both are present."""
    both = ~(np.isnan(a) | np.isnan(b))
    a, b = a[both], b[both]
    if not len(a):
        return np.zeros(6)
    ma, mb = a.mean(), b.mean()
    da, db = a - ma, b - mb
    return np.array([len(a), ma, mb, da @ da, db @ db, da @ db])


def tile_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments ``(n, mi, mj, vi, vj, c)`` of every column of ``a`` with every
    column of ``b``, each about the pair's own means; NaN is missing.

    Matrix products about the columns' medians, which no outlier moves.  A
    pair whose own rows lie far from a median, compared with their spread,
    would lose digits; those few are worked out one by one."""
    here_a, here_b = ~np.isnan(a), ~np.isnan(b)
    with np.errstate(all="ignore"):
        mid_a = np.array([np.median(x[h]) if h.any() else 0.0 for x, h in zip(a.T, here_a.T)])
        mid_b = np.array([np.median(x[h]) if h.any() else 0.0 for x, h in zip(b.T, here_b.T)])
        x, z = np.where(here_a, a - mid_a, 0.0), np.where(here_b, b - mid_b, 0.0)
        p, q = here_a.astype(float), here_b.astype(float)
        n = p.T @ q
        sx, sz, sxx, szz, sxz = x.T @ q, p.T @ z, (x * x).T @ q, p.T @ (z * z), x.T @ z
        rows = np.maximum(n, 1.0)
        mx, mz = sx / rows, sz / rows
        vx, vz, c = sxx - sx * mx, szz - sz * mz, sxz - sx * mz
        lost = ((vx < _LOST * sxx) | (vz < _LOST * szz)) & ((sxx > 0) | (szz > 0)) & (n > 0)
        out = np.stack([n, np.where(n > 0, mid_a[:, None] + mx, 0.0), np.where(n > 0, mid_b[None, :] + mz, 0.0), np.maximum(vx, 0.0), np.maximum(vz, 0.0), c])
        for i, j in np.argwhere(lost | ~np.isfinite(out).all(axis=0)):
            out[:, i, j] = _about_pair_means(a[:, i], b[:, j])
    return out


def merge_moments(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together (Chan's update)."""
    n = s[0] + t[0]
    share = np.divide(t[0], n, out=np.zeros_like(n), where=n > 0)
    # adding nothing changes nothing, infinite means included
    di, dj = np.where(t[0] > 0, t[1] - s[1], 0.0), np.where(t[0] > 0, t[2] - s[2], 0.0)
    di, dj = np.where(s[0] > 0, di, 0.0), np.where(s[0] > 0, dj, 0.0)
    weight = s[0] * share
    first = s[0] == 0
    mi, mj = np.where(first, t[1], s[1] + di * share), np.where(first, t[2], s[2] + dj * share)
    return np.stack([n, mi, mj, s[3] + t[3] + di * di * weight, s[4] + t[4] + dj * dj * weight, s[5] + t[5] + di * dj * weight])


def _tiles(k: int) -> list[tuple[int, int, slice, slice]]:
    edges = [slice(lo, min(lo + TILE, k)) for lo in range(0, k, TILE)]
    return [(i, j, a, b) for i, a in enumerate(edges) for j, b in enumerate(edges) if i <= j]


_TILE_ROW = "ti int, tj int, task int, moments binary"


def _partial(k: int, by: bool):
    """Per task and group one row for every pair of column tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        state: dict = {}
        for batch in batches:
            keys = batch.column(0).to_pylist() if by else [None] * len(batch)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[by:]]) if len(batch) else np.zeros((0, k))
            groups: dict = {}
            for row, key in enumerate(keys):
                groups.setdefault(key, []).append(row)
            for key, rows in groups.items():
                part = x if len(groups) == 1 else x[rows]
                for i, j, a, b in _tiles(k):
                    found = tile_moments(part[:, a], part[:, b])
                    at = (key, i, j)
                    state[at] = merge_moments(state[at], found) if at in state else found
        for (key, i, j), moments in state.items():
            row = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([task], pa.int32()), pa.array([moments.tobytes()], pa.binary())]
            lead = [pa.array([key]).cast(batch.schema.field(0).type)] if by else []
            yield pa.RecordBatch.from_arrays([*lead, *row], [*(batch.schema.names[:by]), "ti", "tj", "task", "moments"])

    return run


def _merged(k: int, by: bool):
    """Tiles of all tasks, which come sorted, merged one after another; then
    one row per pair of columns."""
    slices = {(i, j): (a, b) for i, j, a, b in _tiles(k)}

    def rows(key, names, kind, ti, tj, moments: np.ndarray) -> pa.RecordBatch:
        a, b = slices[ti, tj]
        i, j = (g.ravel() for g in np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij"))
        upper = i <= j
        flat = [m.ravel()[upper] for m in moments]
        lead = [pa.array([key] * int(upper.sum()), kind)] if by else []
        return pa.RecordBatch.from_arrays([*lead, pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), *map(pa.array, flat)], [*names, "i", "j", *_MOMENTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, names, kind = None, None, [], None
        for batch in batches:
            names, kind = batch.schema.names[:by], batch.schema.field(0).type
            keys = batch.column(0).to_pylist() if by else [None] * len(batch)
            for key, ti, tj, raw in zip(keys, batch.column("ti").to_pylist(), batch.column("tj").to_pylist(), batch.column("moments"), strict=True):
                a, b = slices[ti, tj]
                found = np.frombuffer(raw.as_buffer(), float).reshape(6, a.stop - a.start, b.stop - b.start)
                if (key, ti, tj) == now:
                    state = merge_moments(state, found)
                    continue
                if now is not None:
                    yield rows(now[0], names, kind, *now[1:], state)
                now, state = (key, ti, tj), found
        if now is not None:
            yield rows(now[0], names, kind, *now[1:], state)

    return run


def co_moments(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Moments over the rows where both columns are present, about the means
    of just those rows: ``([by,] i, j, n, mi, mj, vi, vj, c)`` for every pair
    i <= j; v and c are sums of squares and products.  NaN counts as missing.

    One pass.  Values that have no partner, however great, don't touch a pair.
    Few columns use built-in aggregates.  Many are cut into tiles of 64: a task
    forwards one row per pair of tiles and group, and a tile is merged row by
    row in the order of the tasks, so memory holds one tile of all tasks at a
    time and reruns agree."""
    keys = [by] if by else []
    cols = list(cols)
    values = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    if len(cols) <= _NARROW:
        cells = []
        for i, j in _pairs(len(cols)):
            x, z = F.col(f"x{i}"), F.col(f"x{j}")
            own = [F.when(F.col(b).isNotNull(), F.col(a)) for a, b in ((f"x{i}", f"x{j}"), (f"x{j}", f"x{i}"))]
            vx, vz = (F.when(F.min(o) < F.max(o), v) for o, v in zip(own, (F.regr_sxx(z, x), F.regr_syy(z, x))))  # exactly 0 for a constant
            found = (F.regr_count(z, x).cast("double"), F.regr_avgx(z, x), F.regr_avgy(z, x), vx, vz, F.regr_sxy(z, x))
            moments = [F.coalesce(m, F.lit(0.0)).alias(s) for s, m in zip(_MOMENTS, found)]
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *moments))
        wide = values.groupBy(*keys).agg(F.array(*cells).alias("_cells"))
        return wide.select(*keys, F.inline("_cells"))
    lead = f"`{by}` {df.schema[by].dataType.simpleString()}, " if by else ""
    parts = values.mapInArrow(_partial(len(cols), bool(by)), lead + _TILE_ROW)
    ordered = parts.repartition(*keys, "ti", "tj").sortWithinPartitions(*keys, "ti", "tj", "task")
    return ordered.mapInArrow(_merged(len(cols), bool(by)), lead + "i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS))


def gram(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Plain sums over the rows where both columns are present:
    ``([by,] i, j, n, si, sj, sii, sjj, sij)`` for every pair i <= j."""
    n, mi, mj = (F.col(m) for m in ("n", "mi", "mj"))
    sums = (n, n * mi, n * mj, F.col("vi") + n * mi * mi, F.col("vj") + n * mj * mj, F.col("c") + n * mi * mj)
    return co_moments(df, cols, by).select(*([by] if by else []), "i", "j", *[v.alias(s) for s, v in zip(_SUMS, sums)])


def corr_pairs(df: DataFrame, cols: Sequence[str], min_abs: float = 0.7) -> DataFrame:
    """Pearson correlation of column pairs, earlier column first, where its
    absolute value exceeds the limit, over the rows where both are present.
    A column that is constant among a pair's rows correlates with nothing
    there, and neither does one with infinite values."""
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "var_name1 string, var_name2 string, corref double")
    names = F.array(*[F.lit(c) for c in cols])
    varies = (F.col("vi") > 0) & (F.col("vj") > 0)
    pairs = co_moments(df, cols).where(F.col("i") < F.col("j")).select(
        F.get(names, F.col("i")).alias("var_name1"),
        F.get(names, F.col("j")).alias("var_name2"),
        F.when(varies, F.col("c") / (F.sqrt("vi") * F.sqrt("vj"))).alias("corref"),
    )
    return pairs.where((F.abs("corref") > min_abs) & ~F.isnan("corref"))


def corr_prune(pairs: DataFrame, iv: DataFrame) -> DataFrame:
    """Variables that survive: of each correlated pair the one with the lower
    IV goes, the second one on ties.  All pairs count, also those of variables
    that go themselves.  ``iv`` is ``(var_name, iv)`` without infinite IV."""
    first = iv.select(F.col("var_name").alias("var_name1"), F.col("iv").alias("_iv1"))
    second = iv.select(F.col("var_name").alias("var_name2"), F.col("iv").alias("_iv2"))
    loser = F.when(F.col("_iv1") >= F.col("_iv2"), F.col("var_name2")).otherwise(F.col("var_name1"))
    losers = pairs.join(first, "var_name1").join(second, "var_name2").select(loser.alias("var_name")).distinct()
    return iv.join(losers, "var_name", "left_anti")


def gram_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """(job) X'X of the columns; one small matrix reaches the driver."""
    k = len(cols)
    g = np.zeros((k, k))
    for r in gram(df, cols).select("i", "j", "sij").collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["sij"]
    return g


class Sweep:
    """Inverse of a cross-product matrix that shrinks column by column.

    The matrix is scaled to a unit diagonal and swept once per column, pivots
    by size; taking a column out again is one more sweep, k x k operations
    instead of a new inverse.  A column whose pivot is below ``tolerance`` is a
    combination of others: it stays out, and it and all columns that make it
    up have infinite factors until one of them goes."""

    def __init__(self, g: np.ndarray, tolerance: float = 1e-10) -> None:
        scale = np.sqrt(np.diag(g))
        self.flat = scale == 0  # nothing but zeros
        scale[self.flat] = 1.0
        self.a = g / np.outer(scale, scale)
        self.left = np.ones(len(g), bool)
        self.inside = np.zeros(len(g), bool)
        self.tolerance = tolerance
        self._enter()

    def _turn(self, k: int, sign: float) -> None:
        """Sweep column k in (1) or out (-1)."""
        a, d = self.a, self.a[k, k]
        row = a[k] / d
        a -= np.outer(a[:, k], row)
        a[k] = sign * row
        a[:, k] = sign * row
        a[k, k] = -1.0 / d

    def _enter(self) -> None:
        while True:
            pivot = np.where(self.left & ~self.inside, np.diag(self.a), -1.0)
            k = int(np.argmax(pivot))
            if pivot[k] <= self.tolerance:
                return
            self._turn(k, 1.0)
            self.inside[k] = True

    def factors(self) -> np.ndarray:
        """Variance inflation of the columns that are left; others NaN."""
        out = np.where(self.inside, -np.diag(self.a), np.nan)
        for u in np.flatnonzero(self.left & ~self.inside & ~self.flat):
            out[u] = np.inf
            out[self.inside & (np.abs(self.a[u]) > np.sqrt(self.tolerance))] = np.inf
        out[self.left & self.flat] = np.inf
        return out

    def drop(self, k: int) -> None:
        """Take a column out for good."""
        if self.inside[k]:
            self._turn(k, -1.0)
            self.inside[k] = False
        self.left[k] = False
        self._enter()


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(job) Variance inflation factor of every column, without a constant;
    infinite for columns that others make up, and for zeros."""
    values = Sweep(gram_matrix(df, cols)).factors() if cols else []
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(cols, values)], "var_name string, vif double"
    )


def vif_prune(df: DataFrame, cols: Sequence[str], max_vif: float = 10.0) -> DataFrame:
    """(job) Drop the column with the greatest factor, the first one on ties,
    until none exceeds the limit: ``(var_name, vif, kept, step)``.

    The data is read once; a step is one sweep of the k x k matrix."""
    sweep = Sweep(gram_matrix(df, cols)) if cols else None
    rows, step = [], 0
    while sweep is not None and sweep.left.any():
        factors = sweep.factors()
        worst = int(np.nanargmax(factors))
        if factors[worst] <= max_vif:
            rows += [(c, float(v), True, step) for c, v, left in zip(cols, factors, sweep.left) if left]
            break
        step += 1
        rows.append((cols[worst], float(factors[worst]), False, step))
        sweep.drop(worst)
    return df.sparkSession.createDataFrame(rows, "var_name string, vif double, kept boolean, step int")
