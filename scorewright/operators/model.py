"""Splits, logistic scorecard fits and batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.columns import key_slot, logistic
from scorewright.operators.newton import Model, fit_all
from scorewright.sources.tables import materialise


_ROWS_PER_TASK = 100_000


def split_by_key(df: DataFrame, key: str, low: int = 7, of: int = 10) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a salted hash of the key: repeatable under any
    partitioning, which a random split is not, and blind to patterns in the
    keys, which a remainder is not."""
    slot = key_slot(F.col(key), of, "split")
    return df.where(slot < low), df.where(slot >= low)


def patterns(df: DataFrame, cols: Sequence[str], y: str, *keep: str) -> DataFrame:
    """(job) Distinct encoded rows with their weights: ``(*keep, *cols, y, w)``.

    Encoded variables take a few values each, so rows collapse to patterns
    before the shuffle, and the many fits of a selection read the patterns
    instead of the table.  Weighted fits give the same coefficients.  Written
    once to reliable storage."""
    columns = [F.col(c).cast("double").alias(c) for c in cols]
    rows = df.dropna(subset=[*cols, y]).select(*keep, *columns, F.col(y).cast("double").alias("y"))
    require_finite(rows, cols)
    counts = materialise(rows.groupBy(*keep, *cols, "y").agg(F.count("*").cast("double").alias("w")))
    # Iterative fits pay per task, so few patterns go into few partitions.
    return counts.coalesce(counts.count() // _ROWS_PER_TASK + 1)


def require_finite(df: DataFrame, cols: Sequence[str]) -> None:
    """(job) An error that names the variables with infinite or NaN cells, as
    the encoding of bins without bads or goods gives them."""
    unfit = [F.max(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in cols]
    named = [c for c, bad in (df.agg(*unfit).first().asDict().items() if unfit else ()) if bad]
    if named:
        raise ValueError(f"infinite or undefined values in {', '.join(named)}: merge their bins without bads or goods first")


def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def fit_scorecard(df: DataFrame, cols: Sequence[str], y: str, C: float = 1.0) -> tuple[dict[str, float], float]:
    """(job) Coefficients by name, and the intercept, of an L2 fit: the summed
    loss plus squared coefficients over ``2 C``, the intercept apart."""
    cols = list(cols)
    (fit,) = fit_all(patterns(df, cols, y), cols, [Model(range(len(cols)))], 1.0 / C)
    return dict(zip(cols, map(float, fit.beta[1:]))), float(fit.beta[0])


def lr_coefficients(df: DataFrame, cols: Sequence[str], y: str, C: float = 1.0) -> DataFrame:
    """(job) Coefficient table, intercept first."""
    coef, intercept = fit_scorecard(df, cols, y, C)
    rows = [("intercept", intercept), *coef.items()]
    return df.sparkSession.createDataFrame(rows, "var_name string, coef double")


def score_batch(df: DataFrame, coef: Mapping[str, float], intercept: float, out: str = "score") -> DataFrame:
    """Add the probability of class 1; a plain expression, no model object."""
    return df.withColumn(out, logistic(coef, intercept))
