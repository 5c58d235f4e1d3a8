"""Column quality: null shares, distinct counts and their stability in time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.operators.ordered import columns_by_kind, long_values

# Aggregates kept in one projection, below the size the JVM still compiles.
_CHUNK = 50


def _missing(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _null_shares(df: DataFrame, cols: Sequence[str], *by: str) -> DataFrame:
    """``(*by, var_name, null_share)`` by one aggregate per column group."""
    parts = []
    for start in range(0, len(cols), _CHUNK):
        group = cols[start : start + _CHUNK]
        wide = df.groupBy(*by).agg(
            *[F.avg(_missing(df.schema[c]).cast("int")).alias(f"_m_{c}") for c in group]
        )
        cells = [e for c in group for e in (F.lit(c), F.col(f"_m_{c}"))]
        parts.append(wide.select(*by, F.stack(F.lit(len(group)), *cells).alias("var_name", "null_share")))
    return reduce(DataFrame.unionByName, parts)


def null_share(df: DataFrame, cols: Sequence[str] | None = None, max_share: float = 0.95) -> DataFrame:
    """Null share of every column and whether it stays below the limit."""
    shares = _null_shares(df, list(cols or df.columns))
    return shares.withColumn("keep", F.col("null_share") < max_share)


def prune_null_columns(df: DataFrame, max_share: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    """(job) Drop the columns whose null share reaches the limit."""
    good = {r["var_name"] for r in null_share(df, max_share=max_share).where("keep").collect()}
    return df.select(*[c for c in df.columns if c in good or c in keep])


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values of every column.

    Long form: values are de-duplicated before the shuffle and spread by
    value, never by column."""
    parts = []
    for kind, names in columns_by_kind(df, cols).items():
        levels = long_values(df, names, kind=kind).groupBy("var_name", "value").agg(F.count("*").alias("n"))
        parts.append(levels.groupBy("var_name").agg(F.count("*").alias("different_values")))
    return reduce(DataFrame.unionByName, parts)


def monthly_null_matrix(df: DataFrame, cols: Sequence[str], period: str) -> DataFrame:
    """Null share per variable and period, with the mean over periods and the
    population standard deviation over the mean."""
    cells = _null_shares(df.where(F.col(period).isNotNull()), list(cols), period)
    over = cells.groupBy("var_name").agg(
        F.avg("null_share").alias("mean_null_share"), F.stddev_pop("null_share").alias("_std")
    )
    stats = over.select(
        "var_name", "mean_null_share", F.try_divide("_std", "mean_null_share").alias("null_std_over_mean")
    )
    # one row per variable
    return cells.join(F.broadcast(stats), "var_name")


def quality_flags(null_share: Column, different: Column) -> tuple[Column, Column]:
    """Use flag and reason; fully null beats mostly null beats single value."""
    reason = (
        F.when(null_share >= 1, "all_null").when(null_share >= 0.95, "mostly_null").when(different == 1, "single_value")
    )
    return reason.isNull(), reason


def quality_profile(df: DataFrame, cols: Sequence[str], period: str) -> DataFrame:
    """One row per variable: null share, distinct values, mean and stability
    of the monthly null share, use flag and reason."""
    shares = _null_shares(df, list(cols))
    months = monthly_null_matrix(df, cols, period).select("var_name", "mean_null_share", "null_std_over_mean").distinct()
    joined = shares.join(distinct_counts(df, cols), "var_name", "left").join(months, "var_name", "left")
    different = F.coalesce("different_values", F.lit(0))
    use, reason = quality_flags(F.col("null_share"), different)
    return joined.select(
        "var_name",
        "null_share",
        different.alias("different_values"),
        "mean_null_share",
        "null_std_over_mean",
        use.alias("use"),
        reason.alias("reason"),
    )
