"""Stability over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators.assemble import union_all
from scorewright.operators.evaluate import ks_auc
from scorewright.operators.ordered import count_levels


def stability_table(df: DataFrame, cols: Sequence[str], period: str, y: str) -> DataFrame:
    """``(var_name, period, bin, n, share, bad_rate)`` for all variables in
    one job: the share of each bin among the period's rows and its bad rate.
    Combinations without rows do not appear."""
    rows = df.where(F.col(period).isNotNull()).withColumn("period", F.col(period))
    cells = count_levels(rows, cols, y, [F.count("*").alias("n"), F.avg(y).alias("bad_rate")], ["period"])
    whole = F.sum("n").over(Window.partitionBy("var_name", "period"))  # one row per bin
    return cells.select("var_name", "period", "bin", "n", (F.col("n") / whole).alias("share"), "bad_rate")


def period_target_cube(df: DataFrame, period: str, y: str) -> DataFrame:
    """Counts by period and target with margins; ``null`` marks a margin."""
    rows = df.dropna(subset=[period, y])
    return rows.cube(F.col(period).alias("period"), F.col(y).alias("target")).agg(
        F.count("*").alias("n"), F.grouping_id().alias("level")
    )


def monthly_ks_auc(df: DataFrame, period: str, score: str, y: str) -> DataFrame:
    """(job) KS and AUC of every period."""
    return ks_auc(df, score, y, [period]).select(F.col(period).alias("period"), "ks", "auc", "total", "bad")


def stack_samples(*samples: DataFrame, period: str, drop: Sequence[str] = ()) -> DataFrame:
    """Development and later samples on top of each other, without the given
    periods."""
    stacked = union_all(*samples)
    return stacked.where(~F.col(period).isin(list(drop))) if drop else stacked
