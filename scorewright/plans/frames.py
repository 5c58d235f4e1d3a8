"""Modelling frames derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.columns import period_key
from scorewright.operators.binning import assign_bins, equal_freq_cuts
from scorewright.operators.clean import SPECIAL
from scorewright.operators.woe import woe_encode, woe_iv
from scorewright.sources.tables import read_table

LINE_VARS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
APP_BINS = ["o_totalprice", "acct_s"]
APP_CODES = ["o_orderpriority", "c_mktsegment", "n_regionkey"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet")


def line(spark: SparkSession, d: str) -> DataFrame:
    """Line items; bad means returned."""
    return table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def app(spark: SparkSession, d: str) -> DataFrame:
    """Applications: orders with customer attributes and a planted target."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    high = F.col("o_totalprice") > 250000
    fifth = F.col("o_orderkey") % 5 == 0
    return joined.select(
        "o_orderkey",
        "o_orderdate",
        "o_totalprice",
        "o_orderpriority",
        "c_mktsegment",
        "n_regionkey",
        "c_acctbal",
        F.when(F.col("o_orderkey") % 10 == 3, F.lit(SPECIAL)).otherwise(F.col("c_acctbal")).alias("acct_s"),
        period_key(F.col("o_orderdate")).alias("month"),
        (high != fifth).cast("int").alias("y"),
    )


def score(spark: SparkSession, d: str) -> DataFrame:
    """Applications with a known score of 4 decimals, cut off and not rounded:
    engines round ties differently."""
    value = F.least(F.floor(F.col("o_totalprice") / 60) / 10000, F.lit(0.9999))
    return app(spark, d).withColumn("score", value)


def evt(spark: SparkSession, d: str) -> DataFrame:
    """Events with missing values and a day."""
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 50 == 0, F.col("value")).alias("rare"),
        F.lit("same").alias("single"),
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        period_key(F.col("ts"), "day").alias("day"),
    )


def binned_app(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Applications with equal-frequency bins of the numeric variables."""
    df = app(spark, d)
    cuts = equal_freq_cuts(df, APP_BINS, k, special=[SPECIAL])
    return assign_bins(df, cuts, special=[SPECIAL])


def encoded_app(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Binned applications with the WOE of every variable, and the names."""
    df = binned_app(spark, d)
    names = [c + "_Bin" for c in APP_BINS] + APP_CODES
    woe = woe_iv(df, names, "y")
    return woe_encode(df, woe, names), [c + "_woe" for c in names]
