"""Bin tables, bad rates, weight of evidence and information value."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators.assemble import join_skewed
from scorewright.operators.ordered import bin_text, count_levels

# Bin tables up to this many rows per variable become CASE-like map literals.
MAP_ROWS = 200


def _counts(y: str = "y") -> list[Column]:
    return [F.count(y).alias("total"), F.sum(y).alias("bad")]


def category_counts(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """``(var_name, bin, total, bad)`` of all columns in one job; the bin is
    the value as text.  Rows without a value or target do not count."""
    return count_levels(df.where(F.col(y).isNotNull()), cols, y, _counts(y))


def bin_bad_rate(counts: DataFrame, overall: bool = False) -> DataFrame:
    """Bad rate per bin, and on request the overall rate of the variable."""
    out = counts.withColumn("bad_rate", F.col("bad") / F.col("total"))
    if not overall:
        return out
    return _with_totals(out).withColumn("overall_rate", F.col("_b") / F.col("_n")).drop("_n", "_b")


def _with_totals(counts: DataFrame, *more: Column) -> DataFrame:
    """Totals per variable, and further aggregates, beside each bin.

    The bin table is summed per variable with map-side combine and joined with
    the sums, one row per variable, so the bins of a variable stay spread over
    all tasks however many there are.  Both sides of the join begin with the
    shuffle that makes the bin table, which runs once: the source is read once."""
    sums = counts.groupBy(F.col("var_name").alias("_var")).agg(F.sum("total").alias("_n"), F.sum("bad").alias("_b"), *more)
    return counts.join(F.broadcast(sums), F.col("var_name") == F.col("_var")).drop("_var")


def log_ratio(a: Column, b: Column) -> Column:
    """``ln(a / b)`` with explicit infinities for zero cells."""
    inf = F.lit(float("inf"))
    return F.when((a == 0) & (b == 0), F.lit(None)).when(a == 0, -inf).when(b == 0, inf).otherwise(
        F.ln(F.try_divide(a, b))
    )


def woe_table(counts: DataFrame) -> DataFrame:
    """Shares, WOE (4 decimals) and IV of every bin table.

    IV comes from unrounded logs and is repeated on each bin.  ``status`` is
    ``zero_cell`` when a bin lacks bads or goods (IV is then infinite) and
    ``single_group`` when the variable has one bin only."""
    good = F.col("total") - F.col("bad")
    odds = F.ln(F.try_divide(F.col("bad"), good))
    zero = (F.col("bad") == 0) | (good == 0)
    # IV is the sum of (bad share - good share) * (log odds - log overall odds); the shares' differences sum to zero,
    # so the overall odds drop out, and what is left are two sums that need no totals
    rows = _with_totals(
        counts,
        F.sum(F.col("bad") * odds).alias("_bad_odds"), F.sum(good * odds).alias("_good_odds"),
        F.count("*").alias("groups"), F.coalesce(F.bool_or(zero), F.lit(False)).alias("_zero"), F.coalesce(F.bool_or(zero & (F.col("total") > 0)), F.lit(False)).alias("_endless"),
    )
    rows = rows.withColumn("good", good).withColumns(
        {
            "bad_rate": F.try_divide(F.col("bad"), F.col("total")),
            "bad_pcnt": F.try_divide(F.col("bad"), F.col("_b")),
            "good_pcnt": F.try_divide(F.col("good"), F.col("_n") - F.col("_b")),
        }
    )
    iv = F.try_divide(F.col("_bad_odds"), F.col("_b")) - F.try_divide(F.col("_good_odds"), F.col("_n") - F.col("_b"))
    one_sided = (F.col("_b") == 0) | (F.col("_b") == F.col("_n"))
    iv = F.when(~one_sided, F.when(F.col("_endless"), F.lit(float("inf"))).otherwise(iv))
    rows = rows.withColumns({"_log": log_ratio(F.col("bad_pcnt"), F.col("good_pcnt")), "iv": iv})
    status = F.when(F.col("groups") < 2, "single_group").when(F.col("_zero"), "zero_cell").otherwise("ok")
    inf = F.lit(float("inf"))
    woe = F.when(F.abs("_log") == inf, F.col("_log")).otherwise(F.round("_log", 4))
    rows = rows.withColumns({"woe": woe, "status": status})
    first = ["var_name", *[c for c in counts.columns if c != "var_name"], "good", "bad_rate", "bad_pcnt", "good_pcnt"]
    return rows.select(*first, "woe", "iv", "groups", "status")


def woe_iv(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """WOE and IV of categorical or already binned columns: one scan, one
    shuffle of partially aggregated bins."""
    return woe_table(category_counts(df, cols, y))


def iv_screen(counts: DataFrame, min_iv: float = 0.02) -> DataFrame:
    """One row per variable with its IV, status and whether it passes.

    Infinite IV passes the threshold, as a zero cell does; variables with one
    group have no IV."""
    one = woe_table(counts).groupBy("var_name").agg(
        F.max("iv").alias("iv"), F.max("groups").alias("groups"), F.max("status").alias("status")
    )
    usable = F.col("status") != "single_group"
    iv = F.when(usable, F.col("iv"))
    return one.select(
        "var_name",
        iv.alias("iv"),
        "groups",
        "status",
        F.coalesce(usable & (F.col("iv") > min_iv), F.lit(False)).alias("selected"),
    )


def iv_rank(screen: DataFrame, min_iv: float = 0.01, strip: str = "_Bin") -> DataFrame:
    """Final IV report: finite IV of at least ``min_iv``, best first, with the
    bin suffix removed from the names."""
    name = F.split("var_name", strip)[0]
    return (
        screen.where((F.col("iv") >= min_iv) & (F.col("iv") < float("inf")))
        .select(name.alias("var_name"), "iv")
        .orderBy(F.desc("iv"), "var_name")
    )


def chi_adjacent(counts: DataFrame, order: str = "bin_no") -> DataFrame:
    """Chi-square, from bads only, of every bin with its right neighbour.

    Runs on bin tables (a few hundred rows per variable)."""
    rows = bin_bad_rate(counts, overall=True)
    expected = F.col("total") * F.col("overall_rate")
    rows = rows.withColumn("_chi", F.try_divide(F.pow(expected - F.col("bad"), 2), expected))
    w = Window.partitionBy("var_name").orderBy(order)
    rows = rows.withColumns(
        {"next_bin": F.lead(order).over(w), "chi2": F.col("_chi") + F.lead("_chi").over(w)}
    )
    return rows.where(F.col("next_bin").isNotNull()).select("var_name", order, "next_bin", "chi2")


def encode(df: DataFrame, table: DataFrame, cols: Sequence[str], measure: str, suffix: str) -> DataFrame:
    """(job) Replace each bin by a measure of its bin table, e.g. WOE.

    Small bin tables (checked: up to 200 bins) are read once and become map
    literals, so the table is encoded without any join.  Larger ones are
    joined on the bin, with hot bins spread."""
    rows = table.where(F.col("var_name").isin(list(cols))).select("var_name", "bin", measure)
    cap = MAP_ROWS * len(cols)
    found = rows.limit(cap + 1).collect()
    if len(found) <= cap:
        sizes = Counter(r["var_name"] for r in found)
    else:
        sizes = {r["var_name"]: r["n"] for r in rows.groupBy("var_name").agg(F.count("*").alias("n")).collect()}
    small = [c for c in cols if sizes.get(c, 0) <= MAP_ROWS]
    if len(found) > cap:
        found = rows.where(F.col("var_name").isin(small)).collect()
    maps: dict[str, list] = {c: [] for c in small}
    for r in found:
        if r["var_name"] in maps and r[measure] is not None:
            maps[r["var_name"]] += [F.lit(r["bin"]), F.lit(float(r[measure]))]
    out = df.withColumns(
        {
            c + suffix: F.try_element_at(F.create_map(*m), bin_text(df, c))
            if m
            else F.lit(None).cast("double")
            for c, m in maps.items()
        }
    )
    for c in cols:
        if c not in small:
            lookup = table.where(F.col("var_name") == c).select(
                F.col("bin").alias("_bin"), F.col(measure).cast("double").alias(c + suffix)
            )
            out = join_skewed(out.withColumn("_bin", bin_text(df, c)), lookup, ["_bin"], "left", unique=True).drop("_bin")
    return out


def rate_encode(df: DataFrame, cols: Sequence[str], y: str, suffix: str = "_rate") -> DataFrame:
    """(job) Add the bad rate of each row's bin."""
    return encode(df, bin_bad_rate(category_counts(df, cols, y)), cols, "bad_rate", suffix)


def woe_encode(df: DataFrame, table: DataFrame, cols: Sequence[str], suffix: str = "_woe") -> DataFrame:
    """(job) Add the WOE of each row's bin from a WOE table."""
    return encode(df, table, cols, "woe", suffix)


def woe_report(table: DataFrame) -> DataFrame:
    """Report projection of a WOE table, joined on the bin and not on its
    counts, so bins with equal counts stay single."""
    return table.select(
        "var_name", "bin", "woe", "total", "bad", "good", "bad_rate", "bad_pcnt", "good_pcnt", "iv", "status"
    )
