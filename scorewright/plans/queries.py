"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions import columns as C
from scorewright.operators import assemble as A
from scorewright.operators import binning as B
from scorewright.operators import clean as P
from scorewright.operators import evaluate as E
from scorewright.operators import linear as L
from scorewright.operators import model as M
from scorewright.operators import monitor as O
from scorewright.operators import profile as Q
from scorewright.operators import select as S
from scorewright.operators import woe as W
from scorewright.plans import frames as fr
from scorewright.sources import tables as io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to 6 places, infinities kept."""
    chosen = cols or [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns(
        {c: F.when(F.abs(c) == float("inf"), F.col(c)).otherwise(F.round(c, 6)) for c in chosen}
    )


# -- sources and sinks ---------------------------------------------------------


@query
def delimited_roundtrip(spark, d):
    path = io.scratch_path(spark, "customer-text")
    customer = fr.table(spark, d, "customer")
    io.write_delimited(customer.select(*reversed(customer.columns)), path)  # found by name, not by place
    schema = "c_custkey string, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return P.require_key(io.read_delimited(spark, path, schema), "c_custkey")


@query
def delimited_mixed_headers(spark, d):
    """Extracts of one folder whose files order their columns differently and hold others besides."""
    path = io.scratch_path(spark, "customer-extracts")
    customer = fr.table(spark, d, "customer")
    odd, third = F.col("c_custkey") % 2 == 1, F.col("c_custkey") % 3 == 0
    orders = {
        "one": customer.where(odd).select("c_custkey", "c_acctbal", "c_nationkey"),
        "two": customer.where(~odd & third).select("c_nationkey", F.lit("x").alias("note"), "c_custkey", "c_acctbal"),
        "three": customer.where(~odd & ~third).select("c_acctbal", "c_nationkey", "c_custkey", "c_name"),
    }
    for name, part in orders.items():
        io.write_delimited(part, f"{path}/{name}")
    return io.read_delimited(spark, f"{path}/*", "c_custkey string, c_nationkey int, c_acctbal double")


@query
def report_blocks(spark, d):
    """Blocks of a report sent again count once; a second writer of a block changes nothing."""
    path = io.scratch_path(spark, "blocks")
    for v in ("l_discount", "l_tax", "l_discount"):
        io.append_block(W.bin_bad_rate(W.category_counts(fr.line(spark, d), [v], "y")), path, f"bad-rate:{v}")
    return r6(io.read_report(spark, path).select("block_id", "var_name", "bin", "total", "bad", "bad_rate"), "bad_rate")


@query
def append_report(spark, d):
    path = io.scratch_path(spark, "bin-report")
    for v in ("l_discount", "l_tax"):
        io.append_report(W.bin_bad_rate(W.category_counts(fr.line(spark, d), [v], "y")), path)
    return r6(io.read_table(spark, path).select("var_name", "bin", "total", "bad", "bad_rate"), "bad_rate")


# -- cleaning --------------------------------------------------------------------


@query
def null_tokens(spark, d):
    raw = fr.evt(spark, d).select(
        "event_id",
        F.when(F.col("event_type") == "error", "\\N")
        .when(F.col("event_id") % 11 == 0, "NA")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
    )
    return P.normalise_nulls(raw)


@query
def infer_numeric(spark, d):
    raw = fr.evt(spark, d).select(
        F.col("event_id").cast("string").alias("event_id"), "k", "event_type", F.col("value").cast("string").alias("v")
    )
    return r6(P.infer_numeric(raw, exclude=["event_id"]))


@query
def sentinel_to_null(spark, d):
    df = fr.app(spark, d).select("o_orderkey", "acct_s", "o_totalprice", "o_orderpriority")
    defaults = {"acct_s": '""', "o_totalprice": "-99", "o_orderpriority": "-99", "o_orderkey": "3"}
    return P.sentinel_to_null(df, defaults, exclude=["o_orderkey"])


@query
def null_to_sentinel(spark, d):
    df = fr.evt(spark, d).select(
        F.col("event_id").cast("double").alias("event_id"),
        "value",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
    )
    return P.null_to_sentinel(df)


@query
def time_range(spark, d):
    hit = P.time_range(fr.table(spark, d, "orders"), "o_orderdate", "1996-01-01", "1997-12-31 23:59:59")
    return hit.select("o_orderkey", "o_totalprice")


@query
def month_key(spark, d):
    months = fr.table(spark, d, "orders").select(
        C.period_key(F.col("o_orderdate")).alias("month"), C.period_key(F.col("o_orderdate"), "day").alias("day")
    )
    return months.groupBy("month").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))


@query
def recode_other(spark, d):
    term = C.recode_other(F.col("l_linenumber"), [1, 3, 6], 998)
    return fr.line(spark, d).groupBy(term.alias("term")).agg(F.count("*").alias("n"))


@query
def dictionary_projection(spark, d):
    listed = [("c_acctbal",), ("c_mktsegment",), ("not_there",)]
    dictionary = spark.createDataFrame(listed, "var_name string")
    return P.project_by_dictionary(fr.table(spark, d, "customer"), dictionary, keep=["c_custkey"])


@query
def null_share_prune(spark, d):
    return r6(Q.null_share(fr.evt(spark, d), ["event_id", "value", "rare", "event_type"]), "null_share")


@query
def safe_ratio(spark, d):
    ratio = C.safe_ratio(F.col("l_discount"), F.col("l_tax"))
    df = fr.line(spark, d).select("l_discount", "l_tax", ratio.alias("ratio"))
    return r6(df.groupBy("l_discount", "l_tax", "ratio").agg(F.count("*").alias("n")), "ratio")


@query
def rule_flag(spark, d):
    segment = F.col("c_mktsegment")
    flag = C.rule_flag(
        [((F.col("c_acctbal") >= 5000) & segment.isin("BUILDING"), 0), (segment.isin("MACHINERY"), 0)], 1
    )
    member = C.member_flag(segment, ["AUTOMOBILE", "HOUSEHOLD"])
    return fr.table(spark, d, "customer").select("c_custkey", flag.alias("flag"), member.alias("member"))


@query
def days_between(spark, d):
    kept = C.drop_impossible_dates(F.col("ts"), "2024-01-25")
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return fr.evt(spark, d).select(
        "event_id",
        C.days_between(at, kept).alias("days_since"),
        C.days_between(at, kept, reverse=True).alias("days_until"),
    )


@query
def category_merge(spark, d):
    df = fr.table(spark, d, "lineitem").select(
        "l_returnflag", C.code_text(F.col("l_linenumber").cast("double")).alias("code")
    )
    maps = {"code": {"1": "first lines", "2": "first lines", "7": "last lines", "6": "last lines"}, "l_returnflag": {"A": "closed", "R": "closed"}}
    return P.merge_categories(df, maps).groupBy("l_returnflag", "code").agg(F.count("*").alias("n"))


@query
def manual_rebin(spark, d):
    label = C.manual_rebin(
        F.col("acct_s"), [("middle", 0, 3000), ("debt", None, 0), ("rich or unknown", 3000, None)],
        P.SPECIAL, "rich or unknown",
    )
    return fr.app(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum("y").alias("bad"))


def _scorecard(df: DataFrame) -> list[dict]:
    """Scorecard rows from the WOE of four price bins, four balance bins with
    a special, and the region codes."""
    cuts = B.equal_freq_cuts(df, fr.APP_BINS, 4, special=[P.SPECIAL])
    bins = B.bin_counts(df, fr.APP_BINS, "y", cuts, special=[P.SPECIAL])
    rows = []
    for r in W.woe_table(bins).collect():
        special = P.SPECIAL if r["bin_no"] < 0 else None
        rows.append({"var_name": r["var_name"], "special": special, "lo": r["lo"], "hi": r["hi"], "woe": r["woe"]})
    for r in W.woe_iv(df, ["n_regionkey"], "y").collect():
        rows.append({"var_name": "n_regionkey", "code": int(r["bin"]), "woe": r["woe"]})
    return rows


@query
def scorecard_lookup(spark, d):
    df = fr.app(spark, d)
    return P.scorecard_apply(df, _scorecard(df)).select(
        "o_orderkey", "o_totalprice_points", "acct_s_points", "n_regionkey_points"
    )


# -- joins, de-duplication, unions ----------------------------------------------


@query
def inner_join(spark, d):
    orders = fr.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = fr.table(spark, d, "customer").select("c_custkey", "c_name")
    return A.inner_join(orders, customer, ["o_custkey"], ["c_custkey"])


@query
def multi_key_join(spark, d):
    events = fr.evt(spark, d)

    def per_day(kind, name):
        return events.where(F.col("event_type") == kind).groupBy("user_id", "day").agg(F.count("*").alias(name))

    return A.inner_join(per_day("view", "views"), per_day("click", "clicks"), ["user_id", "day"])


@query
def left_enrich(spark, d):
    orders = fr.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customer = fr.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return A.enrich(customer, orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"
    )


@query
def vendor_chain_join(spark, d):
    rows = fr.line(spark, d)

    def rollup(flag, name):
        part = rows.where(F.col("l_returnflag") == flag).groupBy("l_orderkey")
        out = part.agg(F.sum("l_quantity").alias(name.upper()), F.max("l_linenumber").alias("unused"))
        return P.lower_names(out.drop("unused"))

    every = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return A.join_chain([every, rollup("A", "qty_a"), rollup("N", "qty_n"), rollup("R", "qty_r")], "l_orderkey", at_once=False)


@query
def allow_list_semi(spark, d):
    customer = fr.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    keys = customer.select(F.col("c_custkey").alias("o_custkey"))
    orders = fr.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.keep_listed(orders, keys, "o_custkey")


@query
def latest_record(spark, d):
    events = fr.evt(spark, d).select("user_id", "event_id", "event_type", "value", "ts")
    gappy = events.withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    return A.latest_record(gappy, ["user_id"], "ts", "event_id").drop("ts")


@query
def first_record(spark, d):
    orders = fr.table(spark, d, "orders").select(
        "o_custkey", F.col("o_orderstatus").alias("status"), "o_orderkey", "o_totalprice"
    )
    return A.first_record(orders, ["o_custkey", "status"], "o_orderkey")


@query
def distinct_rows(spark, d):
    return A.distinct_rows(fr.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query
def union_by_name(spark, d):
    customer = fr.table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")
    )
    supplier = fr.table(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return A.union_all(customer, supplier)


# -- profiling --------------------------------------------------------------------

EVT_VARS = ["event_id", "user_id", "event_type", "value", "rare", "single", "k"]


@query
def quality_profile(spark, d):
    return r6(Q.quality_profile(fr.evt(spark, d), EVT_VARS, "day"))


@query
def monthly_null_matrix(spark, d):
    return r6(Q.monthly_null_matrix(fr.evt(spark, d), ["value", "rare", "user_id"], "day"))


# -- bins, WOE, IV -----------------------------------------------------------------


@query
def bin_bad_rate(spark, d):
    counts = W.category_counts(fr.line(spark, d), ["l_quantity", "l_tax"], "y")
    return r6(W.bin_bad_rate(counts, overall=True))


@query
def rate_encode(spark, d):
    df = W.rate_encode(fr.app(spark, d), ["o_orderpriority", "c_mktsegment"], "y")
    return r6(df.select("o_orderkey", "o_orderpriority_rate", "c_mktsegment_rate"))


@query
def woe_iv(spark, d):
    return r6(W.woe_iv(fr.line(spark, d), ["l_quantity", "l_discount", "l_tax"], "y"))


@query
def woe_report(spark, d):
    df = fr.app(spark, d).withColumn("high", F.col("o_totalprice") > 250000)
    return r6(W.woe_report(W.woe_iv(df, ["high", "n_regionkey", "o_orderpriority"], "y")))


@query
def woe_encode(spark, d):
    df, names = fr.encoded_app(spark, d)
    return r6(df.select("o_orderkey", *names))


def _screen(spark, d):
    df = fr.app(spark, d).withColumns(
        {
            "high": (F.col("o_totalprice") > 250000).cast("string"),
            "constant": F.lit("x"),
            "leak": F.col("y").cast("string"),
        }
    )
    names = ["high", "constant", "leak", "n_regionkey", "o_orderpriority"]
    return W.iv_screen(W.category_counts(df, names, "y"), 0.02)


@query
def iv_screen(spark, d):
    return r6(_screen(spark, d))


@query
def iv_rank(spark, d):
    df = fr.binned_app(spark, d)
    counts = W.category_counts(df, ["o_totalprice_Bin", "acct_s_Bin", "o_orderpriority"], "y")
    return r6(W.iv_rank(W.iv_screen(counts, 0.0), 0.0001))


@query
def chi_adjacent(spark, d):
    df = fr.line(spark, d)
    cuts = B.equal_freq_cuts(df, ["l_quantity", "l_extendedprice"], 8)
    bins = B.bin_counts(df, ["l_quantity", "l_extendedprice"], "y", cuts)
    return r6(W.chi_adjacent(bins))


@query
def equal_freq_cuts(spark, d):
    df = fr.line(spark, d).withColumn("priced", F.col("l_extendedprice"))
    cuts = B.equal_freq_cuts(df, [*fr.LINE_VARS, "priced"], 10)
    return cuts.select("var_name", "n", F.explode("cuts").alias("cut"))


@query
def equal_freq_bins(spark, d):
    df = fr.app(spark, d)
    cuts = B.equal_freq_cuts(df, fr.APP_BINS, 10, special=[P.SPECIAL], reduce_k=True)
    bins = B.bin_counts(df, fr.APP_BINS, "y", cuts, special=[P.SPECIAL], closed="right")
    return bins


@query
def equal_freq_screen(spark, d):
    names = ["o_totalprice", "acct_s", "n_regionkey", "o_orderpriority", "month"]
    return r6(B.equal_freq_screen(fr.app(spark, d), names, "y"))


@query
def chi_bins(spark, d):
    df = fr.app(spark, d)
    cuts = B.equal_freq_cuts(df, fr.APP_BINS, 5, special=[P.SPECIAL])
    bins = B.bin_counts(df, fr.APP_BINS, "y", cuts, special=[P.SPECIAL])
    return r6(W.bin_bad_rate(bins), "bad_rate")


@query
def chi_prebin(spark, d):
    df = fr.app(spark, d).withColumn("prio", F.substring("o_orderpriority", 1, 1).cast("double"))
    return B.chi_prebin(df, ["o_totalprice", "acct_s", "prio"], "y", [P.SPECIAL])


@query
def chi_merge(spark, d):
    df = fr.app(spark, d).withColumn("prio", F.substring("o_orderpriority", 1, 1).cast("double"))
    cuts = B.chi_merge(df, ["o_totalprice", "acct_s", "prio", "n_regionkey"], "y")
    return cuts.select("var_name", "n", F.posexplode_outer("cuts").alias("position", "cut"))


# -- evaluation ---------------------------------------------------------------------


@query
def ks(spark, d):
    return r6(E.ks(fr.score(spark, d), "score", "y"))


@query
def auc(spark, d):
    return r6(E.auc(fr.score(spark, d), "score", "y"))


@query
def roc_points(spark, d):
    return r6(E.roc_points(fr.score(spark, d), "score", "y"))


@query
def monthly_ks_auc(spark, d):
    march = F.substring("month", 6, 2) == "03"  # a month in which the score points the wrong way
    scored = fr.score(spark, d).withColumn("score", F.when(march, 1 - F.col("score")).otherwise(F.col("score")))
    return r6(O.monthly_ks_auc(scored, "month", "score", "y"))


@query
def stacked_monthly(spark, d):
    """Development and later sample together, one month left out."""
    scored = fr.score(spark, d)
    stacked = O.stack_samples(
        scored.where("month < '1996-01'"), scored.where("month >= '1996-01'").drop("c_mktsegment"), period="month", drop=["1995-12"]
    )
    return r6(O.monthly_ks_auc(stacked, "month", "score", "y"))


def _text_key():
    return F.concat(F.lit("K"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))


@query
def rank_slice_pr(spark, d):
    return r6(E.rank_slice_pr(fr.score(spark, d), "score", "y", 10, 400, "o_orderkey"))


@query
def rank_slice_text_tie(spark, d):
    """Ties broken by a text key."""
    coarse = fr.score(spark, d).withColumns({"score": F.floor(F.col("score") * 100) / 100, "key": _text_key()})
    return r6(E.rank_slice_pr(coarse, "score", "y", 10, 400, "key"))


@query
def gains_text_tie(spark, d):
    coarse = fr.score(spark, d).withColumns({"score": F.floor(F.col("score") * 100) / 100, "key": _text_key()})
    return r6(E.gains_table(coarse, "score", "y", 20, "key"))


@query
def gains_table(spark, d):
    coarse = fr.score(spark, d).withColumn("score", F.floor(F.col("score") * 100) / 100)
    return r6(E.gains_table(coarse, "score", "y", 20, "o_orderkey"))


def _halves(spark, d):
    return M.split_by_key(fr.score(spark, d), "o_orderkey")


@query
def gains_fixed(spark, d):
    train, test = _halves(spark, d)
    mins = E.gains_thresholds(E.gains_table(train, "score", "y", 10, "o_orderkey"))
    return r6(E.gains_fixed(test, "score", "y", mins))


@query
def evaluate_sample(spark, d):
    train, test = _halves(spark, d)
    mins = E.gains_thresholds(E.gains_table(train, "score", "y", 10, "o_orderkey"))
    return r6(E.evaluate_sample(test, "score", "y", mins))


@query
def score_bands(spark, d):
    return r6(E.score_bands(fr.score(spark, d), "score", "y"))


@query
def band_apply(spark, d):
    train, test = _halves(spark, d)
    return r6(E.band_apply(test, "score", "y", E.score_bands(train, "score", "y")))


@query
def monitor_band_share(spark, d):
    train, test = _halves(spark, d)
    test = P.fill_label(test.withColumn("y", F.when(F.col("o_orderkey") % 9 != 0, F.col("y"))), "y")
    return r6(E.band_share(test, "score", E.score_bands(train, "score", "y")))


@query
def band_cut(spark, d):
    scored = fr.score(spark, d).withColumn("points", F.col("score") * 100)
    cut = E.band_cut(scored, "points", [5.0, 20.0, 40.0, 60.0])
    return cut.groupBy("segment").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))


@query
def stability_table(spark, d):
    df = fr.binned_app(spark, d)
    return r6(O.stability_table(df, ["o_totalprice_Bin", "acct_s_Bin", "o_orderpriority"], "month", "y"))


@query
def month_target_cube(spark, d):
    return O.period_target_cube(fr.app(spark, d), "month", "y")


@query
def skewed_mixed_keys(spark, d):
    """Hot keys of one type joined with keys of another."""
    left = fr.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("k"), "l_quantity")
    right = fr.table(spark, d, "supplier").select(F.col("s_suppkey").cast("decimal(20,0)").alias("k"), "s_nationkey")
    joined = A.join_skewed(left, right, ["k"], min_rows=1, piece_rows=50)
    return joined.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query
def skewed_both_sides(spark, d):
    """Keys that are hot on both sides, most of their rows equal."""
    line = fr.table(spark, d, "lineitem")
    left = line.select(F.when(F.col("l_linenumber") < 3, 0).otherwise(F.col("l_suppkey")).alias("k"), F.col("l_linenumber").alias("nr"))
    right = fr.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(F.col("c_custkey")).cast("bigint").alias("k"), F.col("c_nationkey").alias("nation"))
    joined = A.join_skewed(left, right, ["k"], min_rows=200, piece_rows=150)
    return joined.groupBy("nation", "nr").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("keys"))


@query
def skewed_left_join(spark, d):
    """Left join whose hot key repeats on the right, and keys that are missing or match nothing."""
    left = fr.evt(spark, d).select(F.when(F.col("event_id") % 4 != 0, F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))).alias("k"), "event_type")
    right = fr.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(F.col("o_custkey") * 3).cast("bigint").alias("k"), F.col("o_orderstatus").alias("status"))
    joined = A.join_skewed(left, right, ["k"], "left", min_rows=50, piece_rows=100)
    return joined.groupBy("event_type", "status").agg(F.count("*").alias("n"), F.count("k").alias("with_key"))


@query
def band_join(spark, d):
    """Scores placed into open-ended bands of a table."""
    bands = spark.createDataFrame([("low", None, 900.0), ("middle", 900.0, 30000.0), ("high", 30000.0, None)], "band string, lo double, hi double")
    joined = A.band_join(fr.table(spark, d, "lineitem"), "l_extendedprice", bands)
    return joined.groupBy("band").agg(F.count("*").alias("n"))


@query
def band_join_many(spark, d):
    """As many bands as orders, overlapping and some of them open, against all line items."""
    orders = fr.table(spark, d, "orders")
    lo = F.floor(F.col("o_totalprice") / 100) * 25
    open_hi, open_lo = F.col("o_orderkey") % 997 == 0, F.col("o_orderkey") % 991 == 0
    bands = orders.select("o_orderkey", F.when(~open_lo, lo).alias("lo"), F.when(~open_hi, lo + F.col("o_orderkey") % 7 * 3).alias("hi"))
    joined = A.band_join(fr.table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice", bands)
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 6).alias("highest"))


@query
def label_domain(spark, d):
    """Rows whose target is 0 or 1, and missing targets as good."""
    raw = fr.app(spark, d).withColumn("y", F.when(F.col("o_orderkey") % 9 == 0, None).when(F.col("o_orderkey") % 13 == 0, 2).otherwise(F.col("y")))
    kept = P.keep_labels(P.fill_label(raw, "y"), "y")
    return kept.groupBy("y").agg(F.count("*").alias("n"))


@query
def prune_columns(spark, d):
    """Long form of what is left of the events when nearly empty columns go."""
    df = Q.prune_null_columns(fr.evt(spark, d).select("event_id", "value", "rare", "single"), 0.95)
    return df.select([F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "var_name", "filled")


@query
def bin_labels(spark, d):
    """Display text of bins, specials counted."""
    df = fr.app(spark, d)
    cuts = B.equal_freq_cuts(df, ["acct_s"], 4, special=[P.SPECIAL])
    binned = B.assign_bins(df, cuts, special=[P.SPECIAL])
    edges = F.array(*[F.lit(int(c // 1)) for c in cuts.where("var_name = 'acct_s'").first()["cuts"]])
    label = B.bin_label(F.col("acct_s_Bin"), edges, specials=1)
    return binned.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query
def name_list_attributes(spark, d):
    """Attributes attached to an ordered list of names, order and repeats kept."""
    names = ["n_regionkey", "acct_s_Bin", "unknown", "o_totalprice_Bin", "acct_s_Bin"]
    bins = fr.binned_app(spark, d)
    iv = W.iv_screen(W.category_counts(bins, ["o_totalprice_Bin", "acct_s_Bin", "n_regionkey"], "y"), 0.0)
    return A.attach_to_names(spark, names, iv.select("var_name", "groups"))


# -- selection and models -----------------------------------------------------------


def _related(spark, d):
    return fr.app(spark, d).select(
        F.col("o_totalprice").alias("a"),
        (F.col("o_totalprice") + F.col("c_acctbal") * 10).alias("b"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal") - F.col("n_regionkey") * 100).alias("c"),
        F.col("c_acctbal").alias("e"),
        (F.col("o_orderkey") % 11).cast("double").alias("f"),
        F.lit(0.1).alias("flat"),
    )


@query
def corr_pairs(spark, d):
    return r6(L.corr_pairs(_related(spark, d), ["a", "b", "c", "e", "f", "flat"]))


@query
def corr_pairs_wide(spark, d):
    df = _related(spark, d).withColumns({"a2": -F.col("a"), "e2": F.col("e") + F.col("f")})
    return r6(L.corr_pairs(df, ["a", "b", "c", "e", "f", "flat", "a2", "e2"]))


@query
def corr_pairs_outliers(spark, d):
    """Columns with gaps, and values of a trillion where their partner is missing."""
    n = F.col("l_linenumber") + 7 * (F.col("l_orderkey") % 1000)
    far = n % 1999 == 0
    df = fr.line(spark, d).select(
        F.when(far, F.lit(1e12)).otherwise(F.col("l_extendedprice")).alias("a"),
        F.when(~far, F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("b"),
        F.when(~far & (n % 5 != 0), F.col("l_quantity") / 1000 + 1e6).alias("c"),
    )
    return r6(L.corr_pairs(df, ["a", "b", "c"]))


@query
def vif_prune_drop(spark, d):
    """Two of three columns grow together; one of them goes."""
    df = fr.line(spark, d).withColumn("mixed", F.col("l_extendedprice") + F.col("l_quantity") * 500)
    return r6(L.vif_prune(df, ["l_extendedprice", "l_discount", "mixed"], max_vif=6.0))


@query
def corr_prune(spark, d):
    pairs = L.corr_pairs(_related(spark, d), ["a", "b", "c", "e", "f"])
    df = fr.app(spark, d)
    bins = fr.binned_app(spark, d)
    iv = W.iv_screen(W.category_counts(bins, ["o_totalprice_Bin", "acct_s_Bin"], "y"), 0.0)
    high = W.iv_screen(
        W.category_counts(df.withColumn("b", (F.col("o_totalprice") > 250000).cast("string")), ["b", "n_regionkey"], "y"), 0.0
    )
    names = {"o_totalprice_Bin": "a", "acct_s_Bin": "e", "b": "b", "n_regionkey": "c"}
    iv = iv.unionByName(high).replace(names, subset=["var_name"]).select("var_name", "iv")
    return r6(L.corr_prune(pairs, iv))


@query
def vif(spark, d):
    return r6(L.vif(fr.line(spark, d), ["l_quantity", "l_extendedprice"]))


@query
def vif_prune(spark, d):
    return r6(L.vif_prune(_related(spark, d).na.fill(0.0), ["a", "b", "c", "e", "f", "flat"]))


@query
def corr_pairs_large_mean(spark, d):
    """Columns whose mean is a million times their spread."""
    df = fr.app(spark, d).select(
        (F.col("o_totalprice") / 1000 + 1.7e9).alias("a"), (F.col("o_totalprice") / 900 + F.col("c_acctbal") / 1e6 + 1.7e9).alias("b"), F.lit(1.7e9).alias("flat")
    )
    return L.corr_pairs(df, ["a", "b", "flat"]).withColumn("corref", F.round("corref", 4))


@query
def fold_counts(spark, d):
    """All ten folds of a training part with text keys."""
    train, _ = M.split_by_key(fr.score(spark, d).withColumn("key", _text_key()), "key")
    return S.fold_counts(train, "key", "y")


@query
def split_70_30(spark, d):
    train, test = M.split_by_key(fr.score(spark, d).withColumn("key", _text_key()), "key")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))


@query
def score_batch(spark, d):
    df, names = fr.encoded_app(spark, d)
    coef = dict(zip(names, [1.0, 0.5, 0.25, -0.5, 2.0]))
    return r6(M.score_batch(df, coef, -0.1).select("o_orderkey", "score"))


@query
def rf_importance(spark, d):
    df, names = fr.encoded_app(spark, d)
    return S.rf_importance(df, names, "y")


@query
def cv_backward(spark, d):
    df, names = fr.encoded_app(spark, d)
    return r6(S.cv_backward(df, names, "y", "o_orderkey"))


@query
def lasso_forward(spark, d):
    df, names = fr.encoded_app(spark, d)
    return S.lasso_forward(df, names, "y", "o_orderkey")


@query
def sign_filter(spark, d):
    df, names = fr.encoded_app(spark, d)
    return r6(S.sign_filter(M.split_by_key(df, "o_orderkey")[0], names, "y"))


@query
def pvalue_backward(spark, d):
    df, names = fr.encoded_app(spark, d)
    return r6(S.pvalue_backward(M.split_by_key(df, "o_orderkey")[0], names, "y"))


@query
def lr_coefficients(spark, d):
    df, names = fr.encoded_app(spark, d)
    return r6(M.lr_coefficients(M.split_by_key(df, "o_orderkey")[0], names, "y"))
