"""KS, AUC, gains tables and score bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scorewright.functions.columns import text_rank
from scorewright.operators.assemble import require_key
from scorewright.operators.ordered import (
    Spread,
    add_bucket,
    add_ranks,
    bucket_count,
    few_valued,
    order_statistics,
    prefix_sum,
    spread_of,
)

# From this share of distinct scores on, rows are bucketed uncombined.
UNIQUE_SHARE = 0.8


def _scored(df: DataFrame, score: str, y: str, *keep: str, weight: str | None = None) -> DataFrame:
    """Rows ``(*keep, score, y, w)`` that have a score and a target; ``w`` is
    the number of equal rows that a row stands for."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(
        *keep, F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y"), w.cast("long").alias("w")
    )
    return require_key(rows, *keep, "score", "y").where(~F.isnan("score"))


@dataclass
class Histogram:
    """``(*by, bucket, score, total, bad)``, one row per distinct score, and
    rows with the same totals per bucket."""

    counts: DataFrame
    source: DataFrame
    by: tuple[str, ...]

    def running(self) -> DataFrame:
        """The counts with cumulative totals and bads, ascending by score."""
        return prefix_sum(self.counts, self.by, "bucket", "score", ["total", "bad"], self.source)


def score_histogram(
    df: DataFrame, score: str, y: str, by: Sequence[str] = (), weight: str | None = None
) -> Histogram:
    """(job) Histogram of the scores, overall or per group."""
    rows = _scored(df, score, y, *by, weight=weight)
    return _histogram(rows, spread_of(rows, ["score"], levels=True)["score"], by)


def _histogram(rows: DataFrame, spread: Spread, by: Sequence[str] = ()) -> Histogram:
    """Counts per score.  Where scores repeat, they are combined before the
    shuffle.  Where almost every row has a score of its own, combining would
    gain nothing, and no score fills more than a few buckets, so rows go straight to their
    buckets: the running sums then need no second shuffle."""
    cells = add_bucket(rows, "score", spread.edges).select(
        *by, "bucket", "score", F.col("w").alias("total"), (F.col("w") * F.col("y")).alias("bad")
    )
    # a score that fills several buckets would cost edges, which repeat then
    unique = spread.levels > UNIQUE_SHARE * spread.n and len(spread.edges) >= bucket_count(rows.sparkSession) - 3
    if unique:
        cells = cells.repartition(*by, "bucket")
    counts = cells.groupBy(*by, "bucket", "score").agg(F.sum("total").alias("total"), F.sum("bad").alias("bad"))
    return Histogram(counts, cells if unique else counts, tuple(by))


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))



def _all_good() -> Column:
    return F.col("all_total") - F.col("all_bad")


def _good_upto() -> Column:
    return F.col("cum_total") - F.col("cum_bad")


def ks_auc_from(running: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ks_abs``, ``ks`` and plain ``auc`` of every group from running counts.

    ``ks_abs`` is the greatest absolute gap of the cumulative shares; ``ks``
    the greatest tpr - fpr from the high side, at least 0; ``auc`` the exact
    trapezoid area, below one half where the score points the wrong way.  A group without bads or
    goods has none of them."""
    good = F.col("total") - F.col("bad")
    gap = _share(F.col("cum_bad"), F.col("all_bad")) - _share(_good_upto(), _all_good())
    # tpr - fpr at "score and above" equals the gap just below the score, negated
    below = _share(_good_upto() - good, _all_good()) - _share(F.col("cum_bad") - F.col("bad"), F.col("all_bad"))
    wins = F.col("bad").cast("double") * ((_good_upto() - good).cast("double") + good / 2)
    out = running.groupBy(*by).agg(
        F.max(F.abs(gap)).alias("ks_abs"),
        F.max(below).alias("_ks"),
        F.sum(wins).alias("_wins"),
        F.max("all_total").alias("total"),
        F.max("all_bad").alias("bad"),
    )
    area = F.try_divide(
        F.col("_wins"), F.col("bad").cast("double") * (F.col("total") - F.col("bad")).cast("double")
    )
    ks = F.when(F.col("_ks").isNotNull(), F.greatest(F.col("_ks"), F.lit(0.0)))
    return out.select(*by, "ks_abs", ks.alias("ks"), area.alias("auc"), "total", "bad")


def ks_auc(
    df: DataFrame, score: str, y: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(job) KS and AUC overall or per group."""
    return ks_auc_from(score_histogram(df, score, y, by, weight).running(), by)


def ks(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(job) Absolute and signed KS."""
    return ks_auc(df, score, y, by).select(*by, "ks_abs", "ks")


def auc(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(job) Area under the ROC curve whichever way the score points: an area
    below one half is flipped.  For the plain one see :func:`ks_auc`."""
    area = F.col("auc")
    return ks_auc(df, score, y, by).select(*by, F.when(area < 0.5, 1 - area).otherwise(area).alias("auc"))


def roc_points(df: DataFrame, score: str, y: str) -> DataFrame:
    """(job) One ROC point per threshold, and the start (0, 0)."""
    r = score_histogram(df, score, y).running()
    good = F.col("total") - F.col("bad")
    points = r.select(
        F.col("score").alias("threshold"),
        (1 - _share(_good_upto() - good, _all_good())).alias("fpr"),
        (1 - _share(F.col("cum_bad") - F.col("bad"), F.col("all_bad"))).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


# -- rank slices and gains ---------------------------------------------------


def _rank_slices(rows: DataFrame, spread, interior: Sequence[int]) -> DataFrame:
    """(job) Sums over the rows ranked by score descending and tie ascending,
    cut at the 0-based ``interior`` positions: one or more rows
    ``(band, max_score, min_score, customers, bad)`` per slice, counted from 1.

    Ranks come from the score histogram.  Only the scores that a cut runs
    through (at most one per cut, and known by then) are ranked row by row, by
    tie, again through buckets, so even a score shared by a third of all rows
    is split by many tasks.  Ties must be unique numbers."""
    cuts = [float(p) for p in interior]
    ranked = _histogram(rows, spread["score"]).running().withColumn(
        "_first", F.col("all_total") - F.col("cum_total")
    )
    placed = add_ranks(
        ranked.withColumn("_last", F.col("_first") + F.col("total") - 1), {"_first": cuts, "_last": cuts}, "_slice"
    )
    # One group per slice and one per score on a cut.
    groups = placed.groupBy("_first_slice", "_last_slice").agg(
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.sum("total").alias("customers"),
        F.sum("bad").alias("bad"),
        F.min("_first").alias("first"),
    ).collect()
    fields = "band int, max_score double, min_score double, customers bigint, bad bigint"
    whole = rows.sparkSession.createDataFrame(
        [
            (g["_first_slice"] + 1, g["max_score"], g["min_score"], g["customers"], g["bad"])
            for g in groups
            if g["_first_slice"] == g["_last_slice"]
        ],
        fields,
    )
    split = {g["min_score"]: g["first"] for g in groups if g["_first_slice"] != g["_last_slice"]}
    if not split:
        return whole
    inside = add_bucket(rows.where(F.col("score").isin(list(split))), "tie", spread["tie"].edges)
    by_tie = inside.groupBy("score", "bucket", "tie").agg(F.sum("w").alias("total"), F.sum("y").alias("bad"))
    starts = F.create_map(*[F.lit(v) for pair in split.items() for v in pair])
    position = F.element_at(starts, F.col("score")) + F.col("cum_total") - F.col("total")
    pieces = prefix_sum(by_tie, ["score"], "bucket", "tie", ["total"]).withColumn("_pos", position)
    pieces = add_ranks(pieces, {"_pos": cuts}, "_slice").select(
        (F.col("_pos_slice") + 1).alias("band"),
        F.col("score").alias("max_score"),
        F.col("score").alias("min_score"),
        F.col("total").alias("customers"),
        "bad",
    )
    return whole.unionByName(pieces)


def _tied(df: DataFrame, score: str, y: str, tie: str) -> DataFrame:
    """Scored rows with a numeric tie key; text is ranked by its digest, which
    is as good an arbitrary order as its spelling."""
    text = isinstance(df.schema[tie].dataType, StringType)
    return _scored(df.withColumn("tie", text_rank(F.col(tie)) if text else F.col(tie)), score, y, "tie")


def rank_slice_pr(df: DataFrame, score: str, y: str, low: int, high: int, tie: str) -> DataFrame:
    """(job) Recall and precision of the rank slice [low, high)."""
    rows = _tied(df, score, y, tie)
    spread = spread_of(rows, ["score", "tie"], levels=True)
    hit = F.col("band") == 2
    return (
        _rank_slices(rows, spread, [low, high])
        .agg(F.sum("bad").alias("_all"), F.coalesce(F.sum(F.when(hit, F.col("bad"))), F.lit(0)).alias("_in"))
        .select(
            _share(F.col("_in"), F.col("_all")).alias("recall"),
            (F.col("_in") / F.lit(high - low)).alias("precision"),
        )
    )


def _band_sums(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("band").agg(
        F.max("max_score").alias("max_score"),
        F.min("min_score").alias("min_score"),
        F.sum("customers").alias("customers"),
        F.sum("bad").alias("bad"),
    )


def _as_pieces(h: DataFrame) -> DataFrame:
    score = F.col("score")
    return h.select("band", score.alias("max_score"), score.alias("min_score"), F.col("total").alias("customers"), "bad")


def _gain_columns(bands: DataFrame) -> DataFrame:
    """Cumulative columns of a gains table; one row per band, so the windows
    run over a few dozen rows."""
    upto = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    n, b = F.sum("customers").over(whole), F.sum("bad").over(whole)
    cn, cb = F.sum("customers").over(upto), F.sum("bad").over(upto)
    rate = _share(F.col("bad"), F.col("customers"))
    return bands.select(
        "band",
        ((F.col("max_score") + F.col("min_score")) / 2).alias("mean_score"),
        "min_score",
        "max_score",
        "customers",
        "bad",
        rate.alias("bad_rate"),
        (_share(cb, b) - _share(cn - cb, n - b)).alias("ks"),
        F.try_divide(rate, _share(b, n)).alias("gain_index"),
        _share(cb, b).alias("cum_recall"),
    )


def gains_table(df: DataFrame, score: str, y: str, part: int, tie: str) -> DataFrame:
    """(job) Gains table of ``part`` equal rank bands, best scores first.

    Band edges are ``round(i * n / part)`` (half to even).  With fewer
    distinct scores than bands, every score is a band."""
    rows = _tied(df, score, y, tie)
    spread = spread_of(rows, ["score", "tie"], levels=True)
    if few_valued(rows, ["score"], part - 1, spread):
        h = rows.groupBy("score").agg(F.count("*").alias("total"), F.sum("y").alias("bad"))
        # fewer rows than bands
        pieces = _as_pieces(h.withColumn("band", F.row_number().over(Window.orderBy(F.desc("score")))))
    else:
        step = spread["score"].n / part
        interior = [round(i * step) for i in range(1, part)]
        pieces = _rank_slices(rows, spread, interior)
    return _gain_columns(_band_sums(pieces))


def gains_thresholds(gains: DataFrame) -> list[float]:
    """(job) Minimum scores of the bands, best first, rounded to 5 places; the
    last one is 0 so that every score falls into a band."""
    mins = [round(r["min_score"], 5) for r in gains.select("band", "min_score").orderBy("band").collect()]
    return [*mins[:-1], 0.0]


def threshold_cuts(mins: Sequence[float]) -> list[float]:
    """Ascending band edges on the 0..100 scale."""
    return [round(m * 100.0, 3) for m in reversed(mins)] + [100.0]


def _fixed_band(df: DataFrame, mins: Sequence[float]) -> DataFrame:
    edges = sorted(set(mins))
    return add_ranks(df, {"score": edges}, "_rank").withColumn("band", F.lit(len(edges) + 1) - F.col("score_rank"))


def gains_fixed(df: DataFrame, score: str, y: str, mins: Sequence[float]) -> DataFrame:
    """Gains table with given minimum scores.

    A row belongs to the first band whose minimum it reaches; empty bands do
    not appear."""
    rows = _fixed_band(_scored(df, score, y), mins)
    bands = rows.groupBy("band").agg(
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.count("*").alias("customers"),
        F.sum("y").alias("bad"),
    )
    return _gain_columns(bands)


def evaluate_sample(df: DataFrame, score: str, y: str, mins: Sequence[float]) -> DataFrame:
    """(job) Fixed-threshold gains table with the KS and AUC of the sample on
    every row; all from one score histogram."""
    h = score_histogram(df, score, y)
    stats = ks_auc_from(h.running()).select(
        F.lit(1).alias("_k"), F.col("ks").alias("sample_ks"), F.col("auc").alias("sample_auc")
    )
    bands = _gain_columns(_band_sums(_as_pieces(_fixed_band(h.counts, mins))))
    return bands.withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k").drop("_k")  # stats: one row


# -- score bands ---------------------------------------------------------------


def _cumulative_bands(bands: DataFrame, n: Column) -> DataFrame:
    down = Window.orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    b, g = F.sum("bad").over(whole), F.sum("good").over(whole)
    return bands.withColumns(
        {
            "cum_share": F.round(_share(F.sum("customers").over(down), n), 4),
            "ks": F.round(
                _share(F.sum("bad").over(down), b) - _share(F.sum("good").over(down), g), 4
            ),
            "cum_recall": F.round(_share(F.sum("bad").over(down), b), 4),
        }
    )


def score_bands(df: DataFrame, score: str, y: str, k: int = 20) -> DataFrame:
    """(job) Equal-frequency score bands with cumulative measures from the
    highest band down.  Edges are on the 0..100 scale; the last band is always
    number ``k - 1``."""
    rows = _scored(df, score, y)
    cuts = order_statistics(rows, ["score"], k).first()["cuts"]
    last = len(cuts)
    rank = F.col("score_rank")
    table = (
        add_ranks(rows, {"score": cuts}, "_rank")
        .groupBy("score_rank")
        .agg(F.count("y").alias("customers"), F.sum("y").alias("bad"))
    )
    edges = F.array(*[F.lit(round(c * 100, 3)) for c in cuts])
    n = F.sum("customers").over(Window.partitionBy())
    table = table.select(
        F.when(rank == last, F.lit(k - 1)).otherwise(rank).alias("number"),
        F.when(rank == 0, F.lit(0.0)).otherwise(F.get(edges, rank - 1)).alias("lo"),
        F.when(rank == last, F.lit(100.0)).otherwise(F.get(edges, rank)).alias("hi"),
        "customers",
        "bad",
        (F.col("customers") - F.col("bad")).alias("good"),
        _share(F.col("customers"), n).alias("share"),
        _share(F.col("bad"), F.col("customers")).alias("bad_rate"),
    )
    return _cumulative_bands(table, n)


def _in_bands(df: DataFrame, score: str, bands: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``number`` of their band and the band table itself.

    Scores are taken times 100 with 3 decimals.  The bands are a few dozen
    rows; their edges become constants."""
    table = [
        (r["number"], float(r["lo"]), float(r["hi"]))
        for r in bands.select("number", "lo", "hi").orderBy("lo").collect()
    ]
    spark = df.sparkSession
    local = spark.createDataFrame(table, "number int, lo double, hi double")
    edges = [lo for _, lo, _ in table]
    rows = df.select(*keep, F.round(F.col(score).cast("double") * 100, 3).alias("score"))
    rows = add_ranks(rows, {"score": edges}, "_rank")
    at = F.col("score_rank") - 1
    number = F.get(F.array(*[F.lit(t[0]) for t in table]), at)
    top = F.get(F.array(*[F.lit(t[2]) for t in table]), at)
    return rows.withColumn("number", F.when(F.col("score") < top, number)), local


def band_apply(df: DataFrame, score: str, y: str, bands: DataFrame) -> DataFrame:
    """(job) The band columns of a new sample under given band edges.

    Every band stays; an empty one has no bad rate.  Shares refer to all rows,
    also those outside the bands."""
    rows, table = _in_bands(df, score, bands, F.col(y).alias("y"))
    counts = rows.groupBy("number").agg(F.count("*").alias("customers"), F.sum("y").alias("bad"))
    n = F.sum("customers").over(Window.partitionBy())
    counts = counts.withColumn("_n", n)
    total = counts.agg(F.max("_n").alias("_n")).withColumn("_k", F.lit(1))
    filled = (
        table.join(counts.drop("_n"), "number", "left")
        .na.fill(0, ["customers", "bad"])
        .withColumn("_k", F.lit(1))
        .join(F.broadcast(total), "_k")  # one row
        .drop("_k")
    )
    out = filled.select(
        "number",
        "lo",
        "hi",
        "customers",
        "bad",
        (F.col("customers") - F.col("bad")).alias("good"),
        _share(F.col("customers"), F.col("_n")).alias("share"),
        F.round(_share(F.col("bad"), F.col("customers")), 4).alias("bad_rate"),
        "_n",
    )
    return _cumulative_bands(out, F.col("_n")).drop("_n")


def band_share(df: DataFrame, score: str, bands: DataFrame) -> DataFrame:
    """(job) Share of a new sample's rows in every band."""
    unlabelled = df.withColumn("_none", F.lit(0))
    return band_apply(unlabelled, score, "_none", bands).select("number", "lo", "hi", "customers", "share")


def band_cut(df: DataFrame, col: str, cuts: Sequence[float], out: str = "segment") -> DataFrame:
    """Add the index of the interval ``[cuts[i], cuts[i+1])``; outside of all
    intervals, the top edge included, it is null."""
    ranked = add_ranks(df, {col: cuts}, "_seg")
    rank = F.col(col + "_seg")
    return ranked.withColumn(out, F.when((rank > 0) & (rank < len(cuts)), rank - 1)).drop(col + "_seg")
