import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewright.operators import evaluate as E
from scorewright.operators import monitor as O
from scorewright.operators import ordered as S

SIX = [(0.1, 0), (0.2, 0), (0.2, 1), (0.4, 1), (0.4, 1), (0.6, 0)]


def frame(spark, rows):
    return spark.createDataFrame([(s, y, i) for i, (s, y) in enumerate(rows)], "score double, y int, id long")


def random_scores(n, seed, digits=3):
    rng = np.random.default_rng(seed)
    s = np.round(rng.random(n), digits)
    s = np.where(rng.random(n) < 0.35, 0.5, s)  # one score holds a third of the rows
    y = (rng.random(n) < 0.2 + 0.4 * s).astype(int)
    return pd.DataFrame({"score": s, "y": y, "id": rng.permutation(n)})


def test_ks_and_auc_by_hand(spark):
    df = frame(spark, SIX)
    assert round(E.ks(df, "score", "y").first().ks_abs, 9) == round(1 / 3, 9)
    assert round(E.auc(df, "score", "y").first().auc, 6) == 0.611111
    flipped = frame(spark, [(s, 1 - y) for s, y in SIX])
    assert round(E.auc(flipped, "score", "y").first().auc, 6) == 0.611111


def brute_curve(p):
    t = p.groupby("score")["y"].agg(["count", "sum"]).sort_index()
    good = t["count"] - t["sum"]
    cb, cg = t["sum"].cumsum() / t["sum"].sum(), good.cumsum() / good.sum()
    signed = max(0.0, ((cg - good / good.sum()) - (cb - t["sum"] / t["sum"].sum())).max())
    area = (t["sum"] * (good.cumsum() - good / 2)).sum() / (t["sum"].sum() * good.sum())
    return (cb - cg).abs().max(), signed, max(area, 1 - area)


@pytest.mark.parametrize("seed", range(3))
def test_curve_matches_brute_force(spark, seed):
    p = random_scores(3000, seed)
    r = E.ks_auc(spark.createDataFrame(p).repartition(7), "score", "y").first()
    assert np.allclose([r.ks_abs, r.ks, r.auc], brute_curve(p))


def test_weights_stand_for_rows(spark):
    p = random_scores(500, 5, 1)
    packed = p.groupby(["score", "y"]).size().reset_index(name="w")
    r = E.ks_auc(spark.createDataFrame(packed), "score", "y", weight="w").first()
    assert np.allclose([r.ks_abs, r.ks, r.auc], brute_curve(p))


def test_monthly_curve_and_one_sided_month(spark):
    p = random_scores(2000, 1)
    p["month"] = np.where(p["id"] % 3 == 0, "2020-01", "2020-02")
    p.loc[:4, "month"], p.loc[:4, "y"] = "2020-03", 1
    out = {r.period: r for r in O.monthly_ks_auc(spark.createDataFrame(p), "month", "score", "y").collect()}
    for m in ("2020-01", "2020-02"):
        assert np.allclose([out[m].ks, out[m].auc], brute_curve(p[p.month == m])[1:])
    assert out["2020-03"].ks is None and out["2020-03"].auc is None and out["2020-03"].total == 5


def test_prefix_sum_equals_plain_window(spark):
    p = random_scores(4000, 2)
    h = E.score_histogram(spark.createDataFrame(p), "score", "y").counts
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    both = S.prefix_sum(h, [], "bucket", "score", ["total", "bad"]).withColumn("plain", F.sum("bad").over(w))
    assert both.where("plain <> cum_bad").count() == 0
    assert both.select("bucket").distinct().count() > 50


def test_no_window_over_the_whole_table(spark):
    """Every single-partition exchange sits above a per-bucket or per-band
    aggregate."""
    df = spark.createDataFrame(random_scores(1000, 3))
    h = E.score_histogram(df, "score", "y")
    plan = h.running()._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    for block in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate(keys=[bucket" in block.split("Exchange")[0]


def test_roc_points(spark):
    out = E.roc_points(frame(spark, SIX), "score", "y").collect()
    points = sorted((round(r.fpr, 6), round(r.tpr, 6)) for r in out)
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and len(points) == 5


def brute_gains(p, part):
    p = p.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    n = len(p)
    if p["score"].nunique() < part:
        sizes = p.groupby("score").size().sort_index(ascending=False).cumsum().tolist()
        edges = [0, *sizes]
    else:
        edges = [round(i * (n / part)) for i in range(part)] + [n]
    rows = []
    for b, (lo, hi) in enumerate(zip(edges, edges[1:]), 1):
        cut, upto = p[lo:hi], p[:hi]
        rate = cut.y.mean()
        ks = upto.y.sum() / p.y.sum() - (1 - upto.y).sum() / (1 - p.y).sum()
        rows.append(
            (b, (cut.score.max() + cut.score.min()) / 2, cut.score.min(), cut.score.max(), len(cut), cut.y.sum(), rate, ks, rate / p.y.mean(), upto.y.sum() / p.y.sum())
        )
    return rows


@pytest.mark.parametrize("part,digits", [(10, 3), (20, 1), (7, 2), (5, 6)])
def test_gains_match_brute_force(spark, part, digits):
    p = random_scores(1501, part, digits)
    got = sorted(map(tuple, E.gains_table(spark.createDataFrame(p).repartition(6), "score", "y", part, "id").collect()))
    assert np.allclose(got, brute_gains(p, part))


def test_gains_edges_half_even(spark):
    df = frame(spark, [(i / 10, i % 2) for i in range(7)])
    assert [r.customers for r in E.gains_table(df, "score", "y", 3, "id").orderBy("band").collect()] == [2, 3, 2]


def test_rank_slice(spark):
    p = random_scores(800, 4, 1)
    r = E.rank_slice_pr(spark.createDataFrame(p), "score", "y", 30, 420, "id").first()
    s = p.sort_values(["score", "id"], ascending=[False, True])[30:420]
    assert np.allclose([r.recall, r.precision], [s.y.sum() / p.y.sum(), s.y.sum() / 390])


def test_fixed_thresholds_place_by_value(spark):
    df = frame(spark, [(0.95, 1), (0.75, 0), (0.74, 1)])
    out = E.gains_fixed(df, "score", "y", [0.9, 0.8, 0.7, 0.0]).orderBy("band").collect()
    assert [(r.band, r.customers) for r in out] == [(1, 1), (3, 2)]


def test_thresholds(spark):
    df = frame(spark, [(i / 10, i % 2) for i in range(10)])
    mins = E.gains_thresholds(E.gains_table(df, "score", "y", 5, "id"))
    assert mins == [0.8, 0.6, 0.4, 0.2, 0.0]
    assert E.threshold_cuts(mins) == [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]


def test_score_bands_invariants_and_apply(spark):
    p = random_scores(2000, 6)
    df = spark.createDataFrame(p)
    bands = E.score_bands(df, "score", "y")
    rows = bands.orderBy("number").collect()
    assert sum(r.customers for r in rows) == 2000
    assert rows[0].cum_recall == 1.0 and rows[0].cum_share == 1.0 and rows[-1].number == 19
    assert all(0 <= r.ks <= 1 or abs(r.ks) < 0.05 for r in rows)
    later = spark.createDataFrame([(0.999, 1), (0.999, 0), (1.0, 1)], "score double, y int")
    out = {r.number: r for r in E.band_apply(later, "score", "y", bands).collect()}
    assert len(out) == len(rows)  # empty bands stay
    assert out[19].customers == 2 and out[19].share == pytest.approx(2 / 3)  # 100 is outside
    assert out[0].customers == 0 and out[0].bad_rate is None


def test_band_share_sums_to_one(spark):
    df = spark.createDataFrame(random_scores(2000, 7))
    share = E.band_share(df, "score", E.score_bands(df, "score", "y"))
    assert share.agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_band_cut(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (100.0,), (-1.0,), (None,)], "x double")
    assert [r.segment for r in E.band_cut(df, "x", [0.0, 5.0, 100.0]).collect()] == [0, 1, None, None, None]


def test_evaluate_sample_repeats_sample_metrics(spark):
    p = random_scores(900, 8)
    out = E.evaluate_sample(spark.createDataFrame(p), "score", "y", [0.8, 0.4, 0.0]).collect()
    _, signed, area = brute_curve(p)
    assert {(round(r.sample_ks, 9), round(r.sample_auc, 9)) for r in out} == {(round(signed, 9), round(area, 9))}
    assert sum(r.customers for r in out) == 900


def test_stability_shares_sum_to_one(spark):
    p = random_scores(500, 9, 1)
    p["m"], p["b"] = np.where(p["id"] % 2, "a", "b"), (p["score"] * 4).astype(int)
    out = O.stability_table(spark.createDataFrame(p), ["b"], "m", "y")
    sums = [r[0] for r in out.groupBy("period").agg(F.sum("share").alias("s")).select("s").collect()]
    assert np.allclose(sums, 1.0) and len(sums) == 2


def test_stack_samples_drops_periods(spark):
    a = spark.createDataFrame([("2018-11", 1)], "m string, y int")
    b = spark.createDataFrame([("2018-12", 0), ("2019-01", 1)], "m string, z int")
    assert sorted(r.m for r in O.stack_samples(a, b, period="m", drop=["2018-12"]).collect()) == ["2018-11", "2019-01"]


def test_unique_scores_need_one_shuffle(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"score": rng.random(20000), "y": rng.integers(0, 2, 20000)})
    df = spark.createDataFrame(p).repartition(4)
    r = E.ks_auc(df, "score", "y").first()
    assert np.allclose([r.ks_abs, r.ks, r.auc], brute_curve(p))
    plan = E.score_histogram(df, "score", "y").running()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket#" in plan and "score#" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning" in line
    )


def test_frequent_scores_are_combined_before_the_shuffle(spark):
    df = spark.createDataFrame(random_scores(3000, 1, 2))
    h = E.score_histogram(df, "score", "y").counts._jdf.queryExecution().executedPlan().toString()
    assert h.index("Exchange hashpartitioning(bucket") < h.index("partial_sum")  # below the exchange


def test_both_sides_read_one_shuffle(spark):
    rng = np.random.default_rng(0)
    unique = pd.DataFrame({"score": rng.random(20000), "y": rng.integers(0, 2, 20000), "m": rng.integers(0, 3, 20000)})
    for p in (unique, random_scores(3000, 1, 2).assign(m=1)):
        for by in ([], ["m"]):
            out = E.ks_auc(spark.createDataFrame(p).repartition(3), "score", "y", by)
            out.collect()
            final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "ReusedExchange" in final
