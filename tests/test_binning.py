import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.operators import binning as B
from scorewright.operators import ordered as O
from scorewright.operators import woe as W

from conftest import SF


def cuts_of(df):
    return {r.var_name: list(r.cuts) for r in df.collect()}


def numbers(spark, values):
    return spark.createDataFrame([(float(v), 1) for v in values], "x double, y int")


def test_equal_frequency_positions(spark):
    df = numbers(spark, range(1, 11))
    assert cuts_of(B.equal_freq_cuts(df, ["x"], 5)) == {"x": [3, 5, 7, 9]}
    special = numbers(spark, [*range(1, 11), -99, -99])
    assert cuts_of(B.equal_freq_cuts(special, ["x"], 6, special=[-99], reduce_k=True)) == {"x": [3, 5, 7, 9]}


@pytest.mark.parametrize("seed", range(4))
def test_cuts_match_sorted_list(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(50, 4000))
    data = pd.DataFrame(
        {
            "hot": np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n)),
            "few": rng.integers(0, 7, n).astype(float),
            "wide": rng.normal(size=n) * 10.0 ** rng.integers(-5, 9, n),
        }
    )
    df = spark.createDataFrame(data).repartition(5)
    for k in (2, 10, 37, 100):
        got = cuts_of(B.equal_freq_cuts(df, ["hot", "few", "wide"], k))
        for c in data:
            v = sorted(data[c])
            assert got[c] == sorted({v[int(i * (n / k))] for i in range(1, k)}), (c, k)


def test_text_cuts(spark):
    rng = np.random.default_rng(0)
    words = ["w" + "abcdefghij"[i % 10] * (i % 4 + 1) + str(i % 60) for i in rng.integers(0, 1000, 700)]
    df = spark.createDataFrame([(w, 1) for w in words], "x string, y int")
    v = sorted(words)
    assert cuts_of(B.equal_freq_cuts(df, ["x"], 10))["x"] == sorted({v[int(i * (700 / 10))] for i in range(1, 10)})


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert cuts_of(B.equal_freq_cuts(df, ["a", "b"], 4)) == {"a": [], "b": [1.0, 2.0]}


def test_many_columns_go_in_groups(spark):
    df = spark.range(200).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(60)])
    got = cuts_of(B.equal_freq_cuts(df, df.columns, 4))
    assert got["c0"] == [50, 100, 150] and got["c59"] == [3000, 6000, 9000] and len(got) == 60


def labels(spark, values, cuts, special, closed):
    df = numbers(spark, values)
    table = O.cut_table(spark, {"x": [float(c) for c in cuts]}, {"x": len(values)})
    binned = B.assign_bins(df, table, special, closed)
    arr = F.lit([float(c) for c in cuts])
    return [r[0] for r in binned.select(B.bin_label(F.col("x_Bin"), arr, len(special), closed)).collect()]


def test_labels(spark):
    assert labels(spark, [-99, 3, 4, 6], [3, 5], [-99], "right") == ["NA", "(-00,3.0]", "(3.0,5.0]", "(5.0,+00])"]
    assert labels(spark, [-99, 0, 1, 3], [1, 3], [-99], "left") == [
        "b-1NA",
        "b0[-inf, 1.0)",
        "b1[1.0,3.0)",
        "b3[3.0,inf)",
    ]


def test_bin_counts_cover_all_rows(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    cols = ["l_quantity", "l_extendedprice"]
    bins = B.bin_counts(df, cols, "y", B.equal_freq_cuts(df, cols, 10))
    total = {r.var_name: r.n for r in bins.groupBy("var_name").agg(F.sum("total").alias("n")).collect()}
    assert set(total.values()) == {df.count()}


def test_partitioning_does_not_matter(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = cuts_of(B.equal_freq_cuts(df, ["l_extendedprice"], 10))
    for n in (1, 17):
        assert cuts_of(B.equal_freq_cuts(df.repartition(n), ["l_extendedprice"], 10)) == want


def woe_rows(spark, rows):
    df = spark.createDataFrame(rows, "var_name string, bin string, total long, bad long")
    return {r.bin: r for r in W.woe_table(df).collect()}


def test_woe_and_iv(spark):
    r = woe_rows(spark, [("v", "A", 10, 2), ("v", "B", 10, 6)])
    assert (r["A"].woe, r["B"].woe) == (-0.9808, 0.8109)
    assert round(r["A"].iv, 6) == 0.746566 and r["A"].status == "ok"


def test_zero_cell(spark):
    r = woe_rows(spark, [("v", "A", 10, 0), ("v", "B", 10, 6)])
    assert r["A"].woe == float("-inf") and r["A"].iv == float("inf") and r["A"].status == "zero_cell"


def test_chi_adjacent(spark):
    df = spark.createDataFrame([("v", 0, 10, 2), ("v", 1, 10, 6)], "var_name string, bin_no int, total long, bad long")
    assert [round(r.chi2, 9) for r in W.chi_adjacent(df).collect()] == [2.0]


def test_encode_small_and_large_tables_agree(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 30).cast("string").alias("g"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    small = W.rate_encode(df, ["g"], "y").groupBy("g", "g_rate").count()
    monkeypatch.setattr(W, "MAP_ROWS", 5)
    large = W.rate_encode(df, ["g"], "y").groupBy("g", "g_rate").count()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


# -- chi-merge ---------------------------------------------------------------------


def groups(values, totals, bads, specials=()):
    return pd.DataFrame({"grp": values, "is_special": [v in specials for v in values], "total": totals, "bad": bads})


def merge(spark, table, max_interval, n_special, prebinned=False):
    rows = spark.createDataFrame(table).selectExpr("'v' as var_name", "grp", "is_special", "total", "bad")
    return B.merge_cuts(rows, max_interval, n_special, ["v"] if prebinned else []).first()["cuts"]


def test_chi_merge_hand_case(spark):
    assert merge(spark, groups([1.0, 2, 3, 4], [10] * 4, [1, 2, 6, 7]), 2, 0) == [3.0]


def test_chi_merge_few_values_keeps_special_as_cut(spark):
    assert merge(spark, groups([-99.0, 0, 5], [5] * 3, [1, 2, 3], [-99.0]), 5, 1) == [-99.0, 0.0]


def test_chi_merge_drops_pure_bins(spark):
    got = merge(spark, groups([1.0, 2, 3, 4, 5, 6], [10] * 6, [0, 0, 5, 5, 10, 10]), 4, 0)
    t = groups([1.0, 2, 3, 4, 5, 6], [10] * 6, [0, 0, 5, 5, 10, 10])
    number = np.searchsorted(got, t.grp, side="right")
    rates = (t.groupby(number)["bad"].sum() / t.groupby(number)["total"].sum()).tolist()
    assert got and 0 not in rates and 1 not in rates


def test_merging_runs_inside_the_jvm(spark):
    table = groups([float(i) for i in range(60)], [10] * 60, [(i * 7) % 10 for i in range(60)])
    rows = spark.createDataFrame(table).selectExpr("'v' as var_name", "grp", "is_special", "total", "bad")
    out = B.merge_cuts(rows, 5, 0, ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and len(out.first()["cuts"]) <= 4
    one_sided = spark.createDataFrame([("v", 1.0, False, 5, 5), ("v", 2.0, False, 5, 5)] + [("w", float(i), True, 5, 1) for i in range(7)], rows.schema)
    assert {r.var_name: r.cuts for r in B.merge_cuts(one_sided, 5, 7, ["v", "w"]).collect()} == {"v": [], "w": []}


def brute_chi_merge(values, y, max_interval, special):
    """Row-level restatement of the rules for a small column."""
    levels = sorted(set(values))
    if len(levels) <= max_interval:
        return levels[:-1]
    data = [(v, t) for v, t in zip(values, y) if v not in special]
    vs = sorted(v for v, _ in data)
    if len(set(vs)) > 100:
        edges = sorted({vs[int(i * (len(vs) / 100))] for i in range(1, 100)})
        data = [(next((e for e in edges if v <= e), 1e11), t) for v, t in data]
    names = sorted({v for v, _ in data})
    tot = {g: sum(1 for v, _ in data if v == g) for g in names}
    bad = {g: sum(t for v, t in data if v == g) for g in names}
    rate = sum(bad.values()) / sum(tot.values())

    def chi(ts, bs):
        return sum((t * rate - b) ** 2 / (t * rate) for t, b in zip(ts, bs))

    parts = [[g] for g in names]
    while len(parts) > max_interval - len(special):
        costs = [chi([tot[g] for g in parts[i] + parts[i + 1]], [bad[g] for g in parts[i] + parts[i + 1]]) for i in range(len(parts) - 1)]
        i = costs.index(min(costs))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    cuts = [max(p) for p in parts[:-1]]
    while cuts:
        table = {}
        for g in names:
            b = sum(c <= g for c in cuts)
            t0, b0 = table.get(b, (0, 0))
            table[b] = (t0 + tot[g], b0 + bad[g])
        seen = sorted(table)
        pure = [b for b in seen if table[b][1] in (0, table[b][0])]
        if not pure:
            return cuts
        at = seen.index(pure[0])
        if pure[0] == seen[-1]:
            cuts = cuts[:-1]
        elif pure[0] == seen[0]:
            cuts = cuts[1:]
        else:
            before = chi(*zip(*[table[b] for b in seen[at - 1 : at + 1]]))
            after = chi(*zip(*[table[b] for b in seen[at : at + 2]]))
            cuts.remove(cuts[at - 1] if before < after else cuts[at])
    return cuts


@pytest.mark.parametrize("seed", range(5))
def test_chi_merge_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 900
    x = {
        "wide": np.round(rng.normal(size=n) * 50, 2),
        "mid": rng.integers(0, 40, n).astype(float),
        "few": rng.integers(0, 4, n).astype(float),
    }
    x["gap"] = np.where(rng.random(n) < 0.2, -99.0, np.round(rng.normal(size=n) * 50, 2))
    x["spike"] = np.where(rng.random(n) < 0.8, 7.0, np.round(rng.normal(size=n) * 50, 2))
    x["spike"][rng.random(n) < 0.3] = -99.0
    x["peak"] = np.where(rng.random(n) < 0.84, 7.0, np.round(rng.random(n) * 50, 2))
    x["gapmid"] = np.where(rng.random(n) < 0.2, -99.0, rng.integers(0, 30, n).astype(float))
    y = (rng.random(n) < 0.1 + 0.5 / (1 + np.exp(-x["wide"] / 20)) * (x["mid"] > 3)).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x | {"y": y}))
    got = cuts_of(B.chi_merge(df, list(x), "y", 5, [-99.0]))
    for c, v in x.items():
        special = [-99.0] if -99.0 in v else []
        assert got[c] == brute_chi_merge(v.tolist(), y.tolist(), 5, special), c


def test_screen_routes(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    out = {r.var_name: r for r in B.equal_freq_screen(df, ["l_extendedprice", "l_linestatus", "l_tax"], "y", min_iv=0.0).collect()}
    assert (out["l_extendedprice"].route, out["l_linestatus"].route, out["l_tax"].route) == ("binned", "direct", "direct")


def test_text_cuts_with_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "TEXT_LEVELS", 20)
    monkeypatch.setattr(O, "TEXT_BUCKETS", 6)
    words = [f"{i * 7919 % 997:03d}" for i in range(3000)]
    df = spark.createDataFrame([(w, 1) for w in words], "x string, y int")
    assert len(O.text_spread_of(df, ["x"])["x"].edges) == 5
    v = sorted(words)
    assert cuts_of(B.equal_freq_cuts(df, ["x"], 10))["x"] == sorted({v[int(i * (3000 / 10))] for i in range(1, 10)})


def test_encode_matches_every_number_type(spark):
    df = spark.sql(
        "select cast(v as float) f, cast(v as double) d, cast(v as int) i, v > 0 b, y"
        " from values (0.1, 1), (0.1, 0), (-0.0, 1), (0.0, 0), (2.5, 1) t(v, y)"
    ).withColumn("d", F.when(F.col("d") == 0, F.lit(-0.0)).otherwise(F.col("d")))
    out = W.rate_encode(df, ["f", "d", "i", "b"], "y").select("f_rate", "d_rate", "i_rate", "b_rate").collect()
    assert [tuple(r)[:2] for r in out] == [(0.5, 0.5), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5), (1.0, 1.0)]
    assert all(v is not None for r in out for v in r)


def test_few_groups_of_many_values_are_still_merged(spark):
    """Few groups left by pre-binning are not few values: the special is no
    cut, and pure bins still go (cuts 1, 2, then 2, then none)."""
    t = groups([-99.0, 1, 2, 3], [10] * 4, [5, 2, 4, 6], [-99.0])
    assert merge(spark, t, 5, 1) == [-99.0, 1.0, 2.0]
    assert merge(spark, t, 5, 1, prebinned=True) == [1.0, 2.0]
    pure = groups([-99.0, 1, 2, 3], [10] * 4, [5, 0, 4, 6], [-99.0])
    assert merge(spark, pure, 5, 1, prebinned=True) == []


def test_bins_of_a_variable_spread_over_tasks(spark):
    """A column of very many values: no window over a variable, totals with map-side combine, the source read once."""
    df = spark.range(200_000).select(F.col("id").alias("wide"), (F.col("id") % 3).alias("few"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    table = W.woe_table(W.category_counts(df, ["wide", "few"], "y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = table.where("var_name = 'wide'").groupBy(F.spark_partition_id()).count().collect()
        table.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 2 * 200_000 / 8
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_the_bin_table_is_made_once(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    table = W.woe_iv(df, ["l_quantity", "l_tax"], "y")
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_iv_equals_its_definition(spark):
    rows = [("v", str(i), t, b) for i, (t, b) in enumerate([(100, 20), (50, 25), (30, 1), (400, 33)])] + [("w", "a", 10, 0), ("w", "b", 10, 5), ("one", "x", 9, 3), ("good", "x", 5, 0), ("good", "y", 6, 0)]
    out = {(r.var_name, r.bin): r for r in W.woe_table(spark.createDataFrame(rows, "var_name string, bin string, total long, bad long")).collect()}
    v = [r for r in rows if r[0] == "v"]
    n, b = sum(r[2] for r in v), sum(r[3] for r in v)
    want = sum((r[3] / b - (r[2] - r[3]) / (n - b)) * np.log((r[3] / b) / ((r[2] - r[3]) / (n - b))) for r in v)
    assert out["v", "0"].iv == pytest.approx(want, rel=1e-12) and out["v", "0"].status == "ok"
    assert out["w", "a"].iv == float("inf") and out["w", "a"].status == "zero_cell"
    assert out["one", "x"].status == "single_group" and out["good", "x"].iv is None and out["good", "x"].status == "zero_cell"
