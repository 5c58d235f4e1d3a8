import random
import re

import pytest
from pyspark.sql import functions as F

from scorewright.functions.columns import search_in
from scorewright.operators import assemble as A


def test_latest_record_prefers_null_time(spark):
    df = spark.sql("select 'a' k, timestamp'2018-01-01' t, 1 id union all select 'a', null, 2 union all select 'b', timestamp'2018-01-01', 3 union all select 'b', timestamp'2018-01-01', 4 union all select null, null, 5")
    out = A.latest_record(df, ["k"], "t", "id")
    assert sorted((r.k, r.id) for r in out.collect()) == [("a", 2), ("b", 4)]


def test_first_record(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(map(tuple, A.first_record(df, ["k"], "o").collect()), key=str) == [("a", 1, None), ("b", 3, "z")]


def test_latest_record_combines_before_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.col("id"))
    plan = A.latest_record(df, ["k"], "t", "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def skewed(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("v"),
    )
    right = spark.range(5, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    return left, right


def test_skewed_join_equals_plain_join(spark):
    left, right = skewed(spark)
    right = right.unionByName(right.where("k < 10"))  # several rows per key
    for how in ("inner", "left"):
        plain = sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str)
        salted = A.join_skewed(left, right, ["k"], how, min_rows=500, piece_rows=100)
        assert sorted(map(tuple, salted.select("k", "v", "w").collect()), key=str) == plain
        assert "_salt" not in salted.columns


def test_hot_key_is_found_and_cut_by_its_rows(spark):
    left, right = skewed(spark)
    hot = A.hot_keys(left, ["k"], min_rows=500, piece_rows=100)
    assert len(hot) == 1 and 10 <= list(hot.values())[0] <= 11
    plan = A.join_skewed(left, right, ["k"], "inner", min_rows=500)._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan


@pytest.mark.parametrize(
    "types",
    [("int", "bigint"), ("bigint", "int"), ("smallint", "decimal(20,0)"), ("decimal(10,2)", "double"), ("double", "float"), ("date", "timestamp"), ("string", "string"), ("int", "string")],
)
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_of_different_types_lose_nothing(spark, types, how):
    def cast(c, t):
        return F.date_add(F.lit("2020-01-01").cast("date"), c.cast("int")).cast(t) if t in ("date", "timestamp") else c.cast(t)

    left = spark.range(400).select(cast(F.when(F.col("id") % 11 != 0, F.col("id") % 4), types[0]).alias("k"), F.col("id").alias("v"))
    right = spark.range(3).select(cast(F.col("id"), types[1]).alias("k"), F.col("id").alias("w"))
    plain = left.join(right, "k", how).drop("k").collect()
    salted = A.join_skewed(left, right, ["k"], how, min_rows=1, piece_rows=20).drop("k").collect()
    assert sorted(map(tuple, salted), key=str) == sorted(map(tuple, plain), key=str)


def largest_task(joined):
    """Rows of the largest join task, and all, before AQE looks at them."""
    rows = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return max(r["count"] for r in rows), sum(r["count"] for r in rows)


def test_equal_rows_of_a_hot_key_are_spread(spark):
    left = spark.range(20_000).select(F.lit(7).alias("k"), F.lit("same").alias("v")).repartition(4)
    right = spark.createDataFrame([(7, 1), (8, 2)], "k int, w int")
    for conf in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(conf, "false" if "adaptive" in conf else "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        most, total = largest_task(A.join_skewed(left, right, ["k"], min_rows=500, piece_rows=1000))
    finally:
        for conf in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(conf)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert total == 20_000 and most <= 2 * 1000


def test_a_retried_task_deals_alike(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("a"), F.lit("x").alias("b")).coalesce(1)
    dealt = [A._dealt(r, F.lit(5), "_salt").groupBy("a", "_salt").count() for r in (rows, rows.sort(F.desc("a")), rows.sort("a").coalesce(1))]
    assert dealt[0].exceptAll(dealt[1]).isEmpty() and dealt[0].exceptAll(dealt[2]).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("sides", ["left", "right", "both"])
def test_keys_hot_on_either_side(spark, how, sides):
    def table(n, hot):
        hot_key = F.when(F.col("id") % 2 == 0, F.lit(7)) if hot else F.when(F.lit(False), F.lit(0))
        return spark.range(n).select(F.coalesce(hot_key, F.when(F.col("id") % 11 == 1, F.lit(None)).otherwise((F.col("id") % 30).cast("int"))).alias("k"), (F.col("id") % 3).alias("v"))

    left = table(400, sides != "right").union(spark.createDataFrame([(99, 0)] * 60, "k int, v long"))
    right = table(300, sides != "left").where("k <> 5").withColumnRenamed("v", "w")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    cut = A.join_skewed(left, right, ["k"], how, min_rows=20, piece_rows=15)
    assert sorted(map(tuple, cut.select(*left.join(right, "k", how).columns).collect()), key=str) == plain


def test_zeros_of_both_signs_join(spark):
    left = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("k"))
    right = spark.createDataFrame([(0.0, 1)], "k double, w int")
    assert A.join_skewed(left, right, ["k"], min_rows=1, piece_rows=10).count() == 100


def test_chain_refuses_repeated_keys(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    two = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(ValueError, match="table 1"):
        A.join_chain([one, two], "k")


def test_chain_checks_while_it_runs(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    two = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(Exception, match="table 1 of the chain repeats"):
        A.join_chain([one, two], "k", at_once=False).collect()
    assert A.join_chain([one, two.limit(1)], "k", at_once=False).count() <= 1


def test_inner_join_suffixes(spark):
    left = spark.createDataFrame([(1, "l")], "a int, name string")
    right = spark.createDataFrame([(1, "r")], "b int, name string")
    out = A.inner_join(left, right, ["a"], ["b"])
    assert out.columns == ["a", "name_x", "b", "name_y"]
    assert tuple(out.first()) == (1, "l", 1, "r")


def test_enrich_does_not_fan_out(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 3), (None, 9)], "k int, v int")
    out = A.enrich(left, right, ["k"], "v")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 3), (2, None), (None, None)]


def test_keep_listed_ignores_duplicates(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    keys = spark.createDataFrame([(1,), (1,)], "k int")
    assert A.keep_listed(df, keys, "k").count() == 1


def test_band_join(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (100.0,), (None,)], "s double")
    bands = spark.createDataFrame([(0, None, 5.0), (1, 5.0, 100.0)], "n int, lo double, hi double")
    assert sorted((r.s, r.n) for r in A.band_join(df, "s", bands).collect()) == [(0.0, 0), (5.0, 1)]


def test_search_equals_counting(spark):
    rows = [(x, sorted(e)) for e in ([], [1.0], [1.0, 2.0, 2.5], [float(i) for i in range(17)]) for x in (None, -1.0, 1.0, 2.2, 2.5, 16.0, 99.0)]
    df = spark.createDataFrame(rows, "x double, e array<double>").select("x", "e", search_in(F.col("x"), F.col("e")).alias("n"))
    assert all(r.n == (None if r.x is None else sum(v <= r.x for v in r.e)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_band_join_of_overlapping_and_open_bands(spark, monkeypatch, seed):
    monkeypatch.setattr("scorewright.operators.ordered.BUCKETS", 4)
    rng = random.Random(seed)
    scores = [rng.choice([None, float("nan"), float("inf"), -float("inf"), 5.0, float(rng.randint(0, 20)), rng.random() * 20]) for _ in range(120)]
    bands = [tuple(rng.choice([None, float(rng.randint(-2, 22)), rng.random() * 20]) for _ in range(2)) for _ in range(40)] + [(5.0, 5.0), (float("nan"), 3.0), (None, None), (7.0, 2.0)]
    df = spark.createDataFrame(list(enumerate(scores)), "i int, s double")
    table = spark.createDataFrame([(n, *b) for n, b in enumerate(bands)], "n int, lo double, hi double")
    got = sorted((r.i, r.n) for r in A.band_join(df, "s", table, min_rows=10, piece_rows=10).collect())
    inside = lambda s, lo, hi: s is not None and s == s and (lo is None or lo <= s) and (hi is None or s < hi)
    real = [(n, lo, hi) for n, (lo, hi) in enumerate(bands) if lo is None or hi is None or lo < hi]
    assert got == sorted((i, n) for i, s in enumerate(scores) for n, lo, hi in real if inside(s, lo, hi))
    assert A.band_join(df, "s", table.limit(0)).count() == 0 and A.band_join(df.limit(0), "s", table).count() == 0


def test_many_bands_stay_off_the_driver(spark, monkeypatch):
    """100,000 bands, most of them disjoint: every score finds its own, and the plan holds no band."""
    edges = spark.range(100_000).select(F.col("id").alias("n"), (F.col("id") * 10.0).alias("lo"), ((F.col("id") + 1) * 10.0).alias("hi"))
    wide = spark.createDataFrame([(-1, None, 500_000.0), (-2, 999_000.0, None), (-3, None, None)], "n long, lo double, hi double")
    scores = spark.range(0, 1_000_000, 37).select(F.col("id").alias("s"))
    kind, seen = type(scores), []
    own = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(own(self)) or seen[-1])
    joined = A.band_join(scores, "s", edges.unionByName(wide))
    monkeypatch.undo()
    assert all(len(rows) <= 2 for rows in seen)  # sketches only
    out = joined.groupBy((F.col("n") >= 0).alias("narrow")).agg(F.count("*").alias("c"), F.count_if(F.expr("n >= 0 and n <> s div 10")).alias("wrong")).collect()
    n = scores.count()
    assert {r.narrow: (r.c, r.wrong) for r in out} == {True: (n, 0), False: (n + scores.where("s < 500000").count() + scores.where("s >= 999000").count(), 0)}


def test_chain_shares_one_partitioning(spark):
    base = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    tables = [base.groupBy("k").agg(F.sum("v").alias(f"v{i}")) for i in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = A.join_chain(tables, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", initial)) == 3  # one per rollup, none for the joins


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_ROWS", 100)
    left = spark.range(900).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v"))
    right = spark.range(60).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("w"))
    joined = A.join_skewed(left, right, ["k"], min_rows=20, piece_rows=15)
    assert "SortMergeJoin" in plan_of(joined) and "BroadcastHashJoin" not in plan_of(joined) and joined.count() == 900 * 60


def test_a_grid_is_bounded_and_keeps_all_pairs(spark, monkeypatch):
    assert A._grid(10_000, 200) == (455, 9) and A._grid(9, 3) == (9, 3) and A._grid(5000, 1) == (5000, 1) and A._grid(2, 100_000) == (1, 4096)
    monkeypatch.setattr(A, "GRID_TASKS", 8)
    left = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    right = spark.range(90).select((F.col("id") % 3).alias("k"), F.col("id").alias("w"))
    joined = A.join_skewed(left, right, ["k"], min_rows=10, piece_rows=2)
    plain = left.join(right, "k")
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_left_join_of_exploded_sides_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_ROWS", 100)
    left = spark.range(900).select(F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = spark.range(60).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("w"))
    joined, plain = A.join_skewed(left, right, ["k"], "left", min_rows=20, piece_rows=15), left.join(right, "k", "left")
    inner = plan_of(joined).split("LeftAnti")[0]
    assert "SortMergeJoin" in inner and "Inner, Build" not in inner
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_listed_bands_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_ROWS", 100)
    bands = spark.range(300).select(F.col("id").alias("n"), F.when(F.col("id") % 9 != 0, F.col("id") * 1.0).alias("lo"), (F.col("id") + 3.0).alias("hi"))
    joined = A.band_join(spark.range(200).select((F.col("id") * 1.0).alias("s")), "s", bands)
    top = [line for line in plan_of(joined).splitlines() if "Join" in line][0]
    assert "SortMergeJoin" in top and "_band_segment" in top
    want = sum((n % 9 == 0 or n <= s) and s < n + 3 for n in range(300) for s in range(200))
    assert joined.count() == want


def test_left_join_broadcasts_no_list_of_keys(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_ROWS", 100)
    left = spark.range(900).select(F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = spark.range(700).select(F.when(F.col("id") % 9 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("w"))
    for how in ("left", "left_semi", "left_anti"):
        joined, plain = A.join_skewed(left, right, ["k"], how, min_rows=20, piece_rows=15), left.join(right, "k", how)
        assert "BroadcastExchange" not in plan_of(joined)
        assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
    assert "BroadcastExchange" not in plan_of(A.enrich(left, right, ["k"], "w"))


@pytest.mark.parametrize("many", (True, False))
def test_edges_of_many_bands_are_not_broadcast(spark, monkeypatch, many):
    monkeypatch.setattr(A, "BROADCAST_ROWS", 100)
    n = 300 if many else 30
    bands = spark.range(n).select(F.col("id").alias("n"), F.when(F.col("id") % 9 != 0, F.col("id") * 1.0).alias("lo"), (F.col("id") + 3.0).alias("hi"))
    joined = A.band_join(spark.range(200).select((F.col("id") * 1.0).alias("s")), "s", bands)
    assert many == ("BroadcastExchange" not in plan_of(joined))
    assert joined.count() == sum((b % 9 == 0 or b <= s) and s < b + 3 for b in range(n) for s in range(200))
