import pytest
from pyspark.sql import functions as F

from scorewright.functions import columns as C
from scorewright.operators import clean as P
from scorewright.sources import tables as io


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in one(df, C.safe_ratio(F.col("a"), F.col("b")))] == [2.0, None, 0.0, None, None]


def test_days_between_floors(spark):
    df = spark.sql(
        "select timestamp_ntz'2018-03-02 00:10:00' a, timestamp_ntz'2018-03-01 23:50:00' b"
    )
    row = df.select(
        C.days_between(F.col("a"), F.col("b")), C.days_between(F.col("a"), F.col("b"), reverse=True)
    ).first()
    assert tuple(row) == (0, -1)


def test_days_between_reads_text(spark):
    df = spark.createDataFrame([("2018-03-05 00:00:00", "2018-03-01")], "a string, b string")
    assert df.select(C.days_between(F.col("a"), F.col("b"))).first()[0] == 4


def test_impossible_dates(spark):
    df = spark.createDataFrame([("2029-12-31",), ("2030-01-01",), (None,)], "d string")
    d = F.col("d").cast("timestamp_ntz")
    assert [r[0] is None for r in one(df, C.drop_impossible_dates(d))] == [False, True, True]


def test_rule_flag_last_case_wins(spark):
    df = spark.createDataFrame([(50.0, "m"), (50.0, "f"), (None, "m"), (None, "f"), (20.0, "m")], "age double, g string")
    flag = C.rule_flag([((F.col("age") >= 43) & (F.col("g") == "m"), 0), (F.col("g") == "f", 0)], 1)
    assert [r[0] for r in one(df, flag)] == [0, 0, 1, 0, 1]


def test_recode_keeps_listed_only(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "t int")
    assert [r[0] for r in one(df, C.recode_other(F.col("t"), [1, 3, 6, 12, 24, 36], 998))] == [1, 998, 998]


def test_merge_and_code_text(spark):
    df = spark.createDataFrame([(3.0,), (-99.0,), (1.0,)], "c double").withColumn("c", C.code_text(F.col("c")))
    out = P.merge_categories(df, {"c": {"-99": "-99&1", "1": "-99&1"}})
    assert [r[0] for r in one(out, "c")] == ["3", "-99&1", "-99&1"]


def test_infer_numeric_needs_every_value(spark):
    rows = [("01", "1.5", "7", None), ("02", "1e3", "x", None), ("03", None, "2", None)]
    out = P.infer_numeric(spark.createDataFrame(rows, "id string, a string, b string, e string"), exclude=["id"])
    assert dict(out.dtypes) == {"id": "string", "a": "double", "b": "string", "e": "double"}
    assert [r[0] for r in one(out, "a")] == [1.5, 1000.0, None]


@pytest.mark.parametrize("text,ok", [("1.0d", False), ("1f", False), (" 2 ", True), ("-.5", True), ("1e5", True), ("", False)])
def test_numeric_text(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parse_number(F.col("t"))).first()[0] == (float(text) if ok else None)


def test_sentinels(spark):
    df = spark.createDataFrame([(-99.0, "-99", -1.0), (1.0, "a", 2.0)], "a double, b string, c double")
    out = P.sentinel_to_null(df, {"a": '""', "b": '""', "c": "-1", "zz": "3"})
    assert one(out, "a", "b", "c") == [(None, "-99", None), (1.0, "a", 2.0)]
    back = P.null_to_sentinel(out.withColumn("b", F.lit(None).cast("string")), -998, "-99")
    assert one(back, "a", "b", "c") == [(-998.0, "-99", -998.0), (1.0, "-99", 2.0)]


def test_null_default_is_no_op(spark):
    df = spark.createDataFrame([(-99.0,)], "a double")
    assert P.sentinel_to_null(df, {"a": None}).first()[0] == -99.0
    assert P.sentinel_to_null(df, {"a": "word"}).first()[0] == -99.0


def test_normalise_nulls(spark):
    df = spark.createDataFrame([("\\N", float("nan")), ("NA", 1.0), ("x\\N", 2.0)], "a string, b double")
    assert one(P.normalise_nulls(df), "a", "b") == [(None, None), (None, 1.0), ("x\\N", 2.0)]


def test_scorecard_order_special_codes_ranges(spark):
    card = [
        {"var_name": "x", "special": -99.0, "woe": 9.0},
        {"var_name": "x", "lo": None, "hi": 1.0, "woe": 1.0},
        {"var_name": "x", "lo": 1.0, "hi": 2.0, "woe": 2.0},
        {"var_name": "x", "code": 5.0, "woe": 5.0},
    ]
    df = spark.createDataFrame([(-99.0,), (0.0,), (1.0,), (2.0,), (5.0,), (None,)], "x double")
    assert [r[0] for r in one(P.scorecard_apply(df, card), "x_points")] == [9.0, 1.0, 2.0, None, 5.0, None]


def test_delimited_keeps_leading_zeros(spark, tmp_path):
    df = spark.createDataFrame([("007", None), ("010", "a,b")], "k string, v string")
    path = str(tmp_path / "t")
    io.write_delimited(df, path)
    assert "\u0001" in open([str(p) for p in (tmp_path / "t").glob("part*")][0]).read()
    back = io.read_delimited(spark, path, "k string, v string", null_tokens=("\\N", "zz"))
    assert sorted(map(tuple, back.collect()), key=str) == [("007", None), ("010", "a,b")]


def test_row_operators_run_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0.5, -99.0), (2.0, 1.0)], "x double, z double").write.parquet(src)
    stream = spark.readStream.schema("x double, z double").parquet(src)
    card = [{"var_name": "x", "lo": None, "hi": 1.0, "woe": 1.0}, {"var_name": "x", "lo": 1.0, "hi": None, "woe": 2.0}]
    scored = P.scorecard_apply(P.sentinel_to_null(stream, {"z": '""'}), card).withColumn(
        "score", C.logistic({"x_points": 1.0}, 0.0)
    )
    q = scored.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select x_points, z from scored order by x").collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (2.0, 1.0)]
