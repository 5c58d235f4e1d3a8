"""Delimited files with headers of their own, and report blocks that count once."""

import pytest
from pyspark.sql import functions as F

from scorewright.sources import tables as io


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    path = put(tmp_path / "t", one="k,a,b\n001,10,20\n", two="k,b,a\n002,20,10\n", three="b,extra,k,a\n20,zz,003,\n", empty="", bare="k,a,b\n")
    out = io.read_csv(spark, path, "k string, a int, b int")
    assert sorted(map(tuple, out.collect())) == [("001", 10, 20), ("002", 10, 20), ("003", None, 20)]


def test_equal_headers_share_a_scan(spark, tmp_path):
    path = put(tmp_path / "t", **{f"f{i}": f"k,a\n{i},1\n" if i % 2 else f"a,k\n1,{i}\n" for i in range(12)})
    out = io.read_csv(spark, path, "k int, a int")
    assert sorted(r.k for r in out.collect()) == list(range(12))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_a_file_without_a_column_is_named(spark, tmp_path):
    path = put(tmp_path / "t", good="k,a\n1,2\n", bad="k,c\n1,2\n")
    with pytest.raises(ValueError, match=r"bad\.csv has no column a"):
        io.read_csv(spark, path, "k string, a int")


def test_a_manifest_saves_opening_known_files(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "t", one="k,a\n1,2\n")
    first = io.header_manifest(spark, path, ",")
    put(tmp_path / "t", two="a,k\n4,3\n")
    opened = []
    monkeypatch.setattr(io, "inheritable_thread_target", lambda _: lambda f: lambda file: opened.append(file) or f(file))
    both = io.header_manifest(spark, path, ",", known=first)
    assert len(opened) == 1 and opened[0].endswith("two.csv") and both.count() == 2
    assert sorted(map(tuple, io.read_delimited(spark, path, "k int, a int", ",", manifest=both).collect())) == [(1, 2), (3, 4)]
    assert io.read_delimited(spark, path, "k int, a int", ",", manifest=both.limit(0)).count() == 0


def test_blocks_count_once(spark, tmp_path):
    path, rows = str(tmp_path / "r"), spark.range(3).withColumn("v", F.lit("x"))
    assert io.append_block(rows, path, "007") and not io.append_block(rows, path, "007") and io.append_block(rows, path, "a b:c")
    # an attempt that died before its commit, and a second writer's commit of the same block
    rows.withColumn("block_id", F.lit("lost")).write.mode("append").partitionBy("block_id").parquet(f"{path}/blocks")
    spark.createDataFrame([("007",)], "block_id string").write.mode("append").parquet(f"{path}/commits")
    seen = io.read_report(spark, path).groupBy("block_id").count().collect()
    assert {r.block_id: r["count"] for r in seen} == {"007": 3, "a b:c": 3}
    assert io.append_block(rows.limit(1), path, "lost")  # replaces what the lost attempt left
    assert io.read_report(spark, path).where("block_id = 'lost'").count() == 1
    with pytest.raises(ValueError, match="id"):
        io.append_block(rows, path, "")
