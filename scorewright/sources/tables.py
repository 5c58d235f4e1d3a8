"""Delimited text, Parquet and report sinks."""

from __future__ import annotations

import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL_A = "\u0001"
_HEADERS_AT_ONCE = 16


def header_manifest(spark: SparkSession, path: str, sep: str = CONTROL_A, known: DataFrame | None = None) -> DataFrame:
    """(job) ``(file, columns)``: the header of every file below ``path``.

    Only first lines are read, by many small jobs side by side; no file is
    scanned.  Files of ``known``, the manifest of an earlier call, aren't
    opened again, so a folder that grows by daily extracts costs its new files
    only.  A file without any line has no columns."""
    listed = spark.read.text(path).inputFiles()
    old = {r["file"]: list(r["columns"]) for r in known.collect()} if known is not None else {}
    new = [f for f in listed if f not in old]

    def header(file: str) -> list[str]:
        return spark.read.option("header", True).option("sep", sep).csv(file).columns

    with ThreadPool(min(_HEADERS_AT_ONCE, len(new) or 1)) as pool:
        found = dict(zip(new, pool.map(inheritable_thread_target(spark)(header), new)))
    return spark.createDataFrame([(f, found[f] if f in found else old[f]) for f in listed], "file string, columns array<string>")


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = CONTROL_A,
    null_tokens: tuple[str, ...] = ("\\N",),
    manifest: DataFrame | None = None,
) -> DataFrame:
    """(job) Delimited text with headers.  Every file is read by its own
    header: columns are found by their name, whatever order each file has them
    in, and others are left out.  A file without one of the columns is an error
    that names it; a file without any line holds no rows.

    Files with equal headers are scanned together, so there are as many scans
    as different headers, united by name.  Keys and undecided columns are
    declared as strings in the schema, so leading zeros survive and nothing is
    guessed.  Whole cells equal to a null token become null, and so do cells
    that can't be read in their type."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in (manifest if manifest is not None else header_manifest(spark, path, sep)).collect():
        if r["columns"]:
            groups.setdefault(tuple(r["columns"]), []).append(r["file"])
    lost = [f"{file} has no column {c}" for head, files in groups.items() for c in wanted.names if c not in head for file in files]
    if lost:
        raise ValueError("; ".join(lost[:20]) + (f" and {len(lost) - 20} more" if len(lost) > 20 else ""))

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        c = F.when(~c.isin(*null_tokens), c) if null_tokens else c
        return (c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name)

    parts = []
    for head, files in groups.items():
        every = T.StructType([T.StructField(c, T.StringType()) for c in head])
        text = spark.read.schema(every).option("header", True).option("sep", sep).option("enforceSchema", False).csv(files)
        parts.append(text.select(*[cell(f) for f in wanted]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], wanted)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma-separated file with a header and an explicit schema."""
    return read_delimited(spark, path, schema, sep=",")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a table result."""
    df.write.mode("overwrite").parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = CONTROL_A, null: str = "\\N") -> None:
    """Overwrite delimited text with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option(
        "nullValue", null
    ).csv(path)


def append_report(df: DataFrame, path: str, by: str = "var_name") -> None:
    """Append report blocks; one directory per variable, written by all tasks."""
    df.write.mode("append").partitionBy(by).parquet(path)


_BLOCK = "block_id"
_LOG = "block_id string"


def committed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the blocks of a report that count, one row each."""
    return spark.read.schema(_LOG).parquet(f"{path}/commits").distinct()


def append_block(df: DataFrame, path: str, block_id: str) -> bool:
    """(job) Append a block of rows to the report below ``path``, once: a block
    whose id is committed already is not written again.  Says whether it was.

    Rows go to a folder of the block, replacing what a lost attempt left
    there; the id is then added to the log.  Readers count only committed
    blocks, each once, so an attempt that dies half way doesn't show, and two
    writers of one block leave one copy."""
    if not block_id:
        raise ValueError("a block needs an id")
    spark = df.sparkSession
    spark.createDataFrame([], _LOG).write.mode("append").parquet(f"{path}/commits")
    if not committed_blocks(spark, path).where(F.col(_BLOCK) == block_id).isEmpty():
        return False
    rows = df.withColumn(_BLOCK, F.lit(block_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BLOCK).parquet(f"{path}/blocks")
    spark.createDataFrame([(block_id,)], _LOG).write.mode("append").parquet(f"{path}/commits")
    return True


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed blocks, with ``block_id``."""
    found = spark.read.parquet(f"{path}/blocks").schema
    schema = T.StructType([T.StructField(_BLOCK, T.StringType()) if f.name == _BLOCK else f for f in found])  # an id like 007 is no number
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    return blocks.join(committed_blocks(spark, path), _BLOCK, "left_semi")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all
    executors share.  Where it is unset, a local session gets a folder of its
    own; for any other session that is an error, as executors on other
    machines could not read what is written there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once to reliable storage in the shared folder and go on
    from there, so loops do not rescan the source and lost executors cost
    nothing but a re-read."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
