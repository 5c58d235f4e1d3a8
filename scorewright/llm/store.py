"""Intermediate tables in the folder that the cluster shares, and stable keys of rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.sources.tables import shared_dir

#: Settings of a session that runs many queries after another; none of them decides a result
_FRUGAL = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. The folder's owner removes old runs."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside exchange batches of about 2 MB with Python, and drop their shuffle files when they end.

    By default a batch has 10,000 rows, whatever their length, which both sides hold whole; and shuffle files stay until
    the driver happens to collect its garbage.
    """
    before = {name: spark.conf.get(name) for name in _FRUGAL}
    for name, value in _FRUGAL.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def row_key(id_col: str, text_col: str) -> Column:
    """A key that every scan of the same row repeats, whatever the partitioning: hash of id and text.

    Rows that agree in id and text share it.
    """
    return F.xxhash64(F.col(id_col), F.col(text_col))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns))
