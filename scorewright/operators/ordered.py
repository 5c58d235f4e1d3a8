"""Order statistics and running sums without a global sort.

A window ordered over a whole table moves every row to one task.  Here values
are first assigned to a few hundred buckets of about equal row count, whose
edges come from an approximate quantile job and are then *constants* of the
plan: the bucket is a pure function of the value, so equal values stay
together and repeated or retried stages agree.  The edges decide only how work
is spread; every result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.columns import double_array, finite, rank_in

# Buckets per variable: at least, and at most; in between the number of
# shuffle partitions, so that every task of a large cluster gets a bucket.
BUCKETS = 512
MAX_BUCKETS = 8192
TEXT_BUCKETS = 128
# Text columns of up to this many distinct values need no buckets.
TEXT_LEVELS = 10_000
# Variables handled by one wide projection.
_WIDE = 25
# Groups in which the sketches of the tasks are merged first.
_MERGE_GROUPS = 64


@dataclass
class Spread:
    """Row counts and bucket edges of one variable."""

    n: int = 0
    n_special: int = 0
    edges: list = field(default_factory=list)
    levels: int = 0  # number of distinct values, for numbers approximate
    exact: bool = False


def is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def long_values(df: DataFrame, cols: Sequence[str], *keep: str, kind: str = "double") -> DataFrame:
    """Rows ``(*keep, var_name, value)`` of the non-missing cells.

    By ``stack`` and not by ``unpivot``: two uses of the rows are then seen to
    be the same, so that a bin table joined with sums of itself is made once."""
    cells = [e for c in cols for e in (F.lit(c), F.col(c).cast(kind))]
    rows = df.select(*keep, F.stack(F.lit(len(cols)), *cells).alias("var_name", "value"))
    present = F.col("value").isNotNull()
    if kind == "double":
        present &= ~F.isnan("value")
    return rows.where(present)


def columns_by_kind(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Columns grouped by the type they are compared in.  A long table has one
    value type; grouping numbers as numbers avoids writing every cell as
    text."""
    kinds: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            kind = "double"
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            kind = "bigint"
        else:
            kind = "boolean" if isinstance(t, T.BooleanType) else "string"
        kinds.setdefault(kind, []).append(c)
    return kinds


def bin_text(df: DataFrame, col: str) -> Column:
    """The ``bin`` of ``count_levels`` that a row's value belongs to."""
    kind = next(iter(columns_by_kind(df, [col])))
    value = F.col(col).cast(kind)
    # negative zero is grouped with zero
    return (value + F.lit(0.0) if kind == "double" else value).cast("string")


def count_levels(
    df: DataFrame, cols: Sequence[str], y: str, sums: Sequence[Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Aggregates per ``(*keys, var_name, bin)`` for all columns, ``bin`` being
    the value as text.  Cells are counted under their own type and combined
    before the shuffle; only the resulting bins are written as text."""
    parts = []
    for kind, names in columns_by_kind(df, cols).items():
        rows = long_values(df, names, *keys, y, kind=kind)
        levels = rows.groupBy(*keys, "var_name", "value").agg(*sums)
        parts.append(levels.withColumn("value", F.col("value").cast("string")).withColumnRenamed("value", "bin"))
    return reduce(DataFrame.unionByName, parts)


def bucket_count(spark: SparkSession) -> int:
    return max(BUCKETS, min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_of(
    df: DataFrame, cols: Sequence[str], special: Sequence[float] = (), levels: bool = False
) -> dict[str, Spread]:
    """(job) Bucket edges of every numeric column, and on request its
    approximate number of distinct values.

    Every task sketches its columns side by side; the sketches, some tens of
    kilobytes each, are merged first in groups and then per variable.  No data
    row is shuffled, and one short array per column reaches the driver."""
    buckets = bucket_count(df.sparkSession)
    shares = double_array(i / buckets for i in range(1, buckets))
    out = {c: Spread() for c in cols}
    parts = []
    for start in range(0, len(cols), _WIDE):
        group = cols[start : start + _WIDE]
        wide = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in group])
        sums = []
        for c in group:
            listed = F.col(c).isin(*map(float, special)) if special else F.lit(False)
            plain = F.when(~listed, F.col(c))
            sums += [
                F.kll_sketch_agg_double(plain, F.lit(4 * buckets)).alias(f"{c}_sketch"),
                F.count(plain).alias(f"{c}_n"),
                F.count(F.when(listed, 1)).alias(f"{c}_special"),
                (F.approx_count_distinct(plain) if levels else F.lit(0).cast("long")).alias(f"{c}_levels"),
            ]
        # Distinct counts cannot be merged afterwards; they are asked for only
        # a few columns, whose sketches one task can merge.
        salt = F.lit(0) if levels else F.pmod(F.spark_partition_id(), F.lit(_MERGE_GROUPS))
        grouped = wide.groupBy(salt.alias("_salt")).agg(*sums)
        fields = ("sketch", "n", "special", "levels")
        cells = [e for c in group for e in (F.lit(c), *[F.col(f"{c}_{f}") for f in fields])]
        parts.append(grouped.select(F.stack(F.lit(len(group)), *cells).alias("var_name", *fields)))
    merged = (
        reduce(DataFrame.unionByName, parts)
        .where(F.col("n") + F.col("special") > 0)
        .groupBy("var_name")
        .agg(
            F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch"),
            F.sum("n").alias("n"),
            F.sum("special").alias("special"),
            F.max("levels").alias("levels"),
        )
    )
    edges = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", shares))
    for r in merged.select("var_name", "n", "special", "levels", edges.alias("edges")).collect():
        out[r["var_name"]] = Spread(r["n"], r["special"], sorted(set(r["edges"] or [])), r["levels"])
    return out


def text_spread_of(df: DataFrame, cols: Sequence[str]) -> dict[str, Spread]:
    """(job) The same for text columns, ordered by code point.

    One job counts rows and distinct values of all columns.  Text has no
    quantile aggregate; a column of many values takes its edges from the
    values with the smallest hashes, a spread of fixed size."""
    out = {c: Spread(exact=True) for c in cols}
    if not cols:
        return out
    levels = _text_levels(df, cols)
    for r in levels.groupBy("var_name").agg(F.sum("rows").alias("n"), F.count("*").alias("levels")).collect():
        out[r["var_name"]] = Spread(r["n"], 0, [], r["levels"], exact=True)
    for c in (c for c in cols if out[c].levels > TEXT_LEVELS):
        near = levels.where(F.col("var_name") == c).orderBy(F.xxhash64("value"), "value")
        values = sorted(r["value"] for r in near.select("value").limit(8 * TEXT_BUCKETS).collect())
        out[c].edges = values[:: 8][1:]
    return out


def _text_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = long_values(df, cols, kind="string")
    return rows.groupBy("var_name", "value").agg(F.count("*").alias("rows"))


def add_ranks(
    df: DataFrame, edges: Mapping[str, Sequence[float]], suffix: str, closed: str = "left"
) -> DataFrame:
    """Add, per numeric column, how many of its edges lie below the value.

    ``closed='left'`` counts edges <= x (bins ``[lo, hi)``), ``'right'``
    counts edges < x (bins ``(lo, hi]``).  The search is a binary one inside
    the JVM; missing values, NaN among them, stay null."""
    splits = {}
    for c, values in edges.items():
        inner = np.unique([v for v in values if np.isfinite(v)])
        if closed == "right":
            inner = np.nextafter(inner, np.inf)
        splits[c] = [-np.inf, *inner.tolist(), np.inf]
    searched = [c for c in splits if len(splits[c]) > 2]
    out = df.withColumns({f"_x{suffix}{c}": finite(F.col(c)) for c in searched})
    if searched:
        out = Bucketizer(
            splitsArray=[splits[c] for c in searched],
            inputCols=[f"_x{suffix}{c}" for c in searched],
            outputCols=[c + suffix for c in searched],
            handleInvalid="keep",
        ).transform(out)
    ranks = {
        c + suffix: F.col(c + suffix).cast("int") if c in searched else F.when(finite(F.col(c)).isNotNull(), F.lit(0))
        for c in splits
    }
    return out.withColumns(ranks).drop(*[f"_x{suffix}{c}" for c in searched])


def long_ranks(
    df: DataFrame, edges: Mapping[str, Sequence[float]], *keep: str, closed: str = "left"
) -> DataFrame:
    """Rows ``(*keep, var_name, value, rank)`` of all numeric columns.

    Columns go in groups small enough for compiled code; the groups read
    different columns of a columnar source, so the union scans nothing
    twice."""
    names = list(edges)
    parts = []
    for start in range(0, len(names), _WIDE):
        group = names[start : start + _WIDE]
        wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in group])
        wide = add_ranks(wide, {c: edges[c] for c in group}, "_rank", closed)
        cells = [e for c in group for e in (F.lit(c), F.col(c), F.col(c + "_rank"))]
        rows = wide.select(*keep, F.stack(F.lit(len(group)), *cells).alias("var_name", "value", "rank"))
        parts.append(rows.where(F.col("value").isNotNull() & ~F.isnan("value")))
    return reduce(DataFrame.unionByName, parts)


def add_bucket(df: DataFrame, col: str, edges: Sequence[float], name: str = "bucket") -> DataFrame:
    """Add the bucket of one numeric column without missing values."""
    ranked = add_ranks(df, {col: edges}, "_bucket")
    # Declared non-null, so that later joins on it add no filter of their own
    # and equal shuffles stay recognisable as such.
    return ranked.withColumn(name, F.coalesce(col + "_bucket", F.lit(0))).drop(col + "_bucket")


def _located(df: DataFrame, cols: Sequence[str], spread: Mapping[str, Spread], special: Sequence[float]) -> DataFrame:
    """``(var_name, bucket, value, rows)``; text is counted by value first."""
    if not is_text(df, cols[0]):
        rows = long_ranks(df, {c: spread[c].edges for c in cols})
        if special:
            rows = rows.where(~F.col("value").isin(*map(float, special)))
        return rows.select("var_name", F.col("rank").alias("bucket"), "value", F.lit(1).alias("rows"))
    levels = _text_levels(df, cols)
    bucket = F.lit(0)
    for c in (c for c in cols if spread[c].edges):
        edges = F.lit(list(spread[c].edges))
        bucket = F.when(F.col("var_name") == c, rank_in(F.col("value"), edges)).otherwise(bucket)
    return levels.select("var_name", bucket.alias("bucket"), "value", "rows")


def prefix_sum(
    h: DataFrame,
    by: Sequence[str],
    bucket: str,
    value: str,
    measures: Sequence[str],
    source: DataFrame | None = None,
) -> DataFrame:
    """Exact running totals over ``value`` inside every ``by`` group.

    ``h`` holds one row per (by, bucket, value).  Adds ``cum_m``, the total up
    to and including the row, and ``all_m``, the total of the group, for every
    measure.  Windows span one bucket; the offsets of the buckets come from a
    table of one row per (by, bucket), summed over ``h`` or over a cheaper
    ``source`` with the same totals."""
    inside = Window.partitionBy(*by, bucket).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # The (always true) test on the value keeps that column in the plan: both
    # sides of the join below then read one and the same shuffle.
    sizes = (h if source is None else source).groupBy(*by, bucket).agg(
        *[F.sum(m).alias(m) for m in measures], F.max(value).alias("_top")
    )
    sizes = sizes.where(F.col("_top").isNotNull())
    offsets = sizes.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
    )
    running = h.select("*", *[F.sum(m).over(inside).alias(f"cum_{m}") for m in measures])
    joined = running.join(offsets, [*by, bucket])
    return joined.select(
        *[F.col(c) for c in h.columns],
        *[(F.col(f"cum_{m}") + F.col(f"off_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )


def order_statistics(
    df: DataFrame,
    cols: Sequence[str],
    k: int,
    special: Sequence[float] = (),
    reduce_k: bool = False,
    spread: Mapping[str, Spread] | None = None,
) -> DataFrame:
    """(job) Distinct values at the 0-based positions ``floor(i * (n / k))``,
    i = 1..k-1, of every sorted column: ``(var_name, n, cuts)``.

    Three passes that shuffle almost nothing: bucket edges, rows per bucket,
    and then only the buckets that hold a wanted position are counted by
    value.  The driver sees edges, bucket counts and cuts."""
    if spread is None:
        spread = text_spread_of(df, cols) if is_text(df, cols[0]) else spread_of(df, cols, special)
    located = _located(df, cols, spread, special)
    sizes: dict[str, list] = {c: [(0, spread[c].n)] for c in cols}
    if any(spread[c].edges for c in cols):
        sizes = {c: [] for c in cols}
        for r in located.groupBy("var_name", "bucket").agg(F.sum("rows").alias("rows")).collect():
            sizes[r["var_name"]].append((r["bucket"], r["rows"]))

    targets = []
    for c in cols:
        n = spread[c].n
        groups = k - 1 if reduce_k and spread[c].n_special else k
        wanted = [int(i * (n / groups)) for i in range(1, groups)] if n else []
        start = 0
        for bucket, rows in sorted(sizes[c]):
            inside = [p - start for p in wanted if start <= p < start + rows]
            if inside:
                targets.append((c, bucket, inside))
            start += rows
    cuts: dict[str, list] = {c: [] for c in cols}
    if targets:
        found = _values_at(located, targets)
        for r in found.collect():
            cuts[r["var_name"]].append(r["value"])
    return cut_table(df.sparkSession, {c: sorted(cuts[c]) for c in cols}, {c: spread[c].n for c in cols})


def _values_at(located: DataFrame, targets: list[tuple[str, int, list[int]]]) -> DataFrame:
    """Values at given positions inside given buckets."""
    by_var: dict[str, list[int]] = {}
    for c, bucket, _ in targets:
        by_var.setdefault(c, []).append(bucket)
    chosen = reduce(
        Column.__or__, [(F.col("var_name") == c) & F.col("bucket").isin(b) for c, b in by_var.items()]
    )
    counts = located.where(chosen).groupBy("var_name", "bucket", "value").agg(F.sum("rows").alias("rows"))
    inside = Window.partitionBy("var_name", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("rows").over(inside)
    spans = counts.select("var_name", "bucket", "value", (end - F.col("rows")).alias("start"), end.alias("end"))
    table = located.sparkSession.createDataFrame(
        pa.table(
            {
                "var_name": pa.array([t[0] for t in targets], pa.string()),
                "bucket": pa.array([t[1] for t in targets], pa.int32()),
                "wanted": pa.array([t[2] for t in targets], pa.list_(pa.int64())),
            }
        )
    )
    # The target table has at most one row per variable and bucket.
    hits = spans.join(F.broadcast(table), ["var_name", "bucket"])
    return hits.where(
        F.exists("wanted", lambda p: (p >= F.col("start")) & (p < F.col("end")))
    ).select("var_name", "value")


def cut_table(spark: SparkSession, cuts: Mapping[str, list], n: Mapping[str, int]) -> DataFrame:
    """``(var_name, n, cuts)``: a short array per variable, held by the plan."""
    kind = pa.string() if any(isinstance(v, str) for c in cuts.values() for v in c) else pa.float64()
    return spark.createDataFrame(
        pa.table(
            {
                "var_name": pa.array(list(cuts), pa.string()),
                "n": pa.array([n[c] for c in cuts], pa.int64()),
                "cuts": pa.array(list(cuts.values()), pa.list_(kind)),
            }
        )
    )


def few_valued(df: DataFrame, cols: Sequence[str], limit: int, spread: Mapping[str, Spread]) -> dict[str, int]:
    """(job) Distinct counts of the columns with at most ``limit`` values,
    special values included.

    Edges are values of the column, so more than ``limit`` distinct edges
    already prove a column to be larger; only the others are counted."""
    out = {c: spread[c].levels for c in cols if spread[c].exact}
    open_cols = [c for c in cols if c not in out and len(spread[c].edges) <= limit]
    out |= dict.fromkeys(open_cols, 0)
    if open_cols:
        levels = long_values(df, open_cols).groupBy("var_name", "value").agg(F.count("*").alias("n"))
        for r in levels.groupBy("var_name").agg(F.count("*").alias("levels")).collect():
            out[r["var_name"]] = r["levels"]
    return {c: n for c, n in out.items() if n <= limit}
