"""Null handling, casting, filtering, projection and scorecard lookup."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.columns import finite, merge_values, parse_number

# Cells the usual text readers take as missing.
READER_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# The missing sentinel of numbers and of text.
SPECIAL = -99.0
SPECIAL_TEXT = "-99"

_NUMBERS = (T.NumericType,)


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, _NUMBERS)


def normalise_nulls(
    df: DataFrame, tokens: Iterable[str] = ("\\N", *READER_NULLS), cols: Iterable[str] | None = None
) -> DataFrame:
    """Text cells equal to a null token, and NaN numbers, become null."""
    wanted = set(cols) if cols is not None else set(df.columns)
    tokens = list(tokens)

    def fixed(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name not in wanted:
            return c
        if _is_text(f):
            return F.when(~c.isin(tokens), c).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(f.name)
        return c

    return df.select(*[fixed(f) for f in df.schema])


def require_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key columns are all present.

    Plain not-null tests, so the filter reaches the scan."""
    return df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True)))


def infer_numeric(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """(job) A text column becomes double only if every value parses.

    One aggregate over all candidate columns decides; its single row is all
    that reaches the driver."""
    skip = set(exclude)
    texts = [f.name for f in df.schema if _is_text(f) and f.name not in skip]
    if not texts:
        return df
    checks = [
        F.coalesce(F.bool_and(parse_number(F.col(c)).isNotNull() | F.col(c).isNull()), F.lit(True)).alias(c)
        for c in texts
    ]
    numeric = df.agg(*checks).first().asDict()
    return df.select(
        *[parse_number(F.col(c)).alias(c) if numeric.get(c) else F.col(c) for c in df.columns]
    )


def sentinel_to_null(
    df: DataFrame, defaults: Mapping[str, str | None], exclude: Iterable[str] = ()
) -> DataFrame:
    """Numeric cells equal to the dictionary default become null.

    The default is text, as the dictionary holds it; the two characters
    ``\"\"`` stand for the numeric sentinel -99.  Text columns, excluded keys
    and defaults that are absent or no number leave a column as it is."""
    skip = set(exclude)

    def fixed(f: T.StructField) -> Column:
        c = F.col(f.name)
        default = defaults.get(f.name)
        if f.name in skip or default is None or not _is_number(f):
            return c
        try:
            value = SPECIAL if default == '""' else float(default)
        except ValueError:
            return c
        return F.when(c != F.lit(value), c).alias(f.name)

    return df.select(*[fixed(f) for f in df.schema])


def null_to_sentinel(
    df: DataFrame, num: float = SPECIAL, text: str = SPECIAL_TEXT, exclude: Iterable[str] = ()
) -> DataFrame:
    """Fill numbers with the numeric and text with the text sentinel; booleans
    count as numbers.  Excluded columns, such as keys, stay as they are."""
    skip = set(exclude)

    def fixed(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in skip:
            return c
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("double")
        if _is_number(f) or isinstance(f.dataType, T.BooleanType):
            return F.coalesce(c.cast("double"), F.lit(float(num))).alias(f.name)
        if _is_text(f):
            return F.coalesce(c, F.lit(text)).alias(f.name)
        return c

    return df.select(*[fixed(f) for f in df.schema])


def time_range(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Inclusive time range; the filter reaches the Parquet scan."""
    kind = df.schema[col].dataType
    return df.where(F.col(col).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def keep_labels(df: DataFrame, col: str, labels: Sequence = (0, 1)) -> DataFrame:
    """Rows whose target is one of the labels."""
    return df.where(F.col(col).isin(list(labels)))


def fill_label(df: DataFrame, col: str) -> DataFrame:
    """A missing target counts as good."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(0)))


def lower_names(df: DataFrame) -> DataFrame:
    """All column names in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def project_by_dictionary(
    df: DataFrame, dictionary: DataFrame, keep: Iterable[str] = (), name_col: str = "var_name"
) -> DataFrame:
    """(job) Keep ``keep`` and the columns that the dictionary lists.

    The dictionary is filtered to existing column names before it is read, so
    at most one name per column reaches the driver."""
    known = dictionary.where(F.col(name_col).isin(df.columns)).select(name_col).distinct()
    listed = {r[0] for r in known.collect()} | set(keep)
    return df.select(*[c for c in df.columns if c in listed])


def merge_categories(df: DataFrame, maps: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Merge categories by hand-edited maps, one map per column."""
    return df.withColumns(
        {c: merge_values(F.col(c).cast("string"), m) for c, m in maps.items() if c in df.columns}
    )


def scorecard_column(x: Column, rows: Sequence[Mapping]) -> Column:
    """Raw value to points: special value first, then equality codes, then
    ``[lo, hi)`` ranges.  Unmatched values give null."""
    out = None

    def case(acc, test, points):
        points = F.lit(float(points))
        return F.when(test, points) if acc is None else acc.when(test, points)

    for r in rows:
        if r.get("special") is not None:
            out = case(out, x == F.lit(r["special"]), r["woe"])
    for r in rows:
        if r.get("code") is not None:
            out = case(out, x == F.lit(r["code"]), r["woe"])
    for r in rows:
        if r.get("special") is None and r.get("code") is None:
            lo, hi = r.get("lo"), r.get("hi")
            test = F.lit(True)
            if lo is not None:
                test = x >= F.lit(lo)
            if hi is not None:
                test = (test & (x < F.lit(hi))) if lo is not None else x < F.lit(hi)
            out = case(out, x.isNotNull() & test, r["woe"])
    return out if out is not None else F.lit(None).cast("double")


def scorecard_apply(
    df: DataFrame, scorecard: Iterable[Mapping], suffix: str = "_points", cols: Iterable[str] | None = None
) -> DataFrame:
    """Add the points of every scorecard variable found in the table.

    ``scorecard`` rows carry ``var_name, special, lo, hi, code, woe``; there
    are a handful per variable, and they compile to one CASE expression each,
    so scoring needs no join and no shuffle."""
    by_var: dict[str, list] = {}
    for r in scorecard:
        row = r.asDict() if hasattr(r, "asDict") else dict(r)
        by_var.setdefault(row["var_name"], []).append(row)
    wanted = list(cols) if cols is not None else list(by_var)

    def value(v: str) -> Column:
        return finite(F.col(v)) if isinstance(df.schema[v].dataType, (T.FloatType, T.DoubleType)) else F.col(v)

    return df.withColumns(
        {v + suffix: scorecard_column(value(v), by_var[v]) for v in wanted if v in by_var and v in df.columns}
    )
