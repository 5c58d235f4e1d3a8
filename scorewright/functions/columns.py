"""Row-wise expressions.  All are built-in functions, so they stay inside
whole-stage code generation and also run on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def period_key(ts: Column, period: str = "month") -> Column:
    """``yyyy-MM`` or ``yyyy-MM-dd`` text of a timestamp or of its ISO text."""
    width = {"month": 7, "day": 10}[period]
    return F.substring(ts.cast("string"), 1, width)


def recode_other(col: Column, allow: Iterable, other) -> Column:
    """Keep listed values; everything else, null included, becomes ``other``."""
    return F.when(col.isin(list(allow)), col).otherwise(F.lit(other))


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b`` with 0/0 = 0 and every other division by zero null."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(
        F.try_divide(a.cast("double"), b.cast("double"))
    )


def rule_flag(cases: Sequence[tuple[Column, object]], default) -> Column:
    """Assignments applied in order onto a default: the last true case wins."""
    flag = F.lit(default)
    for condition, value in cases:
        flag = F.when(condition, F.lit(value)).otherwise(flag)
    return flag


def member_flag(col: Column, allow: Iterable) -> Column:
    """1.0 for listed values, 0.0 for all others and for null."""
    return F.coalesce(col.isin(list(allow)), F.lit(False)).cast("int").cast("double")


def code_text(col: Column) -> Column:
    """A numeric code as integer text: 3.0 gives '3'."""
    return col.cast("bigint").cast("string")


def merge_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace mapped texts; unmapped values pass through."""
    if not mapping:
        return col
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def finite(col: Column) -> Column:
    """NaN counts as missing: comparisons of Spark put it above every number."""
    return F.nullif(col.cast("double"), F.lit(float("nan")))


def key_slot(key: Column, of: int, salt: str) -> Column:
    """A slot 0..of-1 that follows from the key's text: alike for any key type
    and partitioning, without regard to patterns in the keys, and different
    for every salt.  A missing key counts as empty text."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(of)).cast("int")


def text_rank(col: Column) -> Column:
    """A number below 2**52 that follows from the text."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 13), 16, 10).cast("bigint")


def manual_rebin(
    col: Column,
    ranges: Sequence[tuple[str, float | None, float | None]],
    special: float,
    special_label: str,
) -> Column:
    """Label ``[lo, hi)`` ranges by hand; the special value has its own label
    and is tested first.  ``None`` leaves a side open."""
    label = F.when(col == special, F.lit(special_label))
    col = finite(col)
    for name, lo, hi in ranges:
        tests = [col >= lo] if lo is not None else []
        tests += [col < hi] if hi is not None else []
        label = label.when(reduce(Column.__and__, tests, F.lit(True)), F.lit(name))
    return label


def drop_impossible_dates(col: Column, limit: str = "2030-01-01") -> Column:
    """Null every date at or after the limit, and every unreadable one."""
    return F.when(col.try_cast("timestamp_ntz") < F.lit(limit).cast("timestamp_ntz"), col)


def days_between(apply_ts: Column, col: Column, reverse: bool = False) -> Column:
    """Whole elapsed days, floored: twenty minutes before is day -1.
    Unreadable text counts as missing."""
    a, b = (col, apply_ts) if reverse else (apply_ts, col)
    gap = a.try_cast("timestamp_ntz") - b.try_cast("timestamp_ntz")
    seconds = gap.cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds / 86400).cast("bigint")


def numeric_text(col: Column) -> Column:
    """True where the text is a plain decimal or exponent number."""
    return F.trim(col).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def parse_number(col: Column) -> Column:
    """Number of a numeric text, null otherwise (never an error)."""
    return F.when(numeric_text(col), F.trim(col).try_cast("double"))


def logistic(coef: Mapping[str, float], intercept: float = 0.0) -> Column:
    """Probability of class 1 from known coefficients."""
    z = reduce(
        lambda acc, kv: acc + F.col(kv[0]) * F.lit(float(kv[1])),
        coef.items(),
        F.lit(float(intercept)),
    )
    return 1.0 / (1.0 + F.exp(-z))


def double_array(values: Iterable[float]) -> Column:
    """A constant array<double>; folded by the optimizer into one literal."""
    text = ",".join(repr(float(v)) for v in values)
    if not text:
        return F.array().cast("array<double>")
    return F.split(F.lit(text), ",").cast("array<double>")


def rank_in(x: Column, edges: Column, closed: str = "left") -> Column:
    """How many array elements lie below ``x`` (``left``: at or below).

    One comparison per element; for long arrays of numbers see
    ``operators.ordered.add_ranks``."""
    below = (lambda e: e <= x) if closed == "left" else (lambda e: e < x)
    return F.when(x.isNotNull(), F.size(F.filter(edges, below)))


def search_in(x: Column, edges: Column) -> Column:
    """How many elements of a sorted array lie at or below ``x``, by halving:
    a step for each doubling of the array, which may differ from row to row."""
    n = F.size(edges)
    steps = F.ceil(F.log2(n + 1.0)).cast("int")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(edges, mid) <= x)
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    found = F.reduce(F.sequence(F.lit(1), steps), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]
    return F.when(x.isNotNull(), F.when(n == 0, 0).otherwise(found))
