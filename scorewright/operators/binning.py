"""Equal-frequency and chi-merge binning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.columns import rank_in
from scorewright.operators.clean import SPECIAL
from scorewright.operators.ordered import (
    add_ranks,
    few_valued,
    is_text,
    long_ranks,
    long_values,
    order_statistics,
    spread_of,
    text_spread_of,
)
from scorewright.operators.woe import category_counts, iv_screen

# Fixed value: the group above the last pre-bin edge.
ABOVE_ALL = 10e10
PREBINS = 100


def equal_freq_cuts(
    df: DataFrame, cols: Sequence[str], k: int, special: Sequence[float] = (), reduce_k: bool = False, **kw
) -> DataFrame:
    """(job) Equal-frequency cut points ``(var_name, n, cuts)``.

    Special values are left out.  ``reduce_k`` uses ``k - 1`` groups for the
    variables that contain one."""
    return order_statistics(df, cols, k, special, reduce_k, **kw)


def cuts_of(cuts: DataFrame) -> dict[str, list]:
    """The cut table as a dictionary."""
    return {r["var_name"]: list(r["cuts"]) for r in cuts.select("var_name", "cuts").collect()}


def _with_special(rank: Column, x: Column, special: Sequence[float]) -> Column:
    """The i-th special value gets bin ``-i`` instead of its rank."""
    for i, s in reversed(list(enumerate(special, 1))):
        rank = F.when(x == F.lit(s), F.lit(-i)).otherwise(rank)
    return rank


def bin_counts(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    cuts: DataFrame,
    special: Sequence[float] = (),
    closed: str = "left",
) -> DataFrame:
    """``(var_name, bin_no, lo, hi, total, bad)`` of all columns in one scan.

    Rows are reduced to bins before the only shuffle."""
    table = cuts_of(cuts)
    labelled = df.where(F.col(y).isNotNull())
    if is_text(df, cols[0]):
        arrays = F.create_map(*[e for c in cols for e in (F.lit(c), F.lit(table[c]).cast("array<string>"))])
        rows = long_values(labelled, cols, y, kind="string")
        number = rank_in(F.col("value"), arrays[F.col("var_name")], closed)
    else:
        rows = long_ranks(labelled, {c: table[c] for c in cols}, y, closed=closed)
        number = _with_special(F.col("rank"), F.col("value"), special)
    counts = rows.groupBy("var_name", number.alias("bin_no")).agg(
        F.count(y).alias("total"), F.sum(y).alias("bad")
    )
    edges = counts.join(F.broadcast(cuts.select("var_name", "cuts")), "var_name")
    return edges.select(
        "var_name",
        "bin_no",
        F.when(F.col("bin_no") > 0, F.get("cuts", F.col("bin_no") - 1)).alias("lo"),
        F.when(F.col("bin_no") >= 0, F.get("cuts", F.col("bin_no"))).alias("hi"),
        "total",
        "bad",
    )


def assign_bins(
    df: DataFrame,
    cuts: DataFrame,
    special: Sequence[float] = (),
    closed: str = "left",
    suffix: str = "_Bin",
) -> DataFrame:
    """Add the bin number of every column of the cut table.

    The cuts become constants of the plan, so rows are binned without a join
    or a shuffle.  Variables without cuts get no bin column."""
    table = {c: v for c, v in cuts_of(cuts).items() if v}
    texts = [c for c in table if is_text(df, c)]
    numbers = {c: v for c, v in table.items() if c not in texts}
    out = add_ranks(df, numbers, suffix, closed)
    return out.withColumns(
        {c + suffix: _with_special(F.col(c + suffix), F.col(c), special) for c in numbers}
        | {c + suffix: rank_in(F.col(c), F.lit(table[c]), closed) for c in texts}
    )


def bin_label(number: Column, cuts: Column, specials: int = 0, closed: str = "left") -> Column:
    """Display text of a bin.

    Left-closed labels carry a number; the last one counts the special values
    too, so it skips one number for each of them."""
    n = F.size(cuts)
    lo = F.get(cuts, number - 1).cast("string")
    hi = F.get(cuts, number).cast("string")
    if closed == "right":
        return (
            F.when(number < 0, F.lit("NA"))
            .when(number == 0, F.concat(F.lit("(-00,"), hi, F.lit("]")))
            .when(number == n, F.concat(F.lit("("), lo, F.lit(",+00])")))
            .otherwise(F.concat(F.lit("("), lo, F.lit(","), hi, F.lit("]")))
        )
    text = number.cast("string")
    return (
        F.when(number < 0, F.concat(F.lit("b"), text, F.lit("NA")))
        .when(number == 0, F.concat(F.lit("b0[-inf, "), hi, F.lit(")")))
        .when(number == n, F.concat(F.lit("b"), (n + specials).cast("string"), F.lit("["), lo, F.lit(",inf)")))
        .otherwise(F.concat(F.lit("b"), text, F.lit("["), lo, F.lit(","), hi, F.lit(")")))
    )


def equal_freq_screen(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    max_levels: int = 10,
    k: int = 10,
    min_iv: float = 0.02,
    special: Sequence[float] = (SPECIAL,),
) -> DataFrame:
    """(job) IV screening of all variables.

    Variables with more than ``max_levels`` values are cut into equal-frequency
    bins first, the others are used as they are."""
    texts = [c for c in cols if is_text(df, c)]
    numbers = [c for c in cols if c not in texts]
    spread = (spread_of(df, numbers, special) if numbers else {}) | text_spread_of(df, texts)
    few = few_valued(df, cols, max_levels, spread)
    parts = []
    if few:
        parts.append(category_counts(df, [c for c in cols if c in few], y))
    for names in (numbers, texts):
        many = [c for c in names if c not in few]
        if many:
            sp = special if names is numbers else ()
            cuts = equal_freq_cuts(df, many, k, sp, reduce_k=True, spread=spread)
            binned = bin_counts(df, many, y, cuts, sp, closed="right")
            parts.append(binned.select("var_name", F.col("bin_no").cast("string").alias("bin"), "total", "bad"))
    counts = reduce(DataFrame.unionByName, parts)
    route = F.when(F.col("var_name").isin(list(few)), "direct").otherwise("binned")
    return iv_screen(counts, min_iv).withColumn("route", route)


def chi_prebin(
    df: DataFrame, cols: Sequence[str], y: str, special: Sequence[float] = (), prebins: int = PREBINS
) -> DataFrame:
    """(job) Group table before merging: ``(var_name, grp, is_special, total,
    bad)``.

    Columns with more than ``prebins`` plain values are cut into that many
    equal-frequency groups named by their upper edge; others keep their
    values.  Special values keep a row of their own."""
    return _chi_groups(df, cols, y, special, prebins)[0]


def _chi_groups(
    df: DataFrame, cols: Sequence[str], y: str, special: Sequence[float], prebins: int = PREBINS
) -> tuple[DataFrame, list[str]]:
    """The group table, and the columns that were cut."""
    spread = spread_of(df, cols, special)
    known = few_valued(df, cols, prebins + len(special), spread)
    held = _special_levels(df, [c for c in cols if c in known], special, spread)
    few = [c for c in held if known[c] - held[c] <= prebins]
    many = [c for c in cols if c not in few]
    labelled = df.where(F.col(y).isNotNull())
    is_special = F.col("value").isin(*map(float, special)) if special else F.lit(False)
    sums = [F.count(y).alias("total"), F.sum(y).alias("bad")]
    parts = []
    if few:
        rows = long_values(labelled, few, y)
        parts.append(rows.groupBy("var_name", F.col("value").alias("grp"), is_special.alias("is_special")).agg(*sums))
    if many:
        cuts = equal_freq_cuts(df, many, prebins, special, spread=spread)
        rows = long_ranks(labelled, cuts_of(cuts), y, closed="right")
        # Specials keep their value, all others the rank of their group.
        slot = F.when(is_special, F.col("value")).otherwise(F.col("rank").cast("double"))
        slots = rows.groupBy("var_name", slot.alias("slot"), is_special.alias("is_special")).agg(*sums)
        upper = F.coalesce(F.get("cuts", F.col("slot").cast("int")), F.lit(ABOVE_ALL))
        grp = F.when(F.col("is_special"), F.col("slot")).otherwise(upper)
        named = slots.join(F.broadcast(cuts.select("var_name", "cuts")), "var_name")
        parts.append(named.select("var_name", grp.alias("grp"), "is_special", "total", "bad"))
    return reduce(DataFrame.unionByName, parts), many


def _special_levels(df: DataFrame, cols: Sequence[str], special: Sequence[float], spread) -> dict[str, int]:
    """(job) How many of the special values each column holds."""
    if len(special) < 2:
        return {c: int(bool(special) and spread[c].n_special > 0) for c in cols}
    x = {c: F.col(c).cast("double") for c in cols}
    seen = df.agg(*[F.count_distinct(F.when(x[c].isin(*map(float, special)), x[c])).alias(c) for c in cols]).first()
    return seen.asDict()


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chi(total: Column, bad: Column, rate: Column) -> Column:
    expected = total * rate
    return F.try_divide(F.pow(expected - bad, 2), expected)


def _merged_intervals(rows: Column, rate: Column, wanted: Column) -> Column:
    """Intervals ``(hi, chi)`` of the sorted group rows after merging: a fold
    that joins the neighbours of least chi-square, the first ones on ties,
    until ``wanted`` are left."""
    single = F.transform(rows, lambda g: F.struct(g["grp"].alias("hi"), _chi(g["total"], g["bad"], rate).alias("chi")))

    def join_least(intervals: Column) -> Column:
        pairs = F.zip_with(
            F.slice(intervals, 1, F.size(intervals) - 1), F.slice(intervals, 2, F.size(intervals) - 1), lambda a, b: F.struct((a["chi"] + b["chi"]).alias("chi"), b["hi"].alias("hi"))
        )

        def joined(pairs: Column) -> Column:
            least = F.array_min(F.transform(pairs, lambda p: p["chi"]))
            at = F.array_position(F.transform(pairs, lambda p: p["chi"]), least).cast("int")
            pair = F.get(pairs, at - 1)
            return F.concat(
                F.slice(intervals, 1, at - 1), F.array(F.struct(pair["hi"].alias("hi"), pair["chi"].alias("chi"))), F.slice(intervals, at + 2, F.size(intervals))
            )

        return _let(pairs, joined)

    steps = F.greatest(F.size(rows) - F.greatest(wanted, F.lit(1)), F.lit(0))
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.reduce(turns, single, lambda intervals, _: join_least(intervals))


def _without_pure_bins(cuts: Column, rows: Column, rate: Column) -> Column:
    """Cuts without those beside bins of bads or goods only: the first such
    bin loses its cut, an inner one that of the neighbour it is more alike."""
    empty = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("bad"))

    def bins_of(cuts: Column) -> Column:
        numbered = F.transform(rows, lambda g: F.struct(F.size(F.filter(cuts, lambda c: c <= g["grp"])).alias("bin"), g["total"].alias("total"), g["bad"].alias("bad")))

        def summed(numbered: Column) -> Column:
            def one(k: Column) -> Column:
                own = F.filter(numbered, lambda g: g["bin"] == k)
                return F.reduce(own, empty, lambda s, g: F.struct((s["total"] + g["total"]).alias("total"), (s["bad"] + g["bad"]).alias("bad")))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(cuts)), one), lambda b: b["total"] > 0)

        return _let(numbered, summed)

    def drop_one(cuts: Column) -> Column:
        def chosen(bins: Column) -> Column:
            at = F.array_position(F.transform(bins, lambda b: (b["bad"] == 0) | (b["bad"] == b["total"])), F.lit(True)).cast("int") - 1
            chi = lambda k: _chi(F.get(bins, k)["total"], F.get(bins, k)["bad"], rate)
            inner = F.when(chi(at - 1) + chi(at) < chi(at) + chi(at + 1), at - 1).otherwise(at)
            gone = F.when(at == F.size(bins) - 1, F.size(cuts) - 1).when(at == 0, F.lit(0)).otherwise(inner)
            return F.when(at < 0, cuts).otherwise(F.filter(cuts, lambda _, i: i != gone))

        return F.when(F.size(cuts) > 0, _let(bins_of(cuts), chosen)).otherwise(cuts)

    turns = F.when(F.size(cuts) > 0, F.sequence(F.lit(1), F.size(cuts))).otherwise(F.array().cast("array<int>"))
    return F.reduce(turns, cuts, lambda left, _: drop_one(left))


def merge_cuts(groups: DataFrame, max_interval: int, n_codes: int, prebinned: Sequence[str] = ()) -> DataFrame:
    """Chi-merge of group tables ``(var_name, grp, is_special, total, bad)``
    of about a hundred rows a variable: ``(var_name, n, cuts)``.

    Neighbouring intervals with the least chi-square are merged, the first
    one on ties, until few enough are left; then cuts are dropped while a bin
    holds bads or goods only.  Both loops are folds over one array of a
    variable's groups, inside the JVM.  A variable that wasn't pre-binned and
    has few groups keeps them all, specials too."""
    row = F.struct(F.col("grp").cast("double").alias("grp"), "is_special", F.col("total").cast("bigint").alias("total"), F.col("bad").cast("bigint").alias("bad"))
    per = groups.groupBy("var_name").agg(F.array_sort(F.collect_list(row)).alias("groups"), F.sum("total").cast("bigint").alias("n"))
    plain = F.filter("groups", lambda g: ~g["is_special"])
    total = lambda c: F.reduce("rows", F.lit(0).cast("bigint"), lambda s, g: s + g[c])
    per = per.withColumn("rows", plain).withColumns({"t": total("total"), "b": total("bad"), "special": F.size("groups") > F.size("rows")})
    per = per.withColumn("rate", F.try_divide(F.col("b").cast("double"), F.col("t")))
    wanted = F.lit(max_interval) - F.when(F.col("special"), F.lit(n_codes)).otherwise(0)
    none = F.array().cast("array<double>")
    intervals = _merged_intervals(F.col("rows"), F.col("rate"), wanted)
    per = per.withColumn("ends", F.transform(intervals, lambda i: i["hi"]))
    merged = _let(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda c: _without_pure_bins(c, F.col("rows"), F.col("rate")))
    few = (F.size("groups") <= max_interval) & ~F.col("var_name").isin(list(prebinned))
    every = F.transform(F.slice("groups", 1, F.greatest(F.size("groups") - 1, F.lit(0))), lambda g: g["grp"])
    one_sided = F.coalesce(F.col("rate").isin(0.0, 1.0), F.lit(True))
    return per.select("var_name", "n", F.when(few, every).when(one_sided, none).otherwise(merged).alias("cuts"))


def chi_merge(
    df: DataFrame, cols: Sequence[str], y: str, max_interval: int = 5, special: Sequence[float] = (SPECIAL,)
) -> DataFrame:
    """(job) Chi-merge cut points ``(var_name, n, cuts)`` of all columns.

    Every column is reduced to its group table of at most about a hundred
    rows; variables are merged in parallel.  Empty cuts mean that a variable
    cannot be binned."""
    table, many = _chi_groups(df, cols, y, special)
    return merge_cuts(table, max_interval, len(special), many)
