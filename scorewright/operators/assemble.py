"""Joins, de-duplication and unions for building the application table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from scorewright.functions.columns import double_array, search_in
from scorewright.operators.clean import require_key
from scorewright.operators.ordered import add_bucket, add_ranks, spread_of

# A key is hot when it alone fills this many rows or more, and this share of all rows ...
HOT_ROWS = 1_000_000
HOT_SHARE = 0.001
# ... and it is spread over join tasks of about this many rows.
PIECE_ROWS = 500_000
# A key that is hot on both sides becomes at most so many tasks; its pieces grow instead, as more would only copy rows.
GRID_TASKS = 4096
# A side of more rows than this is never broadcast.
BROADCAST_ROWS = 20_000
_TRACKED = 10_000


def _pick(df: DataFrame, keys: Sequence[str], order: Column, best) -> DataFrame:
    df = require_key(df, *keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    chosen = df.groupBy(*keys).agg(best(F.struct(*rest), order).alias("_r"))
    return chosen.select(
        *[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns]
    )


def latest_record(df: DataFrame, keys: Sequence[str], ts: str, tie: str | Sequence[str]) -> DataFrame:
    """The latest row of every key; a missing time counts as the latest.

    An aggregate with map-side combine: each task forwards one row per key,
    so a key that holds a third of the table costs no more than any other."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    return _pick(df, keys, F.struct(F.col(ts).isNull(), F.col(ts), *ties), F.max_by)


def first_record(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The first row of every key in an explicit order (file order is lost)."""
    order = [order] if isinstance(order, str) else list(order)
    return _pick(df, keys, F.struct(*order), F.min_by)


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows of a projection."""
    return df.select(*cols).distinct()


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_types(left: DataFrame, right: DataFrame, on: Sequence[str]) -> list[str] | None:
    """The type in which a join compares each key, or None where it can't be
    told: equal types, numbers with numbers, dates with timestamps."""
    both = left.select(*on).union(right.select(*on)).schema if on else []
    out = []
    for k, wide in zip(on, both):
        types = {left.schema[k].dataType, right.schema[k].dataType}
        alike = len(types) == 1 or all(isinstance(t, NumericType) for t in types)
        if not alike and not all(isinstance(t, (DateType, TimestampType, TimestampNTZType)) for t in types):
            return None
        out.append(wide.dataType.simpleString())
    return out


def _key_hash(on: Sequence[str], types: Sequence[str]) -> Column:
    """Equal for keys that a join takes as equal, on either side: hashed in
    the common type, and with one zero."""
    keys = []
    for k, t in zip(on, types):
        value = F.col(k).cast(t)
        keys.append(value + F.lit(0.0).cast(t) if t in ("float", "double") else value)
    return F.xxhash64(*keys)


def frequent_keys(df: DataFrame, keys: Sequence[str], types: Sequence[str]) -> tuple[int, int, dict[int, int]]:
    """(job) Rows with a key, rows without one, and about how many rows each
    of the most frequent keys has, by the key's hash.

    A frequent-items sketch of fixed size: no shuffle of keys, at most
    a thousand hashes returned.  Only the spreading of work depends on it,
    never a result, so an approximate answer is enough."""
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    hashed = df.select(F.when(~no_key, _key_hash(keys, types)).alias("_h"))
    found = hashed.agg(
        F.count("_h").alias("n"), F.count(F.when(F.col("_h").isNull(), 1)).alias("without"), F.call_function("approx_top_k", F.col("_h"), F.lit(1000), F.lit(_TRACKED)).alias("t")
    ).first()
    return found["n"], found["without"], {i["item"]: i["count"] for i in (found["t"] or []) if i["item"] is not None}


def _cuts(n: int, counts: Mapping[int, int], min_rows: int, piece_rows: int) -> dict[int, int]:
    least = max(min_rows, HOT_SHARE * n)
    return {h: max(2, -(-c // piece_rows)) for h, c in counts.items() if c >= least}


def _grid(a: int, b: int) -> tuple[int, int]:
    """Lines and columns of a key's grid: as asked for, or fewer in the same proportion, which copies the fewest rows."""
    if b == 1 or a == 1 or a * b <= GRID_TASKS:
        return a, b
    over = math.sqrt(a * b / GRID_TASKS)
    few = max(1, int(min(a, b) / over))
    return (min(a, GRID_TASKS // few), few) if a >= b else (few, min(b, GRID_TASKS // few))


def hot_keys(
    df: DataFrame, keys: Sequence[str], types: Sequence[str] | None = None, min_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS
) -> dict[int, int]:
    """(job) Hashes of the keys with about ``min_rows`` rows or more that are
    also a thousandth of all rows, and into how many pieces each is cut."""
    n, _, counts = frequent_keys(df, keys, types or [df.schema[k].dataType.simpleString() for k in keys])
    return _cuts(n, counts, min_rows, piece_rows)


def _dealt(rows: DataFrame, pieces: Column, name: str) -> DataFrame:
    """Rows dealt over their pieces in turn, equal rows too.

    The turn is a row's place in its task, after the task has sorted its rows
    by their content: a task that is run again, over the same rows in another
    order, deals them alike, which neither their place as they come nor a
    random number would."""
    content = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t and "variant" not in t])
    placed = rows.withColumn("_content", content).sortWithinPartitions("_content").drop("_content")
    return placed.withColumn(name, F.pmod(F.monotonically_increasing_id(), pieces.cast("bigint")).cast("int"))


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    min_rows: int = HOT_ROWS,
    piece_rows: int = PIECE_ROWS,
    unique: bool = False,
) -> DataFrame:
    """(job) Equi-join (inner, left, left_semi or left_anti) that survives keys
    that are hot on the left, on the right or on both sides.

    A key with a pieces of left rows and b pieces of right rows becomes a grid
    of a x b join tasks: each left row goes to one line of the grid and all its
    columns, each right row to one column and all its lines, so each pair meets
    once, and a task reads about two pieces.  Rows are dealt in turn, so equal
    rows spread as well.  Where some key is hot, each side is read once for
    its hot rows and once for the others; other keys are shuffled as in a plain
    join.  Keys of different types are compared as the plain join compares
    them; where the common type can't be told, the plain join is used.
    Grids have at most ``GRID_TASKS`` tasks.
    ``unique`` says that the right side holds a key once, so that its rows are
    only counted.  Left rows without a key match nothing and, where they are many, aren't shuffled
    at all.  Nothing is broadcast by hand, and no side of many rows by Spark."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    on = list(on)
    types = common_types(left, right, on)
    if types is None:
        return left.join(right, on, how)
    n, without, counts = frequent_keys(left, on, types)
    lines, columns, n_right, right_counts = _cuts(n, counts, min_rows, piece_rows), {}, 0, {}
    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()
        n_right = right.agg(F.approx_count_distinct(_key_hash(on, types))).first()[0]
    elif unique:
        n_right = right.count()
    else:
        n_right, _, right_counts = frequent_keys(right, on, types)
        columns = _cuts(n_right, right_counts, min_rows, piece_rows)
    for h in lines.keys() & columns.keys():
        lines[h], columns[h] = _grid(lines[h], columns[h])
    if how == "left" and columns:  # a line of the grid may lack the match that another has
        both = join_skewed(left, right, on, "inner", min_rows, piece_rows)
        alone = join_skewed(left, right, on, "left_anti", min_rows, piece_rows)
        return both.unionByName(alone, allowMissingColumns=True)
    if without >= min_rows and how in ("left", "left_anti"):
        no_key = reduce(Column.__or__, [F.col(k).isNull() for k in on])
        kept = join_skewed(left.where(~no_key), right, on, how, min_rows, piece_rows, unique)
        return kept.unionByName(left.where(no_key), allowMissingColumns=True)
    hot = sorted({*lines, *columns})
    # Spark's size estimates don't see the rows that explode makes, here or in what a side is computed from: a small
    # file could stand for more rows than the driver holds
    made_left = sum(counts.get(h, 1) * (k - 1) for h, k in columns.items())
    made_right = sum(right_counts.get(h, 1) * (k - 1) for h, k in lines.items())
    shuffled = max(made_left, n_right + made_right) > BROADCAST_ROWS
    if not hot:
        return left.join(right.hint("merge") if shuffled else right, on, how)
    key = _key_hash(on, types)
    is_hot = F.coalesce(key.isin(hot), F.lit(False))

    def pieces(cuts: Mapping[int, int]) -> Column:
        table = [F.lit(x) for pair in cuts.items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*table), key), F.lit(1)) if cuts else F.lit(1)

    def every(cuts: Mapping[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), pieces(cuts) - 1))

    cold = {"_salt": F.lit(0), "_part": F.lit(0)}
    hot_left = _dealt(left.where(is_hot), pieces(lines), "_salt").withColumn("_part", every(columns))
    hot_right = _dealt(right.where(is_hot), pieces(columns), "_part").withColumn("_salt", every(lines))
    left = left.where(~is_hot).withColumns(cold).unionByName(hot_left)
    right = right.where(~is_hot).withColumns(cold).unionByName(hot_right)
    return left.join(right.hint("merge") if shuffled else right, [*on, "_salt", "_part"], how).drop("_salt", "_part")


def inner_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    **skew,
) -> DataFrame:
    """Inner equi-join on keys that may be named differently on both sides.

    Both key columns stay when the names differ; other clashing names get
    the suffixes."""
    right_keys = list(right_keys or left_keys)
    shared = [k for k, r in zip(left_keys, right_keys) if k == r]
    clash = (set(left.columns) & set(right.columns)) - set(shared)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    lk = [k + suffixes[0] if k in clash else k for k in left_keys]
    rk = [k + suffixes[1] if k in clash else k for k in right_keys]
    extra = {r: F.col(r) for k, r in zip(lk, rk) if k != r}
    for k, r in zip(lk, rk):
        if k != r:
            right = right.withColumn(k, F.col(r))
    joined = join_skewed(left, right, lk, "inner", **skew)
    order = [*left.columns, *[c for c in right.columns if c not in left.columns or c in extra]]
    return joined.select(*order)


def enrich(
    left: DataFrame, right: DataFrame, on: Sequence[str], order: str | Sequence[str], **skew
) -> DataFrame:
    """Left outer enrichment.  The right side is reduced to its first row per
    key before the join, so the left rows neither fan out nor need a second
    de-duplication."""
    return join_skewed(left, first_record(right, on, order), on, "left", unique=True, **skew)


def join_chain(tables: Sequence[DataFrame], key: str, checked: bool = True, at_once: bool = True) -> DataFrame:
    """(job) Inner joins of many tables on one key.  Each table must hold one
    row per key, so one hash partitioning serves the whole chain; a table that
    repeats a key is an error, as it would multiply rows without notice.

    ``at_once`` looks for repeats before it returns, all tables in one job,
    which computes them twice.  Otherwise the check is part of the join: rows
    of a key meet there anyway, sorted, and the query fails when it runs."""
    tables = [require_key(t, key) for t in tables]
    if checked and at_once:
        repeats = [t.groupBy(key).count().where("count > 1").select(F.lit(i).alias("i")).limit(1) for i, t in enumerate(tables)]
        found = sorted(r["i"] for r in reduce(DataFrame.unionAll, repeats).collect())
        if found:
            raise ValueError(f"table {found[0]} of the chain repeats a {key}")
    elif checked:
        tables = [_unrepeated(t, key, i) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, key, "inner"), tables)


def _unrepeated(t: DataFrame, key: str, i: int) -> DataFrame:
    rows = t.withColumn("_repeats", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return rows.where(F.assert_true(F.col("_repeats") == 1, f"table {i} of the chain repeats a {key}").isNull()).drop("_repeats")


def attach_to_names(spark: SparkSession, names: Sequence[str], attributes: DataFrame, name_col: str = "var_name") -> DataFrame:
    """Attributes of an ordered list of names: ``(position, var_name, ...)``.
    Names without attributes stay, with nulls; repeats stay as well."""
    listed = spark.createDataFrame(list(enumerate(names)), f"position int, {name_col} string")
    return listed.join(attributes, name_col, "left").select("position", name_col, *[c for c in attributes.columns if c != name_col])


def keep_listed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """(job) Rows whose key is in the list; duplicates in the list do not
    repeat rows."""
    return join_skewed(df, keys.select(on).distinct(), [on], "left_semi")


def band_join(df: DataFrame, score: str, bands: DataFrame, lo: str = "lo", hi: str = "hi", **skew: int) -> DataFrame:
    """(job) Attach every band with ``lo <= score < hi``; open ends are null.
    Bands may overlap: a row comes once for each band it lies in.

    Scores and band edges are sketched, and the two sketches cut the line into
    ranges of bounded size on either side.  Rows go to the range of their score; a band
    goes to the ranges that it touches.  The band edges inside a range, sorted,
    cut it into segments; a row finds its segment by a binary search, a band is
    listed under the segments it covers, and the two meet on range and segment.
    Only the sketch edges reach the driver, however many bands there are, and
    segments that hold many rows or bands are split.  Rows without a band,
    without a score or with NaN go, and so do bands that are empty."""
    x = lambda c: F.col(c).cast("double")
    bands = bands.where(~(F.coalesce(F.isnan(x(lo)), F.lit(False)) | F.coalesce(F.isnan(x(hi)), F.lit(False))) & F.coalesce(x(lo) < x(hi), F.lit(True)))
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(x(score)))
    finite_edges = bands.select(F.explode(F.array(x(lo), x(hi))).alias("e")).where("e is not null and abs(e) < double('Infinity')")
    spread = spread_of(finite_edges, ["e"])["e"]
    edges = sorted({*spread_of(rows.where(F.abs(x(score)) < float("inf")).select(x(score).alias("e")), ["e"])["e"].edges, *spread.edges})
    limits = double_array(edges)

    first, last = "_band_first", "_band_last"
    touched = add_ranks(bands.withColumns({first: x(lo), last: x(hi)}), {first: edges}, "_at")
    touched = add_ranks(touched, {last: edges}, "_at", closed="right")
    from_, to = F.coalesce(first + "_at", F.lit(0)), F.coalesce(last + "_at", F.lit(len(edges)))
    copies = touched.withColumn("_band_range", F.explode(F.sequence(from_, to)))
    at = F.col("_band_range")
    begins = F.when((F.col(first + "_at") == at) & ((at == 0) | (F.col(first) > F.get(limits, at - 1))), F.col(first))
    ends = F.when((F.col(last + "_at") == at) & ((at == len(edges)) | (F.col(last) < F.get(limits, at))), F.col(last))
    copies = copies.withColumns({"_band_begins": begins, "_band_ends": ends}).drop(first, last, first + "_at", last + "_at")
    inner = copies.groupBy("_band_range").agg(
        F.array_sort(F.array_union(F.collect_set("_band_begins"), F.collect_set("_band_ends"))).alias("_band_edges")
    )
    # It holds each edge once at most. Left to its estimates, Spark would broadcast it whole, or the exploded bands
    inner = inner.hint("merge" if spread.n > BROADCAST_ROWS else "broadcast")
    segment = lambda c: search_in(F.col(c), F.col("_band_edges"))
    covered = F.sequence(
        F.when(F.col("_band_begins").isNull(), 0).otherwise(segment("_band_begins")),
        F.when(F.col("_band_ends").isNull(), F.size("_band_edges")).otherwise(segment("_band_ends") - 1),
    )
    listed = copies.join(inner, "_band_range").withColumn("_band_segment", F.explode(covered)).drop("_band_begins", "_band_ends", "_band_edges")

    placed = add_bucket(rows.withColumn("_band_x", x(score)), "_band_x", edges, "_band_range")
    placed = placed.join(inner, "_band_range").withColumn("_band_segment", segment("_band_x")).drop("_band_x", "_band_edges")
    return join_skewed(placed, listed, ["_band_range", "_band_segment"], **skew).drop("_band_range", "_band_segment")
