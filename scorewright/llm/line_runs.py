"""Delete later copies of repeated runs of lines.

The corpus is a sequence of line ids per document. Prefix doubling ranks every line position by the lines that follow:
rank at depth 2h is the order of the pairs (rank at depth h here, rank at depth h, h lines on). Positions whose rank is
unique at a depth are in no repeated run of that depth and leave; what remains shrinks fast. Positions of equal rank
at a depth are one interval of the suffix array whose common prefix has at least that many lines; every position of
the interval but the first in corpus order starts a later copy. Overlapping copies join up to the maximal repeated runs,
which are deleted.

*Depth.* Ranks go no deeper than ``min_lines``, and the full suffix array isn't built: each window of ``min_lines`` lines
of a longer repeated run repeats too, and starts no later, so these windows cover just the lines of all such runs. Shorter
runs count if they have ``min_words`` words, so ranks are then taken at every depth up to ``min_lines``.

*Scale.* Ranks come from a sort of the distinct pairs that occur at least twice, after an aggregate with map-side
combine, and are joined back; a line that a third of all documents hold is one row of that sort, and its join is
skew-safe. Documents don't meet in one task.

*Rule.* A line is deleted if it lies in a run of at least ``min_lines`` lines, or of at least ``min_words`` words (be it a
single line), that also starts earlier: in a smaller id (null ids last), or further up in the same document. Runs never
cross documents. Blank lines don't count and are kept. Without ``min_words`` only lines count.

Cases: null and empty texts have no lines and stay. Rows that agree in id and text are one document to this rule, and
both stay or change alike. Other columns pass through. No rows give no rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scorewright.llm.store import whole_row, written

NOT_BLANK = r"[^\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
MIN_LINES = 3
MIN_WORDS = 50


def _ranked(table: DataFrame, first: str, second: str | None) -> DataFrame:
    """Positions whose value or pair of values repeats, with its place in the order of such values as ``rank``."""
    pair = [first] + ([second] if second else [])
    values = table.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    order = written(values.orderBy(*pair).withColumn("place", F.monotonically_increasing_id()), "order")
    return table.join(order, pair).select("rk", "doc_id", "pos", "own", "words", F.col("place").alias("rank"))


def _paired(ranks: DataFrame, ahead: int) -> DataFrame:
    """Each position with its rank and the rank ``ahead`` lines on; ``words`` of the longer run if that is one line on."""
    later = ranks.select("rk", (F.col("pos") - ahead).alias("pos"), F.col("rank").alias("rank2"), F.col("words").alias("more"))
    return ranks.join(later, ["rk", "pos"]).withColumn("words", F.col("own") + F.col("more")).drop("more")


def _later(ranks: DataFrame, depth: int) -> DataFrame:
    """``(rk, pos, depth)`` of all positions but the first of each rank."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "rk", "pos")
    first = ranks.groupBy("rank").agg(F.min(place).alias("first"))
    return ranks.join(first, "rank").where(place > F.col("first")).select("rk", "pos", F.lit(depth).alias("depth"))


def repeated_runs(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``(rk, pos, depth)`` of every position that starts a later copy of a run of ``depth`` lines. (job)

    ``lines`` has (rk, doc_id, pos, line, own), one row per line of a document, pos counting from 0; ``own`` is its words.
    """
    ranks, depth, short = written(_ranked(lines.withColumn("words", F.col("own")), "line", None), "ranks"), 1, []
    while depth < min_lines:
        if min_words is not None:
            short.append(_later(ranks.where(F.col("words") >= min_words), depth))
        ahead = min(depth, min_lines - depth) if min_words is None else 1
        ranks = written(_ranked(_paired(ranks, ahead), "rank", "rank2"), "ranks")
        depth += ahead
    return reduce(DataFrame.unionByName, short, _later(ranks, depth))


@F.pandas_udf(StringType())
def _without(text: pd.Series, dead: pd.Series) -> pd.Series:
    def cut(t, d):
        if t is None or d is None:
            return t
        gone = set(d.tolist())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([cut(t, d) for t, d in zip(text, dead, strict=True)], dtype=object)


def line_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = MIN_WORDS) -> DataFrame:
    """``(row, n_lines, n_removed, n_runs)``: the input row as a struct with later copies cut from its text, its lines
    that aren't blank, how many of them were deleted, and in how many runs. (job)"""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    split = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    full = F.filter(split, lambda s: s["line"].rlike(NOT_BLANK))
    own = (F.regexp_count("s.line", F.lit(WORD)) if min_words is not None else F.lit(0)).cast("long")
    table = docs.select(key.alias("rk"), F.col(id_col).alias("doc_id"), F.posexplode(full).alias("pos", "s"))
    table = table.select("rk", "doc_id", "pos", F.col("s.at").alias("at"), F.xxhash64("s.line").alias("line"), own.alias("own")).dropDuplicates(["rk", "pos"])
    lines = written(table, "lines")

    starts = written(repeated_runs(lines.drop("at"), min_lines, min_words), "starts")
    covered = starts.select("rk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("depth") - 1)).alias("pos")).distinct()
    dead = covered.join(lines.select("rk", "pos", "at"), ["rk", "pos"]).groupBy("rk").agg(F.array_sort(F.collect_list("at")).alias("_dead"), F.array_sort(F.collect_list("pos")).alias("_pos"))
    counts = lines.groupBy("rk").agg(F.count("*").alias("_n"))
    facts = counts.join(dead, "rk", "left").withColumnRenamed("rk", "_rk")
    joined = docs.select(key.alias("_rk"), whole_row(docs).alias("row")).join(facts, "_rk", "left")
    runs = F.aggregate(F.col("_pos"), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.when(x == a["last"] + 1, 0).otherwise(1)).alias("n")))["n"]
    removed = F.coalesce(F.size("_dead"), F.lit(0))
    text = F.col("row").getField(text_col)
    kept = F.when(F.col("_dead").isNull(), text).otherwise(_without(F.when(F.col("_dead").isNotNull(), text), F.col("_dead")))
    return joined.select(
        F.struct(*(kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)).alias("row"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.coalesce(runs, F.lit(0)).cast("long").alias("n_runs"),
    )


def drop_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = MIN_WORDS) -> DataFrame:
    """The input rows without later copies; rows of which no line is left, though they had some, go. (job)"""
    cut = line_runs(docs, min_lines, id_col, text_col, min_words)
    return cut.where("n_removed = 0 or n_removed < n_lines").select("row.*")
