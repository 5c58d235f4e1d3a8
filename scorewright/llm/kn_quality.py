"""Quality of documents by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts a byte from the four before it. Digits count as one symbol, the control characters 09-0D as line ends;
a document starts after four line ends. There are 256 ** 5 n-grams, so what is gathered grows with the text, and nothing
is cut off.

*Counting.* Each task adds up the n-grams of its documents, and passes its table on whenever it has grown to
``FLUSH_GRAMS``; counts of trusted text and the n-grams of the whole corpus come from one scan of all rows.
*Probabilities.* Counts, contexts and lower orders are tables sharded by n-gram. Those of every n-gram of the corpus are
joined order by order: ``p(w|abcd) = max(c(abcdw) - D(c), 0) / c(abcd.) + gamma(abcd) p(w|bcd)``, where lower orders count
the different symbols before an n-gram, D takes three values for counts 1, 2 and more, and the lowest order falls back to
1/256.
*Scoring.* The most frequent n-grams, ``HEAD_GRAMS`` at most (12 bytes each, and up to 32 in a worker's table), are broadcast and looked up while texts are
scanned, so texts aren't shuffled. All other n-grams of a document leave it as rows, meet the sharded table of
probabilities in a join, and their sum is added to the document's. The split moves no result.
*Thresholds.* A fifth of the trusted documents, by a hash of the id, is held out of the counts. For each language the given
quantile of the log perplexity of its held-out documents is the limit (``margin`` widens it); languages with fewer than
``least_trusted`` of them take that of all held-out documents. Where no trusted document is held out, the counted ones take
their place. Quantiles come from counts per thousandth of log perplexity, so they are exact to that step at any size.

Cases: null and empty texts have no perplexity and are kept. A null language is a language. Rows of ``labels`` with null
ids or grades are ignored; ids that occur twice there are trusted if any row says so. Without trusted text nothing is
rejected. Rows that agree in id and text are scored alike. Other columns pass through. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm import text as T
from scorewright.llm.store import row_key, whole_row, written

ORDER = 5
SYMBOLS = 256
BITS = 8
QUANTILE = 0.99
MARGIN = 0.0  # of log perplexity, beyond the quantile
LEAST_TRUSTED = 30
HELD_OUT = 5  # one trusted document in so many sets the thresholds and isn't counted
BROADCAST_IDS = 4_000_000  # 8 bytes each
HEAD_GRAMS = 1 << 18
MERGE_GRAMS = 200_000
FLUSH_GRAMS = 1_500_000
TAIL_ROWS = 50_000  # n-grams in one row on their way to the join

_LINE_END = 10


def _symbols() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = _LINE_END
    table[48:58] = 48
    return table


_SYMBOL = _symbols()


def grams(piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every byte of a piece, and where each text's n-grams begin (and one past the last)."""
    first, pad = piece.offsets, ORDER - 1
    n, rows = len(piece.data), len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    padded = np.full(n + pad * rows, _LINE_END, np.int64)
    at = np.arange(n) + pad * (row + 1)
    padded[at] = _SYMBOL[piece.data]
    key = padded.copy()
    for k in range(1, ORDER):
        key[k:] |= padded[:-k] << (BITS * k)
    return key[at], first


def _totals(value: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with the sums of their counts (1 each by default)."""
    if not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if count is None:
        value = np.sort(value)
    else:
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
    fresh = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    return value[fresh], np.diff(np.r_[fresh, len(value)]) if count is None else np.add.reduceat(count, fresh)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(gram, c, f)``: n-grams of a task with their counts in counted and in all texts."""
    held = [_totals(np.zeros(0, np.int64))]  # keys are gram * 2 + (1 in counted texts)
    for batch in batches:
        counted = batch.column("counted").to_numpy(zero_copy_only=False).astype(np.int64)
        for piece in T.pieces(batch.column("text")):
            gram, first = grams(piece)
            held.append(_totals(gram << 1 | np.repeat(counted[piece.lo : piece.hi], np.diff(first))))
            if sum(len(v) for v, _ in held[1:]) > max(MERGE_GRAMS, len(held[0][0])):
                held = [_merged(held)]
                if len(held[0][0]) > FLUSH_GRAMS:
                    yield from _rows(*held[0])
                    held = [_totals(np.zeros(0, np.int64))]
    yield from _rows(*_merged(held))


def _merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _totals(*(np.concatenate(part) for part in zip(*tables, strict=True)))


def _rows(value: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(value), 100_000):
        v, n = value[lo : lo + 100_000], count[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(v >> 1), pa.array(n * (v & 1)), pa.array(n)], ["gram", "c", "f"])


def _mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


def _seen_tables(counts: DataFrame) -> list[DataFrame]:
    """(gram, c) of each order, highest last: counts of the trusted text, below that numbers of different symbols before. (job)

    Each is counted from the written one above it, not from the counts through all orders between."""
    out = [written(counts.where("c > 0"), "seen")]
    for order in range(ORDER - 1, 0, -1):
        below = out[0].groupBy(F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).agg(F.count("*").alias("c"))
        out.insert(0, written(below, "seen"))
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 0.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))  # type: ignore[return-value]


def _all_discounts(seen: list[DataFrame]) -> list[tuple[float, float, float]]:
    """The discounts of every order, from one query. (job)"""
    few = reduce(DataFrame.unionByName, (t.where("c <= 4").select(F.lit(k).alias("order"), "c") for k, t in enumerate(seen, 1)))
    n = {(r["order"], r["c"]): r["n"] for r in few.groupBy("order", "c").agg(F.count("*").alias("n")).collect()}  # four rows an order
    return [discounts(*(n.get((k, c), 0) for c in range(1, 5))) for k in range(1, len(seen) + 1)]


def _probabilities(wanted: DataFrame, seen: list[DataFrame], order: int) -> DataFrame:
    """(gram, p) of every wanted n-gram of this order. (job)

    Each order is a query of its own over the one below: the plan of all of them is long, and the driver gets its text
    anew whenever a stage ends."""
    lower = None
    for k, (table, (d1, d2, d3)) in enumerate(zip(seen[:order], _all_discounts(seen[:order]), strict=True), 1):
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = table.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("mass"))
        below = wanted if k == order else wanted.select(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).distinct()
        below = below.join(table, "gram", "left")  # first, since the distinct n-grams are dealt by gram already
        if lower is None:
            below = below.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            below = below.withColumn("_low", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(lower.select(F.col("gram").alias("_low"), F.col("p").alias("q")), "_low")
        joined = below.withColumn("context", F.shiftright("gram", BITS)).join(contexts, "context", "left")
        p = F.coalesce(F.when(F.col("c").isNotNull(), F.col("c") - cut), F.lit(0.0)) / F.col("total") + F.col("mass") / F.col("total") * F.col("q")
        found = joined.select("gram", F.coalesce(p, F.col("q")).alias("p"))
        lower = found if k == order else written(found, "probabilities")
    return lower


def _head(counts: DataFrame, most: int) -> Column:
    """Condition for the most frequent n-grams, ``most`` at most: all from some frequency on. (job)"""
    frequency = F.floor(F.log2("f") * 8)
    sizes = counts.groupBy(frequency.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()  # at most 8 bins a power of two
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["bin"]
    return F.lit(False) if least is None else frequency >= least


class _Lookup:
    """Log probabilities by n-gram: most are found in the slot of their hash, those that share one by binary search."""

    def __init__(self, gram: np.ndarray, log: np.ndarray) -> None:
        self.gram, self.log = np.r_[gram, np.int64(1 << 62)], np.r_[log, np.float32(0)]  # sorted, with an end that no text holds
        self.shift = np.uint64(64 - max(8, len(gram).bit_length() + 2))
        self.place = np.full(1 << (64 - int(self.shift)), len(gram), np.int32)
        self.place[self._slot(gram)] = np.arange(len(gram))

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams are known, and their log probabilities (0 where not)."""
        at = self.place[self._slot(gram)]
        miss = np.flatnonzero(self.gram[at] != gram)
        at[miss] = np.searchsorted(self.gram, gram[miss])
        hit = self.gram[at] == gram
        return hit, np.where(hit, self.log[at], np.float32(0))


def _scorer(head):
    """Sums of log probabilities of the broadcast n-grams of every text; all its other n-grams as lists in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lookup(*head.value)
        for batch in batches:
            passed = [c for c in batch.schema.names if c != "text"]
            for piece in T.pieces(batch.column("text")):
                gram, first = grams(piece)
                hit, log = known.of(gram)
                sums = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
                rest = gram[~hit]
                upto = np.concatenate([[0], np.cumsum(~hit)])[first]
                parts = np.maximum(-(-np.diff(upto) // TAIL_ROWS), 1)
                row = np.repeat(np.arange(piece.hi - piece.lo), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                lo = np.minimum(upto[row] + part * TAIL_ROWS, upto[row + 1])
                tail = pa.LargeListArray.from_arrays(pa.array(np.r_[lo, len(rest)].astype(np.int64)), pa.array(rest)).cast(pa.list_(pa.int64()))
                own = [batch.column(c).take(pa.array(row + piece.lo)) for c in passed]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part), pa.array(np.diff(first)[row].astype(np.int64)), pa.array((sums[first[1:]] - sums[first[:-1]])[row]), tail], [*passed, "part", "n_symbols", "sum", "tail"])

    return run


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", grade_col: str = "quality") -> DataFrame:
    """Ids of the documents that labels call good."""
    return labels.where(F.col(id_col).isNotNull() & (F.col(grade_col) == 1)).select(F.col(id_col).alias("_id")).distinct()


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head_grams: int = HEAD_GRAMS) -> DataFrame:
    """``(id, th, lang, trusted, counted, n_symbols, log_perplexity)`` of every row, ``th`` a hash of its text. (job)"""
    spark = docs.sparkSession
    trusted = written(trusted_ids(labels), "trusted")
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), row_key(id_col, text_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    held_out = F.pmod(F.crc32(F.concat(F.lit("held out "), F.col("id").cast("string"))), F.lit(HELD_OUT)) == 0
    flagged = base.join(trusted, F.col("id") == F.col("_id"), "left").withColumn("trusted", F.col("_id").isNotNull()).drop("_id")
    flagged = flagged.withColumn("counted", F.coalesce(F.col("trusted") & ~held_out, F.lit(False)))
    counted = flagged.select("text", "counted").mapInArrow(_count, "gram long, c long, f long")
    counts = written(counted.groupBy("gram").agg(F.sum("c").alias("c"), F.sum("f").alias("f")), "grams")
    seen = _seen_tables(counts.select("gram", "c"))
    p = _probabilities(counts.select("gram"), seen, ORDER).withColumnRenamed("gram", "_gram")
    logs = written(counts.join(p, F.col("gram") == F.col("_gram")).select("gram", "f", F.log("p").cast("float").alias("l")), "logs")
    head = logs.where(_head(logs, head_grams)).select("gram", "l").toArrow().sort_by("gram")  # at most head_grams rows
    sent = spark.sparkContext.broadcast((head["gram"].to_numpy(), head["l"].to_numpy()))
    kind, lang = docs.schema[id_col].dataType.simpleString(), docs.schema[lang_col].dataType.simpleString()
    scanned = written(flagged.mapInArrow(_scorer(sent), f"id {kind}, th long, key long, lang {lang}, trusted boolean, counted boolean, part long, n_symbols long, sum double, tail array<long>"), "scanned")
    tails = scanned.where(F.size("tail") > 0).groupBy("key", "part").agg(F.any_value("tail").alias("tail"))
    rare = tails.select("key", F.explode("tail").alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("n"))
    rest = rare.join(logs.select("gram", "l"), "gram").groupBy("key").agg(F.sum(F.col("n") * F.col("l")).alias("rest"))
    whole = scanned.where("part = 0").drop("tail", "part").join(rest, "key", "left")
    mean = -(F.col("sum") + F.coalesce("rest", F.lit(0.0))) / F.col("n_symbols")
    return written(whole.select("id", "th", "lang", "trusted", "counted", "n_symbols", F.when(F.col("n_symbols") > 0, mean).alias("log_perplexity")), "scores")


def thresholds(scores: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """``(lang, most)``: the highest accepted log perplexity of every language of the scores."""
    step = 1000
    bins = scores.where("trusted and log_perplexity is not null").groupBy("lang", F.ceil(F.col("log_perplexity") * step).alias("bin")).agg(F.count("*").alias("n"))

    def at_quantile(table: DataFrame, keys: list[str]) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        ranked = table.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
        return ranked.where(F.col("upto") >= quantile * F.col("total")).groupBy(*keys, "total").agg((F.min("bin") / step + margin).alias("most"))

    own = at_quantile(bins, ["lang"]).where(F.col("total") >= least_trusted).select(F.col("lang").alias("_lang"), "most")
    pooled = at_quantile(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1)), ["all"]).first()
    langs = scores.select("lang").distinct().join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return langs.select("lang", F.coalesce("most", F.lit(pooled["most"] if pooled else None).cast("double")).alias("most"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """``(id, th, lang, n_symbols, perplexity, threshold, kept)`` of every row. (job)"""
    scores = perplexities(docs, labels, id_col, text_col, lang_col)
    held_out = F.col("trusted") & ~F.col("counted")
    if not scores.where(held_out & F.col("log_perplexity").isNotNull()).isEmpty():
        scores = scores.withColumn("trusted", held_out)
    most = written(thresholds(scores, **limits), "thresholds").withColumnRenamed("lang", "_lang")
    joined = scores.join(F.broadcast(most), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # one row per language
    return joined.select(
        "id", "th", "lang", "n_symbols", F.exp("log_perplexity").alias("perplexity"), F.exp("most").alias("threshold"), F.coalesce(F.col("log_perplexity") <= F.col("most"), F.lit(True)).alias("kept")
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The input rows that aren't rejected. (job)"""
    gone = judged(docs, labels, id_col, text_col, lang_col, **limits).where("not kept").select("id", "th", F.col("lang").alias("_lang")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(lang_col).alias("_l"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")) & F.col("_l").eqNullSafe(F.col("_lang"))
    return rows.join(gone, same, "left_anti").select("row.*")
