"""Mix sources to target weights by fixed-length blocks.

The words of each source form one stream, its documents in hash order, cut into blocks of fixed length; a source's
last block may be shorter. Every output shard draws how many of its slots each source fills from a multinomial
distribution. The slots of a source, counted through all shards, map to its blocks: each pass over the source is a
pseudorandom permutation of the block indexes of its own, so every block is used once before any is used again. The
draws are calibrated: a source takes no slots beyond its target, and what the draws leave short is filled by a last,
small shard. The slots of a shard are numbered by a permutation of its own, so its sources alternate. Slots join blocks
by source and index: each slot of the mix lists the word spans of documents that fill its block. ``packed`` adds the
texts to such a list; ``mix_texts`` packs each block once and writes out the slots' texts; ``mix_sources`` sums the words
each document supplies.

*Targets.* Sources in code-point order (null last) weigh by the given cycle and share all words; none exceeds ``repeats``
times its own size, and what is above is shared again by weight among the others until none is above.

*Scale.* Offsets in a source's stream come from two-level prefix sums over hash buckets, so no source is sorted in one
task. The driver sees one row per source. All draws and permutations depend on the seed, the shard and the source only.

Cases: null or blank text has size 0 and nothing is taken of it. A null source is a source. Repeated rows count each.
Ids may be null or repeat. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from scorewright.llm.store import row_key, written
from scorewright.llm.text import mix as spread
from scorewright.operators.assemble import join_skewed

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
BUCKET_ROWS = 50_000


def fill_targets(sizes: list[int], weights: list[float], repeats: int = 3) -> list[float]:
    """Shares of all words by weight, each at most ``repeats`` times its size; the excess goes to the others by weight."""
    budget, free = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        for i in free:
            out[i] = budget * weights[i] / total
        above = [i for i in free if out[i] > repeats * sizes[i]]
        if not above:
            break
        for i in sorted(above):
            out[i] = float(repeats * sizes[i])
            budget -= out[i]
            free.discard(i)
    return out


def slots_for(size: int, target: float, block_words: int) -> tuple[int, int]:
    """Number of blocks of a source, and of slots that come nearest to its target."""
    if size == 0:
        return 0, 0
    blocks = -(-size // block_words)
    passes = int(target / size + 1e-9)
    return blocks, passes * blocks + min(blocks, round((target - passes * size) / block_words))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: four Feistel rounds, walked until the value is in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key, out, todo = key.astype(np.uint64), index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (spread(right ^ spread(key[todo] + np.uint64(turn))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _slot_of(index: pd.Series, slots: pd.Series, key: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return pd.Series(permuted(index.to_numpy(np.int64), slots.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64)))


@F.pandas_udf(LongType())
def _block_of(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    slot, blocks = slot.to_numpy(np.int64), blocks.to_numpy(np.int64)
    with np.errstate(over="ignore"):
        turn = spread(key.to_numpy(np.int64).view(np.uint64) + (slot // blocks).astype(np.uint64))
    return pd.Series(permuted(slot % blocks, blocks, turn))


def _draws(wanted: list[int], seed: int, shard_slots: int):
    total = sum(wanted)
    share = np.array(wanted, float) / total

    def run(batches):
        for batch in batches:
            out = []
            for shard in batch["id"]:
                size = min(shard_slots, total - shard * shard_slots)
                drawn = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(size, share)
                out.append(pd.DataFrame({"shard": int(shard), "source_no": np.arange(len(drawn)), "drawn": drawn}))
            yield pd.concat(out).query("drawn > 0") if out else pd.DataFrame({"shard": [], "source_no": [], "drawn": []})

    return run


def _placed(docs: DataFrame, cycle, repeats: int, block_words: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Every row with its place in the stream of its source; the table of sources; the slots each is to fill. (job)"""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), row_key(id_col, text_col).alias("rk"), size.alias("size")), "sized"
    )
    sources = sorted(
        ((r["source"], r["size"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()),
        key=lambda r: (r[0] is None, r[0] if r[0] is not None else ""),
    )
    sizes = [r[1] for r in sources]
    targets = fill_targets(sizes, [cycle[i % len(cycle)] for i in range(len(sources))], repeats)
    plan = [(k, name, n, t, *slots_for(n, t, block_words)) for k, ((name, n, _), t) in enumerate(zip(sources, targets, strict=True))]
    table = spark.createDataFrame(plan, f"source_no int, _source {sized.schema['source'].dataType.simpleString()}, source_size long, target double, blocks long, wanted long")

    buckets = max(1, math.ceil(sum(r[2] for r in sources) / BUCKET_ROWS))
    order = F.xxhash64(F.lit(seed), "rk")
    placed = (
        sized.join(table.drop("blocks", "wanted"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("turn", order)
        .withColumn("bucket", F.pmod(F.shiftright("turn", 20), F.lit(buckets)))
    )
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source_no", "bucket").orderBy("turn", "rk", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["source_no", "bucket"])
    placed = written(
        placed.select("doc_id", "source", "rk", "size", "source_size", "target", "source_no", (F.col("base") + F.col("ahead")).alias("offset")), "placed"
    )
    return placed, table, [p[5] for p in plan]


def _mix(placed: DataFrame, table: DataFrame, wanted: list[int], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The spans of all slots, as :func:`mix_slots` gives them, with the number of the source and the offset of the row. (job)"""
    last = F.col("offset") + F.col("size") - 1
    per_block = placed.where("size > 0").withColumn("block", F.explode(F.sequence((F.col("offset") / block_words).cast("long"), (last / block_words).cast("long"))))
    start = F.greatest(F.col("block") * block_words, F.col("offset"))
    end = F.least((F.col("block") + 1) * block_words, F.col("offset") + F.col("size"))
    spans = per_block.select(
        "source_no", "block", "source", "doc_id", "rk", "offset", (start - F.col("block") * block_words).alias("at"), (start - F.col("offset")).alias("first_word"), (end - start).alias("words")
    )
    slots = _slots(placed.sparkSession, table, wanted, seed, shard_slots)
    # both grow with the documents, and the planner sees their size only before they are exploded
    mix = slots.hint("merge").join(spans.hint("merge"), ["source_no", "block"])
    return written(mix.select("shard", "slot", "source", "block", "at", "doc_id", "rk", "first_word", "words", "source_no", "offset"), "mix")


def mix_slots(
    docs: DataFrame,
    cycle: tuple[float, ...] = (1, 2, 3),
    repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix: ``(shard, slot, source, block, at, doc_id, rk, first_word, words)``, a row per slot and document in its block. (job)

    Words ``first_word`` to ``first_word + words - 1`` of the document, counted from 0, stand at word ``at`` of the slot.
    ``rk`` is the row key of the document (:func:`scorewright.llm.store.row_key`), for ids that are null or repeat.
    """
    placed = _placed(docs, cycle, repeats, block_words, seed, id_col, text_col, source_col)
    return _mix(*placed, block_words, shard_slots, seed).drop("source_no", "offset")


def mix_sources(
    docs: DataFrame,
    cycle: tuple[float, ...] = (1, 2, 3),
    repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row ``(doc_id, source, size, source_size, target, taken)``. (job)

    ``size`` is in words, ``taken`` the words that the spans of the mix take of the row, repeats counted.
    """
    placed, table, wanted = _placed(docs, cycle, repeats, block_words, seed, id_col, text_col, source_col)
    mix = _mix(placed, table, wanted, block_words, shard_slots, seed)
    # an offset is unique among rows of its source that have words; empty rows are in no slot
    taken = mix.groupBy("source_no", "offset").agg(F.sum("words").alias("taken"))
    full = placed.where("size > 0").join(taken, ["source_no", "offset"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return full.select(columns).unionByName(empty.select(columns))


@F.pandas_udf(StringType())
def _span(text: pd.Series, first: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([" ".join(_WORDS.findall(t)[a : a + n]) for t, a, n in zip(text, first, words, strict=True)], dtype=object)


def packed(mix: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(shard, slot, source, block, text)``: the words of every slot of a mix of ``docs``, a space between them."""
    texts = docs.select(row_key(id_col, text_col).alias("rk"), F.col(text_col).cast("string").alias("_text")).dropDuplicates(["rk"])
    part = mix.join(texts, "rk").withColumn("part", F.struct("at", _span("_text", "first_word", "words").alias("text")))
    parts = part.groupBy("shard", "slot", "source", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("shard", "slot", "source", "block", F.array_join(F.col("parts.text"), " ").alias("text"))


def _packing(block_words: int):
    """The words of each row, cut at the blocks of its source's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, block, at, text = [], [], [], []
            for i, (offset, content) in enumerate(zip(batch.column("offset").to_pylist(), batch.column("text"), strict=True)):
                words = _WORDS.findall(content.as_py())
                first = 0
                while first < len(words):
                    number, place = divmod(offset + first, block_words)
                    last = first + block_words - place
                    row.append(i)
                    block.append(number)
                    at.append(place)
                    text.append(" ".join(words[first:last]))
                    first = last
            kept = batch.select(["source_no", "source", "doc_id"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(block, pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.string())], ["source_no", "source", "doc_id", "block", "at", "text"])

    return run


def mix_texts(
    docs: DataFrame,
    cycle: tuple[float, ...] = (1, 2, 3),
    repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: ``(shard, slot, source, block, doc_ids, text)``, a row per slot. (job)

    ``text`` is the block's words, a space between them, ``doc_ids`` the documents they come from, in order. Every text is
    cut into its blocks once; a block of ``block_words`` words is put together where it meets its slots.
    """
    placed, table, wanted = _placed(docs, cycle, repeats, block_words, seed, id_col, text_col, source_col)
    texts = docs.select(row_key(id_col, text_col).alias("rk"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["rk"])
    full = join_skewed(placed.where("size > 0").select("rk", "source_no", "source", "doc_id", "offset"), texts, ["rk"], unique=True)
    kind = lambda c: placed.schema[c].dataType.simpleString()
    pieces = full.mapInArrow(_packing(block_words), f"source_no int, source {kind('source')}, doc_id {kind('doc_id')}, block bigint, at int, text string")
    parts = pieces.groupBy("source_no", "source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "text"))).alias("parts"))
    blocks = parts.select("source_no", "source", "block", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.text", " ").alias("text"))
    slots = _slots(docs.sparkSession, table, wanted, seed, shard_slots)
    return slots.hint("merge").join(blocks.hint("merge"), ["source_no", "block"]).select("shard", "slot", "source", "block", "doc_ids", "text")


def _slots(spark, table: DataFrame, wanted: list[int], seed: int, shard_slots: int) -> DataFrame:
    """The block that each slot of the mix takes: ``(source_no, block, shard, slot)``, slots counting from 0 in their shard."""
    total = sum(wanted)
    if not total:
        return spark.createDataFrame([], "source_no int, block long, shard long, slot long")
    shards = -(-total // shard_slots)
    drawn = spark.range(0, shards, 1, max(1, min(shards // 64, 10_000))).mapInPandas(_draws(wanted, seed, shard_slots), "shard long, source_no int, drawn long")
    drawn = written(drawn, "draws")
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0))).select("shard", "source_no", "first", (F.col("first") + F.col("drawn")).alias("end"))
    short = drawn.groupBy("source_no").agg(F.sum("drawn").alias("first"))
    filled = table.where("wanted > 0").join(short, "source_no", "left").select(F.lit(shards).cast("long").alias("shard"), "source_no", F.coalesce("first", F.lit(0)).alias("first"), F.col("wanted").alias("end"))
    inside = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        runs.unionByName(filled)
        .join(table.select("source_no", "blocks", "wanted"), "source_no")
        .withColumn("end", F.least("end", "wanted"))
        .where("first < end")
        .withColumn("number", F.col("end") - F.col("first"))
        .withColumn("ahead", F.coalesce(F.sum("number").over(inside), F.lit(0)))
        .withColumn("slots", F.sum("number").over(Window.partitionBy("shard")))
        .withColumn("turn", F.explode(F.sequence(F.col("first"), F.col("end") - 1)))
    )
    key = F.xxhash64(F.lit(seed), F.lit("blocks"), "source_no")
    mixed = F.xxhash64(F.lit(seed), F.lit("slots"), "shard")
    slots = slots.withColumn("block", _block_of("turn", "blocks", key)).withColumn("slot", _slot_of(F.col("ahead") + F.col("turn") - F.col("first"), "slots", mixed))
    return slots.select("source_no", "block", "shard", "slot")
