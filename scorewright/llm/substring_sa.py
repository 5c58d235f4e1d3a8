"""Remove long byte strings that occur more than once, by sharded suffix arrays.

*Anchors.* In every window of ``length`` bytes the k-gram of smallest hash is an anchor (k = ``gram``). Equal windows share
an anchor hash, so only anchors whose hash occurs again can lie in a repeated window. Around each such anchor its
context, the bytes that windows over the anchor can reach, is looked at.

*Equal contexts* are repeated as a whole; they are found by an aggregate on context hashes, and one of each goes on.

*Shards.* The different contexts of an anchor hash meet in one shard of bounded size. There a suffix array of the joined
contexts is built by Larsson-Sadakane refinement (groups of suffixes that agree in h bytes are split by the ranks h bytes
on, sorted groups rest), Kasai's method gives common prefixes of neighbours, and runs of neighbours with at least
``length`` common bytes that stem from different places are repeated strings.

*Hot anchors.* A hash with more contexts than a shard may hold is split over several shards. These send the
fingerprints of their windows in sorted arrays, cut by fingerprint range, and each range merges the arrays of all
shards by binary search. Of windows that repeat within a shard, and so go in any case, one is sent.

A byte is removed if a repeated window covers it. All copies are removed, the first one too; windows are judged on the
input. Hashes have 64 bits and are compared only under an equal anchor hash of 64 bits.

Cases: null text is empty; texts shorter than ``length`` lose nothing. Ids may be null or repeat; a repeated row is a copy of
the other. Periodic text covers itself where it repeats ``length`` bytes. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import text as T
from scorewright.llm.store import row_key, written

LENGTH = 400
GRAM = 100
SHARD_BYTES = 1 << 20  # a suffix array takes about a hundred times as much
HOT_CONTEXTS = 1024
_PLACE_BITS = np.uint64(28)


# ---------------------------------------------------------------- anchors


def window_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every window of ``width`` values."""
    n = len(value)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def thinned(place: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Of neighbouring anchors with equal hashes (periodic text), enough that every window keeps one."""
    same = value[1:] == value[:-1]
    if not same.any():
        return place
    keep, last = np.ones(len(place), bool), place[0]
    for i in np.flatnonzero(same[:-1] & same[1:]) + 1:  # has an equal neighbour on either side
        if keep[i - 1]:
            last = place[i - 1]
        if place[i + 1] <= last + width:
            keep[i] = False
        else:
            last = place[i]
    return place[keep]


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the anchors, given the hash of the k-gram at every place of a text."""
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams >> _PLACE_BITS << _PLACE_BITS) | place
    least = window_least(packed, width)
    found = T.distinct(least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    return thinned(found, grams[found], width)


def _anchor_table(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("rk").to_numpy()
            for piece in T.pieces(batch.column("text")):
                sums = T.prefix_sums(piece.data)
                out: list[tuple] = []
                for i in range(piece.hi - piece.lo):
                    lo, hi = int(piece.offsets[i]), int(piece.offsets[i + 1])
                    if hi - lo < length:
                        continue
                    at = np.arange(lo, hi - gram + 1)
                    grams = T.span_hash(sums, at, at + gram)
                    place = anchors(grams, length - gram + 1)
                    left = np.minimum(place, length - gram)
                    right = np.minimum(hi - lo - place, length)
                    context = T.mix(T.span_hash(sums, lo + place - left, lo + place + right) ^ left.astype(np.uint64))
                    out.append((np.full(len(place), keys[piece.lo + i]), place, left, right, grams[place], context))
                if out:
                    rk, place, left, right, grams, context = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rk), *(pa.array(x.astype(np.int32)) for x in (place, left, right)), pa.array(grams.view(np.int64)), pa.array(context.view(np.int64))],
                        ["rk", "pos", "before", "after", "h", "ctx"],
                    )

    return run


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, by refinement of groups that agree in h bytes; h doubles from 8."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    # suffixes that end within eight bytes tie with others that go on with zero bytes; the next step parts them
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    size = np.diff(np.r_[start, n])
    slots = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while len(slots):
        suffix = order[slots]
        ahead = suffix + h
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, n - 1 - ahead)  # past the end: shorter first
        group = rank[suffix]
        pair = group * (2 * n + 2 * h + 4) + (then + n + 2 * h)
        turn = np.argsort(pair, kind="stable")
        pair = pair[turn]
        order[slots] = suffix[turn]
        new = np.r_[True, pair[1:] != pair[:-1]]
        start = np.flatnonzero(new)
        rank[order[slots]] = slots[start][np.cumsum(new) - 1]
        size = np.diff(np.r_[start, len(slots)])
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """Common prefix of every suffix with the one before it in order. Kasai's method in lockstep over stretches of the
    text: each lane goes through its stretch in text order and keeps one less than the last common prefix."""
    n = len(data)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    padded = np.r_[data.astype(np.int16), np.int16(-1)]
    step = -(-n // lanes)
    at = np.arange(0, n, step)
    stop = np.minimum(at + step, n)
    shared = np.zeros(len(at), np.int64)
    while len(at):
        where = slot[at]
        other = order[np.maximum(where - 1, 0)]
        a, b = np.minimum(at + shared, n), np.minimum(other + shared, n)
        more = (padded[a] == padded[b]) & (where > 0) & (a < n) & (b < n)
        done = ~more
        lcp[where[done]] = np.where(where[done] > 0, shared[done], 0)
        shared = np.where(more, shared + 1, np.where(where > 0, np.maximum(shared - 1, 0), 0))
        at = at + done
        alive = at < stop
        if not alive.all():
            at, stop, shared = at[alive], stop[alive], shared[alive]
    return lcp


def repeated_windows(contexts: list[bytes], owner: np.ndarray, first: np.ndarray, copies: np.ndarray, length: int):
    """Windows of the contexts by class of equal windows.

    ``owner`` and ``first`` give document and place of each context's first byte, ``copies`` how often it occurs. Returns the
    context and offset of every window, its class, and of every class whether it stems from several places.
    """
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data = np.frombuffer(b"\0".join(contexts), np.uint8)
    order = suffix_array(data)
    lcp = common_prefixes(data, order)
    which = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[which]
    whole = offset + length <= sizes[which]
    label = np.cumsum(lcp < length)[whole]
    which, offset = which[whole], offset[whole]
    if not len(label):
        return which, offset, label, np.zeros(0, bool)
    new = np.r_[True, label[1:] != label[:-1]]
    label, start = np.cumsum(new) - 1, np.flatnonzero(new)
    _, document = np.unique(owner, return_inverse=True)
    place = document[which] * np.int64(1 << 40) + first[which] + offset
    several = np.minimum.reduceat(place, start) != np.maximum.reduceat(place, start)
    return which, offset, label, several | (np.maximum.reduceat(copies[which], start) > 1)


def _spans(which: np.ndarray, offset: np.ndarray, owner: np.ndarray, first: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows joined to spans of their documents."""
    turn = np.lexsort((offset, which))
    which, offset = which[turn], offset[turn]
    new = np.r_[True, (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + length)] if len(which) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(which)] - 1 if len(start) else start
    lo = first[which[start]] + offset[start]
    return pa.RecordBatch.from_arrays([pa.array(owner[which[start]]), pa.array(lo), pa.array(first[which[end]] + offset[end] + length)], ["rk", "lo", "hi"])


def _shard(length: int):
    """One shard: spans of its repeated windows, and for a hot anchor the fingerprints of all its windows."""

    def run(table: pa.Table) -> pa.Table:
        contexts = [c.as_py() for c in table.column("bytes")]
        owner, first, copies = (table.column(c).to_numpy() for c in ("rk", "first", "copies"))
        which, offset, label, several = repeated_windows(contexts, owner, first, copies, length)
        hit = several[label] & (copies[which] == 1)
        spans = _spans(which[hit], offset[hit], owner, first, length)
        out = [pa.RecordBatch.from_arrays([*spans.columns, *(pa.nulls(len(spans), t) for t in (pa.int64(), pa.int64(), pa.binary()))], _SHARD.names)]
        split = int(table.column("split")[0].as_py())
        if split > 1 and len(label):
            sums = T.prefix_sums(np.frombuffer(b"".join(contexts), np.uint8))
            base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])[:-1]])
            at = base[which] + offset
            done = several[label] | (copies[which] > 1)
            sent = ~done | np.r_[True, label[1:] != label[:-1]]
            at, which, offset, done = at[sent], which[sent], offset[sent], done[sent]
            rows = np.empty(len(at), _ROW)
            rows["f"], rows["rk"], rows["lo"], rows["done"] = T.span_hash(sums, at, at + length), owner[which], first[which] + offset, done
            rows = rows[np.lexsort((rows["lo"], rows["rk"], rows["f"]))]
            h = table.column("s1")[0].as_py()
            part = (rows["f"] >> np.uint64(32)) * np.uint64(4 * split) >> np.uint64(32)
            for p in np.unique(part):
                blob = rows[part == p].tobytes()
                out.append(pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([h]), pa.array([int(p)]), pa.array([blob], pa.binary())], _SHARD.names))
        return pa.Table.from_batches(out, _SHARD)

    return run


_SHARD = pa.schema([("rk", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("part", pa.int64()), ("windows", pa.binary())])
_ROW = np.dtype([("f", np.uint64), ("rk", np.int64), ("lo", np.int64), ("done", np.bool_)])


def merged(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted array of window fingerprints, which of them occur in another array too; by binary search."""
    out = [np.zeros(len(a), bool) for a in arrays]
    for i, a in enumerate(arrays):
        for j, b in enumerate(arrays):
            if i != j and len(b):
                out[i] |= b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
    return out


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), _ROW) for x in table.column("windows")]
        found = merged([r["f"] for r in rows])
        hits = [r[f & ~r["done"]] for r, f in zip(rows, found, strict=True)]
        hits = np.concatenate(hits) if hits else np.zeros(0, _ROW)
        return pa.table({"rk": hits["rk"], "lo": hits["lo"], "hi": hits["lo"] + length})

    return run


# ---------------------------------------------------------------- documents


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("split", pa.int64()), ("rk", pa.int64()), ("first", pa.int64()), ("copies", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        out, held = [], 0
        for text, rk, found in zip(batch.column("text"), batch.column("rk"), batch.column("found"), strict=True):
            data = (text.as_py() or "").encode()
            for a in found.as_py():
                context = data[a["pos"] - a["before"] : a["pos"] + a["after"]]
                out.append((a["s1"], a["s2"], a["split"], rk.as_py(), a["pos"] - a["before"], a["copies"], context))
                held += len(context)
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema.names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema.names)


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """Number of maximal removed runs, and the parts that stay."""
    at, runs, kept, end = 0, 0, [], -1
    for lo, hi in sorted(spans):
        if lo > end:
            runs += 1
            kept.append(data[at:lo])
        end = max(end, hi)
        at = end
    kept.append(data[at:])
    return runs, kept


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, runs, digest = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = (text.as_py() or "").encode()
            k, kept = cut_spans(data, [(s["lo"], s["hi"]) for s in spans.as_py() or []])
            sha = hashlib.sha256()
            for part in kept:
                sha.update(part)
            n.append(len(data))
            gone.append(len(data) - sum(map(len, kept)))
            runs.append(k)
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digest, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(base: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(rk, lo, hi)``: byte spans that repeated windows cover, for rows (rk, text). Spans may overlap. (job)"""
    found = written(base.mapInArrow(_anchor_table(length, gram), "rk long, pos int, before int, after int, h long, ctx long"), "anchors")
    again = found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    members = written(found.join(again, "h"), "members")
    classes = members.groupBy("h", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("rk", "pos", "before", "after")).alias("one"))
    classes = written(classes, "classes")
    whole = members.join(classes.where("copies > 1").select("h", "ctx"), ["h", "ctx"])
    whole = whole.select("rk", (F.col("pos") - F.col("before")).cast("long").alias("lo"), (F.col("pos") + F.col("after")).cast("long").alias("hi"))

    several = classes.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    several = several.withColumn("split", F.when(F.col("different") > hot_contexts, F.ceil(F.col("different") / hot_contexts)).otherwise(1).cast("long"))
    chosen = written(classes.join(several, "h"), "chosen")
    shards = max(1, math.ceil(chosen.count() * 2 * length / shard_bytes))
    hot = F.col("split") > 1
    placed = chosen.select(
        F.col("one.rk").alias("rk"),
        F.struct(
            "one.pos", "one.before", "one.after", "copies", "split",
            F.when(hot, F.col("h")).otherwise(F.pmod(F.shiftright("h", 7), F.lit(shards))).alias("s1"),
            F.when(hot, 1 + F.pmod(F.shiftright("ctx", 5), F.col("split"))).otherwise(F.lit(0)).alias("s2"),
        ).alias("a"),
    )
    per_doc = placed.groupBy("rk").agg(F.collect_list("a").alias("found"))
    pieces = base.join(per_doc, "rk").select("rk", "text", "found").mapInArrow(
        _contexts, "s1 long, s2 long, split long, rk long, first long, copies long, bytes binary"
    )
    local = written(pieces.groupBy("s1", "s2").applyInArrow(_shard(length), "rk long, lo long, hi long, h long, part long, windows binary"), "shards")
    across = local.where("windows is not null").groupBy("h", "part").applyInArrow(_merge(length), "rk long, lo long, hi long")
    return whole.unionByName(local.where("windows is null").select("rk", "lo", "hi")).unionByName(across)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row. (job)"""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("rk"))
    spans = repeated_spans(base.select("rk", "text"), length, gram, **limits)
    per_doc = spans.groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    return base.join(per_doc, "rk", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
