"""Find benchmark passages in documents, also paraphrased ones, by latent semantic retrieval.

*Weights.* Document frequencies of hashed terms are counted over all documents.
*Latent space.* The TF-IDF matrix A of the passages of all documents and all benchmark items is factored by a randomised
SVD in one pass: Y = A'(A Q) for a random test matrix Q, which every task draws from the same seed, is summed over tasks by
blocks of terms; Q'Y and Y'Y, of ``DIMS + EXTRA`` rows, give the leading singular vectors of A by Nystroem's formula. Terms
are folded in with inverse singular values.
*Candidates.* Each benchmark segment is compared by cosine with the windows of its length of all documents, which move by
a quarter to an eighth of it. All windows with a cosine of at least ``LEAST_COSINE`` are candidates.
*Checks.* The longest common subsequence of words of segment and widened window, as share of the segment, and the share
of the answer, the segment's last words, that occurs in order. A segment is found if its subsequence reaches ``LCS_SURE``, or
``LCS_WITH_ANSWER`` with ``ANSWER`` of the answer; an item is found if one of its segments is.

*Scale.* Documents are scanned, never shuffled; a fit task sends one matrix, whatever it reads, and has ``FIT_DOCS`` documents
or more. What is broadcast has fixed size: the term matrix (``TERMS`` x ``DIMS``) and
``QUERIES_AT_ONCE`` segments; a larger benchmark takes several passes.

Words are runs of letters, digits and other characters beyond ASCII, in lower case.

Cases: null and empty texts hold nothing. Items with fewer than ``LEAST_WORDS`` words aren't searched. Items longer than
64 words are cut into segments. Rows with null item ids are searched under null. Rows that repeat id and text give one
result. Other columns are ignored. No rows on either side give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import text as T
from scorewright.llm.store import row_key, whole_row, written

TERMS = 1 << 16
DIMS = 48
EXTRA = 16
FIT_DOCS = 2000
STEP = 4  # words in a block; windows consist of blocks
LEAST_WORDS = 5
LEAST_COSINE = 0.7
RARE, LEAST_RARE = 8, 0  # a candidate holds so many of the segment's rarest words; with 0 none is left out
ANSWER_WORDS = 5
LCS_SURE, LCS_WITH_ANSWER, ANSWER = 0.6, 0.45, 0.8
QUERIES_AT_ONCE = 20_000
BLOCK_PASSAGES = 32  # of one product of the fit
PAIRS_AT_ONCE = 1 << 16  # windows and segments that are found by rare words and whose cosines are taken together: 25 MB
PRODUCT_SIDE, PRODUCT = 1024, 1 << 18  # segments, and segments times windows, of one matrix of cosines: 1 MB
PLACES_AT_ONCE = 1 << 17  # words of windows that are compared with segments together: 1 MB
DENSE = 1 << 18  # segments times words of a table of places, at most
_PARTS = 32


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(TERMS)).astype(np.int64)


# ---------------------------------------------------------------- weights and latent space


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        rows += len(batch)
        for piece in T.pieces(batch.column("text")):
            w = T.words(piece, T.NOT_LETTERS)
            pair = T.distinct(w.row * TERMS + _terms(w.hash))
            total += np.bincount(pair % TERMS, minlength=TERMS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[rows, total[found]])], ["term", "df"])


def inverse_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and log inverse document frequency of every hashed term. (job)"""
    rows = texts.mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most TERMS + 1 rows
    term, count = (rows.column(c).to_numpy() for c in ("term", "df"))
    df = np.zeros(TERMS)
    df[term[term >= 0]] = count[term >= 0]
    n = int(count[term == -1].sum())
    return n, np.log((n + 1) / (df + 1))


@dataclass
class Passages:
    """TF-IDF rows of unit length: row, term and weight of every entry, by row."""

    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    rows: int


def passages(w: T.Words, idf: np.ndarray, size: int = 32) -> Passages:
    """Consecutive stretches of ``size`` words of each text."""
    place = np.arange(len(w.hash)) - w.first[w.row]
    start = place % size == 0
    stretch = np.cumsum(start) - 1
    key, count = np.unique(stretch * TERMS + _terms(w.hash), return_counts=True)
    row, term = key // TERMS, key % TERMS
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, weight**2, minlength=int(start.sum())))
    return Passages(row, term, (weight / np.maximum(norm[row], 1e-12)).astype(np.float32), int(start.sum()))


def _numbered(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x, which are less than ``below``, and the place of each in them."""
    number = np.zeros(below, np.int64)
    number[x] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[x]


def add_products(a: Passages, q: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A Q). A few passages hold few of the terms, so A is dense over the terms of a block of them."""
    terms, local = _numbered(a.term, TERMS)  # rows of the large matrices are fetched and added to once
    q_here, sums = q[terms], np.zeros((len(terms), q.shape[1]), q.dtype)
    at = np.searchsorted(a.row, np.arange(0, a.rows + BLOCK_PASSAGES, BLOCK_PASSAGES))
    for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        term, place = _numbered(local[lo:hi], len(terms))
        block = np.zeros((BLOCK_PASSAGES, len(term)), q.dtype)
        block[a.row[lo:hi] - i * BLOCK_PASSAGES, place] = a.weight[lo:hi]
        sums[term] += block.T @ (block @ q_here[term])
    out[terms] += sums


def _test_matrix(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TERMS, width), np.float32)


def _power_step(sent, width: int, seed: int):
    """A'(A Q) of a task, in blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q, out = sent.value, None, None
        for batch in batches:
            if q is None:
                q, out = _test_matrix(width, seed), np.zeros((TERMS, width))
            for piece in T.pieces(batch.column("text"), 1 << 18):
                a = passages(T.words(piece, T.NOT_LETTERS), idf)
                add_products(a, q, out)
        if out is not None:
            for i, part in enumerate(np.split(out, _PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for x in table.column("sums"):
        block = np.frombuffer(x.as_buffer(), np.float32)
        total = total + block if len(total) else block.astype(np.float64)
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A'B in double precision, by blocks."""
    return sum(x.T.astype(np.float64) @ y.astype(np.float64) for x, y in zip(np.split(a, _PARTS), np.split(b, _PARTS), strict=True))


def latent_terms(texts: DataFrame, idf: np.ndarray, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Term matrix of the latent space of all texts, inverse frequencies and inverse singular values included. (job)"""
    width = dims + EXTRA
    sent = texts.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    y = np.zeros((TERMS, width), np.float32)
    block = TERMS // _PARTS
    for r in texts.mapInArrow(_power_step(sent, width, seed), "part long, sums binary").groupBy("part").applyInArrow(_added, "part long, sums binary").collect():
        y[r["part"] * block : (r["part"] + 1) * block] = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
    sent.destroy()
    core = _crossed(_test_matrix(width, seed), y)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-6 * max(value[-1], 1e-30)  # less is rounding
    half = vector[:, good] / np.sqrt(value[good])
    square, turn = np.linalg.eigh(half.T @ _crossed(y, y) @ half)  # squares of the singular values of A
    square, turn = square[::-1][:dims], turn[:, ::-1][:, :dims]
    good = square > 1e-6 * max(square.max(initial=0.0), 1e-30)
    fold = np.zeros((TERMS, dims), np.float32)
    fold[:, : good.sum()] = y @ (half @ (turn[:, good] / square[good])).astype(np.float32)
    fold *= idf[:, None].astype(np.float32)
    return fold


# ---------------------------------------------------------------- queries and windows


@dataclass
class Queries:
    """Segments of the benchmark: item, words, unit vector, blocks in a window, rarest words."""

    item: list
    words: list[np.ndarray]
    vector: np.ndarray
    blocks: np.ndarray
    rare_hash: np.ndarray  # sorted, with the segment of each
    rare_of: np.ndarray
    words_all: np.ndarray  # the words of all segments, sorted
    sizes: np.ndarray
    places: tuple[np.ndarray, np.ndarray]  # segment and number in words_all as one sorted number, the bits of the places

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in ``words_all``; those that no segment has get the number behind the last."""
        slot = np.searchsorted(self.words_all, hashes)
        slot[self.words_all[np.minimum(slot, len(self.words_all) - 1)] != hashes] = len(self.words_all)
        return slot

    def masks(self, segment: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Bits of the places where the words ``slot``, a column for each of ``segment``, stand in it."""
        key, bits = self.places
        wide = len(self.words_all) + 1
        distinct, number = np.unique(segment, return_inverse=True)
        if len(distinct) * wide <= DENSE:
            table = np.zeros((len(distinct), wide), np.uint64)
            lo, hi = np.searchsorted(key, distinct * wide), np.searchsorted(key, (distinct + 1) * wide)
            for i, (x, y) in enumerate(zip(lo, hi, strict=True)):
                table[i, key[x:y] - distinct[i] * wide] = bits[x:y]
            return table.ravel()[slot + number * wide]
        wanted = segment * wide + slot
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.where(key[at] == wanted, bits[at], np.uint64(0))


def queries(items: list[tuple], fold: np.ndarray, idf: np.ndarray) -> Queries:
    """Segments of up to 64 words of the items (id, text)."""
    item, words = [], []
    for ident, content in items:
        for piece in T.pieces(pa.array([content], pa.string())):
            h = T.words(piece, T.NOT_LETTERS).hash
            if len(h) < LEAST_WORDS:
                continue
            for part in np.array_split(h, math.ceil(len(h) / 64)):
                item.append(ident)
                words.append(part)
    vector = np.zeros((len(words), fold.shape[1]), np.float32)
    rare_hash, rare_of = [], []
    for i, h in enumerate(words):
        x = fold[_terms(h)].sum(axis=0)
        vector[i] = x / max(float(np.linalg.norm(x)), 1e-9)
        distinct = np.unique(h)
        picked = distinct[np.argsort(-idf[_terms(distinct)], kind="stable")[:RARE]]
        rare_hash.append(picked)
        rare_of.append(np.full(len(picked), i))
    blocks = np.array([max(1, round(len(h) / STEP)) for h in words], np.int64)
    rare_hash, rare_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rare_hash, rare_of))
    turn = np.lexsort((rare_of, rare_hash))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    size = np.array([len(h) for h in words], np.int64)
    words_all, slot = np.unique(flat, return_inverse=True)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    key, at = np.unique(np.repeat(np.arange(len(words)), size) * (len(words_all) + 1) + slot, return_inverse=True)
    bits = np.zeros(len(key), np.uint64)
    np.bitwise_or.at(bits, at, np.uint64(1) << place.astype(np.uint64))
    return Queries(item, words, vector, blocks, rare_hash[turn].astype(np.uint64), rare_of[turn], words_all, size, (key, bits))


def common_subsequence(words: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of ``words`` and the sequence whose places per word are ``masks``."""
    full = (1 << size) - 1
    v = full
    for x in words:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, h in enumerate(words):
        out[h] = out.get(h, 0) | (1 << i)
    return out


def common_subsequences(masks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for many pairs at once, of up to 64 places: a column of ``masks`` has those of the words of one sequence."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - size).astype(np.uint64)
    v = full.copy()
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - np.bitwise_count(v)


def _rare_hits(w: T.Words, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Places where rare words of segments stand, as sorted numbers of segment and place."""
    distinct = np.unique(q.rare_hash)
    slot = np.searchsorted(distinct, w.hash)
    place = np.flatnonzero(distinct[np.minimum(slot, len(distinct) - 1)] == w.hash)
    lo, hi = np.searchsorted(q.rare_hash, w.hash[place]), np.searchsorted(q.rare_hash, w.hash[place], "right")
    many = hi - lo
    which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.sort(q.rare_of[which] * np.int64(len(w.hash) + 1) + np.repeat(place, many)), place


def _rare_pairs(segment: np.ndarray, place: np.ndarray, from_: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a window and a segment with ``LEAST_RARE`` of its rare words between ``from_`` and ``to``, windows of a
    segment in ascending order. Both ends ascend with the window, so each stretch of ``LEAST_RARE`` hits lies in one run of
    windows; a run begins where the last one of its segment ended."""
    more = LEAST_RARE - 1
    near = np.flatnonzero(segment[: len(segment) - more] == segment[more:])
    segment, lo, hi = segment[near], np.searchsorted(to, place[near + more], "right"), np.searchsorted(from_, place[near], "right")
    lo[1:] = np.where(segment[1:] == segment[:-1], np.maximum(lo[1:], hi[:-1]), lo[1:])
    yield from _runs(segment, lo, hi)


def _runs(segment: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows lo to hi, each with its segment, ``PAIRS_AT_ONCE`` at a time."""
    many = np.maximum(hi - lo, 0)
    upto = np.cumsum(many)
    for begin in range(0, int(many.sum()), PAIRS_AT_ONCE):
        pair = np.arange(begin, min(begin + PAIRS_AT_ONCE, int(upto[-1])))
        run = np.searchsorted(upto, pair, "right")
        yield lo[run] + pair - (upto - many)[run], segment[run]


def passes(common: float, answer: float) -> bool:
    """Whether a window with these shares of a segment and its answer holds the segment."""
    return common >= LCS_SURE or (common >= LCS_WITH_ANSWER and answer >= ANSWER)


def _near(pairs: Iterator[tuple[np.ndarray, np.ndarray]], vector: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, segment, cosine) of those of the pairs that reach ``LEAST_COSINE``."""
    for window, segment in pairs:
        own = vector[window]
        value = np.einsum("ij,ij->i", own, of[segment]) / np.maximum(np.linalg.norm(own, axis=1), 1e-9)
        near = value >= LEAST_COSINE
        yield window[near], segment[near], value[near]


def _cosines(vector: np.ndarray, of: np.ndarray, segments: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, segment, cosine) of all pairs of windows and segments that reach ``LEAST_COSINE``; ``of`` are the segments'
    unit vectors."""
    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", vector, vector)), 1e-9)
    least = LEAST_COSINE * norm
    for own in range(0, len(segments), PRODUCT_SIDE):
        turned = np.ascontiguousarray(of[own : own + PRODUCT_SIDE].T)
        windows = max(1, PRODUCT // turned.shape[1])
        for lo in range(0, len(vector), windows):
            dot = vector[lo : lo + windows] @ turned
            hit = np.flatnonzero(dot >= least[lo : lo + windows, None])
            if len(hit):
                i, j = np.divmod(hit, turned.shape[1])
                yield lo + i, segments[own + j], dot.ravel()[hit] / norm[lo + i]


def _shares(q: Queries, slot: np.ndarray, from_: np.ndarray, to: np.ndarray, segment: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, common share, answer share) of segments and the words from ``from_`` to ``to``, for those pairs that have
    ``LCS_WITH_ANSWER`` of the segment in common, which both rules ask for. ``slot`` has one number behind the last word, of
    no word."""
    longest = int((to - from_).max())
    for some in np.array_split(np.arange(len(segment)), 1 + len(segment) * longest // PLACES_AT_ONCE):
        place = from_[some] + np.arange(longest)[:, None]
        masks = q.masks(segment[some], slot[np.where(place < to[some], place, len(slot) - 1)])
        size = q.sizes[segment[some]]
        for share in (lambda: np.count_nonzero(masks, axis=0) / size, lambda: common_subsequences(masks, size) / size):  # the first is no less
            common = share()
            enough = np.flatnonzero(common >= LCS_WITH_ANSWER)
            some, masks, size, common = some[enough], masks[:, enough], size[enough], common[enough]
        tail = np.minimum(size, ANSWER_WORDS)
        yield some, common, common_subsequences(masks >> (size - tail).astype(np.uint64), tail) / tail


def found_in(w: T.Words, fold: np.ndarray, q: Queries) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, segment, cosine, common share, answer share) of the candidates among a piece's windows that have
    ``LCS_WITH_ANSWER`` in common; of several windows of a row and segment the one that has most in common, of those that
    pass if there are any."""
    if not len(w.hash) or not len(q.words):
        return
    if LEAST_RARE:
        hits, _ = _rare_hits(w, q)
        of, place = hits // (len(w.hash) + 1), hits % (len(w.hash) + 1)
    n = np.diff(w.first)
    per_row = -(-n // STEP)
    ahead = np.cumsum(per_row) - per_row
    row = np.repeat(np.arange(len(n)), per_row)
    at = np.arange(len(row))
    local, last = at - ahead[row], (ahead + per_row)[row]
    start = w.first[row] + STEP * local
    term, stop = _terms(w.hash), w.first[row + 1]
    block = np.zeros((len(start), fold.shape[1]), np.float32)
    for k in range(STEP):  # the last row of fold is zero: for places behind the text
        block += fold.take(np.where(start + k < stop, term[np.minimum(start + k, len(term) - 1)], TERMS), axis=0)
    sums, blocks = block.copy(), 1  # of windows of so many blocks; at the end of a text, of those that are left
    slot = np.r_[q.slots(w.hash), len(q.words_all)]
    found: list[tuple] = []
    for size in np.unique(q.blocks):
        stride = 1 if size <= 6 else 2
        if stride == 2 and len(at) == len(row):
            at = at[local % 2 == 0]
            sums = sums[at]
        for blocks in range(blocks, int(size)):
            short = np.flatnonzero(at + blocks >= last[at])
            kept = sums[short]
            sums += block.take(at + blocks, axis=0, mode="clip")
            sums[short] = kept
        blocks = int(size)
        moved = np.flatnonzero((local[at] == 0) | (local[at] + size < per_row[row[at]] + stride))
        first, vector = at[moved], sums if len(moved) == len(at) else sums[moved]
        spare = STEP * int(size) // 2
        from_, to = np.maximum(w.first[row[first]], start[first] - spare), np.minimum(w.first[row[first] + 1], start[first] + STEP * int(size) + spare)
        segments = np.flatnonzero(q.blocks == size)
        if LEAST_RARE:
            pairs = _near(_rare_pairs(of[q.blocks[of] == size], place[q.blocks[of] == size], from_, to), vector, q.vector)
        else:
            pairs = _cosines(vector, q.vector[segments], segments)
        near = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        if near:
            window, segment, value = near
            some, common, answer = (np.concatenate(x) for x in zip(*_shares(q, slot, from_[window], to[window], segment), strict=True))
            window = window[some]
            found.append((row[first[window]], segment[some], start[first[window]], value[some], common, answer))
    if not found:
        return
    of_row, segment, place, value, common, answer = (np.concatenate(x) for x in zip(*found, strict=True))
    good = (common >= LCS_SURE) | ((common >= LCS_WITH_ANSWER) & (answer >= ANSWER))  # as in passes()
    # a window that passes, by whichever rule, goes before one with more in common that doesn't
    turn = np.lexsort((place, -common, ~good, segment, of_row))
    if not len(turn):
        return
    of_row, segment = of_row[turn], segment[turn]
    best = np.flatnonzero(np.r_[True, (of_row[1:] != of_row[:-1]) | (segment[1:] != segment[:-1])])
    for facts in zip(*(x.tolist() for x in (of_row[best], segment[best], value[turn[best]], common[turn[best]], answer[turn[best]])), strict=True):
        yield facts


def _search(sent, item_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, q = sent.value
        fold = np.vstack([fold, np.zeros((1, fold.shape[1]), np.float32)])
        for batch in batches:
            out = []
            for piece in T.pieces(batch.column("text")):
                for r, s, cosine, common, answer in found_in(T.words(piece, T.NOT_LETTERS), fold, q):
                    if passes(common, answer):
                        out.append((piece.lo + r, q.item[s], cosine, common, answer))
            if out:
                at, item, *facts = zip(*out, strict=True)
                kept = batch.select(["doc_id", "rk"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(item, item_type), *(pa.array(f, pa.float64()) for f in facts)], ["doc_id", "rk", "item_id", "cosine", "common", "answer"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, rk, item_id, cosine, common, answer)``: which rows hold which benchmark items. (job)"""
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("rk"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, rk long, item_id long, cosine double, common double, answer double"
    count, idf = inverse_frequencies(base.select("text"))
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, count // FIT_DOCS))  # neighbouring splits share a task
    fold = latent_terms(base.select("text").unionByName(items.select("text")).coalesce(tasks), idf)

    out, held = spark.createDataFrame([], kind), []
    for row in items.orderBy("item", "text").toLocalIterator():
        held.append((row["item"], row["text"]))
        if len(held) == QUERIES_AT_ONCE:
            out, held = out.unionByName(base.mapInArrow(_search(spark.sparkContext.broadcast((fold, queries(held, fold, idf))), pa.int64()), kind)), []
    if held:
        out = out.unionByName(base.mapInArrow(_search(spark.sparkContext.broadcast((fold, queries(held, fold, idf))), pa.int64()), kind))
    return out.groupBy("doc_id", "rk", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answer").alias("answer"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The input rows that hold no benchmark item. (job)"""
    found = written(leaks(docs, benchmark, id_col, text_col, **columns).select(F.col("rk").alias("_rk")).distinct(), "leaks")
    rows = docs.select(whole_row(docs).alias("row"), row_key(id_col, text_col).alias("_rk"))
    return rows.join(found, "_rk", "left_anti").select("row.*")
