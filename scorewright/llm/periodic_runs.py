"""Stretches of words that repeat with a period, at least three times over: where they are, and texts without the repeats.

A run is a stretch of consecutive words in which words one period apart are equal, that no neighbouring word extends, of at
least ``least_words`` words and three periods, under its smallest period. Texts are independent, so each is looked at where
it lies; nothing is shuffled.

*Grid.* A run of period q and length L has L - q neighbouring places whose word returns q on, at least
g = max(least_words - q, 2 q) of them, so one of them is a multiple of g. For every period up to a third of the text the
grid places are tried: a harmonic series, some n log n places in all. At a place whose word returns, the run is as long as
the words from the two places on agree (forward), and before them (backward).

*Longest common extensions* of two places come from a difference cover: a set of residues of which any two places have a
pair within ``COVER`` words. The few words up to that pair are compared as they are; most places differ there. Only for
texts in which some don't, the suffixes at cover places are sorted: by their first ``COVER`` words, then by doubling, where
only groups that still tie are sorted again. Common prefixes of neighbours follow from the ranks kept of each doubling step,
largest step first, and a sparse table gives their least over any range. Backward extensions are those of the reversed text.

Words are compared by number, and numbers are given by the words themselves, not by hashes, so results are exact. Memory
grows with one piece of some megabytes of texts, or the longest text, times the logarithm of its length.

Cases: null text has no words. A text shorter than ``least_words`` has no runs. Periods that are multiples of a smaller
one of the same stretch don't count. Rows and other columns pass through, repeated rows too; a column named like a result
column is an error. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorewright.llm import text as T

LEAST_WORDS = 24
#: A perfect difference set, whose differences are all residues
COVER = 31
RESIDUES = (0, 1, 3, 8, 12, 18)
GRID_AT_ONCE = 1 << 20
OPEN_AT_ONCE = 1 << 20

_SAMPLED = np.isin(np.arange(COVER), RESIDUES)
_RESULT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _steps() -> np.ndarray:
    """For two residues, the least number of steps after which both are in the cover."""
    out = np.full((COVER, COVER), -1, np.int8)
    for h in range(COVER - 1, -1, -1):
        at = np.flatnonzero(_SAMPLED[(np.arange(COVER) + h) % COVER])
        out[np.ix_(at, at)] = h
    return out


STEPS = _steps()


@dataclass
class Texts:
    """Numbered words of several texts, one after another; ``lo`` and ``hi`` bound the text of every word."""

    ids: np.ndarray
    first: np.ndarray  # where each text begins, and one past the last

    def __post_init__(self) -> None:
        sizes = np.diff(self.first)
        self.lo, self.hi = (np.repeat(e, sizes) for e in (self.first[:-1], self.first[1:]))

    def reversed(self) -> Texts:
        """Every text back to front. The word at ``i`` is then at ``lo + hi - 1 - i``."""
        place = np.arange(len(self.ids))
        return Texts(self.ids[self.lo + self.hi - 1 - place], self.first)


def agree_up_to_cover(t: Texts, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from ``i`` and from ``j`` on agree before the next pair of cover places, and whether all do.

    ``i < j`` lie in one text; the later one's text may end before the pair, which settles it."""
    steps = STEPS[(i - t.lo[i]) % COVER, (j - t.lo[j]) % COVER].astype(np.int64)
    most = np.minimum(steps, t.hi[j] - j)
    n, going = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(COVER):
        going = going[most[going] > k]
        if not len(going):
            break
        going = going[t.ids[i[going] + k] == t.ids[j[going] + k]]
        n[going] = k + 1
    return n, (n == steps) & (j + n < t.hi[j])


class CoverSuffixes:
    """Sorted suffixes at the cover places of some texts, for the common prefix of any two of them.

    Suffixes end with their text: what follows counts as equal, and lengths are cut at the end of either text."""

    def __init__(self, t: Texts) -> None:
        self.t = t
        places = np.arange(len(t.ids))
        self.place = places[_SAMPLED[(places - t.lo) % COVER]]
        self.number = np.full(len(t.ids), -1, np.int32)
        self.number[self.place] = np.arange(len(self.place))
        self.end = t.hi[self.place]
        self.levels: list[np.ndarray] = []
        group, open_ = self._by_cover_words()
        self.levels.append(group.astype(np.int32))
        span, longest = COVER, int(np.diff(t.first).max(initial=0))
        while len(open_) and span < longest:
            group, open_ = self._split(group, open_, self._rank_after(self.levels[-1], open_, span))
            self.levels.append(group.astype(np.int32))
            span *= 2
        self.order = np.argsort(group, kind="stable")
        self.rank = np.empty(len(group), np.int64)
        self.rank[self.order] = np.arange(len(group))
        self.table = [self._neighbours()]
        while 2 * (1 << (len(self.table) - 1)) <= len(self.table[0]):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _split(group: np.ndarray, open_: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sort within the groups that tie. A group's number is the rank of its first member, so others keep theirs."""
        order = np.lexsort((key, group[open_]))
        member, key = open_[order], key[order]
        old = group[member]
        at = np.arange(len(member))
        begins = np.r_[True, old[1:] != old[:-1]]
        parts = begins | np.r_[True, key[1:] != key[:-1]]
        group = group.copy()
        group[member] = old + np.maximum.accumulate(np.where(parts, at, 0)) - np.maximum.accumulate(np.where(begins, at, 0))
        alone = parts & np.r_[parts[1:], True]
        return group, member[~alone]

    def _by_cover_words(self) -> tuple[np.ndarray, np.ndarray]:
        group, open_ = np.zeros(len(self.place), np.int64), np.arange(len(self.place))
        bits = int(self.t.ids.max(initial=0) + 2).bit_length()
        per_key = 63 // bits
        for lo in range(0, COVER, per_key):
            if not len(open_):
                break
            key = np.zeros(len(open_), np.int64)
            for k in range(lo, min(COVER, lo + per_key)):
                at = self.place[open_] + k
                inside = at < self.end[open_]
                key = key << bits | np.where(inside, self.t.ids[np.where(inside, at, 0)].astype(np.int64) + 1, 0)
            group, open_ = self._split(group, open_, key)
        return group, open_

    def _rank_after(self, level: np.ndarray, which: np.ndarray, span: int) -> np.ndarray:
        at = self.place[which] + span
        inside = at < self.end[which]
        return np.where(inside, level[self.number[np.where(inside, at, self.place[0])]].astype(np.int64) + 1, 0)

    def _neighbours(self) -> np.ndarray:
        """Common prefix of each suffix, in order, with the next."""
        a, b = self.place[self.order[:-1]], self.place[self.order[1:]]
        ends = np.minimum(self.t.hi[a] - a, self.t.hi[b] - b)
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            going = np.flatnonzero(n < ends)
            level = self.levels[k]
            same = going[level[self.number[a[going] + n[going]]] == level[self.number[b[going] + n[going]]]]
            n[same] += COVER << k
        going = np.flatnonzero(n < ends)
        for _ in range(COVER):
            going = going[self.t.ids[a[going] + n[going]] == self.t.ids[b[going] + n[going]]]
            n[going] += 1
            going = going[n[going] < ends[going]]
            if not len(going):
                break
        return np.minimum(n, ends).astype(np.int32)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from cover places ``i < j`` of one text on."""
        a, b = self.rank[self.number[i]], self.rank[self.number[j]]
        lo, width = np.minimum(a, b), np.abs(a - b)
        out = np.zeros(len(i), np.int64)
        level = np.frexp(width)[1] - 1
        for k in np.unique(level):
            at = level == k
            row, first, last = self.table[k], lo[at], lo[at] + width[at] - (1 << k)
            out[at] = np.minimum(row[first], row[last])
        return np.minimum(out, self.t.hi[j] - j)


def grid(sizes: np.ndarray, least_words: int, at_once: int = GRID_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in the text, period) of all grid places, about ``at_once`` of them at a time."""
    periods = np.where(sizes >= least_words, sizes // 3, 0)
    text_of = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text_of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    apart = np.maximum(least_words - period, 2 * period)
    places = -(-(sizes[text_of] - period) // apart)
    upto = np.concatenate([[0], np.cumsum(places)])
    lo = 0
    while lo < len(period):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, "right")) - 1)
        which = np.repeat(np.arange(lo, hi), places[lo:hi])
        k = np.arange(upto[lo], upto[hi]) - upto[which]
        yield text_of[which], k * apart[which], period[which]
        lo = hi


class _Finder:
    """Collects runs; sorts suffixes only for texts with a pair of places that the words up to the cover don't settle."""

    def __init__(self, t: Texts, least_words: int) -> None:
        self.t, self.least = t, least_words
        self.back = t.reversed()
        self.found: list[np.ndarray] = []  # (start, end, period) by place
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0
        self.sorted_for: np.ndarray | None = None

    def add(self, i: np.ndarray, q: np.ndarray) -> None:
        t = self.t
        here = t.ids[i] == t.ids[i + q]
        i, q = i[here], q[here]
        ahead, ahead_open = agree_up_to_cover(t, i, i + q)
        behind, behind_open = self._before(i, q)
        settled = ~(ahead_open | behind_open)
        self._keep(i[settled] - behind[settled], (i + q + ahead)[settled], q[settled])
        rest = np.flatnonzero(~settled)
        self.waiting.append((i[rest], q[rest], ahead[rest], ahead_open[rest], behind[rest], behind_open[rest]))
        self.n_waiting += len(rest)
        if self.n_waiting > OPEN_AT_ONCE:
            self.settle()

    def _before(self, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`agree_up_to_cover`, for the words before the two places."""
        lo, hi = self.t.lo[i], self.t.hi[i]
        some = i > lo
        n, is_open = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        at = (lo + hi - i)[some]  # the word before, in the reversed text
        n[some], is_open[some] = agree_up_to_cover(self.back, at - q[some], at)
        return n, is_open

    def _keep(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> None:
        long = end - start >= np.maximum(self.least, 3 * q)
        if long.any():
            self.found.append(np.stack([start[long], end[long], q[long]], axis=1))
            if sum(map(len, self.found)) > OPEN_AT_ONCE:
                self.found = [self.runs()]

    def settle(self) -> None:
        """Extend the pairs that wait by the sorted suffixes of their texts."""
        if not self.n_waiting:
            return
        i, q, ahead, ahead_open, behind, behind_open = (np.concatenate(part) for part in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        starts = np.unique(self.t.lo[i])
        if self.sorted_for is None or not np.array_equal(starts, self.sorted_for):
            sizes = self.t.hi[starts] - starts
            self.sorted_for, self.first = starts, np.concatenate([[0], np.cumsum(sizes)])
            words = np.arange(self.first[-1]) + np.repeat(starts - self.first[:-1], sizes)
            some = Texts(self.t.ids[words], self.first)
            self.ahead, self.behind = CoverSuffixes(some), CoverSuffixes(some.reversed())
        nr = np.searchsorted(starts, self.t.lo[i])
        moved = self.first[nr] - self.t.lo[i]  # from places among all texts to places among those sorted
        a = i + ahead + moved
        ahead[ahead_open] += self.ahead.common(a[ahead_open], (a + q)[ahead_open])
        b = self.t.lo[i] + self.t.hi[i] - i + behind + moved
        behind[behind_open] += self.behind.common((b - q)[behind_open], b[behind_open])
        self._keep(i - behind, i + q + ahead, q)

    def runs(self) -> np.ndarray:
        """(start, end, period) of the runs found, in order; of the periods of a stretch the smallest."""
        if not self.found:
            return np.zeros((0, 3), np.int64)
        all_ = np.concatenate(self.found)
        all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
        all_ = all_[np.r_[True, (all_[1:, :2] != all_[:-1, :2]).any(axis=1)]]
        return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def runs_of(ids: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS) -> np.ndarray:
    """(start, end, period) of the runs of several texts of numbered words, by place among all words."""
    t = Texts(ids, first)
    finder = _Finder(t, least_words)
    for text_of, place, period in grid(np.diff(first), least_words):
        finder.add(first[text_of] + place, period)
    finder.settle()
    return finder.runs()


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words only."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    joined = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    return joined.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)


def without(piece: T.Piece, start: np.ndarray, end: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    data = piece.data.copy()
    which = np.flatnonzero(kept)
    text_of = np.searchsorted(first, which, "right") - 1
    followed = which[:-1][text_of[1:] == text_of[:-1]]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[which]] += 1
    edge[end[which]] -= 1
    chosen = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    chosen[end[followed]] = True  # another word follows in the text, so a separator does
    data[end[followed]] = 0x20
    n = np.bincount(text_of, minlength=len(first) - 1)
    size = np.bincount(text_of, (end - start)[which], len(first) - 1).astype(np.int64) + np.maximum(n - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[chosen])])


def _of_piece(piece: T.Piece, least_words: int) -> tuple[pa.Array, pa.Array]:
    start, end, first = T.word_spans(piece)
    runs = runs_of(word_numbers(piece.data, start, end), first, least_words)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    collapsed = without(piece, start, end, first, np.cumsum(edge[:-1]) == 0)
    offsets = np.searchsorted(runs[:, 0], first)
    text_of = np.searchsorted(first, runs[:, 0], "right") - 1
    values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[text_of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), collapsed.cast(pa.string())


def periodic_runs(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``runs``, the runs of every text by start and period (start is a word's number from 0), and
    ``collapsed``, its words without those that a run repeats: of every run the first period stays."""
    names, place = docs.columns, docs.columns.index(text_col)
    clash = {c.lower() for c in names} & {"runs", "collapsed"}
    if clash:
        raise ValueError(f"there is a column {', '.join(sorted(clash))} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch.column(place)):
                found = _of_piece(piece, least_words)
                same = batch.slice(piece.lo, piece.hi - piece.lo)
                yield pa.RecordBatch.from_arrays([*same.columns, *found], [*same.schema.names, "runs", "collapsed"])

    kinds = [f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)]
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, ", ".join([*kinds, _RESULT]))
    return rows.toDF(*names, "runs", "collapsed")
