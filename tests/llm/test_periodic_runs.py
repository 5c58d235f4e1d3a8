"""Periodic runs against brute force over all periods."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import periodic_runs as P


def brute(words, least):
    """Every maximal stretch that returns after q words, smallest q first, three periods and ``least`` words or more."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 3 * q):
                best.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    k, out, size = rng.choice([1, 2, 3, 5, 50]), [], rng.choice([0, 10, 40, 200, 600])
    while len(out) < size:
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 70))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 600)]
    return out


def test_cover():
    assert (P.STEPS >= 0).all() and P.STEPS.max() < P.COVER


@pytest.mark.parametrize("open_at_once", [50, P.OPEN_AT_ONCE])
def test_runs_of_several_texts(monkeypatch, open_at_once):
    monkeypatch.setattr(P, "OPEN_AT_ONCE", open_at_once)
    rng = random.Random(open_at_once)
    for _ in range(400):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        least = rng.choice([24, 24, 6, 3, 1])
        got = P.runs_of(np.array([w for t in texts for w in t], np.int32), first, least)
        want = [(s + at, e + at, q) for t, at in zip(texts, first, strict=False) for s, e, q in brute(t, least)]
        assert [tuple(map(int, r)) for r in got] == [tuple(map(int, r)) for r in want]


def test_common_prefixes():
    rng = random.Random(3)
    for _ in range(30):
        texts = [some_words(rng) for _ in range(3)] + [[1] * 200]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        t = P.Texts(np.array([w for x in texts for w in x], np.int32), first)
        suffixes = P.CoverSuffixes(t)
        for text, at in zip(texts, first, strict=False):
            here = [int(p) for p in suffixes.place if at <= p < at + len(text)]
            for _ in range(30 if len(here) > 1 else 0):
                i, j = sorted(rng.sample(here, 2))
                n = 0
                while j - at + n < len(text) and text[i - at + n] == text[j - at + n]:
                    n += 1
                assert suffixes.common(np.array([i]), np.array([j]))[0] == n


def test_long_texts():
    for words, want in (([0] * 100_000, [(0, 100_000, 1)]), (list(range(1000)) * 50, [(0, 50_000, 1000)]), (list(range(60_000)), [])):
        assert [tuple(map(int, r)) for r in P.runs_of(np.array(words, np.int32), np.array([0, len(words)]))] == want


def test_rows(spark):
    again = "one  two\tthree " * 9
    rows = [(1, "A b " + again + "end"), (2, None), (3, ""), (4, " \n"), (None, "x " * 23), (5, "x " * 24), (5, "x " * 24), (6, "é\U0001f600 " * 30 + "É")]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string").withColumn("words", F.lit("w")).repartition(3)
    out = P.periodic_runs(docs).collect()
    assert out[0].__fields__ == ["doc.id", "text", "words", "runs", "collapsed"]
    found = {(r["doc.id"], r["text"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out}
    assert len(out) == len(rows)
    assert found[1, rows[0][1]] == ([(2, 27, 3)], "A b one two three end")
    assert found[2, None] == found[3, ""] == found[4, " \n"] == ([], "")
    assert found[None, "x " * 23] == ([], " ".join(["x"] * 23))
    assert found[5, "x " * 24] == ([(0, 24, 1)], "x")
    assert found[6, rows[-1][1]] == ([(0, 30, 1)], "é\U0001f600 É")
    assert P.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        P.periodic_runs(docs.withColumn("runs", F.lit(1)))
    # case matters, and pieces don't cut texts apart
    mixed = spark.createDataFrame([(i, ("a A " * 20 if i % 2 else "a a " * 20)) for i in range(50)], "id long, text string")
    for r in P.periodic_runs(mixed).collect():
        assert [tuple(x) for x in r["runs"]] == [(0, 40, 2 if r["id"] % 2 else 1)]
