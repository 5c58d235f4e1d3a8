import random

import numpy as np
import pytest

from documents_fixture import make  # noqa: F401
from scorewright.llm import metric_join as MJ
from scorewright.llm import parity_join as PJ
from scorewright.llm.components import components


def merged(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    out = {r.id: r.component for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingles(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_parity_join_equals_brute_force(spark, make):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \n ", "one", "One", "one two", "two one"]
    for _ in range(6):  # groups around a base: members differ from the base, and more from each other
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120]))]
        for k in range(12):
            copy = list(base)
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[-1], texts[-1].upper()]
    rows = list(enumerate(texts)) + [(None, texts[20]), (5, "one two")]
    for n, percent in ((4, 85), (5, 80)):
        sets = [shingles(t, n) for _, t in rows]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        root = merged(len(rows), pairs)
        least = {}
        for i, r in enumerate(root):
            if rows[i][0] is not None:
                least[r] = min(least.get(r, 10**9), rows[i][0])
        want = sorted(((rows[i][0], len(s), rows[i][0] if not s else least.get(root[i])) for i, s in enumerate(sets)), key=str)
        out = PJ.parity_sketch_join(make(rows), n, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, out), key=str) == want


def test_small_sets_meet_on_members():
    """Two sets with the same empty chunks and no filled chunk alike still share a key."""
    bands = PJ.band_edges(85, 64)
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        b = np.unique(np.r_[a[1:], rng.integers(0, 2**63, 2).astype(np.uint64)])
        same = len(np.intersect1d(a, b))
        if 100 * same >= 85 * (len(a) + len(b) - same):
            assert np.intersect1d(PJ.join_keys(a, 85, bands), PJ.join_keys(b, 85, bands)).size


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1000, 300).astype(np.uint64)) for _ in range(2))
    bits = np.unpackbits((PJ.parity_sketch(a) ^ PJ.parity_sketch(b)).view(np.uint8)).sum()
    assert bits <= len(np.setxor1d(a, b))


def test_wide_sketches_fold_and_bound_the_difference():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    sets = [base[: 64 * PJ.SKETCH_WORDS], base[:1025], base[100:2200], base[:4097], base[50:4900], base]
    assert PJ.wide_sketch(sets[0]) is None and [8 * len(PJ.wide_sketch(s)) for s in sets[1:]] == [2048, 4096, 8192, 8192, 8192]
    wide = [PJ.wide_sketch(s) for s in sets[1:]]
    at, to = (x.ravel() for x in np.indices((5, 5)))
    got = PJ._apart(wide, wide, at, to)
    for i, j, d in zip(at, to, got, strict=True):
        bits = [np.unpackbits(np.frombuffer(wide[k], np.uint8), bitorder="little") for k in (i, j)]
        low = min(map(len, bits))
        one, two = (np.bitwise_xor.reduce(b.reshape(-1, low)) for b in bits)
        apart = len(np.setxor1d(sets[i + 1], sets[j + 1]))
        assert d == (one ^ two).sum() <= apart and (i == j or 2 * d > min(apart, low // 2))


def test_long_texts_with_a_common_passage_are_not_sent_by_pairs(spark, make, monkeypatch):
    """Sets of long texts that share a passage only are told apart by sketches; only similar pairs are compared by sets."""
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n)]
    passage = words(120)
    bases = [words(rng.randrange(1100, 2600)) for _ in range(24)]
    texts = [b[:500] + passage + b[500:] for b in bases]
    texts += [t[:-20] + words(25) for t in texts[:5]] + [t[: len(t) * 3 // 4] for t in texts[5:8]]
    sent, plain = [], PJ._Texts.sets

    def sets(self, classes, entries):
        sent.append(entries)
        return plain(self, classes, entries)

    monkeypatch.setattr(PJ._Texts, "sets", sets)
    monkeypatch.setattr(PJ, "BLOCK_BYTES", 4000, raising=False)
    sets_of = [shingles(" ".join(t), 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets_of[i] & sets_of[j]) >= 80 * len(sets_of[i] | sets_of[j])]
    out = PJ.parity_sketch_join(make(list(enumerate(map(" ".join, texts)))), 5, 80).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, out)) == list(enumerate(merged(len(texts), pairs)))
    assert len(pairs) == 5 and sent and max(sent) <= 8


def test_near_duplicates_keep_one(make):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(3, long), (2, long + " x"), (9, "other words stand here alone today"), (4, None), (5, "")]
    out = PJ.drop_near_duplicates(make(rows))
    assert out.columns == make(rows).columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 9]
    assert PJ.drop_near_duplicates(make([])).count() == 0


def test_of_repeated_rows_one_stays(make):
    long, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(3, long), (2, long + " x"), (2, long + " x"), (None, other), (None, other), (7, "a b c d e f g h"), (4, None), (4, None)]
    out = PJ.drop_near_duplicates(make(rows))
    assert out.columns == make(rows).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, long + " x"), (None, other), (7, "a b c d e f g h"), (4, None), (4, None)], key=str)


@pytest.mark.parametrize("block", [3072, 7])
def test_metric_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(MJ, "CELL_ROWS", 20)
    monkeypatch.setattr(MJ, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 8))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(8) * rng.choice([0, 0.02, 0.1])
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, float("nan")] * 4, 0), (903, [1.0, None] * 4, 0), (904, rows[0][1], None)]
    rows += [(905, [1.0, 2.0], 0), (906, [1.0, 2.0], 0), (906, [1.0, 2.0], 0), (None, rows[0][1], 0), (907, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sound = lambda r: r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if sound(r) else None for r in rows]
    n, pairs = len(rows), []
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                pairs.append((i, j))
    root = merged(n, pairs)
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[i][0])
    links = [sum(i in p for p in pairs) for i in range(n)]
    want = sorted(((rows[i][0], links[i], least.get(root[i]), rows[i][0] is not None and rows[i][0] == least.get(root[i])) for i in range(n)), key=str)
    assert sorted(map(tuple, MJ.metric_join(df).collect()), key=str) == want
    assert MJ.metric_join(df.limit(0)).count() == 0
