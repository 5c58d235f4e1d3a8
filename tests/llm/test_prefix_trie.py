"""The trie against a brute-force version over all prefixes."""

import collections
import hashlib
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from scorewright.llm import prefix_trie as PT
from scorewright.llm.queries import op13_prefix_trie, rebuilt

SCHEMA = "conv_id long, position int, role string, text string, k1 string, depth string"


def brute(convs):
    """Nodes of {conversation: [(role, text)]} by prefix."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        leaves = sum(not children[q] for q in below)
        out.append((min(ids), len(p), parent, len(ids), children[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def build(spark, convs):
    rows = [(c, i, *t, "x", "y") for c, turns in convs.items() for i, t in enumerate(turns)]
    rows += [(c, None, None, None, "x", "y") for c, turns in convs.items() if not turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("group_items", [1, 3, 1000])
def test_against_brute_force(spark, group_items, monkeypatch):
    monkeypatch.setattr(PT, "CHUNK_TURNS", 5)
    monkeypatch.setattr(PT, "PIECE_CHARS", 40)
    rng = random.Random(group_items)
    # words of a small set, so that beginnings and whole conversations repeat; ids aren't in order of the texts
    convs = {rng.randrange(10**6) - 500: [(rng.choice("ua"), rng.choice(["", "é", "hello"])) for _ in range(rng.randint(0, 4))] for _ in range(60)}
    convs |= {-k: [("u", "same")] for k in range(1, 13)}
    assert got(PT.prefix_trie(build(spark, convs), group_items=group_items)) == brute(convs)


def test_long_conversations_take_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(PT, "_peeled", lambda items, floor, whole=PT._peeled: steps.append(floor) or whole(items, floor))
    chain = [("u", str(i)) for i in range(300)]
    convs = {k: [*chain, ("a", str(k)), *[("u", "end")] * (k % 3)] for k in range(9)} | {100: chain[:7], 101: [("u", "other")]}
    assert got(PT.prefix_trie(build(spark, convs), group_items=5)) == brute(convs)
    assert steps == [301, 0]  # all nine meet at 300 turns; nothing crowds above


def test_a_crowded_first_turn_is_spread(spark):
    convs = {k: [("u", "hi"), ("a", str(k % 40)), ("u", str(k % 7))] for k in range(200)} | {900 + k: [("u", str(k))] for k in range(5)}
    assert got(PT.prefix_trie(build(spark, convs), group_items=8, min_rows=10, piece_rows=10)) == brute(convs)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, 0, None, None), (2, 0, "", ""), (3, 1, "u", "b"), (3, 0, "u", "a"), (4, 5, "u", "a"), (4, 7, "u", "b"), (None, 0, "u", "a"), (5, None, "u", "ignored"), (6, 0, "u", "a"), (6, 0, "u", "a")]
    turns = spark.createDataFrame(rows, "conv_id int, position int, role string, text string").repartition(2)
    convs = {1: [("", "")], 2: [("", "")], 3: [("u", "a"), ("u", "b")], 4: [("u", "a"), ("u", "b")], 5: [], 6: [("u", "a"), ("u", "a")]}
    assert got(PT.prefix_trie(turns)) == brute(convs)
    assert PT.prefix_trie(turns.limit(0)).count() == 0
    # ties of one position: any order, but the same for the same turns
    tied = spark.createDataFrame([(c, 0, "u", t) for c in (1, 2) for t in ("abcd" if c == 1 else "dcba")], "conv_id long, position int, role string, text string")
    assert {(r["n_convs"], r["conv_id"]) for r in PT.prefix_trie(tied).collect()} == {(2, 1)}


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    extra = spark.createDataFrame([(10_000, None, "u", "first"), (10_000, 0, None, None), (10_003, 3, "u", "own"), (10_004, 1, "u", "own"), (None, 1, "u", "x")], table.schema)
    both = table.unionByName(extra)
    own = collections.defaultdict(list)
    for r in both.where("conv_id is not null").collect():
        own[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    import zlib

    turns = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    convs = {c: turns.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :] for c, v in turns.items()}
    assert got(PT.prefix_trie(rebuilt(both))) == brute(convs)
    assert op13_prefix_trie(spark, SF).where(F.col("depth") == 0).count() == 1
