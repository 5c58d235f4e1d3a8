"""The trie of conversations by their turns: which beginnings they share, and what sharing saves.

A node is a distinct sequence of first turns, the root the empty one; the conversations that begin with it are its members.

*Turns to keys.* A turn is the digest of role and text (128 bits). A prefix has the digest of the prefix before it and its last
turn. Conversations with equal sequences become one item with their number and smallest id before anything else.

*Peeling.* From the greatest depth down: the items that end at a depth and the nodes that are left from the depth below
(one turn stripped) are grouped by prefix. Each group is a node, complete as it is found: members, children, leaves and
savings below it add up from what was merged, and its children get their parent. It goes on as one row.

*Where.* Items that share a prefix of some depth are peeled down to that depth in one task, many levels at a time, if at
most ``group_items`` different ones share it. The greatest depth at which more of them share a prefix is found by counts;
everything is peeled to just below it, and the step to it is a Spark aggregate with map-side combine, so a first turn that a
third of all conversations share is merged before it is shuffled. Each such step leaves one row per prefix, so there
are as many steps as depths at which more than ``group_items`` different continuations meet, whatever the longest
conversation. Every step is written to the shared folder.

*Endings.* A node's digest of the ids that end at it is taken over them in order: ids are sorted by range over all tasks and
joined in pieces; a last task hashes the pieces of a node one after another. No list of ids is held anywhere.

Cases: turns of equal position are ordered by their digest. A row without position declares a conversation without adding a
turn. Null role or text is empty, and differs from no other empty one. Rows without conversation id are left out.
Repeated rows are repeated turns. Other columns are ignored. No conversations give no nodes. The turns of one conversation
(32 bytes each) meet in one task, as do the few ancestors of one item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.store import written
from scorewright.operators.assemble import join_skewed

GROUP_ITEMS = 4096
CHUNK_TURNS = 1 << 17
PIECE_CHARS = 1 << 20

_KEYS = "k1 array<bigint>, k2 array<bigint>, bytes array<bigint>"
_STATE = "depth bigint, n bigint, first bigint, children bigint, leaves bigint, saved bigint, ends string"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NO_IDS = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- sequences


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of every prefix of every conversation."""
    for batch in batches:
        k1, k2, sizes = [], [], []
        for turns in batch.column("turns"):
            keys, n_bytes, key = [], [], bytes(16)
            for turn in turns.as_py():
                key = hashlib.blake2b(key + turn["digest"], digest_size=16).digest()
                keys.append(key)
                n_bytes.append(turn["bytes"])
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            k1.append(both[:, 0])
            k2.append(both[:, 1])
            sizes.append(n_bytes)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(k1, kind), pa.array(k2, kind), pa.array(sizes, kind)], ["conv_id", "k1", "k2", "bytes"])


def sequences(turns: DataFrame, conv_col: str, position_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, k1, k2, bytes, depth, e1, e2)``: prefix keys and bytes of the turns of every conversation, and its last key."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col(position_col).alias("position"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.when(F.col(position_col).isNotNull(), turn).alias("turn"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    lean = lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))
    keyed = lean.mapInArrow(_prefix_keys, "conv_id bigint, " + _KEYS).withColumn("depth", F.size("k1").cast("long"))
    last = lambda k: F.when(F.col("depth") > 0, F.get(k, F.col("depth").cast("int") - 1)).otherwise(F.lit(0))
    return keyed.withColumns({"e1": last("k1"), "e2": last("k2")})


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted ids of each ending, comma-joined; ``at`` is a piece's first id."""
    for batch in batches:
        e1, e2, ids = (batch.column(c).to_numpy() for c in ("e1", "e2", "conv_id"))
        if not len(ids):
            continue
        cut = np.flatnonzero(np.r_[True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])])
        text = batch.column("conv_id").cast(pa.string()).to_pylist()
        most = PIECE_CHARS // 20
        lo = np.concatenate([np.arange(a, b, most) for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)])
        pieces = [",".join(text[a:b]) for a, b in zip(lo, [*lo[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(e1[lo]), pa.array(e2[lo]), pa.array(ids[lo]), pa.array(pieces)], ["e1", "e2", "at", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each ending's pieces, which come in order."""
    now, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for key, piece in zip(zip(batch.column("e1").to_pylist(), batch.column("e2").to_pylist(), strict=True), batch.column("piece"), strict=True):
            if key == now:
                state.update(b"," + piece.as_buffer())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(piece.as_buffer())
        if done:
            yield _rows(done)
    if now is not None:
        yield _rows([(*now, state.hexdigest())])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    a, b, ends = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ends)], ["e1", "e2", "ends"])


def ending_digests(convs: DataFrame) -> DataFrame:
    """``(e1, e2, ends)``: SHA-256 of the ascending, comma-joined ids of the conversations with each sequence."""
    ids = convs.select("e1", "e2", "conv_id")
    pieces = ids.repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id").mapInArrow(_joined_ids, "e1 bigint, e2 bigint, at bigint, piece string")
    ordered = pieces.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "at")
    return ordered.mapInArrow(_hashed, "e1 bigint, e2 bigint, ends string")


def _items(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence, as the state of a node that only has endings."""
    counted = convs.groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    counted = counted.join(ending_digests(convs), ["e1", "e2"])
    one = counted.join(convs.select(F.col("conv_id").alias("first"), "depth", "k1", "k2", "bytes"), "first")
    zero = F.lit(0).cast("long")
    return one.select("k1", "k2", "bytes", "depth", "n", "first", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")


# ---------------------------------------------------------------- peeling in a task


class _Peeled:
    """Nodes of some items, from their greatest depth down to ``floor``."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, floor: int) -> None:
        lists = [pa.concat_arrays([c.cast(pa.large_list(pa.int64())) for c in batch.column(k).chunks]) for k in ("k1", "k2", "bytes")]
        self.k1, self.k2, self.bytes = (c.flatten().to_numpy() for c in lists)
        self.depth, self.n, self.first, self.children, self.leaves, self.saved = (batch.column(c).to_numpy() for c in ("depth", "n", "first", "children", "leaves", "saved"))
        self.ends = batch.column("ends").to_pylist()
        self.at = np.cumsum(self.depth) - self.depth  # where each item's keys begin
        self.floor = floor
        self.nodes: list[np.ndarray] = []  # first, depth, parent's first, n, children, leaves, saved, item that ends here
        self._peel()

    def _peel(self) -> None:
        by_depth = np.argsort(-self.depth, kind="stable")
        taken, left, above = 0, np.zeros((7, 0), np.int64), None
        for d in range(int(self.depth.max()), self.floor - 1, -1):
            upto = taken + int(np.searchsorted(-self.depth[by_depth[taken:]], -d, "right"))
            new = by_depth[taken:upto]
            taken = upto
            begun = np.stack([new, self.n[new], self.first[new], self.children[new], self.leaves[new], self.saved[new], np.where([self.ends[i] is not None for i in new], new, -1)]) if len(new) else left[:, :0]
            both = np.concatenate([left, begun], axis=1)
            item = both[0]
            if d:
                a, b = self.k1[self.at[item] + d - 1], self.k2[self.at[item] + d - 1]
            else:
                a = b = np.zeros(len(item), np.int64)
            order = np.lexsort((b, a))
            fresh = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            lo = np.flatnonzero(fresh)
            n, children, leaves, saved = (np.add.reduceat(both[k][order], lo) for k in (1, 3, 4, 5))
            first, ends = np.minimum.reduceat(both[2][order], lo), np.maximum.reduceat(both[6][order], lo)
            item = item[order][lo]
            leaves = np.where(children == 0, 1, leaves)
            if d:
                saved = saved + (n - 1) * self.bytes[self.at[item] + d - 1]
            if above is not None:  # the nodes one turn deeper get their parent
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(fresh) - 1
                above[2] = first[group[: above.shape[1]]]
            above = np.stack([first, np.full(len(first), d), np.full(len(first), -1), n, children, leaves, saved, ends])
            self.nodes.append(above)
            left = np.stack([item, n, first, np.ones(len(first), np.int64), leaves, saved, np.full(len(first), -1)])
        self.last = left[0]

    def rows(self) -> pa.RecordBatch:
        """All nodes below the floor, and those at it with their keys (none below a root)."""
        table = np.concatenate(self.nodes, axis=1)
        top = self.nodes[-1].shape[1]
        total = table.shape[1]
        open_ = np.arange(total) >= total - top if self.floor else np.zeros(total, bool)
        offsets = np.concatenate([[0], np.cumsum(np.where(open_, self.floor, 0))])
        where = (np.repeat(self.at[self.last], self.floor).reshape(-1, self.floor) + np.arange(self.floor)).ravel() if self.floor else np.zeros(0, np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c[where]), mask=pa.array(~open_)) for c in (self.k1, self.k2, self.bytes)]
        no_parent = np.arange(total) >= total - top
        columns = [pa.array(table[0]), pa.array(table[1]), pa.array(table[2], mask=no_parent), *(pa.array(row) for row in table[3:7])]
        ends = pa.array([self.ends[i] if i >= 0 else None for i in table[7]], pa.string())
        return pa.RecordBatch.from_arrays([*columns, ends, pa.array(open_), *lists], _PEELED_NAMES)


_PEELED = "first bigint, depth bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string, open boolean, " + _KEYS
_PEELED_NAMES = [part.split()[0] for part in _PEELED.split(", ")]


def _peel_to(floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Peels whole groups of items, which come sorted by ``g1, g2``, some at a time."""
        held: list[pa.RecordBatch] = []
        turns = 0
        for batch in batches:
            held.append(batch)
            turns += len(batch) + len(batch.column("k1").flatten())
            if turns < CHUNK_TURNS:
                continue
            table = pa.Table.from_batches(held)
            g1, g2 = table.column("g1").to_numpy(), table.column("g2").to_numpy()
            cut = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))
            if len(cut):
                whole = int(cut[-1]) + 1
                yield _Peeled(table.slice(0, whole), floor).rows()
                held = table.slice(whole).to_batches()
                turns = sum(len(b) + len(b.column("k1").flatten()) for b in held)
        table = pa.Table.from_batches(held) if held else None
        if table is not None and len(table):
            yield _Peeled(table, floor).rows()

    return run


def _peeled(items: DataFrame, floor: int) -> DataFrame:
    if floor:
        keyed = items.withColumns({"g1": F.get("k1", F.lit(floor - 1)), "g2": F.get("k2", F.lit(floor - 1))}).repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    else:
        keyed = items.withColumns({"g1": F.lit(0).cast("long"), "g2": F.lit(0).cast("long")}).coalesce(1)
    return keyed.mapInArrow(_peel_to(floor), _PEELED)


# ---------------------------------------------------------------- the trie


def _crowded(items: DataFrame, depth: int, group_items: int) -> bool:
    """Whether more than ``group_items`` items share a prefix of this depth. (job)"""
    here = items.where(F.col("depth") >= depth)
    if depth:
        here = here.groupBy(F.get("k1", F.lit(depth - 1)).alias("a"), F.get("k2", F.lit(depth - 1)).alias("b")).count()
        return not here.where(F.col("count") > group_items).isEmpty()
    return here.count() > group_items


def deepest_crowd(items: DataFrame, group_items: int) -> int:
    """The greatest depth at which more than ``group_items`` items share a prefix; -1 if they are fewer in all. (job)"""
    if not _crowded(items, 0, group_items):
        return -1
    lo, hi = 0, 1
    while _crowded(items, hi, group_items):
        lo, hi = hi, 2 * hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if _crowded(items, mid, group_items) else (lo, mid)
    return lo


def _node(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_IDS)).alias("ends_sha256"),
    )


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", position_col: str = "position", role_col: str = "role", text_col: str = "text", group_items: int = GROUP_ITEMS, **skew: int
) -> DataFrame:
    """The nodes of the trie: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``. (job)

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (root: null), ``n_leaves`` the childless nodes of
    the subtree and ``saved_tokens`` its sum of (members - 1) times the bytes of the last turn's text; both include the
    node. ``ends_sha256`` digests the ids of the conversations that end at the node.
    """
    convs = written(sequences(turns, conv_col, position_col, role_col, text_col), "sequences")
    items, parts = written(_items(convs), "items"), []
    while (crowd := deepest_crowd(items, group_items)) >= 0:
        floor = crowd + 1
        found = written(_peeled(items.where(F.col("depth") >= floor), floor), "peeled")
        parts.append(_node(found.where("not open")))
        at_floor = found.where("open")
        cut = lambda k: F.slice(k, 1, crowd).alias(k)
        one = F.lit(1).cast("long")
        stripped = at_floor.select(cut("k1"), cut("k2"), cut("bytes"), "n", "first", one.alias("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends"))
        ended = items.where(F.col("depth") == crowd).select(*stripped.columns)
        key = [F.coalesce(F.get(k, F.lit(crowd - 1)), F.lit(0)).alias(f"p{k[1]}") if crowd else F.lit(0).cast("long").alias(f"p{k[1]}") for k in ("k1", "k2")]
        merged = stripped.unionByName(ended).select("*", *key).groupBy("p1", "p2").agg(
            *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.min("first").alias("first"), F.max("ends").alias("ends"), F.any_value(F.struct("k1", "k2", "bytes")).alias("keys")
        )
        merged = merged.select("p1", "p2", "keys.k1", "keys.k2", "keys.bytes", F.lit(crowd).cast("long").alias("depth"), "n", "first", "children", "leaves", "saved", "ends")
        parents = written(merged, "parents")
        children = at_floor.drop("parent")
        if crowd:
            named = join_skewed(children.select("*", *key), parents.select("p1", "p2", F.col("first").alias("parent")), ["p1", "p2"], unique=True, **skew)
        else:
            named = children.withColumn("parent", F.lit(parents.first()["first"]))  # the root alone
        parts.append(_node(named))
        items = written(parents.drop("p1", "p2").unionByName(items.where(F.col("depth") < crowd)), "items")
    parts.append(_node(_peeled(items, 0)))
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes
