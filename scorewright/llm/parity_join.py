"""Similarity join of word n-gram sets by parity sketches.

Two sets whose Jaccard similarity is at least p percent differ in at most ``(a + b)(100 - p) / (100 + p)`` members. The
members of a set are dealt by hash to C chunks, and each chunk keeps the parity (exclusive or) of its members' hashes.
A member that is in one set only changes one chunk, so with more chunks than possible differences at least one chunk
of the two sets agrees: the pigeonhole join is an equality join on (size band, chunk, parity).

*Size bands.* Bands grow by a fixed ratio and fix C. A set enters its own band and those of larger partners.

*Empty chunks* don't join. A set with more filled chunks than possible differences ("safe") meets every partner in a
filled chunk all the same; two sets that are both not safe meet because such sets join on every single member too.

*Candidates.* All sets under one key are linked to one leader of the key: rows are linear in the group. A second parity
sketch of fixed length, whose Hamming distance is a lower bound of the difference, sorts out most pairs. It says little
of sets with more members than it has bits: those have a wide one besides, of a bit per member or two, which folds to any
smaller power of two. Pairs that pass both are verified by their sets. Wide sketches meet in squares of a grid of blocks of
classes, so a class travels once per block it has a pair in, not once per pair. Only groups that still fall into several components are looked at again, with a leader that
differs from key to key. What then remains apart is compared by the sketches pair by pair, and those that pass are
verified. Links inside a component that is known already change nothing and are never listed, so
a group of near copies isn't expanded to all its pairs.

*Copies.* Rows with equal sets form one class and are compared once.

Cases: null or blank text has the empty set and links with nothing. A text with fewer words than n gives its whole
sequence as one member. Null ids take part, but never name a component unless no row of it has an id (then null).
Rows that repeat an id are compared by their own texts. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import text as T
from scorewright.llm.components import components
from scorewright.llm.store import row_key, whole_row, written

BAND_RATIO = 1.6
SKETCH_WORDS = 16  # 1,024 bits
BLOCK_BYTES = 16_000_000  # wide sketches of a block of classes
BLOCK_PAIRS = 500_000  # on the average, in a square of two blocks
LEADER_ROUNDS = 2
BROADCAST_IDS = 4_000_000  # 8 bytes each; beyond it texts are picked by a shuffled join
SEEN = 200_000  # classes a task remembers, so that it sends copies once
_SALT = np.uint64(0xA0761D6478BD642F)


def allowed(total: int, percent: int) -> int:
    """The most members two sets of this total size may differ in."""
    return total * (100 - percent) // (100 + percent)


def band_edges(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(lowest size, highest size, chunks, differences) of each band up to size ``most``."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, int(lo * BAND_RATIO) - 1)
        differ = allowed(2 * hi, percent)
        out.append((lo, hi, int(1.15 * (differ + 1)) + 3, differ))
        lo = hi + 1
    return out


def signature(members: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed numbers."""
    a = np.bitwise_xor.reduce(T.mix(members ^ np.uint64(0x1234567))) ^ np.uint64(len(members))
    b = np.add.reduce(T.mix(members + np.uint64(0x89ABCDEF)), dtype=np.uint64)
    both = T.mix(np.array([a, b], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of members fall."""
    bits = np.bincount((T.mix(members ^ _SALT) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def wide_sketch(members: np.ndarray) -> bytes | None:
    """The same of a set of more members than that has bits, in the next power of two of bits."""
    if len(members) <= 64 * SKETCH_WORDS:
        return None
    bits = 1 << (len(members) - 1).bit_length()
    odd = np.bincount((T.mix(members ^ _SALT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def join_keys(members: np.ndarray, percent: int, bands: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The keys under which a set meets every partner."""
    size, out = len(members), []
    for k, (lo, hi, chunks, differ) in enumerate(bands):
        if hi < size or lo > size * 100 // percent:
            continue
        seed = T.mix(np.array([k], np.uint64))[0]
        chunk = (T.mix(members ^ seed) % np.uint64(chunks)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        chunk = chunk[order]
        at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        parity = np.bitwise_xor.reduceat(members[order], at)
        out.append(T.mix(parity ^ T.mix(chunk[at].astype(np.uint64) + seed)))
        if len(at) <= differ:  # not safe
            out.append(T.mix(members ^ T.mix(np.array([seed + np.uint64(7)], np.uint64))))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct n-gram hashes) of every row of the batch."""
    for piece in T.pieces(batch.column("text")):
        value, row = T.ngram_hashes(T.words(piece), n)
        for i, members in enumerate(T.row_sets(value, row, piece.hi - piece.lo)):
            yield piece.lo + i, members


def _row_table(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, members in _sets(batch, n):
                size[i] = len(members)
                one[i], two[i] = signature(members) if len(members) else (0, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rk"), pa.array(size), pa.array(one, mask=size == 0), pa.array(two)],
                ["doc_id", "rk", "n_shingles", "set_id", "set_check"],
            )

    return run


def _key_table(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = band_edges(percent, 64)
        seen: set[int] = set()
        for batch in batches:
            keys, ids, held = [], [], 0
            for _, members in _sets(batch, n):
                if not len(members):
                    continue
                top = len(members) * 100 // percent
                if bands[-1][1] < top:
                    bands = band_edges(percent, 2 * top)
                set_id, _ = signature(members)
                if set_id in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(set_id)
                own = join_keys(members, percent, bands)
                keys.append(own)
                ids.append(np.full(len(own), set_id))
                held += len(own)
                if held > 200_000:
                    yield _key_batch(keys, ids)
                    keys, ids, held = [], [], 0
            if keys:
                yield _key_batch(keys, ids)

    return run


def _key_batch(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "set_id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that several classes share, with the key's first class. Input is sorted; one row is held back."""
    held: tuple[int, int, int, bool] | None = None  # key, class, leader, whether the key has shown another class
    for batch in batches:
        key, ident = batch.column("key").to_numpy(), batch.column("set_id").to_numpy()
        if not len(key):
            continue
        if held is not None:
            key, ident = np.r_[held[0], key], np.r_[held[1], ident]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])]
        key, ident = key[fresh], ident[fresh]
        new = np.r_[True, key[1:] != key[:-1]]
        leader = ident[np.flatnonzero(new)][np.cumsum(new) - 1]
        shared = np.r_[~new[1:], False] | ~new
        if held is not None:
            same = key == held[0]
            leader = np.where(same, held[2], leader)
            shared |= same & held[3]
        held = (int(key[-1]), int(ident[-1]), int(leader[-1]), bool(shared[-1]))
        out = shared[:-1]
        if out.any():
            yield _group_batch(key[:-1][out], ident[:-1][out], leader[:-1][out])
    if held is not None and held[3]:
        yield _group_batch(np.array([held[0]]), np.array([held[1]]), np.array([held[2]]))


def _group_batch(key: np.ndarray, ident: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ident), pa.array(leader)], ["key", "set_id", "leader"])


def _sketch_table(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(signature(m)[0], len(m), wide_sketch(m), parity_sketch(m)) for _, m in _sets(batch, n) if len(m)]
            if found:
                ids, sizes, wide, sketches = zip(*found, strict=True)
                flat = np.stack(sketches)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(SKETCH_WORDS))], ["set_id", "n", "wide", *_BITS])

    return run


def _set_table(n: int):
    """The set of each row for every leader it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaders = batch.column("set_id"), batch.column("leaders")
            out, sets, held = [], [], 0
            for i, members in _sets(batch, n):
                for leader in leaders[i].as_py():
                    out.append((leader, ids[i].as_py()))
                    sets.append(members.view(np.int64))
                    held += len(members)
                    if held > 500_000:
                        yield _set_batch(out, sets)
                        out, sets, held = [], [], 0
            if out:
                yield _set_batch(out, sets)

    return run


def _set_batch(pairs: list, sets: list) -> pa.RecordBatch:
    offsets = pa.array(np.r_[0, np.cumsum([len(m) for m in sets])].astype(np.int32))
    src, dst = (pa.array(c, pa.int64()) for c in zip(*pairs, strict=True))
    return pa.RecordBatch.from_arrays([src, dst, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["src", "dst", "members"])


_BITS = [f"b{k}" for k in range(SKETCH_WORDS)]


def _may_link(percent: int):
    """Size and Hamming bound of the sides ``x`` and ``y``."""
    distance = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in _BITS[1:]), F.bit_count(F.col(f"x.{_BITS[0]}").bitwiseXOR(F.col(f"y.{_BITS[0]}"))))
    n, m = F.col("x.n"), F.col("y.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * distance <= (100 - percent) * (n + m))


@dataclass
class _Texts:
    """One row of the corpus for every class: where the sets and sketches of classes are computed from."""

    base: DataFrame
    rows: DataFrame
    n: int
    wide_bytes: int = 0

    def of(self, classes: DataFrame, entries: int = 0) -> tuple[DataFrame, bool]:
        """``(*columns of classes, text)``: a text of each class (set_id, ...), and whether some class may come twice:
        where rows repeat id and text. ``entries`` is how many array entries the classes carry in all."""
        keys = self.rows.join(classes.select("set_id"), "set_id").groupBy("set_id", "rk").agg(F.count("*").alias("times"))
        keys = written(keys.groupBy("set_id").agg(F.min(F.struct("rk", "times")).alias("one")).select("set_id", "one.rk", "one.times"), "wanted")
        count, times = keys.agg(F.count("*"), F.max("times")).first()
        wanted = keys.select("set_id", "rk").join(classes, "set_id")
        if 2 * count + entries <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return self.base.join(wanted, "rk").select(*classes.columns, "text"), (times or 0) > 1

    def sketches(self, classes: DataFrame) -> DataFrame:
        texts, twice = self.of(classes)
        out = texts.select("text").mapInArrow(_sketch_table(self.n), ", ".join(["set_id long, n long, wide binary", *(f"{b} long" for b in _BITS)]))
        out = written(out.dropDuplicates(["set_id"]) if twice else out, "sketches")
        self.wide_bytes = out.agg(F.sum(F.octet_length("wide"))).first()[0] or 0
        return out

    def sets(self, classes: DataFrame, entries: int) -> DataFrame:
        """``(src, dst, members)``: the set of every class dst for each of its ``leaders`` src."""
        return self.of(classes, entries)[0].mapInArrow(_set_table(self.n), "src long, dst long, members array<long>")


def _apart(x: list[bytes], y: list[bytes], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hamming distances of the sketches x[at] and y[to], wider ones folded."""
    out = np.zeros(len(at), np.int64)
    widths = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    both = np.stack([widths[0][at], widths[1][to]], 1)
    for wx, wy in np.unique(both, axis=0).tolist():
        width, bits, place = min(wx, wy), [], []
        for side, mine, wide in ((x, widths[0], wx), (y, widths[1], wy)):
            own = np.flatnonzero(mine == wide)
            flat = np.frombuffer(b"".join(side[i] for i in own), np.uint64).reshape(len(own), wide // 8)
            while flat.shape[1] * 8 > width:
                flat = flat[:, : flat.shape[1] // 2] ^ flat[:, flat.shape[1] // 2 :]
            bits.append(flat)
            place.append((own, np.searchsorted(own, np.arange(len(mine)))))
        pair = np.flatnonzero((both == (wx, wy)).all(1))
        for some in np.array_split(pair, 1 + len(pair) * width // 8_000_000):
            differ = bits[0][place[0][1][at[some]]] ^ bits[1][place[1][1][to[some]]]
            out[some] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def _compared(percent: int):
    """The pairs of a square, given with the wide sketches of its classes, that the sketches don't tell apart."""

    def run(table: pa.Table) -> pa.Table:
        src, dst = table.column("src"), table.column("dst")
        sketches, pairs = table.filter(dst.is_null()), table.filter(dst.is_valid())
        ids, sizes, wide = (sketches.column(c) for c in ("src", "n", "wide"))
        order = np.argsort(ids.to_numpy())
        ids, sizes, wide = ids.to_numpy()[order], sizes.to_numpy()[order], wide.take(pa.array(order)).to_pylist()
        src, dst = pairs.column("src").to_numpy(), pairs.column("dst").to_numpy()
        at, to = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        may = (100 + percent) * _apart(wide, wide, at, to) <= (100 - percent) * (sizes[at] + sizes[to])
        return pa.table({"src": pa.array(src[may], pa.int64()), "dst": pa.array(dst[may], pa.int64())})

    return run


def _by_wide_sketches(pairs: DataFrame, many: int, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``many`` pairs (src, dst) of classes with wide sketches, ``size`` bytes in all, that these don't tell apart."""
    cores = sketches.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.isqrt(2 * cores), -(-size // BLOCK_BYTES), math.isqrt(many // BLOCK_PAIRS) + 1)
    block = lambda c: F.pmod(F.xxhash64(F.lit(blocks), c), F.lit(blocks)).alias(f"{c}_block")
    squares = ["src_block", "dst_block"]
    dealt = pairs.select("src", "dst", block("src"), block("dst"))
    sides = dealt.select(F.col("src").alias("set_id"), *squares).unionByName(dealt.select(F.col("dst").alias("set_id"), *squares)).distinct()
    sent = sides.join(sketches, "set_id").select(F.col("set_id").alias("src"), F.lit(None).cast("long").alias("dst"), *squares, "n", "wide")
    return sent.unionByName(dealt, allowMissingColumns=True).groupBy(*squares).applyInArrow(_compared(percent), "src long, dst long")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough."""
    light, least = sketches.drop("wide"), F.least("x.n", "y.n")
    close = written(
        pairs.join(light.alias("x"), F.col("src") == F.col("x.set_id"))
        .join(light.alias("y"), F.col("dst") == F.col("y.set_id"))
        .where(_may_link(percent))
        .select("src", "dst", (least > 64 * SKETCH_WORDS).alias("large")),
        "close",
    )
    entries, large = close.agg(F.count("*"), F.count_if("large")).first()
    if large:
        few = _by_wide_sketches(close.where("large"), large, sketches.where("wide is not null").select("set_id", "n", "wide"), texts.wide_bytes, percent)
        close = written(close.where("not large").select("src", "dst").unionByName(few), "closer")
        entries = close.count()
    if not entries:
        return close.select("src", "dst")
    # each set travels once, to its leader; a class has no more leaders than keys
    to_leader = close.groupBy(F.col("dst").alias("set_id")).agg(F.collect_set("src").alias("leaders"))
    leading = close.select(F.col("src").alias("set_id")).distinct().withColumn("leaders", F.array("set_id"))
    own = texts.sets(leading, entries).select("src", F.col("members").alias("m1"))
    checked = texts.sets(to_leader, entries).join(own, "src").select("src", "dst", (F.size("m1") + F.size("members")).alias("total"), F.size(F.array_intersect("m1", "members")).alias("common"))
    return written(checked.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("src", "dst").distinct(), "links")


def _open_groups(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Groups of keys whose classes lie in more than one component, with the component of each row. Groups that are
    settled once stay so."""
    named = groups.select("key", "set_id").join(found.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = named.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    return named.join(mixed, "key")


def similar_documents(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows and classes: ``(doc_id, rk, n_shingles, set_id)`` per row, ``(set_id, component)`` per linked class. (job)

    ``rk`` is the key of :func:`scorewright.llm.store.row_key`. Classes without links are missing from the second.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("rk", row_key("doc_id", "text"))
    rows = written(
        base.mapInArrow(_row_table(n), "doc_id long, rk long, n_shingles long, set_id long, set_check long"), "rows"
    )
    clash = rows.where("set_id is not null").groupBy("set_id").agg(F.min("set_check").alias("a"), F.max("set_check").alias("b")).where("a <> b")
    if clash.limit(1).count():
        raise ValueError("two different sets share a 64-bit signature; change the salt of signature()")

    keys = base.select("text").mapInArrow(_key_table(n, percent), "key long, set_id long")
    grouped = keys.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_groups, "key long, set_id long, leader long")
    groups = written(grouped, "groups")

    texts = _Texts(base, rows, n)
    sketches = texts.sketches(groups.select("set_id").distinct())
    links = _verified(groups.where("set_id <> leader").select(F.col("leader").alias("src"), F.col("set_id").alias("dst")).distinct(), sketches, texts, percent)
    found = written(components(links), "found")
    for turn in range(LEADER_ROUNDS):
        groups = unsettled = written(_open_groups(groups, found), "open")
        if unsettled.isEmpty():
            return rows.drop("set_check"), found.select(F.col("id").alias("set_id"), "component")
        other = unsettled.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key", "set_id"), "set_id", "component")).alias("lead"))
        pairs = unsettled.join(other, "key").where("component <> lead.component").select(F.col("lead.set_id").alias("src"), F.col("set_id").alias("dst")).distinct()
        links = links.unionByName(_verified(pairs, sketches, texts, percent))
        found = written(components(links), "found")

    sides = written(_open_groups(groups, found).select("key", "set_id", "component").join(sketches.drop("wide"), "set_id"), "sides")
    if sides.isEmpty():
        return rows.drop("set_check"), found.select(F.col("id").alias("set_id"), "component")
    x, y = sides.alias("x"), sides.alias("y")
    apart = (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.component") != F.col("y.component"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _may_link(percent)).select(F.col("x.set_id").alias("src"), F.col("y.set_id").alias("dst")).distinct()
    links = links.unionByName(_verified(pairs, sketches, texts, percent))
    return rows.drop("set_check"), components(links).select(F.col("id").alias("set_id"), "component")


def parity_sketch_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its set size and component: ``(doc_id, rk, n_shingles, component_id)``. (job)

    ``component_id`` is the smallest id that links of at least ``percent`` percent Jaccard similarity reach; a row with
    the empty set is its own component.
    """
    rows, found = similar_documents(docs, n, percent, id_col, text_col)
    named = rows.join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = written(named, "named")
    least = named.where("set_id is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(least, "component", "left")
    return joined.select("doc_id", "rk", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, one of each component: the smallest id, of rows that repeat it the first by row key, and of rows that
    agree in both id and text one. (job)

    Rows with the empty set all stay.
    """
    named = parity_sketch_join(docs, n, percent, id_col, text_col)
    kept = named.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("best"))
    copies = named.where("n_shingles > 0").groupBy(F.col("rk").alias("_rk")).agg((F.count("*") > 1).alias("_many"))
    kept = kept.select(F.col("best.rk").alias("_rk")).join(copies, "_rk")
    kept = written(kept.unionByName(named.where("n_shingles = 0").select(F.col("rk").alias("_rk"), F.lit(False).alias("_many")).distinct()), "kept")
    keyed = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_rk"), whole_row(docs).alias("row"))
    single = keyed.join(kept.where("not _many"), "_rk", "left_semi")
    if kept.where("_many").isEmpty():
        return single.select("row.*")
    repeated = keyed.join(kept.where("_many"), "_rk", "left_semi")
    one = repeated.groupBy("_rk").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.unionByName(one).select("row.*")
