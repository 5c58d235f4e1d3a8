"""Toxic text by a support vector machine over a gap-tolerant subsequence string kernel with Nystroem landmarks.

*Units.* A sentence is read as units: words, and runs of single letters set apart ("i d i o t"). Letters count in lower case, a
few digits and signs as the letters they stand for, other signs not at all; ``^`` bounds a unit at both ends.
*Kernel.* Two units share every subsequence of three symbols within a span of ``SPAN``; each symbol left out weighs
``DECAY``. So an insult with inserted or dropped letters stays close to the plain one. Kernels are scaled by the root of the
summed squared weights of either unit.
*Landmarks.* The units that mark toxic training documents most, and frequent units of the others. With K the kernel
matrix of the landmarks, a unit's features are its kernels with them times K^(-1/2).
*Training.* Units that occur ``LIFT`` times as often in toxic documents are positive sentences' witnesses, units of the others
negative; a linear support vector machine separates their features. The worst unit of a document, how many units are
beyond the margin and how many there are, give its probability by logistic regression on the training documents.
*Scoring.* The decision function is linear in the subsequences, so landmarks and weights fold into one table of 64 ** 3
numbers (1 MB, broadcast). Every whole text is scanned; a task scores each distinct unit once.

The fit uses at most about ``SAMPLE`` labelled rows of each class, those of smallest hash; scoring covers all rows. Labels,
language, source and id are no inputs of a score.

Cases: null and empty texts have no units and score as such. Labels other than 0 and 1 and null ids are ignored; an id
with both labels is toxic. With fewer than one row of either class all scores are the share of toxic training rows (0 if
there are none). Rows that repeat are scored alike. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import text as T
from scorewright.llm.store import written

SAMPLE = 3000
SPAN = 6
DECAY = 0.6
WIDTH = 24  # symbols of a unit that are looked at together; longer units are read in stretches
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 64, 32
LIFT, LEAST_Z = 8.0, 3.0
PLAIN_UNITS = 10_000
PLAIN_WEIGHT = 20.0  # of all plain units against all toxic ones
CACHE = 1_000_000
_EDGE, _CODES = 63, 64

_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:192] = 28 + (np.arange(64) & 31)
for _sign, _letter in zip("0134@5$7", "oieaasst", strict=True):
    _CODE[ord(_sign)] = ord(_letter) - 96


@dataclass
class Units:
    """Units of a piece: row, hash and byte span of each, by row for words and then for runs."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def units(piece: T.Piece) -> Units:
    """Words and runs of single letters of a piece."""
    w = T.words(piece)
    letters = np.concatenate([[0], np.cumsum(_CODE[piece.data] > 0)])
    count = letters[w.end] - letters[w.start]
    single = count <= 1
    same = np.r_[False, w.row[1:] == w.row[:-1]] if len(w.row) else np.zeros(0, bool)
    opens = np.flatnonzero(single & ~(np.r_[False, single[:-1]] & same)) if len(single) else np.zeros(0, np.int64)
    ends_here = single & ~np.r_[(single[1:] & same[1:]), False] if len(single) else single
    closes = np.flatnonzero(ends_here)
    enough = letters[w.end[closes]] - letters[w.start[opens]] >= 3
    opens, closes = opens[enough], closes[enough]
    some = count > 1
    start, end = np.r_[w.start[some], w.start[opens]], np.r_[w.end[some], w.end[closes]]
    extra = T.span_hash(T.prefix_sums(piece.data), w.start[opens], w.end[closes])
    return Units(np.r_[w.row[some], w.row[opens]], np.r_[w.hash[some], extra], start, end)


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the spans as rows of a matrix, zeros behind; and the span of each row (long spans have several)."""
    length = end - start
    span = np.repeat(np.arange(len(start)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
    code = _CODE[data[at]]
    span, code = span[code > 0], code[code > 0]
    n = np.bincount(span, minlength=len(start)) + 2
    offset = np.cumsum(n) - n
    flat = np.full(int(n.sum()), _EDGE, np.uint8)
    place = np.arange(len(code)) - np.repeat(np.cumsum(n - 2) - (n - 2), n - 2)
    flat[np.repeat(offset, n - 2) + 1 + place] = code
    half = WIDTH // 2
    stretches = np.maximum(1, -(-(n - half) // half))
    owner = np.repeat(np.arange(len(start)), stretches)
    first = offset[owner] + half * (np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
    index = first[:, None] + np.arange(WIDTH)
    inside = index < (offset + n)[owner][:, None]
    return np.where(inside, flat[np.minimum(index, max(len(flat) - 1, 0))], 0), owner


_STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN + 1) for a in range(1, b)]


def subsequences(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of steps: the number of the three symbols at every place, whether they are there, and the weight."""
    wide = code.astype(np.int32)
    width = int((code > 0).sum(axis=1).max(initial=0))
    for a, b, weight in _STEPS:
        if width > b:
            yield (wide[:, : width - b] << 12) | (wide[:, a : width - b + a] << 6) | wide[:, b:width], wide[:, b:width] > 0, weight


def scale(code: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of each row."""
    n = (code > 0).sum(axis=1)
    total = sum(np.maximum(n - b, 0) * weight**2 for _, b, weight in _STEPS)
    return np.sqrt(np.maximum(total, 1e-9))


def kernel_table(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled subsequence weights of a bounded number of rows: where each of the 64 ** 3 subsequences stands in the table
    (0: in none of the rows), and the table with a column per row and zeros at 0."""
    weights = [(number[there], np.nonzero(there)[0], weight) for number, there, weight in subsequences(code)]
    used = np.unique(np.concatenate([n for n, _, _ in weights])) if weights else np.zeros(0, np.int64)
    place = np.zeros(_CODES**3, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(code)), np.float32)
    for number, row, weight in weights:
        np.add.at(table, (place[number], row), weight)
    return place, table / scale(code)


def products(code: np.ndarray, table: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Scaled kernel of each row with a table over subsequences: one number each, or with ``place`` the table's columns."""
    out = np.zeros((len(code), *table.shape[1:]))
    for number, there, weight in subsequences(code):
        picked = table[number if place is None else place[number]]
        picked *= (weight * there) if table.ndim == 1 else (weight * there)[..., None]
        out += picked.sum(axis=1)
    return out / (scale(code) if table.ndim == 1 else scale(code)[:, None])


# ---------------------------------------------------------------- training


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for piece in T.pieces(batch.column("text")):
            u = units(piece)
            _, first = np.unique(np.stack([u.row.astype(np.uint64), u.hash]), axis=1, return_index=True) if len(u.row) else (None, np.zeros(0, np.int64))
            code, owner = coded(piece.data, u.start[first], u.end[first])
            letters = ["".join(map(chr, c[1:][c[1:] > 0])).rstrip(chr(_EDGE)) for c in code]
            found = sorted(set(zip((piece.lo + u.row[first][owner]).tolist(), letters, strict=True)))  # spelt alike in one text: once
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in found], pa.string()), pa.array(toxic[[r for r, _ in found]] if found else toxic[:0])], ["unit", "toxic"])


def _from_letters(letters: list[str]) -> np.ndarray:
    """Symbol rows of units that :func:`_unit_rows` has spelt by symbol numbers."""
    out = np.zeros((len(letters), WIDTH), np.uint8)
    for i, x in enumerate(letters):
        row = [_EDGE, *map(ord, x), _EDGE][:WIDTH]
        out[i, : len(row)] = row
    return out


def _features(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table, root = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                z = products(_from_letters(part.column("unit").to_pylist()), table, place) @ root
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([flat, part.column("label"), part.column("weight")], ["z", "label", "weight"])

    return run


def fit_table(sample: DataFrame) -> tuple[np.ndarray, float] | None:
    """Table over subsequences and intercept of the decision function, from rows (text, toxic). (job)"""
    spark = sample.sparkSession
    sizes = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not (sizes[0] and sizes[1]):
        return None
    n1, n0 = float(sizes[0]), float(sizes[1])
    counted = sample.mapInArrow(_unit_rows, "unit string, toxic int").where("unit <> ''").groupBy("unit").agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
    p1, p0, p = F.col("d1") / n1, F.col("d0") / n0, (F.col("d1") + F.col("d0") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    lift = ((F.col("d1") + 0.5) / n1) / ((F.col("d0") + 0.5) / n0)
    counted = written(counted.select("unit", "d1", "d0", z.alias("z"), lift.alias("lift")), "units")
    witness = (F.col("lift") >= LIFT) & (F.col("z") >= LEAST_Z) & (F.col("d1") >= 2)
    marks = counted.where(witness).orderBy(F.desc("z"), "unit").limit(TOXIC_LANDMARKS).collect()
    plain = counted.where("d0 > 0 and lift < 2").orderBy(F.desc("d0"), "unit").limit(PLAIN_LANDMARKS).collect()
    if not marks or not plain:
        return None
    other = counted.where("d0 > 0 and lift < 2")
    chance = F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) / float(1 << 30)
    common = other.orderBy(F.desc("d0"), "unit").limit(PLAIN_UNITS).select("unit", "d0")
    spread = other.where(chance < PLAIN_UNITS / max(other.count(), 1)).select("unit", "d0")
    toxic = counted.where(witness).select("unit", F.lit(1).alias("label"), F.col("d1").cast("double").alias("weight"))
    calm = common.unionByName(spread)
    table, intercept = _machine([r["unit"] for r in marks + plain], toxic, calm)
    # once more, with the plain units that come closest to insults among the landmarks and the training units
    scored = other.select("unit", "d0").repartition(8).mapInArrow(_decisions(spark.sparkContext.broadcast((table, intercept))), "unit string, d0 long, f double")
    hard = written(scored.where("f > -1").orderBy(F.desc(F.col("f") + F.log10("d0")), "unit").limit(PLAIN_UNITS), "hard")
    near = hard.orderBy(F.desc(F.col("f") + F.log10("d0")), "unit").limit(2 * PLAIN_LANDMARKS).collect()
    return _machine([r["unit"] for r in marks + plain + near], toxic, calm.unionByName(hard.select("unit", "d0")))


def _machine(landmarks: list[str], toxic: DataFrame, calm: DataFrame) -> tuple[np.ndarray, float]:
    """Folded table and intercept of a machine with these landmarks, trained on toxic units and on plain ones (unit, d0)."""
    spark = toxic.sparkSession
    place, columns = kernel_table(_from_letters(list(dict.fromkeys(landmarks))))
    value, vector = np.linalg.eigh(columns.T.astype(np.float64) @ columns)
    root = (vector * np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0.0)) @ vector.T
    plain = calm.distinct().select("unit", F.lit(0).alias("label"), F.col("d0").cast("double").alias("weight"))
    share = toxic.agg(F.sum("weight")).first()[0] / max(plain.agg(F.sum("weight")).first()[0] or 1.0, 1.0)
    both = toxic.unionByName(plain.withColumn("weight", F.col("weight") * share * PLAIN_WEIGHT))
    sent = spark.sparkContext.broadcast((place, columns, root))
    ready = written(both.repartition(8).mapInArrow(_features(sent), "z array<double>, label int, weight double"), "features")
    ready = ready.select(array_to_vector("z").alias("features"), "label", "weight").coalesce(8).cache()  # a bounded sample, read in every step
    model = LinearSVC(maxIter=40, regParam=1e-4, weightCol="weight", standardization=False).fit(ready)
    ready.unpersist()
    folded = columns @ (root @ model.coefficients.toArray())
    return folded[place].astype(np.float32), float(model.intercept)


def _decisions(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 5000):
                part = batch.slice(lo, 5000)
                f = products(_from_letters(part.column("unit").to_pylist()), table) + intercept
                yield pa.RecordBatch.from_arrays([part.column("unit"), part.column("d0"), pa.array(f)], ["unit", "d0", "f"])

    return run


# ---------------------------------------------------------------- scoring

_FLOOR = -3.0


def _unit_scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = sent.value
        known: dict[int, float] = {}
        for batch in batches:
            worst, beyond, size = np.full(len(batch), _FLOOR), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for piece in T.pieces(batch.column("text")):
                u = units(piece)
                if not len(u.row):
                    continue
                distinct, first, back = np.unique(u.hash, return_index=True, return_inverse=True)
                score = np.array([known.get(h, np.nan) for h in distinct.tolist()])
                new = np.flatnonzero(np.isnan(score))
                for lo in range(0, len(new), 20_000):
                    part = new[lo : lo + 20_000]
                    score[part] = decided(piece.data, u.start[first[part]], u.end[first[part]], table, intercept)
                if len(known) > CACHE:
                    known = {}
                known.update(zip(distinct[new].tolist(), score[new].tolist(), strict=True))
                value = score[back]
                row = u.row + piece.lo
                np.maximum.at(worst, row, value)
                np.add.at(beyond, row, value > 0)
                np.add.at(size, row, 1)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(worst), pa.array(beyond), pa.array(size)], [*names, "worst", "beyond", "size"])

    return run


def decided(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, intercept: float) -> np.ndarray:
    """Decision value of each unit, its worst stretch, within -3 and 3."""
    code, owner = coded(data, start, end)
    turn = np.argsort((code > 0).sum(axis=1), kind="stable")
    value = np.empty(len(code))
    for part in np.array_split(turn, max(1, len(turn) // 2000)):
        value[part] = products(code[part], table) + intercept
    out = np.full(len(start), _FLOOR)
    np.maximum.at(out, owner, np.clip(value, _FLOOR, -_FLOOR))
    return out


def _inputs() -> F.Column:
    return F.array(F.col("worst"), F.log1p(F.col("beyond").cast("double")), F.log1p(F.col("size").cast("double")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row. (job)

    Rows whose crc32 of the id as text is 0 modulo ``folds`` are held out: their labels aren't used.
    """
    spark = docs.sparkSession
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(folds))
    graded = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    graded = written(graded, "graded")
    sizes = {r["toxic"]: r["count"] for r in graded.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = F.when(F.col("toxic") == 1, sample / max(n1, 1)).otherwise(sample / max(n0, 1))
    chosen = graded.where(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    weight = F.when(F.col("toxic") == 1, max(1.0, n1 / sample)).otherwise(max(1.0, n0 / sample))
    train = docs.select(F.col(id_col).alias("_id2"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_id2") == F.col("_id"))  # about 2 * sample rows
    train = written(train.select("text", "toxic", weight.alias("weight")), "train")

    fitted = fit_table(train.select("text", "toxic"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    if fitted is None:
        score = F.lit(n1 / max(n1 + n0, 1))
        return base.select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    sent = spark.sparkContext.broadcast(fitted)
    facts = "worst double, beyond long, size long"
    known = written(train.mapInArrow(_unit_scores(sent), f"toxic int, weight double, {facts}"), "known").select(array_to_vector(_inputs()).alias("features"), F.col("toxic").alias("label"), "weight")
    model = LogisticRegression(maxIter=50, regParam=1e-4, weightCol="weight").fit(known)
    w, b = model.coefficients.toArray().tolist(), float(model.intercept)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = base.mapInArrow(_unit_scores(sent), f"doc_id {kind}, {facts}")
    margin = F.lit(b) + w[0] * F.col("worst") + w[1] * F.log1p(F.col("beyond").cast("double")) + w[2] * F.log1p(F.col("size").cast("double"))
    return scored.select("doc_id", held, (1 / (1 + F.exp(-margin))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
