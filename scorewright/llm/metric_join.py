"""Exact range join of unit vectors in a metric space of many cells.

Vectors with cosine of at least ``least`` lie within distance r = sqrt(2 - 2 least) of each other on the unit sphere.

*Cells.* Pivots, a hash sample of the vectors of each label, partition its vectors: each belongs to the cell of its nearest
pivot. By the triangle inequality two vectors within r of each other whose nearest pivots are p and q satisfy
d(x, q) - d(x, p) <= 2 r, and the bisecting hyperplane of p and q is no further than r from either. A vector is copied as a
guest to the cells with smaller number that satisfy both, so each close pair meets in exactly one cell.
*Blocks.* Cells join independently. A cell above ``BLOCK_ROWS`` is cut by hash into blocks, and each pair of blocks is a
task's work of bounded size, however dense the cell is.
*Links* are counted inside the task; only counts per vector and a spanning forest of the links leave it, so a group of
near copies isn't expanded to all its pairs.
*Copies.* Equal vectors of a label are one class with a count.

Pivots only decide how work is spread; results are exact for any. Their number grows with the rows of a label up to
``MAX_PIVOTS``, and they reach the vectors by a join, not a broadcast.

Cases: null, empty and zero vectors, and those that hold nulls or non-finite values, link with nothing, nor do rows with
null labels. Vectors of different length don't link. Repeated rows link with each other. A null id counts as a vector,
but names no component; it is never kept. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.components import components
from scorewright.llm.store import written

CELL_ROWS = 2048
MAX_PIVOTS = 1024
CHUNK_ROWS = 20_000
BLOCK_ROWS = 3072
_SLACK = 1e-9


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cells_of(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) of the own cell of every vector and of the cells with smaller number it must visit."""
    square = np.maximum(2 - 2 * vectors @ pivots.T, 0)
    own = square.argmin(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[own]
    nearest = square[np.arange(len(own)), own][:, None]
    plane = (square - nearest) <= 2 * between * radius + _SLACK
    triangle = np.sqrt(square) - np.sqrt(nearest) <= 2 * radius + _SLACK
    row, cell = np.nonzero(plane & triangle & (np.arange(len(pivots)) < own[:, None]))
    return np.r_[np.arange(len(own)), row], np.r_[own, cell], np.r_[np.zeros(len(own), bool), np.ones(len(row), bool)]


def _assign(radius: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _CELLS.empty_table()
        vectors = unit_rows(left.column("v"))
        if right.num_rows:
            order = np.argsort(right.column("pivot_cid").to_numpy())
            row, cell, guest = cells_of(vectors, unit_rows(right.column("pivot_v"))[order], radius)
        else:
            row, cell, guest = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors), bool)
        size = vectors.shape[1]
        flat = pa.array(vectors[row].ravel())
        unit = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * size), flat)
        picked = left.select(["gid", "cid", "n"]).take(pa.array(row))
        return pa.table([*picked.columns, pa.array(cell), pa.array(guest), unit], schema=_CELLS)

    return run


_CELLS = pa.schema([("gid", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("cell", pa.int64()), ("guest", pa.bool_()), ("v", pa.list_(pa.float64()))])


def linked(vectors: np.ndarray, guest: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the two sides with cosine >= least, each once; pairs of two guests belong to another cell."""
    near = vectors[one] @ vectors[two].T >= least
    near &= ~(guest[one][:, None] & guest[two][None, :])
    i, j = np.nonzero(near)
    i, j = one[i], two[j]
    return (i[i < j], j[i < j]) if np.array_equal(one, two) else (i, j)


def _join(least: float):
    def run(table: pa.Table) -> pa.Table:
        vectors, guest = unit_rows(table.column("v")), table.column("guest").to_numpy()
        cid, n, block = (table.column(c).to_numpy() for c in ("cid", "n", "block"))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        one, two = np.flatnonzero(block == a), np.flatnonzero(block == b)
        add = np.zeros(len(cid), np.int64)
        label = np.arange(len(cid))
        if len(one) and len(two):
            i, j = linked(vectors, guest, one, two, least)
            np.add.at(add, i, n[j])
            np.add.at(add, j, n[i])
            while len(i):  # labels sink to the smallest of each local component
                low = np.minimum(label[i], label[j])
                new = label.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        hit = add > 0
        return pa.table({"cid": cid[hit], "links": add[hit], "root": cid[label[hit]]})

    return run


def metric_join(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row. (job)"""
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v")))
    usable = rows.where("v is not null")
    classes = usable.groupBy("label", "v").agg(F.count("*").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("gid", F.xxhash64("label", F.size("v"))), "classes")

    # a shared 64-bit group number of two labels is told apart below, where classes of different labels are not joined
    groups = classes.groupBy("gid", "label", F.size("v").alias("dim")).agg(F.count("*").alias("rows"))
    if groups.groupBy("gid").count().where("count > 1").limit(1).count():
        raise ValueError("two groups of label and length share a 64-bit number")
    groups = written(groups.select("gid", "rows"), "groups")
    pivots_of = F.when(F.col("rows") > CELL_ROWS, F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("rows") / CELL_ROWS) + 3)).otherwise(0)
    sized = classes.join(groups, "gid").withColumn("chunks", F.ceil(F.col("rows") / CHUNK_ROWS))
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "cid"), F.lit(1 << 30)) / float(1 << 30)
    pivots = sized.where(chance < pivots_of / F.col("rows")).select(
        F.col("gid").alias("pivot_gid"), F.col("cid").alias("pivot_cid"), F.col("v").alias("pivot_v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("pivot_chunk")
    )
    chunked = sized.select("gid", "cid", "n", "v", F.pmod(F.xxhash64("cid"), F.col("chunks")).alias("chunk"))
    assigned = chunked.groupBy("gid", "chunk").cogroup(pivots.groupBy("pivot_gid", "pivot_chunk")).applyInArrow(_assign(radius), "gid long, cid long, n long, cell long, guest boolean, v array<double>")
    assigned = written(assigned, "cells")

    blocks = assigned.groupBy("gid", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = assigned.join(blocks, ["gid", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).select("gid", "cell", "a", "b", "block", "cid", "n", "guest", "v")
    found = written(dealt.groupBy("gid", "cell", "a", "b").applyInArrow(_join(least), "cid long, links long, root long"), "links")

    linked_to = found.groupBy("cid").agg(F.sum("links").alias("links"))
    member_of = components(found.where("cid <> root").select(F.col("cid").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("id", "cid")
    facts = classes.join(linked_to, "cid", "left").join(member_of, "cid", "left")
    facts = facts.select("label", "v", "n", "cid", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    named = written(usable.join(facts, ["label", "v"]).select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component"), "named")
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    joined = named.join(least_id, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
