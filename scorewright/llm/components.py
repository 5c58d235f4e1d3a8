"""Connected components of a table of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.store import written


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every linked id; component is the smallest id that links reach.

    Each round joins every node's neighbours to their minimum, a small aggregate with map-side combine, so a node
    with very many neighbours is never gathered in one place. Rounds grow with the logarithm of the longest chain,
    and each is written to the shared folder. Links with null ends are ignored; no links give no rows.
    """
    edges = written(
        links.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    stars = edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component")
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return stars.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    own = least.select("hi", F.col("m").alias("lo"))
    return moved.unionByName(own).where("hi <> lo").distinct()
