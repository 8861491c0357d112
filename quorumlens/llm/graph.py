"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _centred(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the least id among u and all its neighbours.

    The minimum is summed up before the shuffle, so a centre with very many neighbours
    moves one row a task.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id in ``links``: root is the least id it is linked with, however far.

    Each round hangs larger neighbours on the least one, then smaller ones too, until
    every edge leads to a root; the number of rounds grows with the logarithm of the
    longest chain. Rounds are kept by checkpoints, so a lost executor costs one round.
    """
    edges = checkpoint(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:  # ends: a round that changes nothing is the last
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _centred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tied = _centred(large)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u != v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).collect()[0]
        if before == (now["n"], now["x"]):
            break
        before = (now["n"], now["x"])
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
