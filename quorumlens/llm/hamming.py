"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's binary code has a bit for each component (1 where it is positive), cut into
segments of about log2(n) bits, each indexed by its value. In round r every unfinished query
probes all segment values that differ from its own in exactly r bits. Two codes at distance
d differ in at most d // segments bits of some segment, so after round r everything up to
``segments * (r + 1) - 1`` has been verified: a query ends as soon as its k-th verified
distance is no greater. A pair is counted once, at the first segment of its least radius.

Equal codes are one entry with the least ids that share it. Every round is an equi-join that
Spark shuffles (and splits where skewed); the rounds, at most a segment's bits and one, are
kept by checkpoints.

Defined results: as for ``vectors.usable``; repeated rows are one; with fewer other rows than
asked for all are returned; ties go to the smaller vec_id; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint
from .vectors import classes, usable

#: A segment has at most so many bits.
MOST_BITS = 16


def spans(bits: int, entries: int) -> list[tuple[int, int]]:
    """(start, length) of the segments for so many entries."""
    size = max(1, min(MOST_BITS, bits, round(math.log2(max(entries, 2)))))
    count = -(-bits // size)
    edge = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _code(v: str, start: int, length: int) -> Column:
    bit = lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)
    return F.aggregate(F.slice(v, start + 1, length), F.lit(0), bit)


def nearest_codes(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` nearest others of each row that ``is_query`` (over vec_id) picks."""
    rows, bits = usable(rows)
    bits = max(bits, 1)
    # The code as whole numbers of 32 bits names an entry; the segments follow from the number of entries.
    words = [(a, min(31, bits - a)) for a in range(0, bits, 31)]
    rows = rows.select("vec_id", F.array(*[_code("v", a, n) for a, n in words]).alias("code"), "v")
    entries = checkpoint(classes(rows, "code", k + 1))
    cut = spans(bits, entries.count())
    segment = [F.lit(0)] * len(cut)
    for j, (start, length) in enumerate(cut):
        bit = lambda i: F.shiftright(F.element_at("key", i // 31 + 1), words[i // 31][1] - 1 - i % 31).bitwiseAND(F.lit(1))  # noqa: E731, B023
        segment[j] = reduce(lambda acc, i: acc * 2 + bit(i), range(start, start + length), F.lit(0))
    m = len(cut)
    entries = checkpoint(entries.select("id", "ids", "key", *[s.alias(f"s{j}") for j, s in enumerate(segment)]))
    index = entries.select("id", F.size("ids").alias("n"), *[f"s{j}" for j in range(m)], F.posexplode(F.array(*[f"s{j}" for j in range(m)])).alias("j", "value"))
    asking = rows.where(is_query).select("vec_id", F.col("code").alias("key")).distinct().join(entries.select("key", F.col("id").alias("query")), "key").select("vec_id", "query")
    asking = checkpoint(asking)
    active = asking.select("query").distinct().join(entries.select(F.col("id").alias("query"), *[F.col(f"s{j}").alias(f"q{j}") for j in range(m)]), "query")
    active, state = checkpoint(active), None
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = Window.partitionBy("query").orderBy("distance", "id")
    finished: list[DataFrame] = []
    for r in range(max(n for _, n in cut) + 1):
        # Few queries make many probes: they are dealt out anew, so that each task makes its share.
        probes = active.repartition(tasks, "query").select("*", F.posexplode(F.array(*[f"q{j}" for j in range(m)])).alias("j", "v"))
        probes = probes.join(F.broadcast(_masks(rows.sparkSession, [n for _, n in cut], r)), "j").withColumn("value", F.col("v").bitwiseXOR(F.col("mask"))).drop("v", "mask")
        apart = [F.bit_count(F.col(f"q{j}").bitwiseXOR(F.col(f"s{j}"))) for j in range(m)]
        first = reduce(lambda rest, j: F.when(apart[j] <= r, j).otherwise(rest), reversed(range(m)), F.lit(-1))
        nearer = reduce(lambda a, b: a & b, [d >= r for d in apart])
        hits = probes.join(index, ["j", "value"]).where(nearer & (first == F.col("j")))
        hits = hits.select("query", "id", "n", reduce(lambda a, b: a + b, apart).alias("distance"))
        if state is not None:
            hits = hits.unionByName(state.join(active.select("query"), "query", "left_semi"))
        ranked = hits.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
        state = checkpoint(ranked.select("query", "id", "n", "distance"))
        # Own row included, so the (k + 1)-th counts; a query whose count is not reached goes on.
        upto = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, 0))
        kth = state.withColumn("upto", upto).where(F.col("upto") >= k + 1).groupBy("query").agg(F.min("distance").alias("kth"))
        done = checkpoint(kth.where(F.col("kth") <= m * (r + 1) - 1).select("query"))
        finished.append(state.join(done, "query", "left_semi"))
        active = checkpoint(active.join(done, "query", "left_anti"))
        if active.isEmpty():
            break
    else:  # every code has been seen: what is left has fewer than k others
        finished.append(state.join(active.select("query"), "query", "left_semi"))
    found = reduce(DataFrame.unionByName, finished)
    found = found.join(entries.select("id", "ids"), "id").select("query", "distance", F.explode("ids").alias("vec_id"))
    near = found.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))).where(F.col("rn") <= k + 1)
    out = asking.select(F.col("vec_id").alias("query_id"), "query").join(near.drop("rn"), "query").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def _masks(spark: SparkSession, lengths: list[int], radius: int) -> DataFrame:
    """(j, mask): for each segment all numbers of its length in bits of which exactly ``radius`` are set.

    At most C(``MOST_BITS``, radius) a segment, 12,870, whatever the input.
    """
    fits = F.array_compact(F.array(*[F.when(F.col("id") < 1 << n, j) for j, n in enumerate(lengths)]))
    numbers = spark.range(1 << max(lengths)).where(F.bit_count("id") == radius)
    return numbers.select(F.explode(fits).alias("j"), F.col("id").cast("int").alias("mask"))
