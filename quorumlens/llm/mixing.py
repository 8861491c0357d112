"""Mixing sources to target weights.

Each source has a token target; its documents get hash-random keys, are cut into equal key
ranges (the keys are uniform, so the ranges are balanced whatever the input's order),
prefix-summed range by range, and taken up to exactly the source's budget: whole epochs
first, then the documents before the cut, then the part of the document at the cut.

The key ranges of a source are in proportion to its share of all words, so a source that
holds a third of the rows is spread over a third of all ranges. What is planned on the
driver is one number per source, as shares are settled between all sources; the table of
ranges has ``RANGES`` rows and one more for each source. Both grow with the number of
sources, so Spark chooses how they are joined by their size.

Defined results: null text has size 0; a null source is a source of its own and comes last;
documents of size 0 and sources without a word take 0; rows are told apart by doc_id and
text, and repeated rows are each counted; a null doc_id is kept; empty input gives no row;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its own size.
MOST = 3.0
#: Key ranges over all sources. Each holds about 1/RANGES of the words, in one task at a time.
RANGES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, total: float | None = None) -> dict[str | None, float]:
    """Each source's target: weights repeat over the sources by code point, null last.

    ``total`` (default: all words) is shared by weight; what exceeds ``MOST`` times a source's
    size is shared anew among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = float(sum(sizes.values())) if total is None else float(total)
    out: dict[str | None, float] = {}
    free = [s for s in order if sizes[s] > 0]
    out.update({s: 0.0 for s in order if sizes[s] <= 0})
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / whole > MOST * sizes[s]]
        if not full:
            out.update({s: left * weight[s] / whole for s in free})
            break
        for s in full:
            out[s] = MOST * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in set(full)]
    return out


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ranges: int = RANGES) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken added to (doc_id, source)."""
    spark = docs.sparkSession
    # Only ids, sources and sizes go on: texts are never shuffled.
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(23), "doc_id", F.xxhash64("text")).alias("key"))
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    total = max(sum(sizes.values()), 1)
    goal = targets(sizes, weights)
    parts = {s: max(1, math.ceil(ranges * n / total)) for s, n in sizes.items()}
    plan = spark.createDataFrame([(s, int(n), float(goal[s]), parts[s]) for s, n in sizes.items()], "source string, source_size long, target double, parts int")
    half = F.shiftrightunsigned("key", 1) / float(1 << 63)
    sized = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    sized = sized.withColumn("part", F.least(F.floor(half * F.col("parts")).cast("int"), F.col("parts") - 1))
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "part").orderBy(F.shiftrightunsigned("key", 1), "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranked = ranked.join(starts, ranked["source"].eqNullSafe(starts["s"]) & (ranked["part"] == starts["p"])).drop("s", "p")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start") - F.col("ahead")))
    return ranked.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "key")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each time a document is used.

    Of a document at its source's cut the first words of its share are used, joined by one
    space; rows that are not used go.
    """
    used = take(docs.select("doc_id", "text", "source"), weights).where("taken > 0")
    # Rows of equal text may be cut at different places: number them, by all their columns, so that each use is joined to one row.
    same = Window.partitionBy("doc_id", "key").orderBy(F.desc("taken"))
    used = used.select("doc_id", "key", "taken", "size", F.row_number().over(same).alias("copy"))
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(23), "doc_id", F.xxhash64("text")))
    keyed = keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.xxhash64(*docs.columns))))
    used = used.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("taken").alias("__taken"), F.col("size").alias("__size"), F.col("copy").alias("__c"))
    joined = keyed.join(used, keyed["doc_id"].eqNullSafe(used["__id"]) & (keyed["__key"] == used["__k"]) & (keyed["__copy"] == used["__c"]))
    uses = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__taken") / F.col("__size")))
    rows = joined.withColumn("__use", F.explode(uses))
    left = F.col("__taken") - (F.col("__use") - 1) * F.col("__size")
    rows = rows.withColumn("__left", left)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__left").cast("int")), " ")
    text = F.when(F.col("__left") >= F.col("__size"), F.col("text")).otherwise(cut)
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)
