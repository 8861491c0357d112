"""Norms that follow a collection from one snapshot to the next.

What a norm needs of a group is how many members hold each value, and the first of them in
order. Both are kept as a table (group..., value, count, first). From it and the pages that came,
went or changed the next snapshot's table follows without counting the rest again: counts are
added and taken away, and the first is looked up anew only for values whose first member left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .consensus import MIN_MEMBERS, MIN_SHARE, thresholds, winners


def counts(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(group..., value, c, first) of rows."""
    return rows.groupBy(*group, value).agg(F.count("*").alias("c"), F.min(F.struct(*order)).alias("first"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(gone, come): rows of two snapshots of equal columns that are only in the one before, or only in the one after.

    ``keys`` say which row is which; a row that has changed is in both, its old and its new form.
    """
    rest = [c for c in before.columns if c not in keys]
    form = F.xxhash64(*rest).alias("__h") if rest else F.lit(0).alias("__h")
    gone = before.withColumn("__h", form).join(after.select(*keys, form), [*keys, "__h"], "left_anti").drop("__h")
    come = after.withColumn("__h", form).join(before.select(*keys, form), [*keys, "__h"], "left_anti").drop("__h")
    return gone, come


def advance(known: DataFrame, gone: DataFrame, come: DataFrame, after: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """``counts`` of the snapshot ``after`` from those of the one before.

    ``after`` is read only for the groups and values whose first member is among ``gone``.
    """
    cell = [*group, value]
    less = counts(gone, group, value, order).select(*cell, (-F.col("c")).alias("c"), F.col("first").alias("left"), F.lit(None).cast(dict(known.dtypes)["first"]).alias("first"))
    more = counts(come, group, value, order).select(*cell, "c", F.lit(None).cast(dict(known.dtypes)["first"]).alias("left"), "first")
    old = known.select(*cell, "c", F.lit(None).cast(dict(known.dtypes)["first"]).alias("left"), "first")
    summed = old.unionByName(less).unionByName(more).groupBy(*cell).agg(F.sum("c").alias("c"), F.min("left").alias("left"), F.min("first").alias("first")).where("c > 0")
    # The least of those that left is the first only if it was; then the next one is not known.
    fine, lost = summed.where("left is null or left > first"), summed.where("left <= first")
    anew = counts(after.join(lost.select(*cell), cell, "left_semi"), group, value, order)
    return fine.drop("left").unionByName(anew)


def norms(known: DataFrame, group: Sequence[str], value: str, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(group..., n, norm, agree) as ``consensus`` gives it, from counts."""
    return thresholds(winners(known, group, value), min_members, min_share)
