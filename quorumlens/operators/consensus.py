"""Thresholded majority: what most members of a group hold, and who deviates.

All counting is hash aggregation with partial sums before the shuffle, in two levels
(group and value, then group), so a group that holds a third of all rows is summed up where
it lies. Who deviates is an equi-join on the group, which Spark splits where it is skewed.
Thresholds are numbers, or columns of a table of families, so one plan serves all families.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_MEMBERS = 5
MIN_SHARE = 0.8
EVIDENCE = 3


def mode(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(group, n, norm, agree): the commonest value; ties go to the value seen first by ``order``."""
    return winners(rows.groupBy(*group, value).agg(F.count("*").alias("c"), F.min(F.struct(*order)).alias("first")), group, value)


def winners(each: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, norm, agree) of counted values (group, value, c, first)."""
    best = F.min_by(F.struct(F.col(value).alias("norm"), F.col("c").alias("agree")), F.struct((-F.col("c")).alias("c"), F.col("first")))
    return each.groupBy(*group).agg(F.sum("c").alias("n"), best.alias("best")).select(*group, "n", "best.norm", "best.agree")


def limited(rows: DataFrame, min_members: int | DataFrame, min_share: float) -> tuple[DataFrame, Column, Column]:
    """Rows with the least number and the least share that hold for them, as columns.

    These are two numbers for all, or, where the first is a table (family, min_members, min_share),
    those of each row's family; rows of families that are not in it are left out.
    """
    if isinstance(min_members, DataFrame):
        own = min_members.select("family", F.col("min_members").alias("__members"), F.col("min_share").cast("double").alias("__share"))
        return rows.join(own, "family"), F.col("__members"), F.col("__share")
    return rows, F.lit(min_members), F.lit(float(min_share))


def enough(rows: DataFrame, n: str, agree: str, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows whose ``n`` is large enough and of which ``agree`` is a large enough share. Shares are doubles."""
    found, members, share = limited(rows, min_members, min_share)
    return found.where((F.col(n) >= members) & (F.col(agree).cast("double") / F.col(n) >= share)).select(*rows.columns)


def large(rows: DataFrame, n: str, min_members: int | DataFrame = MIN_MEMBERS) -> DataFrame:
    """Rows whose ``n`` is large enough."""
    found, members, _ = limited(rows, min_members, 0.0)
    return found.where(F.col(n) >= members).select(*rows.columns)


def thresholds(norms: DataFrame, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, unanimous: bool = False) -> DataFrame:
    """Groups that are large and agreed enough; unanimous ones only if asked for."""
    kept = enough(norms, "n", "agree", min_members, min_share)
    return kept if unanimous else kept.where("agree < n")


def consensus(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[str], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(group, n, norm, agree) of each group that has a norm and someone who deviates from it."""
    return thresholds(mode(rows, group, value, order), min_members, min_share)


def last_votes(rows: DataFrame, group: Sequence[str], member: str, value: str, order: Sequence[str], *carried: str) -> DataFrame:
    """One row per group and member: the last mention by ``order`` counts, ``mentions`` tells how many there were."""
    last = F.max_by(F.struct(value, *carried, *[F.col(o) for o in order if o not in carried]), F.struct(*order))
    return rows.groupBy(*group, member).agg(F.count("*").alias("mentions"), last.alias("x")).select(*group, member, "mentions", "x.*")


def member_consensus(votes: DataFrame, group: Sequence[str], value: str, order: Sequence[str], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """Like ``consensus`` over ``last_votes``: members vote once, but n counts all mentions.

    Labels that repeat within pages thereby lower the share and keep the detector silent.
    """
    total = votes.groupBy(*group).agg(F.sum("mentions").alias("n"))
    norms = mode(votes, group, value, order).drop("n").join(total, list(group))
    return thresholds(norms.select(*group, "n", "norm", "agree"), min_members, min_share)


def deviators(rows: DataFrame, norms: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The rows of a group whose value is not the norm, with n, norm and agree."""
    return rows.join(norms, list(group)).where(F.col(value) != F.col("norm"))


def first_k(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int = EVIDENCE) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each task to k rows a group before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= k).withColumnRenamed("__rn", "rank")


def first_siblings(rows: DataFrame, group: Sequence[str], member: str, value: str, k: int = EVIDENCE) -> DataFrame:
    """(group, siblings): the first ``k`` members of each group by member and value, as url and value."""
    place = F.dense_rank().over(Window.partitionBy(*group).orderBy(member, value))  # each task keeps its first k before the shuffle
    top = rows.select(*group, member, value).withColumn("rank", place).where(F.col("rank") <= k).distinct()
    pair = F.transform(F.array_sort(F.collect_list(F.struct("rank", member, value))), lambda x: F.struct(x[member].cast("string").alias("url"), x[value].cast("string").alias("value")))
    return top.groupBy(*group).agg(pair.alias("siblings"))


def evidence(rows: DataFrame, norms: DataFrame, group: Sequence[str], value: str, member: str, k: int = EVIDENCE, shown: str | None = None) -> DataFrame:
    """(group, siblings): up to ``k`` members that agree, in member order, each with its value or what it shows."""
    agreeing = rows.join(norms.select(*group, "norm"), list(group)).where(F.col(value) == F.col("norm"))
    return first_siblings(agreeing, group, member, shown or value, k)
