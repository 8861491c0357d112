"""Ratcliff-Obershelp similarity, Arrow-batched; callers narrow candidates by an equi-join first.

Of two texts the longest common block is taken, and the same is done left and right of it; the
similarity is twice the characters in blocks by those of both texts. A block takes equal
characters from both, so it is at most what the counts of each character allow. This bound is
worked out by Spark's own functions and spares pairs that it rules out the way to Python.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Between 0 and 1; not symmetric, and null if either side is."""
    return _ratio(a, b)


def bound(a: Column, b: Column) -> Column:
    """No less than ``similarity``: what both texts have of each character, as a share."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    size = F.length(a) + F.length(b)
    return F.when(size == 0, 1.0).otherwise(2 * common / size)


def similar(rows: DataFrame, a: str, b: str, least: float, also: Column | None = None) -> DataFrame:
    """Rows whose texts are similar enough, or that ``also`` holds for, with their ``ratio``."""
    size, other = F.length(a), F.length(b)
    short = 2 * F.least(size, other) >= least * (size + other) - 1e-9  # cheaper, so it comes first
    may_be = short & (bound(F.col(a), F.col(b)) >= least - 1e-9)
    keep = (lambda c: c) if also is None else (lambda c: c | also)
    return rows.where(keep(may_be)).withColumn("ratio", similarity(F.col(a), F.col(b))).where(keep(F.col("ratio") >= least))
