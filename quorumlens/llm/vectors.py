"""What both searches over vectors share: which rows take part, and one entry for equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and the number of components.

    Null ids, and vectors that are null, empty, zero, or hold null or non-finite components,
    take no part; of vectors of different lengths only those of the commonest length do (the
    longest of equally common ones).
    """
    v = F.col(vector)
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = found[0]["d"] if found else 0
    return rows.where(F.size("v") == width), width


def classes(rows: DataFrame, key: Column | str, most: int) -> DataFrame:
    """One row for equal ``key``: (key, id, ids), the least id and the ``most`` least ids in order.

    A search for the nearest never needs more than ``most`` of equal entries. Spark cuts
    each task's rows to that number before the shuffle, so a key that a third of all rows
    share moves no more than ``most`` rows a task.
    """
    w = Window.partitionBy("key").orderBy("vec_id")
    rows = rows.select((F.col(key) if isinstance(key, str) else key).alias("key"), "vec_id").distinct()
    least = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return least.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("ids")).select("key", F.element_at("ids", 1).alias("id"), "ids")
