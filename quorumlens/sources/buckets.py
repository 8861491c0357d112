"""Tables that are merged by key: a batch reads and rewrites only the hash buckets that it touches.

A table lies under one folder, in ``bucket=<n>`` by the hash of its key. An upsert takes the
numbers of the buckets that its rows fall into, reads these alone, and replaces them by dynamic
partition overwrite, so its cost goes with what it touches and not with the table. What is
written is worked out before (a reliable checkpoint), so a lost executor or a batch that is run
again never reads a bucket that has been replaced half: the newest row of a key counts, however
often it is merged. Readers should not read while a batch is being written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint

#: Buckets of a table; it stays the same for as long as the table lives.
BUCKETS = 64


def bucket(keys: Sequence[str], count: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def read(spark: SparkSession, folder: str, schema: str, only: Sequence[int] | None = None) -> DataFrame:
    """A table's rows, of the buckets in ``only`` if that is given; without a table no rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, bucket int").parquet(folder)
    return (rows if only is None else rows.where(F.col("bucket").isin(list(only)))).drop("bucket")


def touched(updates: DataFrame, keys: Sequence[str], count: int = BUCKETS) -> list[int]:
    """The buckets that rows fall into: ``count`` numbers at most."""
    return sorted(r[0] for r in updates.select(bucket(keys, count)).distinct().collect())


def upsert(updates: DataFrame, folder: str, keys: Sequence[str], newest: Sequence[str] = (), count: int = BUCKETS) -> list[int]:
    """Put rows into a table: the newest by ``newest`` counts, and of equally new ones that of ``updates``.

    Of several rows of a key in ``updates`` the newest (or, without ``newest``, one of them that is
    the same on every run) is taken. Returns the buckets that were rewritten.
    """
    updates = checkpoint(updates)
    numbers = touched(updates, keys, count)
    if not numbers:
        return []
    columns = updates.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in updates.dtypes)
    old = read(updates.sparkSession, folder, schema, numbers)
    both = updates.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)))
    rest = F.struct(*[c for c in columns if c not in keys])
    order = F.struct(*newest, "__new", F.xxhash64(*columns).alias("__h"))
    last = both.groupBy(*keys).agg(F.max_by(rest, order).alias("x")).select(*keys, "x.*").select(*columns)
    rows = checkpoint(last.withColumn("bucket", bucket(keys, count)))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return numbers
