"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are maximal runs without ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) a folder of our own is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quorumlens-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Used where a large intermediate result is read more than once: the files are
    compressed, survive lost executors, and are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quorumlens-{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(drop_shared)
    _folders[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_shared() -> None:
    """Remove what ``write_shared`` has left; frames read from it must no longer be in use."""
    for path, spark in list(_folders.items()):
        _folders.pop(path)
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM has ended: the cluster's own clean-up removes the folder
            return


class Scratch:
    """Intermediate tables of one operator in the shared folder, removed by ``close`` once its result is written."""

    def __init__(self, name: str):
        self.name = name
        self.kept: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = set(_folders)
        out = write_shared(df, f"{self.name}-{name}")
        self.kept += [(df.sparkSession, path) for path in set(_folders) - before]
        return out

    def close(self) -> None:
        for spark, path in self.kept:
            _folders.pop(path, None)
            remove(spark, path)
        self.kept.clear()


def text_id() -> Column:
    """doc_id as text, for the way through pandas, where whole numbers beside nulls lose digits."""
    return F.col("doc_id").cast("string").alias("doc_id")


def typed_id(df: DataFrame, like: DataFrame) -> DataFrame:
    """doc_id back in the type it has in ``like``."""
    return df.withColumn("doc_id", F.col("doc_id").cast(like.schema["doc_id"].dataType))


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample_by_class(labelled: DataFrame, label: str, bound: int, counts: dict) -> DataFrame:
    """About ``bound`` documents of each class (all of a class that has fewer), one row each, the same on every run.

    ``counts`` are the classes' row counts over all data. A document is taken if the hash of its
    doc_id falls below its class's share of documents, so one scan serves all classes and only what is taken is
    shuffled. Rows that share doc_id and class are one document; of their other columns those of least
    hash are taken. Each class has a bound of its own: at most ``2 * bound`` documents.
    """
    found = {r[label]: r["d"] for r in labelled.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("d")).collect()}
    # Without repeated documents the counts of rows are exact, and better than an estimate.
    size = {c: n if found.get(c, 0) >= 0.9 * n else found[c] for c, n in counts.items() if found.get(c)}
    if not size:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for c, n in size.items() for x in (c, min(1.0, bound / max(n, 1)))])
    draw = F.xxhash64(F.col("doc_id"), F.lit(17)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    rest = [c for c in labelled.columns if c not in ("doc_id", label)]
    taken = labelled.where(draw < share[F.col(label)]).withColumn("__draw", draw)
    one = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__x") if rest else F.count(F.lit(1)).alias("__x")
    once = taken.groupBy("doc_id", label, "__draw").agg(one)
    within = once.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy("__draw", "doc_id"))).where(F.col("__n") <= 2 * bound)
    return within.select("doc_id", label, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*labelled.columns)


def isotonic(positives: list[float], totals: list[float]) -> list[float]:
    """Pool adjacent violators over ordered bins; returns a non-decreasing rate for each bin."""
    blocks: list[list[float]] = []
    for p, n in zip(positives, totals, strict=True):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    out: list[float] = []
    for p, n, k in blocks:
        out += [p / n if n else 0.0] * int(k)
    return out
