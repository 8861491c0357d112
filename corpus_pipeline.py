"""The training-data pipeline: five stages, each written as Parquet and read back as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame. All
but the last return the columns of ``documents``; repeated rows that share a doc_id are one
document for the near-duplicate stage, and the mixture may use a document more than once.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlens.llm import langid, minhash, mixing, packing, passages
from quorumlens.llm.common import remove, shared_dir, table

#: Documents whose language is found with less certainty are rejected, as are those without a letter.
LEAST_SCORE = 0.4
#: Bytes of rows that Spark hands to Python at once. The 64 MB that it takes by default are held several
#: times over, by each task in the JVM and in its Python worker; results do not depend on it.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_small_batches(stage):
    """The stage with ``BATCH`` set in the session: it stays set, as frames are planned when they are written."""

    @wraps(stage)
    def f(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return f


@in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; their ``lang`` stays as it is.

    Rows without a text, or whose text has no letter, are rejected; a null doc_id is no reason.
    """
    found = langid.identified(*langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out(3, 1))))
    judged = docs.withColumn("__found", found("text"))
    return judged.where((F.col("__found.lang_pred") != langid.UNDETERMINED) & (F.col("__found.score") >= LEAST_SCORE)).select(*docs.columns)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each class, once; rows without a doc_id stay."""
    named = docs.where(F.col("doc_id").isNotNull())
    chosen = minhash.near_duplicates(named).where("doc_id = class_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = named.join(chosen, "doc_id", "left_semi").withColumn("__n", once).where("__n = 1").select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


@in_small_batches
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages from the texts; every document stays, a null text as an empty one."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = passages.strip_repeats(docs, others, counts=False)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Use each source's documents up to its target, a row for each use."""
    return mixing.mix(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table in the shared folder goes once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before, batch = None, spark.conf.get(BATCH)
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{base}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    finally:
        spark.conf.set(BATCH, batch)
    return docs
