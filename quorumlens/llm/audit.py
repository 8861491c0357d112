"""How filters of a cleaning chain interact: what each removes at each place of every order.

Five filters are judged on each whole text. What a document fails is one of 32 masks, and a
precomputed table of 32 masks by 120 orders tells at which step of an order the first failure
comes. Tasks look their rows up there and count (part, order, step) with ``np.bincount``, for
all documents and for two labels; the partial arrays are summed by Spark, and every other
figure follows from the sums: what fails a filter is what it removes in first place, what
fails nothing else is what it removes in last place.

1. Texts pass Python once: a row of (doc_id, part, mask of A to D, digest of the text) each,
   written to the shared folder; equal rows are added up before anything is joined.
2. The least doc_id of each digest comes from a partial aggregation. It is joined back on
   digest *and* doc_id, so a text that very many documents share is no hot key.
3. Labels are joined by doc_id; then come the counts.

Defined results: a null text is an empty one, a null language the part ''; a text repeats if
a row with a smaller doc_id has the same bytes, so rows that share a doc_id do not repeat each
other, and rows without a doc_id neither repeat others nor are repeats; of several labels of a
document any 1 counts; no rows give no part; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_shared

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
LEAST_WORDS = 200
#: Parts whose arrays a task holds at a time; beyond it they are handed on and begun anew.
PARTS = 200

_CAPITALS = bytes(range(65, 91))
_CONTINUING = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def first_failures() -> np.ndarray:
    """The step (from 0) of the first failure of each mask in each order; ``STEPS`` where nothing fails."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int16)
    for j, order in enumerate(ORDERS):
        for step in range(STEPS - 1, -1, -1):
            failing = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            table[failing, j] = step
    return table


def failures(text: bytes) -> int:
    """Which of the filters A to D a text fails, as bits."""
    words = text.split()
    n = len(words)
    few = n < LEAST_WORDS
    repeating = 100 * len(set(words)) < 50 * n
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 3 * len(text.translate(None, _CONTINUING))
    marked = len(text) != len(text.translate(None, _MARKS))
    return few | repeating << 1 | loud << 2 | marked << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = [], []
        for text in b.column("text").to_pylist():
            masks.append(failures(text))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest, n): what documents fail of A to D, equal rows added up."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(_judge, f"doc_id {kind}, part string, mask int, digest binary")
    return out.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask of all filters, good, toxic, n) of every document, not yet added up."""
    rows = write_shared(judged(docs), "audit")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    repeats = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged_all = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask").bitwiseOR(repeats))
    label = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return judged_all.join(marked, "doc_id", "left").select("part", "mask", label("good"), label("toxic"), "n")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = first_failures()
    cells = len(ORDERS) * (STEPS + 1)
    place = np.arange(len(ORDERS), dtype=np.int64) * (STEPS + 1)
    parts: dict[str, int] = {}
    sums = np.zeros((3, 0), np.int64)

    def partial() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(parts), object), cells), pa.string()), pa.array(np.tile(np.arange(cells, dtype=np.int32), len(parts))), *map(pa.array, sums)],
            names=["part", "cell", "removed", "good_lost", "toxic_lost"])

    for b in batches:
        names = b.column("part").to_pylist()
        for at in range(0, b.num_rows, 5000):
            here = names[at : at + 5000]
            if len(parts) + len(set(here)) > PARTS and parts:
                yield partial()
                parts, sums = {}, np.zeros((3, 0), np.int64)
            part = np.array([parts.setdefault(p, len(parts)) for p in here], np.int64)
            if (room := len(parts) * cells - sums.shape[1]) > 0:
                sums = np.concatenate([sums, np.zeros((3, room), np.int64)], axis=1)
            mask, good, toxic, n = (b.column(c).slice(at, 5000).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic", "n"))
            where = (part[:, None] * cells + place + table[mask]).ravel()
            for row, weight in enumerate((n, n * good, n * toxic)):
                if weight.any():
                    sums[row] += np.bincount(where, np.repeat(weight, len(ORDERS)), sums.shape[1]).astype(np.int64)
    if parts:
        yield partial()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counted = masks(docs, labels).mapInArrow(_count, "part string, cell int, removed long, good_lost long, toxic_lost long")
    sums = counted.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")])
    # From here on there are 720 rows a part.
    rows = sums.withColumn("filter_order", F.element_at(F.array(*map(F.lit, ORDERS)), (F.col("cell") / (STEPS + 1)).cast("int") + 1)).withColumn("step", F.col("cell") % (STEPS + 1) + 1)
    order = Window.partitionBy("part", "filter_order").orderBy("step")
    rows = rows.withColumn("documents", F.sum("removed").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("kept", F.col("documents") - F.sum("removed").over(order))
    rows = rows.where(F.col("step") <= STEPS).withColumn("filter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    by_filter = Window.partitionBy("part", "filter")
    at_step = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(by_filter)
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", (at_step(1) - F.col("removed")).alias("redundant"), at_step(STEPS).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(by_filter).alias("shapley"))
