"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Shingles are five consecutive lower-cased words, weighted by how often they occur in the
document. For every shingle a Poisson process of that rate makes arrivals, each at a random
register; a register keeps the shingle that arrives first, and a document is done as soon
as no further arrival can come before the last register's. Two documents agree in a register
with the probability Jaccard similarity of their weighted shingles. Signatures are cut into
bands; documents with an equal band are candidates, and only pairs whose exact similarity is
``SIMILAR`` or more are linked. The result is the class (connected component) of each document.

Copies (equal lower-cased words) are one node of the graph. A band's bucket is never paired
off: its members are compared with one hub, the member that shares its bands with most others.
Members of buckets that are then still split over several components are joined on shared
shingles, rarest first, and only on as many of each document's shingles as a similarity of
``SIMILAR`` leaves no way around. So every bucket is decided exactly: two of its members are
compared, connected already, or provably less similar, whatever the bucket's size.

Defined results: texts without a word (null, empty) are classes of their own; texts of fewer
than five words have one shingle of all their words; rows with a null doc_id get a null
class; rows that share a doc_id are one document, similar to whatever one of its texts is
similar to; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, checkpoint, write_shared
from .graph import components
from .wordhash import mix, run_hashes, word_hashes

SHINGLE = 5
SIMILAR = 0.8
#: A pair of similarity 0.8 shares no band with a chance of 1 in 13,000; one of 0.4 does with 1 in 5.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Bits of the filter that finds the texts to compare.
BITS = 1 << 25
#: What rounding may add to or take from a bound.
SLACK = 1e-9

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, bytes] | None:
    """Distinct shingle hashes, their counts, and a fingerprint of all words; None without a word."""
    words = word_hashes(text.lower()) if text else ()
    if not len(words):
        return None
    found = run_hashes(words, min(SHINGLE, len(words)))
    kinds, counts = np.unique(found, return_counts=True)
    return kinds, counts, hashlib.md5(words.tobytes()).digest()


def signature(kinds: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first at each register."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    need = int(registers * (np.log(registers) + 1))
    alive, at, arrival = kinds, np.zeros(len(kinds)), 0
    rate = weights.astype(float)
    while len(alive):
        # As many arrivals of each live shingle at a time as are likely needed.
        block = min(64, max(1, -(-need // len(alive)))) if not np.isfinite(first).all() else 1
        j = np.arange(arrival, arrival + block, dtype=np.uint64) + np.uint64(1)
        r = mix(alive[:, None] + j[None] * _GOLD)
        wait = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        times = at[:, None] + np.cumsum(wait, axis=1)
        where = ((mix(r ^ _GOLD) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        flat, reg = times.ravel(), where.ravel()
        near = np.flatnonzero(flat < first.max())
        if len(near):
            order = near[np.argsort(flat[near])[::-1]]
            # The last write wins: registers end with their earliest arrival of this block.
            best, who = np.full(registers, np.inf), np.zeros(registers, np.int64)
            best[reg[order]] = flat[order]
            who[reg[order]] = order // block
            won = best < first
            first[won], owner[won] = best[won], alive[who[won]]
        arrival += block
        go = times[:, -1] < first.max()
        alive, at, rate = alive[go], times[go, -1], rate[go]
    return owner


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two (sorted hashes, weights).

    The sum over common shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i), which is x_i over
    sum_j max(x_j, t y_j) with t = x_i / y_i: shingles of one ratio t share their sum.
    """
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    ratio, at = np.unique(x[i] / y[j], return_inverse=True)
    mass = np.bincount(at, x[i])
    alone_x, alone_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    whole = [alone_x + t * alone_y + np.maximum(x[i], t * y[j]).sum() for t in ratio]
    return float((mass / whole).sum())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n, plain, bands) of every row: copy is equal for equal words, all are null without words.

    ``n`` is the number of shingles, repeated ones included; ``plain`` tells that none repeats.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _GOLD).reshape(BANDS, ROWS)
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                found = shingles(text)
                if found is None:
                    out.append((i, None, None, None, None))
                    continue
                kinds, counts, copy = found
                owner = signature(kinds, counts).reshape(BANDS, ROWS)
                out.append((i, copy, counts.sum(), counts.max() == 1, mix((owner * turn).sum(axis=1, dtype=np.uint64)).view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "copy", "n", "plain", "bands"]).astype({"n": "Int64"})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(run, "doc_id long, copy binary, n long, plain boolean, bands array<bigint>")


def contents(docs: DataFrame) -> DataFrame:
    """(id, node, n, kinds, counts) of every row with words: shingle hashes, and their counts where any repeats.

    ``node`` tells the texts of one doc_id apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                found = shingles(text)
                if found:
                    kinds, counts, copy = found
                    out.append((i, int.from_bytes(copy[:8], "little", signed=True), counts.sum(), kinds.view(np.int64), None if counts.max() == 1 else counts))
            yield pd.DataFrame(out, columns=["id", "node", "n", "kinds", "counts"])

    return docs.select("doc_id", "text").mapInPandas(run, "id long, node long, n long, kinds array<bigint>, counts array<bigint>")


def verified(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, b, plain) whose exact similarity is ``SIMILAR`` or more.

    Sets (``plain``: no repeated shingle on either side) are compared by Spark's own functions;
    only pairs with repeated shingles pass through Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = lambda k, c: (k.view(np.uint64), np.ones(len(k)) if c is None else c)
        for p in batches:
            keep = [similarity(side(ka, ca), side(kb, cb)) >= SIMILAR for ka, ca, kb, cb in zip(p["ka"], p["ca"], p["kb"], p["cb"], strict=True)]
            yield p.loc[keep, ["a", "b"]]

    def both(which: DataFrame) -> DataFrame:
        side = lambda x: content.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("kinds").alias(f"k{x}"), F.col("counts").alias(f"c{x}"))
        return which.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    sets = both(pairs.where("plain")).where("ca IS NULL AND cb IS NULL").where(F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect("ka", "kb"))
    sets = sets.where(shared / (F.col("na") + F.col("nb") - shared) >= SIMILAR).select("a", "b")
    weighted = both(pairs.where("NOT plain")).where("ca IS NOT NULL OR cb IS NOT NULL")
    return sets.unionByName(weighted.select("a", "b", "ka", "ca", "kb", "cb").mapInPandas(run, "a long, b long"))


def _pair(a: Column, b: Column, *more: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), *more]


def _hubs(members: DataFrame) -> DataFrame:
    """(a, b, plain): each member of a bucket with its bucket's hub, where their sizes allow it."""
    order = F.struct((-F.col("central")).alias("c"), F.xxhash64("id").alias("x"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("plain").alias("hub_plain"))
    hubs = members.groupBy("bucket").agg(F.min(order).alias("x")).select("bucket", "x.hub", "x.hub_n", "x.hub_plain")
    pairs = members.join(hubs, "bucket").where("id != hub").withColumn("both", F.col("plain") & F.col("hub_plain"))
    near = F.least("n", "hub_n") >= SIMILAR * F.greatest("n", "hub_n")  # a bound for sets only
    return pairs.where(near | ~F.col("both")).select(*_pair(F.col("id"), F.col("hub"), F.col("both").alias("plain"))).distinct()


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id hashes to a bit that one of ``ids`` sets: all rows of ``ids`` and few others.

    Keeps whole texts out of the shuffle of the exact join that follows. The bits are broadcast
    in ``BITS / 32768`` rows of 4 KB, 4 MB at most whatever the input; where there are so many
    ids that most bits are set, fewer texts are held back.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    block, bit = F.floor(place / 32768).cast("int").alias("block"), (place % 32768).cast("int").alias("bit")
    bits = ids.select(block, bit).distinct().groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    found = docs.withColumns({"block": block, "bit": bit}).join(F.broadcast(bits), "block")
    set_ = F.expr("getbit(cast(conv(hex(substring(bits, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) = 1")
    return found.where(set_).select(*docs.columns)


def _split(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of the members of buckets that hold more than one component."""
    rows = members.select("bucket", "id").join(roots.withColumnRenamed("root", "r"), "id", "left").select("bucket", "id", F.coalesce("r", "id").alias("root"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    return rows.join(several, "bucket", "left_semi").select("id", "root").distinct()


def _rest(left: DataFrame, content: DataFrame) -> DataFrame:
    """(a, b, plain): pairs of (id, root) across components that can be similar, each once.

    Let x and y share the parts p and q of their shingles' weight. Their similarity is at most
    pq / (p + q - pq): for sets it is the Jaccard similarity itself, and with weights the terms of
    the sum are concave in both weights, so bounding each by what is not shared gives the same.
    Both lists of shingles are sorted by the number of components that have a shingle, then by
    hash. The first shingle that x and y share then has at most 1 - p of x's weight and 1 - q of
    y's before it, so they meet in a join on it that takes rows only up to the share 1 - ``SIMILAR``
    of their document's weight, and on one side only up to half of what may be lost in all;
    most of these rows are shingles that no other component has and need no join.
    """
    one = F.transform("kinds", lambda k: F.struct(k.alias("kind"), F.lit(1).cast("long").alias("w")))
    several = F.zip_with("kinds", "counts", lambda k, c: F.struct(k.alias("kind"), c.alias("w")))
    rows = content.join(left.select("id", "root"), "id").select("id", "node", "root", "n", F.col("counts").isNull().alias("plain"), F.explode(F.when(F.col("counts").isNull(), one).otherwise(several)).alias("s"))
    scratch = Scratch("shingles")
    rows = scratch.write(rows.select("id", "node", "root", "n", "plain", "s.kind", "s.w"), "rows")
    spread = rows.select("kind", "root").distinct().groupBy("kind").agg(F.count("*").alias("spread"))
    before = F.sum("w").over(Window.partitionBy("id", "node").orderBy("spread", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    placed = rows.join(spread, "kind").withColumn("part", 1 - before / F.col("n"))
    placed = scratch.write(placed.where((F.col("spread") > 1) & (F.col("part") >= SIMILAR - SLACK)).select("kind", "id", "root", "n", "plain", "part"), "placed")
    most = 1 + 1 / SIMILAR  # 1/p + 1/q is at most this for a similar pair
    close = F.col("part") >= 2 / most - SLACK
    other = placed.select("kind", *[F.col(c).alias(f"{c}_") for c in ("id", "root", "n", "plain", "part")])
    pairs = placed.where(close).join(other, "kind").where((F.col("root") != F.col("root_")) & (1 / F.col("part") + 1 / F.col("part_") <= most + SLACK))
    sets = F.least(F.col("n") * F.col("part"), F.col("n_") * F.col("part_"))
    sized = sets >= SIMILAR * (F.col("n") + F.col("n_") - sets) - SLACK
    both = F.col("plain") & F.col("plain_")
    out = checkpoint(pairs.where(~both | sized).select(*_pair(F.col("id"), F.col("id_"), both.alias("plain"))).distinct())
    scratch.close()
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): class_id is the least doc_id of the document's class."""
    scratch = Scratch("near")
    marks = scratch.write(signatures(docs), "signatures")
    nodes = marks.where(F.col("copy").isNotNull()).groupBy("copy").agg(F.min("doc_id").alias("id"), F.any_value(F.struct("bands", "n", "plain")).alias("x"))
    nodes = scratch.write(nodes.select("copy", "id", "x.*"), "nodes")
    entries = nodes.select("id", "n", "plain", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    # A document that shares its bands with most others makes the best hub: it is nearest to the group's original.
    central = F.sum("size").over(Window.partitionBy("id"))
    members = scratch.write(entries.join(shared, "bucket").select("bucket", "id", "n", "plain", central.alias("central")), "buckets")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    text = _likely(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids).join(ids, "doc_id")  # a semi join would be moved below the filter
    content = scratch.write(contents(text).dropDuplicates(["id", "node"]), "contents")

    links = checkpoint(verified(_hubs(members), content).unionByName(_repeated(marks, nodes)))
    roots = components(links)
    left = checkpoint(_split(members, roots))
    if not left.isEmpty():
        more = checkpoint(verified(_rest(left, content), content))
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    least = roots.select("id", F.col("root").alias("r"))
    found = nodes.select("copy", "id").join(least, "id", "left").select("copy", F.coalesce("r", "id").alias("class_id"))
    worded = marks.where(F.col("copy").isNotNull()).select("doc_id", "copy").join(found, "copy").select("doc_id", "class_id")
    empty = marks.where(F.col("copy").isNull()).select("doc_id").join(least, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("r", "doc_id").alias("class_id"))
    none = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    out = write_shared(worded.unionByName(empty).unionByName(none), "classes")
    scratch.close()
    return out


def _repeated(marks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): a doc_id that has several texts, linked with the node of each of them."""
    text = F.coalesce("copy", F.lit(b""))
    several = marks.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low != high").select("doc_id")
    texts = marks.select("doc_id", "copy").join(several, "doc_id").distinct().join(nodes.select("copy", "id"), "copy")
    return texts.select(*_pair(F.col("doc_id"), F.col("id")))
