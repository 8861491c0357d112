"""Collocations: phrases whose words occur together more often than apart, found level by level.

Texts are lower-cased (A to Z), split into pieces at punctuation and line ends, and those into
words. All counts are by language. Level k counts phrases of k words:

1. ``Apriori``: a phrase of k words can only be frequent if both of its phrases of k - 1 words
   are. The frequent ones of the level below are broadcast, as 64-bit hashes, and a task hands
   over only those occurrences whose two overlapping parts are both among them. More than
   ``MOST`` hashes are broadcast as a table of ``BITS`` bits instead, whose size is fixed. A
   hash or bit that two phrases share lets a rare phrase through; its exact count, by the
   phrase itself, drops it. So results do not depend on the form of the broadcast.
2. Every level's frequent phrases are a table in the shared folder. Cuts of a candidate into two
   parts are scored by joining these tables, in exact decimal arithmetic.
3. Candidates that a longer one mostly contains go, and the best of each language stay. These
   are found in ``SALTS`` divisions of a language first, so none is ranked in one task.

Defined results: a null text has no words; a null language is ``und``; repeated rows count as
often as they are there, whatever their doc_id; phrases never cross a piece or a text; ties
are broken by frequency and then by the phrase's bytes; no rows, or no frequent phrase, give no
row; other columns are ignored. Counts up to 10**15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_shared

LONGEST = 3
LEAST = 10
#: A candidate goes if a longer one has at least this share of its occurrences, in hundredths.
INSIDE = 50
TOP = 2000
SALTS = 64
#: Hashes that are broadcast (16 MB), and bits of the table that stands in for more (16 MB).
MOST = 2_000_000
BITS = 1 << 27
#: Bytes of text that a task counts together.
BLOCK = 4 << 20

#: Never part of a UTF-8 text, so it stands for the end of a piece.
_END = b"\xff"
_FOLD = bytes(0xFF if chr(i) in ".,;:!?\n\v\f\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


class Frequent:
    """The frequent phrases of a level, by hash: sorted hashes, or a table of bits."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None = None):
        self.hashes, self.bits = hashes, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = (h & np.uint64(len(self.bits) * 64 - 1)).astype(np.int64)
            return (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h


def phrase_hash(lang: bytes, phrases: list[bytes]) -> np.ndarray:
    """The hashes of phrases as ``xxhash64(lang, phrase)`` gives them."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))


def frequent(level: DataFrame, most: int = MOST, bits: int = BITS) -> Frequent:
    """What is broadcast of a level: a hash for each phrase, or bits of a fixed number beyond ``most``."""
    hashes = level.select(F.xxhash64("lang", "phrase").alias("h"))
    if level.count() <= most:
        return Frequent(np.sort(hashes.toArrow()["h"].to_numpy().view(np.uint64)))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashes.select((at / 64).cast("long").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b"))
    rows = words.groupBy("i").agg(F.expr("bit_or(b)").alias("b")).toArrow()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[rows["i"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return Frequent(None, table)


class _Codes(dict):
    """Numbers words in order of appearance; the end of a piece is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(code, return_inverse=True, return_counts=True)


def _grams(texts: list[bytes], lang: bytes, k: int, below: Frequent | None) -> tuple[list[bytes], np.ndarray]:
    """Phrases of ``k`` words with their counts, of which both parts are in ``below``."""
    words = (b" " + _END + b" ").join(t.translate(_FOLD).replace(_END, b" " + _END + b" ") for t in texts).split()
    codes = _Codes()
    w = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    names = list(codes)
    # Phrases of m words by number, the places they start at, and the texts of the numbers.
    number, inside = w, w > 0
    for m in range(2, k + 1):
        if m < k:
            good = np.ones(len(names), bool)
        else:
            good = below.holds(phrase_hash(lang, names))
        ok = inside & good[number]
        pair = ok[:-1] & ok[1:] & (w[m - 1 :] > 0)
        value, inverse, _ = _distinct(number[:-1][pair] * len(codes) + w[m - 1 :][pair])
        vocabulary = list(codes)
        names = [names[a] + b" " + vocabulary[b] for a, b in zip((value // len(codes)).tolist(), (value % len(codes)).tolist(), strict=True)]
        inside, number = pair, np.zeros(len(pair), np.int64)
        number[pair] = inverse
    counts = np.bincount(number[inside], minlength=len(names))
    if k == 1:
        names, counts = names[1:], counts[1:]
    return names, counts


def _level(k: int, shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def rows(lang: str, phrases: list[bytes | None], counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

        def count() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                names, n = _grams(texts, lang.encode(), k, shared.value if shared else None)
                if k == 1 and names:
                    yield rows(lang, [None], n.sum(keepdims=True))
                for at in range(0, len(names), 50_000):
                    yield rows(lang, names[at : at + 50_000], n[at : at + 50_000])

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                    if size >= BLOCK:
                        yield from count()
                        held, size = {}, 0
        yield from count()

    return task


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[DataFrame]:
    """Tables (lang, phrase, f) of the frequent phrases of 1, 2 ... words; in the first, the null phrase has the count of all words."""
    rows = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    out: list[DataFrame] = []
    shared = None
    for k in range(1, longest + 1):
        found = rows.mapInArrow(_level(k, shared), "lang string, phrase string, f long")
        counted = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())
        out.append(write_shared(counted, f"phrases-{k}"))
        if k < longest:
            shared = docs.sparkSession.sparkContext.broadcast(frequent(out[-1].where("phrase is not null"), most, bits))
    return out


def _part(begin: Column | int, end: Column | int) -> Column:
    """Words ``begin`` to ``end`` (from 1) of the phrase."""
    begin, end = (F.lit(x) if isinstance(x, int) else x for x in (begin, end))
    return F.array_join(F.slice("words", begin, end - begin + 1), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, most: int = MOST, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    tables = levels(docs, longest, least, most, bits)
    known = tables[0].where("phrase is not null")
    for t in tables[1:]:
        known = known.unionByName(t)
    candidates = known.where(F.instr("phrase", " ") > 0).withColumn("words", F.split("phrase", " ", -1)).withColumn("k", F.size("words")).withColumnRenamed("f", "a")
    # Each cut into two parts, both of which are frequent and so in the tables.
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k")).alias("right"))
    left, right = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cuts = cuts.select("lang", "phrase", "a", "cut", "l", "r", F.lit(1_000_000).cast("decimal(7,0)").alias("million"), *[wide(c).alias(f"{c}_") for c in ("a", "l", "r")])
    cuts = cuts.withColumn("score", F.expr("(a_ * a_ * million) div (l_ * r_)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # Phrases inside longer candidates, with the most frequent of these.
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left_over = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = left_over.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    within = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = tables[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
