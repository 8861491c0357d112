"""Quality scores by kernel ridge regression in random Fourier features.

Statistics of each whole text are mapped through random Fourier features that approximate a
Gaussian kernel; each partition sums its share of the normal equations, Spark adds the
shares, the driver solves one small system for all rows and one for the rows outside each
fold, and isotonic regression over a fixed grid of score bins calibrates on scores of rows
that their fold's weights have not seen.

Defined results: null or empty text has all-zero statistics and is scored like any other
row; very long texts are read whole, a row at a time; labels that are null, or whose document
is missing, are ignored; repeated labels or rows count as often as they occur; with no usable
label of both classes every score is the share of ones (0.5 with no label at all); null
doc_ids are scored but never learned from; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import isotonic, write_shared
from .langid import held_out

FEATURES = 128
#: Width of the Gaussian kernel over statistics that are scaled to about unit range.
WIDTH = 1.6 / 3
RIDGE = 1e-3
BINS = 400
#: Parts of the labelled rows; each is calibrated with weights fitted on the others.
FOLDS = 4
STATISTICS = 16

_words = re.compile(r"[^\x20\x09-\x0D]+")
_upper = re.compile(r"[A-ZÀ-Þ]+")
_digits = re.compile(r"[0-9]+")
_marks = re.compile(r"[#$%&*@^~=<>{}\[\]\\/_+|]+")
_stops = re.compile(r"[.!?]+")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, each scaled to about 0 to 1."""
    if not text:
        return [0.0] * STATISTICS
    n = len(text)
    words = _words.findall(text)
    m = len(words)
    if not m:
        return [0.0] * (STATISTICS - 1) + [1.0]
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    kinds = set(words)
    length = lambda p: sum(map(len, p.findall(text)))
    sentences = len(_stops.findall(text))
    letters = sum(map(len, words))
    return [
        np.log1p(m) / 10,
        letters / m / 12,
        len(kinds) / m,
        length(_upper) / n * 2,
        length(_digits) / n * 8,
        length(_marks) / n * 6,
        text.count("!") / m,
        text.count("|") / m,
        text.count(",") / m * 4,
        min(1.0, m / (sentences + 1) / 60),
        len(set(full)) / max(1, len(full)),
        min(1.0, m / max(1, len(full)) / 60),
        max(map(len, words)) / (max(map(len, words)) + 20),
        sum(1 for w in kinds if len(w) == 1) / len(kinds) * 4,
        (len(text.encode("utf-8", "replace")) - n) / n * 4,
        (n - letters) / n * 2,
    ]


def basis(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def lift(x: np.ndarray) -> np.ndarray:
    """Random Fourier features, with a constant column."""
    w, b = basis()
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))], axis=1)


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text], dtype=object)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array<double>) of every row of (doc_id, text)."""
    return docs.select("doc_id", _statistics("text").alias("stats"))


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Ridge weights of summed normal equations; the last feature is the constant. None without rows of both classes."""
    d, n, ones = len(right), gram[-1, -1], right[-1]
    if ones <= 0 or ones >= n:
        return None
    return np.linalg.solve(gram + RIDGE * n * np.diag([1.0] * (d - 1) + [1e-9]) / d + 1e-9 * np.eye(d), right)


def normal_equations(train: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(gram, right) of each fold of (stats, y, fold), summed in the partitions and then by Spark."""
    d = FEATURES + 1
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, len(upper[0]) + d))
        for b in batches:
            for fold, rows in b.groupby("fold"):
                z = lift(np.stack(rows["stats"].to_numpy()))
                total[fold] += np.concatenate([(z.T @ z)[upper], z.T @ rows["y"].to_numpy(dtype=float)])
        if total.any():
            yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    found = train.mapInPandas(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
    out = []
    for value in found["v"].to_numpy().reshape(-1, len(upper[0]) + d):
        gram = np.zeros((d, d))
        gram[upper] = value[: len(upper[0])]
        out.append((gram + np.triu(gram, 1).T, value[len(upper[0]) :]))
    return out


def fit(train: DataFrame) -> tuple[np.ndarray | None, list[float]]:
    """Fit on (stats, y, fold); returns the ridge weights and the calibrated rate of each score bin."""
    parts = normal_equations(train)
    if not parts:
        return None, [0.5] * BINS
    gram, right = (sum(p[i] for p in parts) for i in (0, 1))
    weights = solve(gram, right)
    if weights is None:
        return None, [float(right[-1] / gram[-1, -1])] * BINS
    # Where the other folds lack a class, a fold's rows are scored with the weights of all rows.
    others = [solve(gram - g, right - r) for g, r in parts]
    others = np.stack([weights if w is None else w for w in others])

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BINS))
        for b in batches:
            if len(b):
                at = bins((lift(np.stack(b["stats"].to_numpy())) * others[b["fold"].to_numpy()]).sum(axis=1))
                y = b["y"].to_numpy(dtype=float)
                total += [np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]
        yield pd.DataFrame({"bin": np.arange(BINS), "ones": total[0], "n": total[1]})

    grid = train.mapInPandas(counts, "bin int, ones double, n double").groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).toPandas().sort_values("bin")
    # Half a row of each bin follows the ridge score itself, so that empty bins have a value.
    prior = np.clip((np.arange(BINS) + 0.5) / BINS * 1.5 - 0.25, 0.001, 0.999)
    return weights, isotonic(list(grid["ones"] + 0.5 * prior), list(grid["n"] + 0.5))


def bins(score: np.ndarray) -> np.ndarray:
    """Ridge scores from -0.25 to 1.25 on the grid; what lies beyond goes to the end bins."""
    return np.clip(((score + 0.25) / 1.5 * BINS).astype(int), 0, BINS - 1)


def score(stats: DataFrame, weights: np.ndarray | None, rates: list[float]) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, stats)."""
    table = np.array(rates)

    @F.pandas_udf("double")
    def rate(rows: pd.Series) -> pd.Series:
        if weights is None or not len(rows):
            return pd.Series(np.full(len(rows), table[0]))
        return pd.Series(np.clip(table[bins(lift(np.stack(rows.to_numpy())) @ weights)], 0, 1))

    return stats.select("doc_id", rate("stats").alias("score"))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Learn from labels of rows that are not held out (crc32 of doc_id mod 3 is not 1), score all.

    Texts are read once: their statistics, 128 bytes a document, are written to the shared folder.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(3, 1)).select("doc_id", F.col(label).cast("double").alias("y"))
    stats = write_shared(with_statistics(docs), "statistics")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    weights, rates = fit(stats.join(marks, "doc_id").select("stats", "y", fold.alias("fold")))
    return score(stats, weights, rates).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
