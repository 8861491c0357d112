"""Toxicity by maximum-scoring segments of token log-odds.

Token weights are log-odds between toxic and other labelled documents under an informative
Dirichlet prior (the counts of both together). Tokens whose log-odds are not significant in
either direction share one small negative weight. A linear-time scan over each whole text
finds every maximal segment whose summed weight is positive (all of them, not only the
best); segment scores are put on the scale of the extreme-value distribution that such
maxima follow in unremarkable text, and the document's value is mapped to a probability by
isotonic regression. For that, each half of the labelled rows is scored with the weights that
the other half gives.

A token's weight is that of the token or of one of its stems, whichever is greater; the
evidence of each is the number of different contexts (the neighbours of its first place in
a document) it was seen in, so that a passage copied into a thousand documents counts once.
All that is learned (weights, prior, distribution, calibration) comes from about
``docs_per_class`` labelled documents of each class, by default ``DOCS_PER_CLASS``.

Defined results: null and empty texts have no segment and get the rate of label 1 among
labelled documents without one; very long texts are scanned whole; null labels are ignored;
with no label every score is 0; null doc_ids are scored but never learned from; repeated rows
are each scored; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, isotonic, sample_by_class

#: Bound of what is learned from: about so many labelled documents of each class.
DOCS_PER_CLASS = 4000
#: Dirichlet prior: pseudo-counts in all; z-score, log-odds and contexts from which a feature has a weight.
PRIOR = 2000.0
SIGNIFICANT = 2.6
LEAST_ODDS = 2.0
LEAST_CONTEXTS = 3
#: Number of chance segments of its score in a text from which a segment is no longer significant.
CHANCE = 0.05
#: Lengths of the stems that share evidence; tokens whose weight a task remembers.
STEM = (3, 7)
MEMO = 1_000_000
#: Rows that a task hands over at a time.
ROWS = 100_000
#: Grid of the calibrated value, from no segment (0) upwards.
BINS = 60

_token = re.compile(r"\w+")


def held_out():
    return F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(True))


def features(token: str) -> list[str]:
    """What carries a token's evidence: the token itself and its stems, so that inflected forms share weight."""
    return [f"={token}", *(f"^{token[:k]}" for k in range(STEM[0], min(STEM[1], len(token)) + 1))]


class Weights(dict):
    """Token to weight (0.0: none of its own), found once per token from the weights of its features."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model
        self.starts = {f[1 : 1 + STEM[0]] for f in model}

    def __missing__(self, token: str) -> float:
        w = 0.0
        if token[: STEM[0]] in self.starts:
            own = [self.model[f] for f in features(token) if f in self.model]
            w = max(own, default=0.0)
        self[token] = w
        return w

    def bound(self) -> None:
        if len(self) > MEMO:
            self.clear()


def token_weights(sample: DataFrame) -> list[dict[str, float]]:
    """Weights of significant features by all rows of (text, y, half), by half 0 and by half 1."""

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, y, half in zip(b["text"], b["y"], b["half"], strict=True):
                w = _token.findall((text or "").lower())
                first: dict[str, int] = {}
                for i, t in enumerate(w):
                    if f"={t}" not in first:
                        for f in features(t):
                            first.setdefault(f, i)
                out += [(f, zlib.crc32(" ".join(w[max(0, i - 1) : i + 2]).encode("utf-8", "replace")), y, half) for f, i in first.items()]
                if len(out) > ROWS:
                    yield pd.DataFrame(out, columns=["feature", "context", "y", "half"])
                    out = []
            yield pd.DataFrame(out, columns=["feature", "context", "y", "half"])

    rows = sample.mapInPandas(contexts, "feature string, context long, y int, half int")
    of = lambda h: F.when(F.col("half") == h, F.col("y")) if h is not None else F.col("y")
    # A context seen in both classes says nothing about either and counts for both.
    once = rows.groupBy("feature", "context").agg(*[x for i, h in enumerate((None, 0, 1)) for x in (F.max(of(h)).alias(f"y{i}"), F.min(of(h)).alias(f"l{i}"))])
    sums = [x for i in range(3) for x in (F.coalesce(F.sum(f"y{i}"), F.lit(0)).alias(f"a{i}"), F.coalesce(F.sum(1 - F.col(f"l{i}")), F.lit(0)).alias(f"b{i}"))]
    seen = once.groupBy("feature").agg(*sums).persist()
    try:
        total = seen.where(F.col("feature").startswith("=")).agg(*[F.sum(c).alias(c) for c in seen.columns[1:]]).collect()[0]
        return _significant(seen, [(float(total[f"a{i}"] or 0), float(total[f"b{i}"] or 0)) for i in range(3)])
    finally:
        seen.unpersist()


def _significant(seen: DataFrame, totals: list[tuple[float, float]]) -> list[dict[str, float]]:
    """By set of rows, the log-odds of the features of (feature, a0, b0, a1, b1, ...) that tell toxic or other texts significantly."""

    def odds(i: int, n1: float, n0: float) -> Column:
        """The set's number and the feature's log-odds in it; null if they are not significant."""
        c1, c0 = F.col(f"a{i}"), F.col(f"b{i}")
        prior = PRIOR / (n1 + n0) * (c1 + c0)
        a, b = c1 + prior, c0 + prior
        found = F.log(a / (n1 + PRIOR - a)) - F.log(b / (n0 + PRIOR - b))
        z = found / F.sqrt(1 / a + 1 / b)
        toxic = (z >= SIGNIFICANT) & (found >= LEAST_ODDS) & (c1 >= LEAST_CONTEXTS)
        other = (z <= -SIGNIFICANT) & F.col("feature").startswith("=")
        return F.when((c1 + c0 >= LEAST_CONTEXTS) & (toxic | other), F.struct(F.lit(i).alias("set"), found.alias("odds")))

    sets = [odds(i, n1, n0) for i, (n1, n0) in enumerate(totals) if n1 and n0]
    out: list[dict[str, float]] = [{} for _ in totals]
    if sets:
        for r in seen.select("feature", F.explode(F.array_compact(F.array(*sets))).alias("x")).select("feature", "x.*").collect():
            out[r["set"]][r["feature"]] = r["odds"]
    return out


def extreme_values(sample: DataFrame, models: list[dict[str, float]]) -> list[tuple[float, float, float]]:
    """By model, the weight of tokens without their own, and lambda and K of the extreme-value distribution.

    The first model is judged by all rows of (text, y, half), the others by those of half 0 and 1; one pass serves all.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memos, total = [Weights(m) for m in models], Counter()
        for b in batches:
            for text, y, half in zip(b["text"], b["y"], b["half"], strict=True):
                tokens = _token.findall((text or "").lower())
                for i in (0, 1 + half):
                    total.update((i, int(y), round(w, 1)) for w in map(memos[i].__getitem__, tokens))
            for memo in memos:
                memo.bound()
        if total:
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["i", "y", "w", "n"])

    rows = sample.mapInPandas(spread, "i int, y int, w double, n long").groupBy("i", "y", "w").agg(F.sum("n").alias("n")).collect()
    return [_distribution([r for r in rows if r["i"] == i], m) for i, m in enumerate(models)]


def _distribution(rows: list, model: dict[str, float]) -> tuple[float, float, float]:
    if not any(w > 0 for w in model.values()):
        return -1e-4, 1.0, 1e-12
    tokens = [sum(r["n"] for r in rows if r["y"] == y) for y in (0, 1)]
    hits = [sum(r["n"] for r in rows if r["y"] == y and r["w"] > 0) for y in (0, 1)]
    rate0, rate1 = ((hits[y] + 0.5) / (tokens[y] + 1) for y in (0, 1))
    drift = min(math.log((1 - rate1) / (1 - rate0)), -1e-4)
    null = [(r["w"] or drift, r["n"] / (tokens[0] + 1)) for r in rows if r["y"] == 0]
    if not any(w > 0 for w, _ in null):
        null.append((max(model.values()), rate0))
    # lambda: the positive root of E[exp(lambda * weight)] = 1 in unremarkable text.
    mean = lambda x: sum(p * math.exp(min(x * w, 700)) for w, p in null) - sum(p for _, p in null)
    low, high = 1e-6, 1.0
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return drift, high, rate0


def segments(text: str | None, weights: Weights, drift: float) -> tuple[list[tuple[int, int, float]], int]:
    """All maximal-scoring segments (first token, end token, score) of a text, and its tokens.

    One pass: each candidate keeps a link to the last one before it whose sum on the left is
    smaller, so that the search for it skips all in between.
    """
    tokens = _token.findall(text.lower()) if text else []
    own = list(map(weights.__getitem__, tokens))
    sums = list(accumulate((w or drift for w in own), initial=0.0))
    start: list[int] = []
    end: list[int] = []
    link: list[int] = []
    for i in [i for i, w in enumerate(own) if w > 0]:
        first, right = i, sums[i + 1]
        k = len(start) - 1
        while True:
            left = sums[first]
            while k >= 0 and sums[start[k]] >= left:
                k = link[k]
            if k < 0 or sums[end[k]] >= right:
                break
            first = start[k]
            before = link[k]
            del start[k:], end[k:], link[k:]
            k = before
        start.append(first)
        end.append(i + 1)
        link.append(k)
    return [(s, e, sums[e] - sums[s]) for s, e in zip(start, end, strict=True)], len(tokens)


def value(found: list[tuple[int, int, float]], tokens: int, scale: float, k: float) -> float:
    """-log10 of the chance that unremarkable text of that length has such segments (0: none).

    Segments beyond the best add their own surprise, each judged at the whole length.
    """
    out = 0.0
    for _, _, s in found:
        expected = k * tokens * math.exp(-min(scale * s, 600))
        out = max(out, 0.0) + max(0.0, -math.log10(max(-math.expm1(-expected), 1e-300)))
    return out


def grade(x: float, any_segment: bool) -> int:
    return 0 if not any_segment else 1 + min(BINS - 2, int(x * 4))


def score(docs: DataFrame, model: tuple, rates: list[float]) -> DataFrame:
    """(doc_id, score, n_segments, worst_start, worst_end, passages) of every row of (doc_id, text).

    ``passages`` are the significant segments (start, end in tokens, score), in order.
    """
    weights, drift, scale, k = model

    @F.pandas_udf("score double, n_segments int, worst_start long, worst_end long, passages array<struct<start: long, `end`: long, score: double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Weights(weights)
        for texts in batches:
            out = []
            memo.bound()
            for text in texts:
                found, n = segments(text, memo, drift)
                worst = max(found, key=lambda s: (s[2], -s[0]), default=(None, None, 0))
                clear = [{"start": s, "end": e, "score": x} for s, e, x in found if k * n * math.exp(-min(scale * x, 600)) <= CHANCE]
                out.append((rates[grade(value(found, n, scale, k), bool(found))], len(found), worst[0], worst[1], clear))
            yield pd.DataFrame(out, columns=["score", "n_segments", "worst_start", "worst_end", "passages"]).astype({"worst_start": "Int64", "worst_end": "Int64"})

    return docs.select("doc_id", judge("text").alias("x")).select("doc_id", "x.*")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", docs_per_class: int = DOCS_PER_CLASS) -> DataFrame:
    """Learn from a bounded sample of labels outside the held-out rows, score all of ``docs``."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    model, rates = ({}, -1e-4, 1.0, 1e-12), [0.0] * BINS
    if counts:
        # The sample's bound is proven, so it may be broadcast: documents are not shuffled to find it.
        picked = sample_by_class(marks, "y", docs_per_class, counts)
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
        found = docs.where(~held_out()).join(F.broadcast(picked), "doc_id")
        # Rows that share a doc_id are one document here, so they cannot outgrow the bound.
        sample = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y", half).persist()
        try:
            weights = token_weights(sample)
            models = [(w, *x) for w, x in zip(weights, extreme_values(sample, weights), strict=True)]
            model, rates = models[0], calibrate(sample, models[1:], counts)
        finally:
            sample.unpersist()
    return score(docs, model, rates).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_segments", "worst_start", "worst_end", "passages")


def calibrate(sample: DataFrame, models: list[tuple], counts: dict[int, int]) -> list[float]:
    """The rate of label 1 for each grade, non-decreasing; classes are weighed back to their shares.

    Each row of (text, y, half) is graded by the model of the other half.
    """

    def grades(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, memos = np.zeros((2, BINS)), [Weights(m[0]) for m in models]
        for b in batches:
            for text, y, half in zip(b["text"], b["y"], b["half"], strict=True):
                _, drift, scale, k = models[1 - half]
                found, n = segments(text, memos[1 - half], drift)
                total[int(y), grade(value(found, n, scale, k), bool(found))] += 1
            for memo in memos:
                memo.bound()
        yield pd.DataFrame({"g": np.arange(BINS), "n0": total[0], "n1": total[1]})

    rows = sample.mapInPandas(grades, "g int, n0 double, n1 double").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().sort_values("g")
    if rows.empty:
        return [0.0] * BINS
    n0, n1 = rows["n0"].to_numpy(), rows["n1"].to_numpy()
    n0 = n0 * counts.get(0, 0) / max(n0.sum(), 1)
    n1 = n1 * counts.get(1, 0) / max(n1.sum(), 1)
    prior = np.linspace(0, 1, BINS)
    return [min(1.0, max(0.0, r)) for r in isotonic(list(n1 + 0.5 * prior), list(n0 + n1 + 0.5))]
