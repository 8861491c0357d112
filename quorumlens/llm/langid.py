"""Language identification with a byte convolutional network.

Multi-width filters over byte embeddings, max pooling and a softmax layer, trained in
numpy on a bounded sample of labelled documents; every document is cut into fixed-length
windows over its whole text, and the windows are scored in batches inside Spark tasks.

Defined results: null text or text without a letter gives ``und`` with score 0; a null
doc_id counts as held out and is never learned from; with no labelled row everything is
``und``; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, sample_by_class

WINDOW = 128
EMBED = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
#: Bounds of what is learned from: documents of a language, windows of a document.
DOCS_PER_LANGUAGE = 1500
WINDOWS_PER_DOC = 2
#: Characters of text that are turned into windows at a time.
CHUNK = 1 << 20
UNDETERMINED = "und"


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows of all texts, and how many windows each text has."""
    parts, counts = [], []
    for text in texts:
        raw = text.lower().encode("utf-8", "replace")
        pad = -len(raw) % WINDOW
        parts.append(raw + b"\0" * pad)
        counts.append((len(raw) + pad) // WINDOW)
    return np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, WINDOW), np.array(counts)


class ByteCnn:
    """The network; ``weights`` is a plain dict of arrays so that Spark ships it cheaply."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7, epochs: int = 4, batch: int = 64, rate: float = 4e-3) -> ByteCnn:
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for k in WIDTHS:
            w[f"conv{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS)).astype(np.float32)
            w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
        w["dense"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        w["out"] = np.zeros(classes, np.float32)
        w["embed"][0] = 0
        share = np.bincount(y, minlength=classes) / len(y)
        weight = (1 / np.maximum(share, 1e-9) / classes)[y].astype(np.float32)
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        step = 0
        for _ in range(max(epochs, -(-600 * batch // max(len(y), 1)) if len(y) < 150 * batch else epochs)):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                grads = cls._gradients(w, x[rows], y[rows], weight[rows])
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                w["embed"][0] = 0
        return cls(w)

    @staticmethod
    def _gradients(w, x, y, weight):
        n = len(x)
        emb = w["embed"][x]
        pooled, saved = [], []
        for k in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(emb, k, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - k + 1, k * EMBED)
            act = view @ w[f"conv{k}"] + w[f"bias{k}"]
            at = act.argmax(axis=1)
            top = np.take_along_axis(act, at[:, None], axis=1)[:, 0]
            pooled.append(np.maximum(top, 0))
            saved.append((view, at, top))
        h = np.concatenate(pooled, axis=1)
        z = h @ w["dense"] + w["out"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[:, None] / n
        g = {"dense": h.T @ p, "out": p.sum(axis=0)}
        dh = p @ w["dense"].T
        d_emb = np.zeros_like(emb)
        who = np.arange(n)[:, None]
        for i, (k, (view, at, top)) in enumerate(zip(WIDTHS, saved, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
            seen = view[who, at]
            g[f"conv{k}"] = np.einsum("bfk,bf->kf", seen, d)
            g[f"bias{k}"] = d.sum(axis=0)
            back = (d[:, :, None] * w[f"conv{k}"].T).reshape(n, FILTERS, k, EMBED)
            for j in range(k):
                np.add.at(d_emb, (who, at + j), back[:, :, j])
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], x.ravel(), d_emb.reshape(-1, EMBED))
        return g

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters as look-up tables: what each pair of bytes, or byte, adds to each filter."""
        e = self.w["embed"]
        part = lambda k, j: e @ self.w[f"conv{k}"][j * EMBED : (j + 1) * EMBED]
        pair = lambda k, j: (part(k, j)[:, None] + part(k, j + 1)[None]).reshape(65536, FILTERS)
        lead = np.concatenate([pair(k, 0) + self.w[f"bias{k}"] for k in WIDTHS], axis=1)
        return np.ascontiguousarray(lead, np.float32), np.ascontiguousarray(part(3, 2), np.float32), np.ascontiguousarray(pair(4, 2), np.float32)

    def log_probabilities(self, x: np.ndarray, tables, block: int = 128) -> np.ndarray:
        lead, third, last = tables
        out = np.empty((len(x), len(self.w["out"])))
        for at in range(0, len(x), block):
            b = x[at : at + block]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            act = lead.take(pairs, axis=0)
            act[:, :-1, FILTERS : 2 * FILTERS] += third.take(b[:, 2:], axis=0)
            act[:, :-2, 2 * FILTERS :] += last.take(pairs[:, 2:], axis=0)
            h = np.concatenate([act[:, : WINDOW - k + 1, i * FILTERS : (i + 1) * FILTERS].max(axis=1) for i, k in enumerate(WIDTHS)], axis=1)
            z = np.maximum(h, 0) @ self.w["dense"] + self.w["out"]
            z -= z.max(axis=1, keepdims=True)
            out[at : at + block] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], dict | None]:
    """Train on (doc_id, text, lang); returns the languages and the network's weights.

    At most about ``docs_per_language`` documents of each language reach the driver, and
    ``WINDOWS_PER_DOC`` windows, spread over the text, of each. Every value of ``lang`` is a class,
    so their number, that of the languages, is the bound of what is held.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = labelled.groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in found}
    languages = sorted(counts)
    if not languages:
        return [], None
    # The windows are cut in the tasks: whole texts never reach the driver.
    start = "cast(greatest(0, floor((octet_length(text) - {w}) * {i} / {n})) as int) + 1"
    pieces = [F.expr(f"substring(cast(lower(text) as binary), {start.format(w=WINDOW, i=i + 1, n=WINDOWS_PER_DOC + 1)}, {WINDOW})") for i in range(WINDOWS_PER_DOC)]
    cut = labelled.select("doc_id", "lang", F.array_distinct(F.array(*pieces)).alias("cut"))
    rows = sample_by_class(cut, "lang", docs_per_language, counts).collect()
    x, y = [], []
    for r in rows:
        for piece in r["cut"]:
            if piece:
                x.append(np.frombuffer(bytes(piece).ljust(WINDOW, b"\0"), np.uint8))
                y.append(languages.index(r["lang"]))
    if not x:
        return [], None
    order = np.lexsort(np.stack(x).T[::-1])
    return languages, ByteCnn.fit(np.stack(x)[order], np.array(y)[order], len(languages)).w


def identified(languages: list[str], weights: dict | None):
    """A column function from a text to a struct of lang_pred and score; nothing else passes through Python."""

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = ByteCnn(weights) if weights else None
        tables = net.tables() if net else None
        for texts in batches:
            pred, value = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            todo, size = [], 0
            for i, text in enumerate([*texts, None]):
                if net and text is not None and any(c.isalpha() for c in text):
                    todo.append(i)
                    size += len(text)
                if todo and (size >= CHUNK or i == len(texts)):
                    x, counts = windows([texts.iat[k] for k in todo])
                    weight = (x != 0).sum(axis=1)
                    logs = net.log_probabilities(x, tables) * weight[:, None]
                    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
                    mean = np.add.reduceat(logs, at) / np.maximum(np.add.reduceat(weight, at), 1)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for k, best, s in zip(todo, p.argmax(axis=1), p.max(axis=1), strict=True):
                        pred[k], value[k] = languages[best], s
                    todo, size = [], 0
            yield pd.DataFrame({"lang_pred": pred, "score": value})

    return found


def identify(docs: DataFrame, languages: list[str], weights: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    found = identified(languages, weights)
    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.lang_pred", "f.score")


def held_out(modulus: int, remainder: int):
    """Whether a row is held out; a null doc_id is."""
    return F.coalesce(bucket_of("doc_id", modulus) == remainder, F.lit(True))


def language_id(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Learn from the rows of ``labelled`` (default: ``docs``) that are not held out, and label all of ``docs``."""
    train = (docs if labelled is None else labelled).select("doc_id", "text", "lang").where(~held_out(3, 1))
    languages, weights = fit(train)
    return identify(docs, languages, weights).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
