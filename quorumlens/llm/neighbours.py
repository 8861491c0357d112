"""Approximate nearest neighbours with robust-pruned directed graphs.

Distinct vectors are dealt into shards. In each shard a graph is built by insertion: a greedy
beam search over what is there proposes a new vector's neighbours, pruning keeps those that
no kept one is nearer to by the factor ``ALPHA``, and links back are pruned in the same way.
The same beam search then answers every query in every shard; the nearest of all shards are
merged. Equal vectors are one entry of the index, with the least ids that share it.

Defined results: rows that ``vectors.usable`` names take no part; repeated rows are one;
with fewer other candidates than asked for all are returned; ties go to the smaller vec_id;
without a usable row the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import classes, usable

DEGREE = 24
#: Nodes that a search keeps: while a graph is built, and for a query.
BUILD_BEAM, BEAM = 64, 160
ALPHA = 1.2
#: Vectors of a shard: at least and at most, and the number of shards aimed for between them. Of 64
#: independent components, the hardest case, shards of 8000 keep a recall of 0.93.
SHARD = (1024, 8_000)
SHARDS = 64
#: Nodes that are opened at a time, and searches that are run side by side.
OPEN = 4
BATCH = 256
#: Beyond so many times the median distance from the centre a shard is searched in double precision.
FAR = 1000


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes (ids, squared distances) that each query's search comes by; -1 fills up."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, x.dtype)
    opened = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0] = entry
    dist[:, 0] = ((queries - x[entry]) ** 2).sum(axis=1)
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), np.inf, dist[live])
        pick = np.argpartition(waiting, OPEN - 1, axis=1)[:, :OPEN]
        ok = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        go = ok.any(axis=1)
        live, pick, ok = live[go], pick[go], ok[go]
        if not len(live):
            break
        row = live[:, None]
        opened[row, pick] |= ok
        near = np.where(ok[:, :, None], graph[ids[row, pick]], -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[row, near]
        near = np.where(fresh, near, -1)
        near.sort(axis=1)  # the same node from two opened ones counts once
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        node = near[r, c]
        seen[live[r], node] = True
        d = np.full(near.shape, np.inf, x.dtype)
        d[r, c] = ((x[node] - queries[live[r]]) ** 2).sum(axis=1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, axis=1)
        ids[live] = np.take_along_axis(all_i, best, axis=1)
        opened[live] = np.take_along_axis(all_o, best, axis=1)
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node the kept neighbours among ``near`` (-1: none), nearest first, at most ``degree``."""
    bad = (near < 0) | (near == nodes[:, None])
    v = x[near]
    d = ((v - x[nodes][:, None]) ** 2).sum(axis=2)
    d[bad] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
    v = np.take_along_axis(v, order[:, :, None], axis=1)
    square = (v**2).sum(axis=2)
    between = np.maximum(square[:, :, None] + square[:, None] - 2 * v @ v.transpose(0, 2, 1), 0)
    alive = np.isfinite(d)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        at = alive.argmax(axis=1)
        has = alive[rows, at]
        if not has.any():
            break
        out[has, k] = near[rows, at][has]
        alive &= ~(has[:, None] & (alpha * alpha * between[rows, at] <= d))
        alive[rows, at] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """The graph (neighbours of each node, -1: none) and the node where searches begin."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done, size = 1, 1
    while done < n:
        new = order[done : done + size]
        found, _ = beam_search(x, graph, entry, x[new], beam)
        # Vectors inserted together also propose one another.
        peers = np.broadcast_to(new[: min(len(new), degree)], (len(new), min(len(new), degree)))
        graph[new] = prune(x, new, np.concatenate([found, peers], axis=1), degree, alpha)
        back, to = graph[new].ravel(), np.repeat(new, degree)
        to, back = to[back >= 0], back[back >= 0]
        rank = np.argsort(back, kind="stable")
        back, to = back[rank], to[rank]
        nodes, first, count = np.unique(back, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(back)) - np.repeat(first, count)] = to
        for at in range(0, len(nodes), BATCH):
            part = slice(at, at + BATCH)
            graph[nodes[part]] = prune(x, nodes[part], np.concatenate([graph[nodes[part]], extra[part]], axis=1), degree, alpha)
        done += len(new)
        size = min(2 * size, BATCH)
    return graph, entry


def _search(k: int, degree: int, beam: int, alpha: float):
    names = ["query", "vec_id", "score"]

    def ready(points: list[tuple[int, list[int], np.ndarray]]):
        exact = np.stack([v for _, _, v in points]).astype(np.float64)
        # The graph works around the centre, in single precision unless some vectors lie so far out
        # that the others would become equal in it; what is returned is measured anew.
        centre = np.median(exact, axis=0)
        size = np.abs(exact - centre).max(axis=1)
        scale = float(np.median(size)) or float(size.max()) or 1.0
        kind = np.float64 if size.max() > FAR * scale else np.float32

        def fit(v: np.ndarray, kind: type = kind) -> np.ndarray:
            return ((v - centre) / scale).astype(kind)

        x = fit(exact)
        graph, entry = build(x, degree, BUILD_BEAM, alpha)
        return exact, [ids for _, ids, _ in points], fit, x, graph, entry

    def search(shard, ids_of: list[int], asked: np.ndarray) -> pd.DataFrame:
        exact, ids, fit, x, graph, entry = shard
        q = fit(asked, np.float64)
        # A query far outside has no finite square in single precision.
        space = x if np.abs(q).max() <= FAR else x.astype(np.float64)
        found, _ = beam_search(space, graph, entry, q.astype(space.dtype), max(beam, k))
        out = []
        for query, vector, nodes in zip(ids_of, asked, found, strict=True):
            nodes = nodes[nodes >= 0]
            d = np.sqrt(((exact[nodes] - vector) ** 2).sum(axis=1))
            near = sorted((float(s), int(i)) for s, node in zip(d.tolist(), nodes.tolist(), strict=True) for i in ids[node])[:k]
            out += [(query, i, s) for s, i in near]
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From rows sorted by (shard, points before queries, id): one shard's points and one batch of queries at a time."""
        at, points, shard = None, [], None
        for b in batches:
            for key, group in b.groupby("shard", sort=True):
                if key != at:
                    at, points, shard = key, [], None
                asks = group["ids"].isna().to_numpy()
                new = group[~asks]
                points += zip(new["id"].tolist(), new["ids"].tolist(), new["v"].tolist(), strict=True)
                group = group[asks]
                if len(group) and points and shard is None:
                    shard, points = ready(points), []
                if shard is None:
                    continue
                for i in range(0, len(group), BATCH):
                    part = group.iloc[i : i + BATCH]
                    yield search(shard, part["id"].tolist(), np.stack(part["v"].to_numpy()).astype(np.float64))

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 10, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, shard: tuple[int, int] = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others found for each row that ``is_query`` (over vec_id) picks."""
    rows, _ = usable(rows)
    entries = classes(rows, "v", k + 1).withColumnRenamed("key", "v")
    n = entries.count()
    size = min(shard[1], max(shard[0], n // SHARDS))
    shards = max(1, -(-n // size))
    points = entries.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    # Equal query vectors are searched once.
    asking = rows.where(is_query).distinct()
    queries = asking.groupBy("v").agg(F.min("vec_id").alias("id"))
    everywhere = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    # A shard's points come first, then its queries pass by in Arrow batches: no task holds all queries or results.
    asks = everywhere.select(F.col("s").alias("shard"), F.lit(None).cast("array<bigint>").alias("ids"), "id", "v")
    dealt = points.select("shard", "ids", "id", "v").unionByName(asks).repartition("shard").sortWithinPartitions("shard", F.col("ids").isNull(), "id")
    found = dealt.mapInPandas(_search(k + 1, degree, beam, alpha), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    own = asking.join(queries, "v").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
    joined = own.join(found, "query").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
