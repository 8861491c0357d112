"""Substring dedup by bytes: Burrows-Wheeler transforms of shards, merged by interleave refinement.

A window is ``WINDOW`` bytes of one text. Every byte that lies in a window which also starts
anywhere else, in any text, goes.

1. Deal. Texts are dealt into shards, and windows into groups by something that equal windows
   share: the least hash among their runs of ``RUN`` bytes. Neighbouring windows with that run
   in one place are one piece of text. Only keys that are seen twice go on. A key that has more
   than ``BUSY`` different pieces (a phrase among ever different bytes, thousands of near copies)
   is dealt anew by the windows themselves, each of which is then a key, so no group grows with
   what merely surrounds a common phrase. Equal pieces of a shard are one row.
2. Merge. The pieces of a group's keys are taken together in units of ``UNIT`` bytes, and those
   gathered into shards of ``PART`` bytes, each with a suffix array and its Burrows-Wheeler
   transform. The transforms are merged without sorting suffixes again: the interleave (which
   transform the next suffix comes from) is refined step by step from the order by h bytes to
   the order by h + q bytes, by a stable sort of the q bytes that stand before each suffix. With
   it goes, at each step, where neighbours part, so after ``WINDOW`` bytes it is known which of
   them have that prefix in common: an interval of equal windows. q is as large as the
   different runs of q bytes allow (``CODES``), so that each step sorts 16-bit numbers;
   suffixes that have become too short for a step leave. A key that has one piece only has
   nothing to be merged with: all of its windows stand wherever the piece does.
3. Remove. Intervals that stand for two places or more go back to the shards of their texts.

Group and shard have bounded size; the driver learns the size of all texts only. Keys are hashes
that only deal out work: windows are equal by their bytes alone. Only two different texts of one
shard with equal 64-bit hashes would be taken for each other.

Defined results: a null text is empty; every row is a document of its own, also if it shares its
doc_id or all columns with another, or has no doc_id; empty input gives no row; columns other
than those asked for are ignored; what is left need not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .wordhash import powers

WINDOW = 200
RUN = 64
#: Different pieces of a key, beyond which it is dealt anew.
BUSY = 4000
#: Bytes of text in a shard, in what is merged together, and in a part of it that gets its own suffix array.
SHARD = 4 << 20
UNIT = 60_000
PART = 1 << 13
#: Most different runs of q bytes that a step sorts by; 0 stands for the beginning of a piece.
CODES = (1 << 16) - 1

#: Bytes that are looked at together; places in them take the lower bits of a hash.
_SPAN_BITS = 20
_SPAN = 1 << _SPAN_BITS
_PLACE = np.uint64(_SPAN - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


# -- dealing out windows --------------------------------------------------------------------


class Rule:
    """Sizes of windows, runs, units and parts, and the limit of busy keys."""

    def __init__(self, window: int = WINDOW, run: int = RUN, busy: int = BUSY, unit: int = UNIT, part: int = PART):
        self.window, self.run, self.busy, self.unit, self.part = window, run, busy, unit, part


def _stir(x: np.ndarray) -> np.ndarray:
    """In place: every bit of a number comes to depend on all that are below it, and the upper ones on all."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _hashes(total: np.ndarray, inverse: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each place on, from running sums of bytes times powers."""
    out = total[size:] - total[:-size]
    out *= inverse[: len(out)]
    return _stir(out)


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    width, low = 1, x
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    n = len(x) - span + 1
    return np.minimum(low[:n], low[span - width : span - width + n])


def _spans(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Texts in groups of at most ``_SPAN`` bytes: (text, from, to); a longer text in overlapping spans."""
    held, size = [], 0
    step = _SPAN - window
    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for at in range(0, max(1, len(t) - window + 1), step):
            end = min(len(t), at + step + window - 1)
            if size + end - at > _SPAN:
                yield held
                held, size = [], 0
            held.append((i, at, end))
            size += end - at
    if held:
        yield held


def pieces(texts: list[bytes], rule: Rule, busy: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts, in batches (level, key, text, start, number of windows).

    Level 0 are windows that share their least run; those of keys in ``busy`` (sorted) come one by one at level 1.
    """
    power, inverse = powers(_BASE, _SPAN + 1)
    for span in _spans(texts, rule.window):
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in span), np.uint8)
        begin = np.cumsum([0, *(b - a for _, a, b in span)])
        total = np.zeros(len(data) + 1, np.uint64)
        np.add(data, np.uint64(1), out=total[1:], dtype=np.uint64)
        total[1:] *= power[: len(data)]
        np.cumsum(total[1:], out=total[1:])
        runs = _hashes(total, inverse, rule.run)
        anchor = (_sliding_least((runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64), rule.window - rule.run + 1) & _PLACE).astype(np.int64)
        # Windows end within their own text, and a piece where the text or the place of the least run changes.
        new = np.ones(len(anchor) + 1, bool)
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:-1])
        last = begin[1:] - rule.window
        new[begin[:-1][begin[:-1] < len(new)]] = True
        new[last[last >= 0] + 1] = True
        first = np.flatnonzero(new)
        start, count = first[:-1], np.diff(first)
        which = np.searchsorted(begin, start, "right") - 1
        fits = start <= last[which]
        start, count, which = start[fits], count[fits], which[fits]
        key = runs[anchor[start]]
        number, offset = (np.array([x[i] for x in span]) for i in (0, 1))
        over = np.isin(key, busy) if busy is not None and len(busy) else np.zeros(len(key), bool)
        yield 0, key[~over], number[which[~over]], (start + offset[which] - begin[which])[~over], count[~over]
        if over.any():
            n = count[over]
            start = np.repeat(start[over], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(which[over], n)
            whole = (total[start + rule.window] - total[start]) * inverse[start]
            yield 1, _stir(whole), number[which], start + offset[which] - begin[which], np.ones(len(start), np.int64)


def _once(texts: Sequence) -> tuple[list[bytes], list[int]]:
    """The different texts of a shard, and how often each is there."""
    seen: dict[bytes, int] = {}
    for t in texts:
        if t is not None and len(t):
            seen[t] = seen.get(t, 0) + 1
    return list(seen), list(seen.values())


def _piece_hash(texts: list[bytes], text: np.ndarray, start: np.ndarray, count: np.ndarray, rule: Rule) -> np.ndarray:
    """A hash of each piece's bytes."""
    return np.fromiter((xxhash.xxh64_intdigest(texts[i][s : s + n + rule.window - 1]) for i, s, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)), np.uint64, len(text))


def _sorted_keys(rows: pd.DataFrame) -> np.ndarray:
    return np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))


def _keys(rule: Rule, level: int):
    """How many different pieces a shard has of each key of a level, and in how many places."""

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        busy = _sorted_keys(right[right["busy"]]) if level else None
        found = []
        if len(left) and (not level or len(busy)):
            texts, times = _once(left["text"])
            found = [(key, text, key if level else _piece_hash(texts, text, start, count, rule)) for here, key, text, start, count in pieces(texts, rule, busy) if here == level]
        if not found:
            return pd.DataFrame(columns=["key", "shard", "level", "kinds", "places"])
        key, text, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((piece, key)) if not level else np.argsort(key)
        key, piece, often = key[order], piece[order], np.array(times, np.int64)[text[order]]
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        kind = np.concatenate([[1], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])])
        return pd.DataFrame({"key": key[first].view(np.int64), "shard": left["shard"].iloc[0], "level": level, "kinds": np.add.reduceat(kind, first), "places": np.minimum(np.add.reduceat(often, first), 2)})

    return task if level else lambda left: task(left, left)


def _send(rule: Rule, groups: int):
    """The pieces of repeated keys, once for a shard, with their places in it."""

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        rows = []
        if len(left) and len(right):
            texts, times = _once(left["text"])
            ids = [xxhash.xxh64_intdigest(t) for t in texts]
            wanted = [_sorted_keys(right[(right["level"] == j) & ~right["busy"]]) for j in range(2)]
            for level, key, text, start, count in pieces(texts, rule, _sorted_keys(right[right["busy"]])):
                take = np.isin(key, wanted[level])
                for k, i, s, n in zip(key[take].view(np.int64).tolist(), text[take].tolist(), start[take].tolist(), count[take].tolist(), strict=True):
                    found.setdefault((k, texts[i][s : s + n + rule.window - 1]), []).append((i, s))
            shard = int(left["shard"].iloc[0])
            for (k, piece), places in found.items():
                packed = np.array([(ids[i], s) for i, s in places], np.uint64).tobytes()
                rows.append((k % groups, k, shard, piece, min(2, sum(times[i] for i, _ in places)), packed))
        return pd.DataFrame(rows, columns=["group", "key", "shard", "piece", "places", "packed"])

    return task


# -- merging transforms ---------------------------------------------------------------------


def _suffix_array(data: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by doubling from eight on; ``room`` is what is left of each one's text."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
    # What lies beyond the end of a text does not count; a shorter one comes first where that makes them equal.
    short = np.flatnonzero(room < 8)
    rank[short] &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - room[short].astype(np.uint64)) - np.uint64(1)) << np.uint64(1)) - np.uint64(1))
    order, h = np.argsort(rank), 8
    less = np.minimum(room, 8)
    parted = (rank[order][1:] != rank[order][:-1]) | (less[order][1:] != less[order][:-1])
    if len(short):
        order = np.lexsort((less, rank))
        parted = (rank[order][1:] != rank[order][:-1]) | (less[order][1:] != less[order][:-1])
    rank = np.empty(n, np.int64)
    while True:
        rank[order] = np.concatenate([[1], np.cumsum(parted) + 1])
        if h >= depth or parted.all():
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - h, 0)] = rank[h:]
        both = rank * (n + 2) + np.where(room > h, nxt, 0)
        order, h = np.argsort(both), 2 * h
        parted = both[order][1:] != both[order][:-1]


def transform(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a shard: its bytes, and of each suffix in order the place, text, place in the text and bytes left."""
    size = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    of = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    room = size[of] - 1 - at
    order = _suffix_array(data, room, depth)
    return data, order, of[order], at[order], room[order]


def _before(data: np.ndarray, order: np.ndarray, q: int) -> np.ndarray:
    """The transform: the ``q`` bytes before each suffix as one number."""
    value = np.zeros(len(order), np.uint64)
    for i in range(q):
        value = (value << np.uint64(8)) | data[np.maximum(order - q + i, 0)]
    return value


def merge(shards: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal stretches of ``depth`` bytes of several shards of texts, by merging the shards' transforms.

    For every suffix of at least ``depth`` bytes, in merged order: its interval, whose suffixes
    have ``depth`` bytes in common, its text (numbered over all shards) and its place there.
    """
    parts = [transform(s, depth) for s in shards]
    source = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p[1]) for p in parts])
    text = np.concatenate([p[2] + n for p, n in zip(parts, np.cumsum([0, *map(len, shards)]), strict=False)])
    at, room = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    for q in (8, 5, 4, 2, 1):
        if depth % q == 0:
            kinds, code = np.unique(np.concatenate([_before(p[0], p[1], q) for p in parts]), return_inverse=True)
            if len(kinds) <= CODES:
                break
    code, left = np.where(at >= q, code + 1, 0).astype(np.uint16), room
    # By source, in the order of its suffix array: what is in play. In merged order: the interleave and the intervals.
    interleave, interval = source.astype(np.uint8 if len(parts) <= 256 else np.uint16), np.zeros(len(source), np.int64)
    for h in range(0, depth, q):
        merged = np.empty(len(interleave), np.uint16)
        merged[np.argsort(interleave, kind="stable")] = code
        live = left >= h + q
        code, left = code[live], left[live]
        order = np.argsort(merged, kind="stable")[len(merged) - len(code) :]  # those with a 0 come first and go
        both = ((interval << 16) | merged)[order]
        interleave, interval = interleave[order], np.zeros(len(order), np.int64)
        np.cumsum(both[1:] != both[:-1], out=interval[1:])
    # The k-th suffix of a source in merged order is the k-th of its suffix array.
    whole, place = room >= depth, np.argsort(interleave, kind="stable")
    merged_text, merged_at = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    merged_text[place], merged_at[place] = text[whole], at[whole]
    return interval, merged_text, merged_at


def repeated(texts: list[bytes], times: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """For each text, which windows are in an interval that stands for two places or more."""
    shards, size = [[]], 0
    for t in texts:
        if size + len(t) > rule.part and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(t)
        size += len(t)
    interval, text, at = merge(shards, rule.window)
    again = np.bincount(interval, times[text])[interval] >= 2
    windows = np.array([len(t) - rule.window + 1 for t in texts])
    begin = np.cumsum(windows) - windows
    flat = np.zeros(windows.sum(), bool)
    flat[begin[text[again]] + at[again]] = True
    return np.split(flat, begin[1:])


def _units(sizes: list[int], keys: list[int], most: int) -> Iterator[list[int]]:
    """Numbers of pieces in units of about ``most`` bytes; ``keys`` are sorted and never divided."""
    held, size = [], 0
    for i, (n, k) in enumerate(zip(sizes, keys, strict=True)):
        if held and size + n > most and k != keys[i - 1]:
            yield held
            held, size = [], 0
        held.append(i)
        size += n
    if held:
        yield held


def _merge_groups(rule: Rule):
    def task(rows: pd.DataFrame) -> pd.DataFrame:
        """Back to the shards: the places of pieces, and which of their windows are repeated."""
        kinds: dict[tuple[int, bytes], int] = {}
        of = np.array([kinds.setdefault(x, len(kinds)) for x in zip(rows["key"].tolist(), rows["piece"], strict=True)])
        times = np.bincount(of, rows["places"].to_numpy())
        several: dict[int, int] = {}
        for k, _ in kinds:
            several[k] = several.get(k, 0) + 1
        found: dict[int, np.ndarray] = {}
        numbered = sorted((k, i, p) for (k, p), i in kinds.items())
        for k, i, p in numbered:
            if several[k] == 1:
                found[i] = np.full(len(p) - rule.window + 1, times[i] > 1)
        merged = [x for x in numbered if several[x[0]] > 1]
        for unit in _units([len(p) for _, _, p in merged], [k for k, _, _ in merged], rule.unit):
            texts, numbers = [merged[j][2] for j in unit], [merged[j][1] for j in unit]
            found.update(zip(numbers, repeated(texts, times[numbers], rule), strict=True))
        some = np.array([found[i].any() for i in range(len(kinds))])[of]
        packed = {i: np.packbits(f).tobytes() for i, f in found.items()}
        return pd.DataFrame({"shard": rows["shard"][some], "packed": rows["packed"][some], "windows": [packed[i] for i in of[some]], "n": [len(found[i]) for i in of[some]]})

    return task


def _remove(rule: Rule, keep: Sequence[str]):
    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        starts: dict[int, list[np.ndarray]] = {}
        for packed, windows, n in zip(right["packed"], right["windows"], right["n"], strict=True):
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(windows, np.uint8), count=int(n)))
            for text, start in np.frombuffer(packed, np.uint64).reshape(-1, 2).tolist():
                starts.setdefault(text, []).append(hit + start)
        size, removed, spans, kept = [], [], [], []
        for text in left["text"]:
            text = text or b""
            gone = np.zeros(len(text), bool)
            if starts and len(text) >= rule.window and (found := starts.get(xxhash.xxh64_intdigest(text))):
                change = np.zeros(len(text) + 1, np.int64)
                at = np.concatenate(found)
                np.add.at(change, at, 1)
                np.add.at(change, at + rule.window, -1)
                gone = np.cumsum(change[:-1]) > 0
            size.append(len(text))
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if removed[-1] else text)
        return left[list(keep)].assign(kept=kept, n_bytes=size, n_removed=removed, n_spans=spans)

    return task


# -- the operator ---------------------------------------------------------------------------


def strip_repeats(docs: DataFrame, keep: Sequence[str] = (), rule: Rule | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, the columns in ``keep``, kept (binary: what is left of the text), n_bytes, n_removed, n_spans of every row."""
    rule = rule or Rule()
    carried = [f"__k{i}" for i in range(len(keep))]  # by number, so that no name can clash with ours
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)])
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = max(1, -(-size // shard_bytes))
    # All passes below deal texts out in the same way, so Spark shuffles them once.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    schema = "key long, shard int, level int, kinds int, places int"
    by_key = Window.partitionBy("key")  # one row a shard at most

    def repeated_keys(kinds: DataFrame, busy: Column) -> DataFrame:
        counted = kinds.withColumn("places", F.sum("places").over(by_key)).withColumn("kinds", F.sum("kinds").over(by_key)).where("places > 1")
        return counted.select("key", "shard", "level", busy).toDF("key", "shard", "level", "busy")

    by_run = repeated_keys(dealt.groupBy("shard").applyInPandas(_keys(rule, 0), schema), F.col("kinds") > rule.busy)
    by_window = repeated_keys(dealt.groupBy("shard").cogroup(by_run.groupBy("shard")).applyInPandas(_keys(rule, 1), schema), F.lit(False))
    known = by_run.unionByName(by_window)
    sent = dealt.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_send(rule, shards), "group long, key long, shard int, piece binary, places int, packed binary")
    merged = sent.groupBy("group").applyInPandas(_merge_groups(rule), "shard int, packed binary, windows binary, n int")
    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id string", *[f"{k} {types[c]}" for c, k in zip(keep, carried, strict=True)], "kept binary", "n_bytes long", "n_removed long", "n_spans long"])
    out = dealt.groupBy("shard").cogroup(merged.groupBy("shard")).applyInPandas(_remove(rule, ["doc_id", *carried]), schema)
    names = [F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)]
    return out.select(F.col("doc_id").cast(types["doc_id"]).alias("doc_id"), *names, "kept", "n_bytes", "n_removed", "n_spans")
