"""Substring dedup with automata of repeated passages.

A window is ``WINDOW`` consecutive words of one document. Every word that lies in a window
whose words also start earlier (smaller doc_id, or earlier in the same document) goes.

1. Find: each window is keyed by the least hash among its runs of ``RUN`` words, which equal
   windows share. Windows seen twice in one block of a task are settled there; of the rest
   only first sightings are shuffled, packed by key (about one row for eight windows), so a
   passage that very many documents hold moves one row a block. Where a phrase stands among
   ever different words, many windows share its key: a block that has more than ``BUSY`` of them
   hands these over one by one and leaves a mark at the key, which makes its other windows
   follow; they are matched in a second step, dealt out by the windows themselves.
2. Confirm: neighbouring repeated windows with the same distance to an earlier sighting are
   one passage; its words are read from that earlier document, once for every ``TOGETHER`` of the
   shards that need them.
3. Locate: documents are dealt into shards; the confirmed passages that a shard needs are
   compiled into one Aho-Corasick automaton over words, and all of the shard's documents are
   streamed through it. What it finds is removed, so hash collisions cannot remove a word.

Nothing of the corpus reaches the driver but its size; an automaton never holds more than
the passages of one shard.

Two different windows of one key that agree in 48 bits would hide a repeat (they remove
nothing); a key that is not busy has few windows, so the chance is about 1 in 10**10 a key.

Defined results: null text has no words and comes back as an empty text; rows with a null
doc_id neither remove nor lose words; rows that share a doc_id are one document, of whose equal
windows the least start counts, and equal starts in them do not remove each other; words are left unchanged and joined by one space;
empty input gives no row; columns other than those asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix, run_hashes, word_hashes

WINDOW = 20
RUN = 5
#: Bytes kept of a window's hash; its key adds eight.
PACKED = 6
#: Different windows of one key in a block, beyond which they are handed over one by one.
BUSY = 128
#: Sizes that tell such a window, and the mark left at its key, from packed rows.
ONE, MARK = -2, -1
#: Characters of text that are settled together in a task, and bytes of text in a shard.
BLOCK = 6 << 20
SHARD = 4 << 20
#: Shards that a passage is read for at a time.
TOGETHER = 1000

_FOUND_NAMES = ["doc", "start", "size", "src_doc", "src_start"]
_FOUND = "key long, doc long, start int, size int, hashes binary, src_doc long, src_start int"


def _keys(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and key of every window of a document."""
    hashes = run_hashes(words, window)
    if not len(hashes):
        return hashes, hashes
    runs = run_hashes(words, run)
    # A running minimum by doubling: spans of 1, 2, 4 ... joined to the span needed.
    span, width = window - run + 1, 1
    low = runs
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    n = len(hashes)
    return hashes, np.minimum(low[:n], low[span - width : span - width + n])


def _single(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each window, from its key and the bytes of its hash that are kept."""
    return mix(keys * np.uint64(0x9E3779B97F4A7C15) + (hashes & np.uint64((1 << 8 * PACKED) - 1)))


def _bounds(*changes: np.ndarray) -> np.ndarray:
    """Starts of stretches: the first place, and each place where any of ``changes`` holds."""
    any_of = np.logical_or.reduce(changes)
    return np.concatenate([[0], np.flatnonzero(any_of) + 1])


def _settle(block: list[tuple[int, str]], window: int, run: int) -> pd.DataFrame:
    """First sightings of a block, packed by key, and the repeated windows within it."""
    block.sort(key=lambda x: x[0])
    hashes, keys, docs, starts = [], [], [], []
    for doc, text in block:
        h, k = _keys(word_hashes(text), window, run)
        hashes.append(h)
        keys.append(k)
        docs.append(np.full(len(h), doc, np.int64))
        starts.append(np.arange(len(h), dtype=np.int32))
    h, k, d, s = map(np.concatenate, (hashes, keys, docs, starts))
    if not len(h):
        return pd.DataFrame(columns=["key", "doc", "start", "size", "hashes", "src_doc", "src_start"])
    if len({doc for doc, _ in block}) < len(block):  # rows of one document: of equal windows the least start comes first
        order = np.lexsort((s, d))
        h, k, d, s = h[order], k[order], d[order], s[order]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    source = first[which]
    new = source == np.arange(len(h))
    frames = []
    at = np.flatnonzero(new)
    kinds, of, counts = np.unique(k[at], return_inverse=True, return_counts=True)
    busy = counts > BUSY
    if busy.any():
        ones, at = at[busy[of]], at[~busy[of]]
        frames.append(pd.DataFrame({"key": _single(k[ones], h[ones]).view(np.int64), "doc": d[ones], "start": s[ones], "size": np.int32(ONE), "hashes": b"", "src_doc": np.int64(0), "src_start": np.int32(0)}))
        frames.append(pd.DataFrame({"key": kinds[busy].view(np.int64), "doc": np.iinfo(np.int64).min, "start": np.int32(-1), "size": np.int32(MARK), "hashes": b"", "src_doc": np.int64(0), "src_start": np.int32(0)}))
    begin = _bounds(np.diff(at) != 1, np.diff(d[at]) != 0, np.diff(s[at]) != 1, np.diff(k[at].view(np.int64)) != 0)
    end = np.append(begin[1:], len(at))
    raw = h[at].view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()
    if len(at):
        frames.append(pd.DataFrame({
            "key": k[at][begin].view(np.int64), "doc": d[at][begin], "start": s[at][begin], "size": (end - begin).astype(np.int32),
            "hashes": [raw[PACKED * a : PACKED * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], "src_doc": np.int64(0), "src_start": np.int32(0)}))
    at = np.flatnonzero(~new)
    if len(at):
        src = source[at]
        begin = _bounds(np.diff(at) != 1, np.diff(d[at]) != 0, np.diff(s[at]) != 1, np.diff(src) != 1, np.diff(d[src]) != 0, np.diff(s[src]) != 1)
        end = np.append(begin[1:], len(at))
        i, j = at[begin], src[begin]
        frames.append(pd.DataFrame({"key": d[i], "doc": d[i], "start": s[i], "size": (end - begin).astype(np.int32), "hashes": None, "src_doc": d[j], "src_start": s[j]}))
    return pd.concat(frames, ignore_index=True)


def _find(window: int, run: int):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size = [], 0
        for b in batches:
            for doc, text in zip(b["doc"].tolist(), b["text"], strict=True):
                block.append((doc, text))
                size += len(text)
                if size >= BLOCK:
                    yield _settle(block, window, run)
                    block, size = [], 0
        if block:
            yield _settle(block, window, run)

    return task


def _runs(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Join neighbouring repeated windows (doc, start, src_doc, src_start) into stretches with a size."""
    out: list[list[int]] = []
    for doc, start, src, at in found:
        x = out[-1] if out else None
        if x and x[0] == doc and x[1] + x[2] == start and x[3] == src and x[4] + x[2] == at:
            x[2] += 1
        else:
            out.append([doc, start, 1, src, at])
    return [tuple(x) for x in out]


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (key, doc, start): which windows were sighted before, and where.

    Windows of marked keys come out one by one (size ``ONE``), with the number they are matched
    by in the next step for ``src_doc``.
    """
    seen: dict[int, tuple[int, int]] = {}
    last: int | None = None
    marked = False
    for b in batches:
        settled = b[b["hashes"].isna()]
        if len(settled):
            yield settled[_FOUND_NAMES]
        ones = b[b["size"] == ONE]
        if len(ones):
            yield ones[_FOUND_NAMES].assign(src_doc=ones["key"])
        b = b[b["hashes"].notna() & (b["size"] != ONE)]
        if b.empty:
            continue
        key = b["key"].to_numpy()
        same = np.concatenate([[key[0] == last], key[1:] == key[:-1]])
        follows = np.append(same[1:], True)  # the last row's key may go on in the next batch
        busy = np.flatnonzero(same | follows)
        key, doc, start, size, raw = key[busy].tolist(), b["doc"].to_numpy()[busy].tolist(), b["start"].to_numpy()[busy].tolist(), b["size"].to_numpy()[busy].tolist(), b["hashes"].to_numpy()[busy]
        out: list[tuple[int, int, int, int]] = []
        later: list[pd.DataFrame] = []
        for k, d, s, n, r in zip(key, doc, start, size, raw, strict=True):
            if k != last:
                seen, last, marked = {}, k, False
            if n == MARK:
                marked = True
                continue
            if marked:
                part = np.zeros((n, 8), np.uint8)
                part[:, :PACKED] = np.frombuffer(r, np.uint8).reshape(n, PACKED)
                w = _single(np.full(n, k, np.int64).view(np.uint64), part.view(np.uint64).ravel())
                later.append(pd.DataFrame({"doc": d, "start": np.arange(s, s + n), "size": ONE, "src_doc": w.view(np.int64), "src_start": 0}))
                continue
            for i in range(0, len(r), PACKED):
                here = d, s
                window = r[i : i + PACKED]
                before = seen.setdefault(window, here)
                if before < here:
                    out.append((d, s, *before))
                elif before > here:  # several rows of one document
                    out.append((*before, d, s))
                    seen[window] = here
                s += 1
        k = int(b["key"].iloc[-1])
        if k != last:
            seen, last, marked = {}, k, False
        if out:
            yield pd.DataFrame(_runs(out), columns=_FOUND_NAMES)
        if later:
            yield pd.concat(later)


def _match_singles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From windows handed over one by one, sorted by (number, doc, start): which were sighted before, and where."""
    last, source = None, (0, 0)
    for b in batches:
        if b.empty:
            continue
        w, doc, start = (b[c].to_numpy(np.int64) for c in ("src_doc", "doc", "start"))
        first = np.concatenate([[w[0] != last], w[1:] != w[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(w)), -1))
        src_doc, src_start = (np.where(at >= 0, x[at], y) for x, y in zip((doc, start), source, strict=True))
        last, source = w[-1], (src_doc[-1], src_start[-1])
        again = (src_doc != doc) | (src_start != start)
        yield pd.DataFrame({"doc": doc, "start": start, "size": 1, "src_doc": src_doc, "src_start": src_start})[again]


def _settle_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is matched, by (doc, start), is joined to stretches; then come the windows that are not, by number."""
    batches, ones = iter(batches), []

    def matched() -> Iterator[pd.DataFrame]:
        for b in batches:
            single = b["size"] == ONE
            yield b[~single]
            if single.any():
                ones.append(b[single])
                return

    yield from _merge(matched())
    yield from _match_singles(chain(ones, batches))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join touching stretches of a document, from rows sorted by (doc, start)."""
    x: list[int] | None = None
    for b in batches:
        out = []
        for row in b[_FOUND_NAMES].itertuples(index=False):
            doc, start, size, src, at = map(int, row)
            if x and x[0] == doc and x[3] == src and start - x[1] == at - x[4] and start <= x[1] + x[2]:
                x[2] = max(x[2], start + size - x[1])
            else:
                if x:
                    out.append(x)
                x = [doc, start, size, src, at]
        yield pd.DataFrame(out, columns=_FOUND_NAMES)
    if x:
        yield pd.DataFrame([x], columns=_FOUND_NAMES)


def passages(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, start, size, src_doc, src_start): ``size`` windows from ``start`` on are those from ``src_start`` on in ``src_doc``."""
    found = docs.where("doc is not null and text is not null").select("doc", "text").mapInPandas(_find(window, run), _FOUND)
    schema = "doc long, start int, size int, src_doc long, src_start int"
    matched = found.repartition("key").sortWithinPartitions("key", "doc", "start").mapInPandas(_match, schema)
    single = F.col("size") == ONE
    by = F.when(single, F.col("src_doc")).otherwise(F.col("doc"))
    rest = matched.repartition(single, by).sortWithinPartitions(single, by, "doc", "start").mapInPandas(_settle_rest, schema)
    return rest.repartition("doc").sortWithinPartitions("doc", "start").mapInPandas(_merge, schema)


def _read(window: int):
    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The words of the passages asked for, from their earlier documents, once for so many shards."""
        out = []
        if len(right):
            wanted = {int(d): g for d, g in right.groupby("src_doc")}
            for doc, text in zip(left["doc"], left["text"], strict=True):
                if isinstance(text, str) and not pd.isna(doc) and (g := wanted.get(int(doc))) is not None:
                    words = text.encode("utf-8", "surrogatepass").split()
                    for start, size, to in zip(g["src_start"], g["size"], g["to"], strict=True):
                        passage = words[start : start + size + window - 1]
                        if len(passage) >= window:  # another row of the document may be shorter
                            out.append((to, int(doc), start, b" ".join(passage)))
        return pd.DataFrame(out, columns=["to", "src_doc", "src_start", "words"])

    return task


class _Codes(dict):
    """One character for each word of the passages, or two where there are too many words; all other words share one code.

    First and second characters come from different halves, so that a match starts at a word.
    """

    HALF = 0x6000

    def __init__(self, words: set[bytes]):
        self.width = 1 if len(words) < 2 * self.HALF else 2
        for n, w in enumerate(sorted(words), 1):
            self[w] = chr(n) if self.width == 1 else chr(n // self.HALF) + chr(self.HALF + n % self.HALF)
        self.other = "\0" * self.width

    def __missing__(self, word):
        return self.other


def _locate(window: int, keep: Sequence[str]):
    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        # Of equal passages the earliest source counts.
        wanted = [(src, at, text.split()) for src, at, text in sorted(zip(right["src_doc"], right["src_start"], right["words"], strict=True), key=lambda x: (x[0], x[1]))]
        codes = _Codes({w for _, _, words in wanted for w in words})
        for src, at, words in wanted:
            coded = "".join(map(codes.__getitem__, words))
            if coded not in automaton:
                automaton.add_word(coded, (int(src), int(at), len(words)))
        ready = len(automaton) > 0
        if ready:
            automaton.make_automaton()
        kept, total, gone = [], [], []
        for doc, text in zip(left["doc"], left["text"], strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
            n = len(words)
            cover = np.zeros(n + 1, np.int32)
            if ready and n >= window and not pd.isna(doc):
                doc = int(doc)
                for end, (src, at, size) in automaton.iter("".join(map(codes.__getitem__, words))):
                    end //= codes.width
                    start = end - size + 1
                    if (src, at) < (doc, start):
                        cover[start] += 1
                        cover[end + 1] -= 1
            covered = np.cumsum(cover[:n]) > 0
            removed = int(covered.sum())
            if removed:
                words = [words[i] for i in np.flatnonzero(~covered)]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            total.append(n)
            gone.append(removed)
        return left[list(keep)].assign(text=kept, n_words=total, n_removed=gone)

    return task


def strip_repeats(docs: DataFrame, keep: Sequence[str] = (), window: int = WINDOW, run: int = RUN, counts: bool = True) -> DataFrame:
    """doc_id, the columns in ``keep``, text (what is left), and with ``counts`` n_words and n_removed, of every row.

    ``doc_id`` must be a whole number; ``keep`` names further columns to carry along.
    """
    carried = [f"__k{i}" for i in range(len(keep))]  # by number, so that no name can clash with ours
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("doc_id").cast("string").alias("doc_id"), "text", *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)])
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = max(1, -(-size // SHARD))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    found = passages(rows, window, run)
    # A passage is read once for every ``TOGETHER`` shards that need it, and multiplied by Spark.
    asked = found.select(shard(F.col("src_doc")).alias("s"), "src_doc", "src_start", "size", shard(F.col("doc")).alias("to"))
    asked = asked.groupBy("s", "src_doc", "src_start", "size", F.floor(F.col("to") / TOGETHER).alias("part")).agg(F.collect_set("to").alias("to")).drop("part")
    # Both passes below deal documents out in the same way, so Spark shuffles the texts once.
    loose = F.pmod(F.xxhash64("text", *carried), F.lit(shards)).cast("int")
    dealt = rows.withColumn("shard", F.when(F.col("doc").isNull(), loose).otherwise(shard(F.col("doc"))))
    read = dealt.groupBy("shard").cogroup(asked.groupBy("s")).applyInPandas(_read(window), "to array<int>, src_doc long, src_start int, words binary")
    text = read.select(F.explode("to").alias("to"), "src_doc", "src_start", "words")
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id string", *[f"{k} {kinds[c]}" for c, k in zip(keep, carried, strict=True)], "text string", "n_words long", "n_removed long"])
    out = dealt.groupBy("shard").cogroup(text.groupBy("to")).applyInPandas(_locate(window, ["doc_id", *carried]), schema)
    names = [F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)]
    return out.select(F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), *names, "text", *(["n_words", "n_removed"] if counts else []))
