"""Mixture-controlled packing of tokenised documents into sequences of fixed length.

Documents are tokenised once and dealt at random into groups. Inside a group deficit
round-robin over one queue per source fills each sequence to the target proportions: a
source earns its share of every window, pays for what it places, and what it is owed (or
owes) is carried to the next window. Across groups the balance is carried too: what the
groups before have earned and placed is a prefix sum over (group, source) totals, so every
group starts with its opening balance and all groups are packed side by side.

What is left at a group's end is cut into sequences whose lengths are powers of two, which
need no padding.

Defined results: null text is empty, and an empty document is its end mark alone; a null
source is a queue of its own; repeated rows are separate documents; a null doc_id is kept;
empty input gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_id, typed_id, write_shared

LENGTH = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as byte ranks: the same ids several times faster. None: use the first alone.
RANKS = "byte_bpe_50k.tiktoken"
#: Texts that hold this are special to the first library, so they go through it.
SPECIAL = "<|endoftext|>"
#: A source that is owed less than this waits for a later window, so documents aren't cut to shreds.
LEAST_PIECE = 128
#: Tokens of a group: at least, at most, and the number of groups aimed for between them.
GROUP_TOKENS = (2_000_000, 64_000_000)
GROUPS = 20_000

_encoders: dict[tuple, object] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
    """A function from a text to its ids; loaded once in each Python worker."""
    if (vocabulary, ranks) not in _encoders:
        import public_tokenizers

        where = lambda name: name if "/" in name else public_tokenizers.path(name)
        whole: list = []

        def slow(text: str) -> list[int]:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(where(vocabulary)))
            return whole[0].encode(text, add_special_tokens=False).ids

        encode = slow
        if ranks:
            import tiktoken

            with open(where(ranks), "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            encode = lambda text: slow(text) if SPECIAL in text else fast(text)
        _encoders[vocabulary, ranks] = encode
    return _encoders[vocabulary, ranks]


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, end: int = END) -> DataFrame:
    """(doc_id, source, n, ids, key): ids as little-endian unsigned 32-bit (16 where all fit) numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, ranks)
        for b in batches:
            size, ids = [], []
            for text in b.pop("text"):
                found = encode(text) if text else []
                found.append(end)
                size.append(len(found))
                ids.append(array("H" if max(found) < 65536 else "I", found).tobytes())
            yield b.assign(n=size, ids=ids)[["doc_id", "source", "n", "ids", "key"]]

    # The key comes from the row's place too, so repeated rows spread; it is written before it is used.
    rows = docs.select(text_id(), F.col("source").cast("string"), "text", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("key"))
    return rows.mapInPandas(run, "doc_id string, source string, n long, ids binary, key long")


def fill(queues: dict, share: dict, balance: dict, length: int = LENGTH, least: int = LEAST_PIECE) -> Iterator[list[tuple]]:
    """Deficit round-robin: yields sequences as lists of (document, start, length).

    ``queues``: source to a deque of (document, tokens); ``balance`` (tokens owed) is changed.
    """
    at = {s: 0 for s in queues}
    left = sum(n for q in queues.values() for _, n in q)

    def place(s, most: int, pieces: list) -> int:
        q, done = queues[s], 0
        while q and done < most:
            doc, n = q[0]
            k = min(n - at[s], most - done)
            pieces.append((doc, at[s], k))
            done += k
            at[s] += k
            if at[s] == n:
                q.popleft()
                at[s] = 0
        balance[s] -= done
        return done

    live = list(queues)
    while left:
        room = window = min(length, left)
        pieces: list[tuple] = []
        live = [s for s in live if queues[s]]
        for s in share:
            balance[s] += share[s] * window
        for s in live:
            owed = int(balance[s])
            if owed >= least and room:
                room -= place(s, min(owed, room), pieces)
        while room:  # the rest goes to whom most is owed, against later windows
            s = max((s for s in live if queues[s]), key=lambda s: balance[s])
            room -= place(s, room, pieces)
        left -= window
        yield pieces


def split(pieces: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Cut a sequence into ones whose lengths are powers of two; a full one stays whole."""
    total = sum(k for _, _, k in pieces)
    if total == length:
        yield pieces
        return
    todo = deque(pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            doc, start, k = todo.popleft()
            if k > room:
                todo.appendleft((doc, start + room, k - room))
                k = room
            out.append((doc, start, k))
            room -= k
        yield out


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, length: int = LENGTH, group_tokens: tuple[int, int] = GROUP_TOKENS, **vocabulary) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights``: target proportion of each source; by default its share of all tokens, so that
    no source runs out before the others.
    """
    rows = write_shared(tokenise(docs, **vocabulary), "tokens")
    by_source = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    total = sum(by_source.values())
    goal = {s: float(n if weights is None else weights.get(s, 0.0)) for s, n in by_source.items()}
    whole = sum(goal.values()) or 1.0
    share = {s: g / whole for s, g in sorted(goal.items(), key=lambda x: (x[0] is None, x[0] or ""))}
    size = min(group_tokens[1], max(group_tokens[0], total // GROUPS))
    groups = max(1, -(-total // size))
    rows = rows.withColumn("group", F.pmod("key", F.lit(groups)).cast("int"))

    # Opening balances: a row per group and source, from counts alone.
    sums = rows.groupBy("group", "source").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    each = sums.groupBy("group").agg(F.sum("n").alias("tokens"))
    listed = F.array(*[F.struct(F.lit(s).cast("string").alias("source"), F.lit(v).alias("share")) for s, v in share.items()]) if share else F.array().cast("array<struct<source: string, share: double>>")
    grid = each.select("group", "tokens", F.explode(listed).alias("x")).select("group", "tokens", "x.*")
    grid = grid.join(sums.withColumnRenamed("source", "s").withColumnRenamed("group", "g"), (F.col("group") == F.col("g")) & F.col("source").eqNullSafe(F.col("s")), "left")
    owed = F.coalesce(F.sum(F.col("share") * F.col("tokens") - F.coalesce("n", F.lit(0))).over(ahead), F.lit(0.0))
    opening = grid.select(F.col("group"), "source", owed.alias("owed")).groupBy("group").agg(F.collect_list(F.struct("source", "owed")).alias("balance"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        balance = {s: 0.0 for s in share}
        for x in (right["balance"].iloc[0] if len(right) else []):
            balance[x["source"]] = x["owed"]
        left = left.sort_values("key", kind="stable")
        names, raw, ns = [s if isinstance(s, str) else None for s in left["source"]], left["ids"].tolist(), left["n"].tolist()
        queues: dict = {s: deque() for s in share}
        for i, s in enumerate(names):
            queues[s].append((i, ns[i]))
        out: list[tuple] = []
        views: dict[int, memoryview] = {}
        sequence = int(key[0]) << 32
        for window in fill(queues, share, balance, length):
            for pieces in split(window, length):
                offset = 0
                for i, start, k in pieces:
                    v = views.get(i)
                    if v is None:
                        kind = "<u2" if len(raw[i]) == 2 * ns[i] else "<u4"
                        v = views[i] = memoryview(np.frombuffer(raw[i], kind).astype("<u4").tobytes())
                    cut = v[4 * start : 4 * (start + k)]
                    out.append((i, start, k, zlib.crc32(cut), sequence, offset))
                    offset += k
                    if start + k == ns[i]:
                        del views[i]
                sequence += 1
        frame = pd.DataFrame(out, columns=["i", "start", "length", "ids_crc32", "sequence_id", "offset"])
        at = frame.pop("i").to_numpy()
        frame.insert(0, "doc_id", left["doc_id"].to_numpy()[at])
        frame["doc_tokens"] = left["n"].to_numpy()[at]
        frame["source"] = np.array(names, dtype=object)[at]
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]]

    packed = rows.groupBy("group").cogroup(opening.withColumnRenamed("group", "g").groupBy("g")).applyInPandas(
        run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
    return typed_id(packed, docs)
