"""Packing, substring dedup, near duplicates, mixing and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlens.llm import minhash, mixing, packing, passages, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, score double, `group` int"


def docs_of(spark, rows):
    """(doc_id, text, source) rows, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 0.5, 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "one two", "b"), (4, "one two", "b"), (5, "ONE  Two", "b"), (None, "no id here", "b"), (None, None, None), (6, long, "a"), (7, "x" * 50000, "a"), (8, "\ud83d\ude00 é ü", "c")]
    return docs_of(spark, rows)


# -- packing --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(pieces, docs, tokenizer):
    ids = defaultdict(list)
    for i, text in docs:
        ids[i].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p["doc_id"]].append(p)
        per_sequence[p["sequence_id"]].append(p)
    for i, copies in ids.items():
        assert sum(p["length"] for p in per_doc[i]) == sum(map(len, copies))
        for p in per_doc[i]:
            assert any(len(c) == p["doc_tokens"] and zlib.crc32(c[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for c in copies)
        if len(copies) == 1:
            spans = sorted((p["start"], p["length"]) for p in per_doc[i])
            assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
    for s in per_sequence.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [0, *np.cumsum([p["length"] for p in s])[:-1]]
        total = sum(p["length"] for p in s)
        assert total <= 2048 and total & (total - 1) == 0


def test_packing_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check_packing(queries.op1_packing(spark, DATA).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], tokenizer)


def test_packing_odd_rows(spark, odd, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_packing(packing.pack(odd).collect(), [r for r in rows if r[0] is not None], tokenizer)
    assert packing.pack(odd.limit(0)).isEmpty()


def test_both_tokenizers_give_the_same_ids(tokenizer):
    fast, rng = packing.encoder(), random.Random(3)
    alphabet = "abcXYZ 0129.,;!?'\"\n\t\r\u00a0éüßñΩждा中文字한글\u200b\u2028🙂-_/\\<|endoftext|>'s't"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert fast(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert fast("a<|endoftext|>b") == tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_windows_hold_the_target_proportions():
    from collections import deque

    queues = {"a": deque([(i, 700) for i in range(60)]), "b": deque([(100 + i, 500) for i in range(60)])}
    share = {"a": 0.6, "b": 0.4}
    windows = list(packing.fill(queues, share, {"a": 0.0, "b": 0.0}))
    placed = Counter()
    for k, w in enumerate(windows[:30], 1):
        for doc, _, n in w:
            placed["a" if doc < 100 else "b"] += n
        assert abs(placed["a"] - 0.6 * 2048 * k) <= packing.LEAST_PIECE + 1


def test_balances_carry_over_groups(spark):
    rows = [(i, "word " * (200 + i % 7), "a" if i % 3 else "b") for i in range(120)]
    pieces = packing.pack(docs_of(spark, rows), {"a": 0.5, "b": 0.5}, group_tokens=(4096, 4096)).collect()
    assert len({p["sequence_id"] >> 32 for p in pieces}) > 2
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_a_group_begins_with_what_the_ones_before_owe(spark):
    """The first window of each group, worked out from the totals of the groups before it."""
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(150, 400), "a" if i < 90 else "b") for i in range(180)]
    pieces = packing.pack(docs_of(spark, rows), {"a": 0.5, "b": 0.5}, group_tokens=(9000, 9000)).collect()
    placed, first = defaultdict(Counter), defaultdict(Counter)
    for p in pieces:
        group = p["sequence_id"] >> 32
        placed[group][p["source"]] += p["length"]
        if p["sequence_id"] & 0xFFFFFFFF == 0:
            first[group][p["source"]] += p["length"]
    assert len(placed) > 3
    before, carried = Counter(), 0
    for group in sorted(placed):
        total = sum(before.values())
        owed = {s: total / 2 - before[s] + 1024 for s in "ab"}  # with a share of the window itself
        room, want = 2048, Counter()
        for s in "ab":
            if int(owed[s]) >= packing.LEAST_PIECE:
                want[s] = min(int(owed[s]), room)
                room -= want[s]
        if room:
            want[max("ab", key=lambda s: owed[s] - want[s])] += room
        if all(placed[group][s] >= want[s] for s in "ab"):  # else a queue runs dry
            assert +want == first[group]
            carried += want != Counter(a=1024, b=1024)
        before += placed[group]
    assert carried > 1


# -- substring dedup ------------------------------------------------------------------------


def brute_passages(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


def test_substring_dedup_is_exact(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(k) for k in (19, 20, 21, 60, 200)]
    rows = []
    for i in range(80):
        parts = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            parts += rng.choice(shared) + text(rng.randint(0, 30))
        rows.append((i, "  ".join(parts), "s"))
    rows += [(100, "De " * 90, "s"), (101, "a b " * 60, "s"), (102, rows[5][1], "s"), (103, "x\u00a0y\u2003z " * 30, "s")]
    got = passages.strip_repeats(docs_of(spark, rows), keep=["rest", "score", "group"]).collect()
    want = brute_passages([(i, t) for i, t, _ in rows])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got} == want
    assert got[0]["rest"] == "x" and got[0]["group"] == 1


def test_substring_dedup_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD", 4000)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passages.strip_repeats(docs).collect()}
    assert got == {i: v[:2] for i, v in brute_passages([(r["doc_id"], r["text"]) for r in rows]).items()}


def test_a_phrase_among_ever_different_words(spark, monkeypatch):
    """Many different windows share a key: they are handed over one by one, in some blocks or in all."""
    rng = random.Random(11)
    phrase = [f"p{i}" for i in range(19)]
    rows = []
    for i in range(150):
        words = [f"x{rng.randrange(3)}y{i // (1 if i % 3 else 4)}z{j}" for j in range(6)] + phrase + [f"e{i if i % 5 else 0}w{j}" for j in range(30)]
        rows.append((i, " ".join(words), "s"))
    rows += [(200 + i, rows[i][1] + " tail", "s") for i in range(0, 150, 7)]
    want = brute_passages([(i, t) for i, t, _ in rows])
    for block, busy in ((600, 20), (5000, 8), (6 << 20, 128), (6 << 20, 0)):
        size = {"BLOCK": block, "BUSY": busy}
        for k, v in size.items():
            monkeypatch.setattr(passages, k, v)
        found = passages._find(passages.WINDOW, passages.RUN)

        def task(batches, found=found, size=size):
            for k, v in size.items():
                setattr(passages, k, v)
            yield from found(batches)

        monkeypatch.setattr(passages, "_find", lambda window, run, task=task: task)
        got = passages.strip_repeats(docs_of(spark, rows).repartition(3)).collect()
        monkeypatch.undo()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got} == want


def test_word_codes_of_very_many_words():
    few, many = passages._Codes({b"a", b"b"}), passages._Codes({str(i).encode() for i in range(1_300_000)})
    assert (few.width, many.width) == (1, 2) and few[b"zz"] == "\0" and many[b"zz"] == "\0\0"
    assert len(set(many.values())) == 1_300_000
    firsts, seconds = {v[0] for v in many.values()}, {v[1] for v in many.values()}
    assert not firsts & seconds


def test_rows_without_a_doc_id_are_spread(spark):
    rows = [(None, f"text number {i} " * 30, "s") for i in range(40)]
    got = passages.strip_repeats(docs_of(spark, rows)).collect()
    assert len(got) == 40 and all(r["n_removed"] == 0 and r["doc_id"] is None for r in got)


def test_substring_dedup_odd_rows(spark, odd):
    got = passages.strip_repeats(odd).collect()
    assert len(got) == odd.count()
    assert {r["n_removed"] for r in got if r["doc_id"] in (1, 2, 3, 4, 5, 7, 8, None)} == {0}
    assert next(r for r in got if r["doc_id"] == 6)["n_removed"] == 60000 - 977 - 19 + 19  # all but the first round
    assert passages.strip_repeats(odd.limit(0)).isEmpty()


def strip_rows_plainly(rows, window=20):
    """Of rows that may share a doc_id: (words, removed, what is left) of each, by the least (doc_id, start) of equal windows."""
    split = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s : s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 7])
@pytest.mark.parametrize("block", [300, 6 << 20])
def test_rows_of_one_document_do_not_depend_on_how_they_lie(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    w, rng = " ".join(f"w{i}" for i in range(25)), random.Random(7)
    rows = [(5, " ".join(f"p{i}" for i in range(30)) + " " + w, "s"), (5, w, "s"), (5, "short", "s"), (4, "x " + " ".join(f"q{i}" for i in range(22)), "s"), (5, "y z " + " ".join(f"q{i}" for i in range(22)), "s"), (None, w, "s")]
    for _ in range(60):
        at = rng.randrange(0, 60)
        rows.append((rng.randrange(8, 14), " ".join([f"u{rng.random()}"] * rng.randrange(3) + [f"v{i}" for i in range(at, at + rng.randrange(5, 40))]), "s"))
    rng.shuffle(rows)
    got = passages.strip_repeats(docs_of(spark, rows).coalesce(1) if partitions == 1 else docs_of(spark, rows).repartition(partitions)).collect()
    want = Counter(strip_rows_plainly([(i, t) for i, t, _ in rows]))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == want


# -- near duplicates ------------------------------------------------------------------------


def brute_classes(rows):
    found = {i: minhash.shingles(t) for i, t in rows}
    root = {i: i for i in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in found if found[i]]
    for a in ids:
        for b in ids:
            if b < a and minhash.similarity(found[a][:2], found[b][:2]) >= minhash.SIMILAR:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in found}


def test_near_duplicates_of_a_large_group(spark):
    """One large group of near copies, most of them too far from one another, and its exact copies."""
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 80)))) for i in range(40)]
    for i in range(40, 200):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[i % 7 + 60][1].upper()) for i in range(200, 260)]
    got = minhash.near_duplicates(docs_of(spark, [(*r, "s") for r in rows])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_pairs_that_the_bound_leaves_out_are_not_similar(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 7)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append((i, " ".join(words)))
    docs = docs_of(spark, [(*t, "s") for t in texts])
    content = minhash.contents(docs)
    left = spark.createDataFrame([(i, i) for i, _ in texts], "id long, root long")
    pairs = pairs_of(minhash._rest(left, content))
    found = {i: minhash.shingles(t)[:2] for i, t in texts}
    similar = {(a, b) for a in found for b in found if b < a and minhash.similarity(found[a], found[b]) >= minhash.SIMILAR}
    assert similar <= pairs and len(pairs) < 60 * 59 / 2


def test_pairs_that_the_bound_leaves_out_are_not_similar_with_weights(spark):
    """Shingles that repeat, with counts far apart: the bound holds for probability Jaccard too."""
    rng = random.Random(14)
    base = {j: rng.choice((1, 1, 1, 2, 9, 60)) for j in range(70)}
    bags = {}
    for i in range(70):
        bag = {j: max(1, w + rng.choice((0, 0, 0, 1, -1))) for j, w in base.items() if rng.random() > 0.06}
        bags[i] = bag | {1000 * (i % 20) + j + 500: rng.choice((1, 1, 8)) for j in range(rng.randint(0, 6))}
    rows = [(i, i, sum(b.values()), sorted(b), [b[k] for k in sorted(b)] if max(b.values()) > 1 else None) for i, b in bags.items()]
    content = spark.createDataFrame(rows, "id long, node long, n long, kinds array<bigint>, counts array<bigint>")
    left = spark.createDataFrame([(i, i % 35) for i in bags], "id long, root long")
    pairs = pairs_of(minhash._rest(left, content))
    arrays = {i: (np.array(sorted(b), np.uint64), np.array([b[k] for k in sorted(b)])) for i, b in bags.items()}
    similar = {(a, b) for a in bags for b in bags if b < a and a % 35 != b % 35 and minhash.similarity(arrays[a], arrays[b]) >= minhash.SIMILAR}
    assert similar and similar <= pairs and len(pairs) < 70 * 69 / 2


def pairs_of(frame):
    return {(r["a"], r["b"]) for r in frame.collect()}


def contents_of(spark, sets):
    """What ``minhash.contents`` gives, of sets of whole numbers."""
    rows = [(i, i, len(x), sorted(x), None) for i, x in sets.items()]
    return spark.createDataFrame(rows, "id long, node long, n long, kinds array<bigint>, counts array<bigint>")


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_bound_of_a_document_in_its_hubs_component(spark):
    hub = set(range(1, 101))
    a = set(range(1, 96)) | set(range(101, 106))
    b = (a - set(range(86, 96))) | set(range(201, 211))
    assert jaccard(hub, a) >= minhash.SIMILAR and jaccard(a, b) >= minhash.SIMILAR > jaccard(hub, b)
    left = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "id long, root long")
    assert (2, 1) in pairs_of(minhash._rest(left, contents_of(spark, {0: hub, 1: a, 2: b})))


def test_bound_with_components_of_several_documents(spark):
    rng = random.Random(8)
    base = list(range(100))
    sets = {i: set(rng.sample(base, 91)) | {1000 * i + j for j in range(rng.randint(0, 4))} | {10**6 + (i % 6) * 10 + j for j in range(rng.randint(0, 5))} for i in range(48)}
    root = {i: i % 6 for i in sets}
    left = spark.createDataFrame([(i, root[i]) for i in sets], "id long, root long")
    pairs = pairs_of(minhash._rest(left, contents_of(spark, sets)))
    similar = {(a, b) for a in sets for b in sets if b < a and root[a] != root[b] and jaccard(sets[a], sets[b]) >= minhash.SIMILAR}
    assert similar and similar <= pairs


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    kinds = np.unique(rng.integers(0, 2**62, 400).astype(np.uint64))
    weights = rng.integers(1, 5, len(kinds))
    a, b = (kinds[:300], weights[:300]), (kinds[80:], weights[80:] + (np.arange(len(kinds) - 80) % 3 == 0))
    exact = minhash.similarity(a, b)
    x, y = kinds[np.isin(kinds, a[0])], dict(zip(b[0].tolist(), b[1].tolist()))
    slow = 0.0
    wa, wb = dict(zip(a[0].tolist(), a[1].tolist())), y
    for i in set(wa) & set(wb):
        slow += 1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in set(wa) | set(wb))
    assert exact == pytest.approx(slow)
    estimate = np.mean(minhash.signature(*a, registers=4000) == minhash.signature(*b, registers=4000))
    assert abs(estimate - exact) < 0.04
    assert x is not None


def test_near_duplicates_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)}
    assert minhash.near_duplicates(odd.limit(0)).isEmpty()


def test_rows_that_share_a_doc_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (4, c.upper()), (4, None), (5, None), (5, " "), (6, b + " more"), (7, ""), (7, a)]
    got = minhash.near_duplicates(docs_of(spark, [(*r, "s") for r in rows])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3), (4, 3), (4, 3), (5, 5), (5, 5), (6, 0), (7, 0), (7, 0)]


def test_pairs_of_high_similarity_are_found(spark):
    """Recall of banding and verification over pairs of similarity 0.8 to 0.9, words and whole runs replaced."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(20000)]
    rows, wanted = [], []
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        other = list(words)
        at = rng.randrange(len(words) - 12)
        other[at : at + len(words) // 12 - 3] = [rng.choice(vocabulary) for _ in range(len(words) // 12 - 3)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if 0.8 <= minhash.similarity(minhash.shingles(rows[-2][1])[:2], minhash.shingles(rows[-1][1])[:2]) < 0.9:
            wanted.append(k)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, [(*r, "s") for r in rows])).collect()}
    assert len(wanted) > 100 and sum(got[2 * k] == got[2 * k + 1] for k in wanted) >= 0.99 * len(wanted)


def test_near_duplicates_of_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op6_near_duplicates(spark, DATA).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


# -- mixing ---------------------------------------------------------------------------------


def test_mixing_targets():
    assert mixing.targets({"a": 10, "b": 10, "c": 10}) == pytest.approx({"a": 18.75, "b": 7.5, "c": 3.75})
    capped = mixing.targets({"a": 1, "b": 100, None: 100})
    assert capped["a"] == 3 and sum(capped.values()) == pytest.approx(201)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mixing_budgets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, again = (mixing.take(d).collect() for d in (docs, docs.repartition(9)))
    assert {(r["doc_id"], r["taken"]) for r in first} == {(r["doc_id"], r["taken"]) for r in again}
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    per = defaultdict(int)
    for r in first:
        assert r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]] += r["taken"]
    goal = {r["source"]: r["target"] for r in first}
    assert all(abs(per[s] - goal[s]) <= 0.5 for s in goal)
    assert sum(goal.values()) == pytest.approx(sum(words.values()))


def mix_plainly(spark, rows):
    """(doc_id, text, source) rows with the words that the mixture takes of each, and the rows of the mixture."""
    keyed = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.xxhash64(F.lit(23), "doc_id", F.xxhash64("text")).alias("key")).collect()
    by = defaultdict(list)
    for r in keyed:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        by[r["source"]].append(((r["key"] & (1 << 64) - 1) >> 1, r["key"], r["doc_id"], len(words), words, r["text"]))
    goal = mixing.targets({s: sum(x[3] for x in found) for s, found in by.items()})
    taken, mixture = [], []
    for source, found in by.items():
        size, budget, ahead = sum(x[3] for x in found), math.floor(goal[source] + 0.5), 0
        for _, _, i, n, words, text in sorted(found, key=lambda x: x[:4]):
            own = (budget // size if size else 0) * n + max(0, min(n, budget % size - ahead if size else 0))
            ahead += n
            taken.append((i, n, own))
            for use in range(-(-own // n) if n else 0):
                left = own - use * n
                mixture.append((i, text if left >= n else " ".join(words[:left])))
    return taken, mixture


def test_mixing_takes_what_a_plain_count_takes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    taken, mixture = mix_plainly(spark, [tuple(r) for r in docs.collect()])
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.take(docs).collect()) == sorted(taken)
    assert Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect()) == Counter(mixture)


def test_mixing_odd_rows(spark, odd):
    got = mixing.take(odd).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.take(odd.limit(0)).isEmpty() and mixing.mix(odd.limit(0)).isEmpty()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.select(F.sum(mixing.words(F.col("text")))).collect()[0][0] == sum(r["taken"] for r in got)


# -- the pipeline ---------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_the_pipeline_against_plain_stages(spark, tokenizer):
    """All stages one after another, each worked out plainly from what the one before has left."""
    from quorumlens.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    said = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if said[r["doc_id"]]["lang_pred"] != langid.UNDETERMINED and said[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
    assert 0 < len(rows) <= docs.count()
    classes = brute_classes([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    source = {i: s for i, _, s in rows}
    rows = [(i, text, source[i]) for i, _, _, text in strip_rows_plainly([(i, t) for i, t, _ in rows])]
    _, mixture = mix_plainly(spark, rows)
    check_packing(corpus_pipeline.run(spark, DATA).collect(), mixture, tokenizer)


def test_pipeline_stages(spark, odd, tmp_path):
    docs, sizes = odd, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
    assert sizes[0] == 0  # no row tells its language, so none can be recognised
    known = odd.withColumn("lang", F.lit("en"))
    assert corpus_pipeline.language(spark, known, DATA).count() == 7  # those with a letter
    assert corpus_pipeline.near_duplicates(spark, odd, DATA).count() == 9
    assert corpus_pipeline.substrings(spark, odd, DATA).count() == odd.count()


def test_stages_hand_python_small_batches(spark):
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(5000).cast("long").alias("n_chars"))
    sizes = lambda: [r[0] for r in docs.select("text").mapInPandas(lambda batches: (b.assign(n=b["text"].str.len().sum())[["n"]].head(1) for b in batches), "n long").collect()]
    before = spark.conf.get(corpus_pipeline.BATCH)
    assert max(sizes()) == 20_000_000
    try:
        corpus_pipeline.mix(spark, docs, DATA)
        assert max(sizes()) < 5_000_000 and sum(sizes()) == 20_000_000
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
