"""Filter audit, collocations and removal of repeated bytes, against brute force."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quorumlens.llm import audit, collocations, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, `group` int, phrase string, digest string, key string"


def docs_of(spark, rows):
    """(doc_id, text, lang) rows, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, "s", None, 7, 1, "x", "y", None) for i, t, g in rows], SCHEMA)


# -- filter audit ---------------------------------------------------------------------------

WORDS = " ".join(f"w{i}" for i in range(250))
AUDIT = [
    (1, None, "en"), (2, "", "en"), (3, WORDS, "en"), (4, WORDS, "de"), (4, WORDS, "de"), (5, "A B # " * 300, None), (6, WORDS.upper(), ""), (7, WORDS + " #", "en"),
    (8, "one two", "en"), (None, "one two", "en"), (None, WORDS, "fr"), (9, "one two", "fr"), (3, WORDS + " é" * 9, "en"), (10, "é\x1c É" * 400, "de"), (11, "a " * 100_000, "de"),
]
LABELS = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (4, 1, 1), (9, None, None), (None, 1, 1), (99, 1, 1)]


def audit_plainly(rows, labels):
    first, good, toxic = {}, defaultdict(int), defaultdict(int)
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good[i] |= q == 1
        toxic[i] |= x == 1
    good[None] = toxic[None] = 0
    out = Counter()
    docs = []
    for i, t, g in rows:
        w = (t or "").encode().split()
        f = {"A": len(w) < 200, "B": 2 * len(set(w)) < len(w), "C": 100 * sum("A" <= c <= "Z" for c in t or "") > 3 * len(t or ""), "D": any(c in "#$%&*|" for c in t or ""), "E": i is not None and i > first[t or ""]}
        docs.append((g or "", f, good[i], toxic[i]))
    for part, f, q, x in docs:
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, c in enumerate(order, 1):
                key = (part, order, step)
                for name, v in (("kept", not gone and not f[c]), ("removed", not gone and f[c]), ("redundant", gone and f[c]), ("unique_fails", f[c] and sum(f.values()) == 1), ("good_lost", not gone and f[c] and q), ("toxic_lost", not gone and f[c] and x)):
                    out[key, name] += int(v)
                if not gone and f[c]:
                    out[part, c] += 1
                gone = gone or f[c]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(out[(p, o, s), n] for n in names), out[p, o[s - 1]]) for p in {d[0] for d in docs} for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


@pytest.mark.parametrize("parts", [1, 5])
def test_audit_against_brute_force(spark, parts):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in audit.audit(docs_of(spark, AUDIT).repartition(parts), labels).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_plainly(AUDIT, LABELS)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs_of(spark, AUDIT).limit(0), labels).isEmpty()
    assert audit.audit(docs_of(spark, AUDIT[:3]), labels).count() == 600


def test_table_of_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and len(set(audit.ORDERS)) == 120
    assert all(table[0] == 5) and all(table[31] == 0)
    assert table[0b00001, audit.ORDERS.index("EDCBA")] == 4 and table[0b10010, audit.ORDERS.index("ACBDE")] == 2


def test_many_parts_are_handed_on(spark):
    """More parts than a task holds arrays for."""
    rows = [(i, f"text {i % 7}", f"lang{i % 450}") for i in range(900)]
    got = [tuple(r) for r in audit.audit(docs_of(spark, rows).coalesce(1), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step <= 2").collect()]
    want = {r for r in audit_plainly(rows, []) if r[1] == "EABCD" and r[2] <= 2}
    assert len(got) == len(want) and set(got) == want


# -- collocations ---------------------------------------------------------------------------


def collocations_plainly(rows, longest, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\v\f\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            if any(100 * b >= inside * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(5)
    vocabulary = ["new", "york", "City", "the", "old", "é", " x", "a\x1cb", "\U0001f600", "of"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\v"]) for _ in range(rng.randrange(60)))
    rows = [(i, text(), rng.choice(["en", "en", "de", None])) for i in range(120)]
    return [*rows, (1, None, "en"), (2, "", "fr"), (None, "new york " * 5000, "en"), (3, "new york city! " * 40, "en"), (3, "new york city! " * 40, "en"), (4, "only once", "es"), (5, "z" * 30_000, "es")]


@pytest.mark.parametrize(("longest", "least", "top", "most"), [(3, 10, 2000, 1 << 20), (2, 3, 5, 1 << 20), (4, 4, 30, 0), (3, 2, 2000, 0)])
def test_collocations_against_brute_force(spark, phrases, longest, least, top, most):
    """With the hashes of frequent phrases, and (``most`` of 0) with the table of bits in their place."""
    got = [tuple(r) for r in collocations.collocations(docs_of(spark, phrases).repartition(3), longest, least, top=top, most=most, bits=1 << 10).collect()]
    assert sorted(got) == sorted(collocations_plainly(phrases, longest, least, 50, top))


def test_collocations_of_nothing(spark, phrases):
    docs = docs_of(spark, phrases)
    assert collocations.collocations(docs.limit(0)).isEmpty()
    assert collocations.collocations(docs.where("lang = 'es'")).isEmpty()


def test_hashes_are_those_of_spark(spark):
    words = ["new york", "é", "", "x" * 99]
    rows = spark.createDataFrame([("de", w) for w in words], "lang string, phrase string").selectExpr("xxhash64(lang, phrase) h").collect()
    assert [r["h"] for r in rows] == collocations.phrase_hash(b"de", [w.encode() for w in words]).view(np.int64).tolist()


def test_counts_beyond_64_bits(spark):
    """a * a * 1000000 does not fit 64 bits."""
    n = 5_000_000
    rows = [(i, "ab cd " * (n // 20), "en") for i in range(20)]
    got = collocations.collocations(docs_of(spark, rows), longest=2).collect()
    assert {(r["phrase"], r["a"], r["score"]) for r in got} == {("ab cd", n, 1_000_000), ("cd ab", n - 20, 1_000_000 * (n - 20) ** 2 // n**2)}


# -- repeated bytes -------------------------------------------------------------------------


def strip_plainly(texts, window):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def odd_texts(rng, n):
    """Copies, near copies, a common phrase among ever different bytes, periodic and odd texts."""
    base = "".join(rng.choice("abcd é") for _ in range(300))
    texts = [None, "", "a" * 400, "ab" * 200, "\U0001f600é" * 30, base, base, base[:150] + "X" + base[150:]]
    for _ in range(n):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
        texts.append("".join(rng.choice("abcdefgh ") for _ in range(40)) + base[20:50] + "".join(rng.choice("abcdefgh ") for _ in range(40)))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randrange(80))))
    return texts


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("window", "run", "busy", "unit", "part"), [(40, 8, 5, 10**6, 700), (40, 12, 10**6, 2000, 10**6), (24, 5, 1, 900, 300), (7, 3, 3, 500, 200)])
def test_repeated_bytes_against_brute_force(spark, seed, window, run, busy, unit, part):
    """With keys so busy that they are dealt by single windows, and with one or many transforms merged."""
    texts = odd_texts(random.Random(seed), 25)
    rows = [(None if i % 11 == 3 else i // 2, t, None) for i, t in enumerate(texts)]
    got = suffixes.strip_repeats(docs_of(spark, rows).repartition(3), ["phrase"], suffixes.Rule(window, run, busy, unit, part), shard_bytes=3000).collect()
    want = Counter((i, *x) for (i, _, _), x in zip(rows, strip_plainly([(t or "").encode() for t in texts], window), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert {r["phrase"] for r in got} == {"x"}


def test_equal_windows_share_a_key():
    """With few and with all keys busy, every window is in one piece, and equal ones have one key."""
    texts = [t.encode() for t in odd_texts(random.Random(1), 25) if t]
    rule = suffixes.Rule(40, 8)
    keys = np.sort(np.concatenate([k for _, k, *_ in suffixes.pieces(texts, rule)]))
    for busy, levels in ((None, {0}), (keys[::3], {0, 1}), (keys, {1})):
        windows, seen = Counter(), defaultdict(set)
        for level, key, text, start, count in suffixes.pieces(texts, rule, busy):
            for k, i, s, n in zip(key.tolist(), text.tolist(), start.tolist(), count.tolist()):
                for j in range(s, s + n):
                    windows[i, j] += 1
                    seen[texts[i][j : j + 40]].add((level, k))
        assert windows == Counter((i, j) for i, t in enumerate(texts) for j in range(len(t) - 39))
        assert {level for k in seen.values() for level, _ in k} == levels and all(len(k) == 1 for k in seen.values())


def test_long_text_in_spans(spark):
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500))
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1_100_000))
    text = long[:1_048_300] + part + long[1_048_300:] + part
    got = suffixes.strip_repeats(docs_of(spark, [(1, text, None)])).collect()[0]
    assert (got["n_bytes"], got["n_removed"], got["n_spans"], bytes(got["kept"])) == (len(text), 1000, 2, long.encode())


def test_no_rows(spark):
    assert suffixes.strip_repeats(docs_of(spark, [(1, "x", None)]).limit(0)).isEmpty()


@pytest.mark.parametrize("depth", [8, 12, 14, 3])
def test_merged_transforms_are_in_order(depth):
    """The merge gives what sorting all suffixes by ``depth`` bytes gives, whatever lies in which shard."""
    rng = random.Random(depth)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(depth, 60))) for _ in range(30)]
    for cut in ([30], [1, 29], [10, 10, 10], [1] * 30):
        it = iter(texts)
        shards = [[next(it) for _ in range(n)] for n in cut]
        interval, text, at = suffixes.merge(shards, depth)
        found = [texts[t][a : a + depth] for t, a in zip(text.tolist(), at.tolist())]
        assert found == sorted(found) and len(found) == sum(len(t) - depth + 1 for t in texts)
        assert [a == b for a, b in zip(found, found[1:])] == (np.diff(interval) == 0).tolist()
