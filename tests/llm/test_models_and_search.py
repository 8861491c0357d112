"""URL filter, searches and the three classifiers: brute force and held-out accuracy."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import hamming, langid, neighbours, quality, queries, toxicity, urls

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# -- urls -----------------------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def rule_for(host, path):
    fits = []
    for action, rule in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    odd = [None, "", "nohost", "://", "a://?x", "HTTP://A.Example.NET/de/8?q", "x://example.com/en/7#f", "x://com/en/", "x://notcom/en/1", "x://É.com/en/é", "a://b://c.org/es/", "x://net", "x://a.org/ES/"]
    rng = random.Random(5)
    odd += [f"http://{rng.choice(['', 'a.', 'www.'])}example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}" for _ in range(150)]
    odd += odd[-3:]
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in enumerate(odd)], "page_id long, url string, rule string, score double")
    got = {r["page_id"]: r for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert len(got) == len(odd)
    for i, u in enumerate(odd):
        host, path = split_url(u)
        rule, action = rule_for(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == action if action else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0), queries.URL_RULES).isEmpty()


def test_url_model_parts_two_kinds(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(9))
    known = [(f"http://{word('aeiou')}.x/{word('lmn')}", False) for _ in range(200)] + [(f"http://{word('qxzkw')}.x/{word('rst')}", True) for _ in range(200)]
    labelled = spark.createDataFrame(known, "url string, rejected boolean")
    pages = spark.createDataFrame([(i, f"http://{word('aeiou' if i % 2 else 'qxzkw')}.x/") for i in range(60)], "page_id int, url string")
    got = urls.judge(pages, [], labelled).collect()
    assert all((r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in got)


def test_url_model_against_a_plain_count(spark):
    known = {"ab": (3, 0, 1), "abc": (3, 0, 0), "abab": (2, 1, 1), "ba": (0, 3, 2), "bab": (0, 3, 0), "a" * 2500: (1, 0, 1)}
    rows = spark.createDataFrame([(u, *x) for u, x in known.items()], "url string, n0 long, n1 long, fold int")
    levels = urls.model(urls.counts(rows))
    got = {r["g"]: (r["r"], r["h"]) for level in levels for r in level.collect()}

    def plain(folds):
        counts = [{}, {}]
        for u, (n0, n1, fold) in known.items():
            if fold in folds:
                text = urls.START * (urls.ORDER - 1) + u
                for i in range(urls.ORDER - 1, len(text)):
                    for k in range(1, urls.ORDER + 1):
                        g = text[i - k + 1 : i + 1]
                        counts[0][g] = counts[0].get(g, 0) + n0
                        counts[1][g] = counts[1].get(g, 0) + n1

        def p(bad, g):
            if not g:
                return 1 / urls.SYMBOLS
            same = lambda b: [n for h, n in counts[b].items() if len(h) == len(g) and h[:-1] == g[:-1]]
            if sum(same(0)) + sum(same(1)) < urls.LEAST:
                return p(bad, g[1:])
            d = max(1, sum(n > 0 for n in same(bad)))
            return (counts[bad].get(g, 0) + d * p(bad, g[1:])) / (sum(same(bad)) + d)

        return {g: np.log(p(0, g) / p(1, g)) for g in counts[0]}

    every, outside = plain({0, 1, 2}), plain({1, 2})
    assert set(got) == set(every)
    for g, (r, h) in got.items():
        assert r == pytest.approx(every[g]) and (h is None) == (g not in outside) and (h is None or h == pytest.approx(outside[g]))

    asked = ["abba", "xyz", "bab", "ba" * 1500]
    scores = {r["uid"]: r for r in urls.with_score(spark.createDataFrame(list(enumerate(asked)), "uid long, url string"), levels).collect()}
    for i, u in enumerate(asked):
        text = urls.START * (urls.ORDER - 1) + u
        longest = lambda table, e: next((table[text[e - k + 1 : e + 1]] for k in range(urls.ORDER, 0, -1) if text[e - k + 1 : e + 1] in table), 0.0)  # noqa: E731, B023
        for name, table in (("score", every), ("held", outside)):
            assert scores[i][name] == pytest.approx(np.mean([longest(table, e) for e in range(urls.ORDER - 1, len(text))]))


def test_url_threshold_where_the_fold_lacks_a_class(spark):
    folds = {r["url"]: r["f"] for r in spark.createDataFrame([(f"x://h/{c}{i}",) for c in "ab" for i in range(60)], "url string").select("url", F.pmod(F.xxhash64("url"), F.lit(urls.HOLD)).alias("f")).collect()}
    known = [(u, "b" in u) for u, f in folds.items() if f > 0 or "a" in u]  # no rejected URL in the fold
    pages = spark.createDataFrame([(1, "x://h/a777"), (2, "x://h/b777"), (3, None)], "page_id int, url string")
    got = {r["page_id"]: (r["verdict"], r["score"]) for r in urls.judge(pages, [], spark.createDataFrame(known, "url string, rejected boolean")).collect()}
    assert (got[1][0], got[2][0]) == ("allow", "block") and got[3][1] == 0.0


def test_url_filter_runs_without_python(spark):
    plan = queries.op2_url_filter(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_url_filter_broadcasts_no_ngrams_or_urls(spark):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = {x.executionId() for x in listed(store.executionsList())}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("10")  # MB: more than the files of these URLs
    got = queries.op2_url_filter(spark, DATA)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString() and got.count() > 0
    bus.waitUntilEmpty(30_000)
    ran = [x for x in listed(store.executionsList()) if x.executionId() not in before]
    assert len(ran) > urls.ORDER
    for x in ran:  # only the model's levels, by which the n-grams look up their ratio, and if they are small
        assert set(re.findall(r"BroadcastHashJoin[^\n]*\n(?:[^\n]+\n)*?Join type: (\w+)", x.physicalPlanDescription())) <= {"LeftOuter"}
        values = store.executionMetrics(x.executionId())
        sent = [values.get(m.accumulatorId()) for n in listed(store.planGraph(x.executionId()).allNodes()) if n.name() == "BroadcastExchange" for m in listed(n.metrics()) if m.name() == "number of output rows"]
        rows = [int(v.get().replace(",", "")) for v in sent if v.isDefined()]
        assert max(rows, default=0) < spark.read.parquet(f"{DATA}/pages.parquet").select("url").distinct().agg(F.sum(F.length("url"))).first()[0]


# -- searches -------------------------------------------------------------------------------


def vectors(seed=1, n=900, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[300:600] = x[300]  # a third of all are equal
    rows = [(i, v.tolist(), 0.5) for i, v in enumerate(x)]
    odd = [(5000, None, 0.0), (5001, [0.0] * d, 0.0), (5002, [float("nan")] * d, 0.0), (5003, [None] + [1.0] * (d - 1), 0.0), (5004, [float("inf")] * d, 0.0), (5005, [1.0], 0.0), (5006, [], 0.0), (None, [1.0] * d, 0.0)]
    return x, rows + odd + rows[:5]


SCHEMA = "vec_id long, embedding array<float>, score double"


def test_nearest_neighbours(spark):
    x, rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, shard=(128, 128)).collect()
    hits = total = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(want))
        total += 10
    assert hits / total >= 0.95
    assert {r["query_id"] for r in got} == set(range(0, len(x), 20))
    few = neighbours.nearest(frame.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") == 0).isEmpty()


def test_queries_pass_a_shard_in_batches():
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    rows = pd.DataFrame({"shard": 0, "ids": [[i] for i in range(300)] + [None] * 400, "id": [*range(300), *range(1000, 1400)], "v": list(x)})
    reads = []

    def batches():
        for at in range(0, 700, 100):
            reads.append(at)
            yield rows.iloc[at : at + 100]

    out = neighbours._search(5, neighbours.DEGREE, neighbours.BEAM, neighbours.ALPHA)(batches())
    first = next(out)
    assert len(first) == 500 and reads[-1] == 300  # the later queries are not read yet
    got = pd.concat([first, *out])
    assert got["query"].nunique() == 400
    hits = sum(len(set(g["vec_id"]) & set(np.argsort(((x[:300] - x[300 + q - 1000]) ** 2).sum(axis=1))[:5])) for q, g in got.groupby("query"))
    assert hits / 2000 >= 0.95


def test_one_huge_vector_does_not_blind_its_shard():
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[17, 2] = 1e20
    points = pd.DataFrame({"shard": 0, "ids": [[i] for i in range(600)], "id": range(600), "v": list(x)})
    asks = points[points["id"] % 10 == 0].assign(ids=None)
    got = pd.concat(neighbours._search(6, neighbours.DEGREE, neighbours.BEAM, neighbours.ALPHA)(iter([points, asks])))
    hits = sum(len(set(g["vec_id"]) & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[:6])) for q, g in got.groupby("query"))
    assert hits / 360 >= 0.9
    others = points.iloc[100:]  # a shard without it must answer it too
    assert len(pd.concat(neighbours._search(6, neighbours.DEGREE, neighbours.BEAM, neighbours.ALPHA)(iter([others, points[points["id"] == 17].assign(ids=None)])))) == 6


def test_recall_at_the_largest_shard():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(neighbours.SHARD[1], 64)).astype(np.float32)
    graph, entry = neighbours.build(x, neighbours.DEGREE, neighbours.BUILD_BEAM, neighbours.ALPHA)
    asked = rng.choice(len(x), 100, replace=False)
    found, _ = neighbours.beam_search(x, graph, entry, x[asked], neighbours.BEAM)
    hits = 0
    for q, nodes in zip(asked, found):
        nodes = nodes[nodes >= 0]
        mine = nodes[np.argsort(((x[nodes] - x[q]) ** 2).sum(axis=1))[:11]]
        hits += len(set(mine) & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[:11]))
    assert hits / 1100 >= 0.9


def test_hamming_search(spark):
    x, rows = vectors(2)
    frame = spark.createDataFrame(rows, SCHEMA)
    for k in (3, 10):
        got = hamming.nearest_codes(frame, F.col("vec_id") % 20 == 0, k).collect()
        bits = x > 0
        for q in range(0, len(x), 20):
            d = (bits != bits[q]).sum(axis=1)
            want = [(int(d[i]), int(i)) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
            assert [(r["distance"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert len(hamming.nearest_codes(frame.where("vec_id < 3"), F.col("vec_id") == 0).collect()) == 2
    assert hamming.nearest_codes(frame.limit(0), F.col("vec_id") == 0).isEmpty()


def test_hamming_search_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(queries.OP4_SQL).fetchall())
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in queries.op4_hamming_search(spark, DATA).collect()) == want


# -- classifiers ----------------------------------------------------------------------------

ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (None, "Hello there"), (5, "x" * 40000), (5, "x" * 40000), (6, "\U0001f600")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0.5) for i, t in ODD], "doc_id long, text string, lang string, score double")


def test_language(spark, odd):
    got = queries.op8_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()
    rows = langid.language_id(odd, spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, 4, 6}
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["lang_pred"] for r in langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(odd.limit(0)).isEmpty()


def test_convolution_tables_equal_the_network():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.ByteCnn.fit(x, rng.integers(0, 3, 40), 3, epochs=1)
    emb = net.w["embed"][x]
    pooled = []
    for k in langid.WIDTHS:
        view = np.stack([emb[:, i : i + k].reshape(40, -1) for i in range(langid.WINDOW - k + 1)], axis=1)
        pooled.append(np.maximum((view @ net.w[f"conv{k}"] + net.w[f"bias{k}"]).max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ net.w["dense"] + net.w["out"]
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), z, atol=1e-3)


def held_out_accuracy(spark, frame, label):
    rows = frame.join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return (rows["predicted"] == rows[label]).mean()


def test_quality(spark, odd):
    assert held_out_accuracy(spark, queries.op10_quality(spark, LARGER), "quality") >= 0.97
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("doc_id < 0")
    assert {r["score"] for r in quality.quality(odd, none).collect()} == {0.5}
    assert quality.quality(odd.limit(0), labels).isEmpty()


def test_normal_equations_and_calibration_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (300, quality.STATISTICS))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.5).astype(float)
    fold = rng.integers(0, quality.FOLDS, 300)
    train = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, fold)], "stats array<double>, y double, fold int").repartition(5)
    z = quality.lift(x)
    for k, (gram, right) in enumerate(quality.normal_equations(train)):
        assert np.allclose(gram, z[fold == k].T @ z[fold == k]) and np.allclose(right, z[fold == k].T @ y[fold == k])

    def ridge(rows):
        d = z.shape[1]
        penalty = np.eye(d) * (quality.RIDGE * rows.sum() / d + 1e-9)
        penalty[-1, -1] = 1e-9 * (quality.RIDGE * rows.sum() / d + 1)
        return np.linalg.inv(z[rows].T @ z[rows] + penalty) @ z[rows].T @ y[rows]

    weights, rates = quality.fit(train)
    assert np.allclose(z @ weights, z @ ridge(np.ones(300, bool)), atol=1e-6)
    at = np.empty(300, int)
    for k in range(quality.FOLDS):
        at[fold == k] = quality.bins(z[fold == k] @ ridge(fold != k))
    prior = np.clip((np.arange(quality.BINS) + 0.5) / quality.BINS * 1.5 - 0.25, 0.001, 0.999)
    n = np.bincount(at, minlength=quality.BINS) + 0.5
    r = (np.bincount(at, y, quality.BINS) + 0.5 * prior) / n
    # Isotonic regression by its min-max formula.
    total, weight = np.concatenate([[0], np.cumsum(r * n)]), np.concatenate([[0], np.cumsum(n)])
    mean = (total[None, 1:] - total[:-1, None]) / (weight[None, 1:] - weight[:-1, None] + 1e-300)
    want = [max(min(mean[i, j] for j in range(k, quality.BINS)) for i in range(k + 1)) for k in range(0, quality.BINS, 7)]
    assert np.allclose(rates[::7], want, atol=1e-6)
    # The features' inner products approximate the kernel.
    kernel = np.exp(-((x[:40, None] - x[None, :40]) ** 2).sum(-1) / 2 / quality.WIDTH**2)
    assert np.abs(z[:40, :-1] @ z[:40, :-1].T - kernel).mean() < 0.1


def test_toxicity(spark, odd):
    assert held_out_accuracy(spark, queries.op9_toxicity(spark, LARGER), "toxic") >= 0.92
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.toxicity(odd, labels.where("doc_id < 0")).collect()} == {0.0}
    assert toxicity.toxicity(odd.limit(0), labels).isEmpty()


def test_passages_are_returned(spark):
    docs = spark.createDataFrame([(1, "fine " * 50 + "awful awful awful " + "fine " * 300 + "awful awful awful awful"), (2, "fine"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, ({"=awful": 6.0}, -0.5, 1.0, 0.01), [0.0] * toxicity.BINS).collect()}
    assert [(p["start"], p["end"]) for p in rows[1]["passages"]] == [(50, 53), (353, 357)]
    assert rows[2]["passages"] == rows[3]["passages"] == [] and (rows[1]["worst_start"], rows[1]["n_segments"]) == (353, 2)


def test_scan_is_linear_in_its_hits():
    import time

    weights = toxicity.Weights({"=bad": 2.0, "=worse": 2.5})

    def seconds(n):
        text = " ".join(("bad" if i % 3 else "worse") + " fine fine fine fine fine" for i in range(n))
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            assert len(toxicity.segments(text, weights, -0.6)[0]) == n
            best = min(best, time.perf_counter() - began)
        return best

    seconds(2000)
    assert seconds(80000) < 12 * seconds(20000)  # four times the hits; a quadratic scan takes sixteen times


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(9)
    x = rng.integers(1, 256, (12, langid.WINDOW)).astype(np.uint8)
    y, weight = rng.integers(0, 3, 12), rng.uniform(0.5, 2, 12)
    w = {k: v.astype(np.float64) for k, v in langid.ByteCnn.fit(x, y, 3, epochs=1).w.items()}

    def loss():
        emb = w["embed"][x]
        pooled = []
        for k in langid.WIDTHS:
            view = np.stack([emb[:, i : i + k].reshape(12, -1) for i in range(langid.WINDOW - k + 1)], axis=1)
            pooled.append(np.maximum((view @ w[f"conv{k}"] + w[f"bias{k}"]).max(axis=1), 0))
        z = np.concatenate(pooled, axis=1) @ w["dense"] + w["out"]
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -(weight * z[np.arange(12), y]).sum() / 12

    grads = langid.ByteCnn._gradients(w, x, y, weight)
    for name, g in grads.items():
        for at in {np.unravel_index(np.abs(g).argmax(), g.shape), tuple(rng.integers(0, n) for n in g.shape)}:
            keep, step = w[name][at], 1e-6
            w[name][at] = keep + step
            up = loss()
            w[name][at] = keep - step
            down = loss()
            w[name][at] = keep
            assert g[at] == pytest.approx((up - down) / 2 / step, abs=1e-5), (name, at)


def brute_segments(scores):
    """All maximal scoring segments, by their definition: take the best, then look left and right of it."""
    best, out = (0.0, 0, 0), []
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and best[0] > 0 and j + 1 - i > best[2] - best[1] and i <= best[1]):
                best = (total, i, j + 1)
    if best[0] <= 1e-9:
        return []
    _, i, j = best
    return brute_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(7)
    weights = toxicity.Weights({"=bad": 2.03, "=awful": 3.57, "=kind": -1.71})
    for _ in range(150):
        words = [rng.choice(["bad", "awful", "kind", *["fine"] * 4]) for _ in range(rng.randint(0, 30))]
        found, n = toxicity.segments(" ".join(words), weights, -0.613)
        scores = [weights[w] or -0.613 for w in words]
        assert n == len(words)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert [s for _, _, s in found] == pytest.approx([s for _, _, s in brute_segments(scores)])


def test_samples_by_class_hold_every_class(spark):
    """Rows of one document are drawn as one, and no class pushes another out."""
    from quorumlens.llm.common import sample_by_class

    rows = [(1, 0, f"x{i}") for i in range(60)] + [(100 + i, 1, "y") for i in range(300)] + [(7, 2, None), (7, 2, None), (8, 2, "b")]
    marks = spark.createDataFrame(rows, "doc_id long, y int, text string").repartition(5)
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    got = sample_by_class(marks, "y", 5, counts).collect()
    by = {y: [r for r in got if r["y"] == y] for y in (0, 1, 2)}
    assert len(by[0]) == 1 and 1 <= len(by[1]) <= 10 and sorted(r["doc_id"] for r in by[2]) == [7, 8]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, sample_by_class(marks.repartition(2), "y", 5, counts).collect()), key=repr)
    assert sample_by_class(marks.limit(0), "y", 5, {}).isEmpty()
