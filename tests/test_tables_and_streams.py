"""Merged tables, streams of states, families as a table, rules as a table, norms over snapshots, large panels."""

import difflib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from quorumlens.functions import similar, text as T
from quorumlens.operators import consensus as C, detectors as D, disposition as X, findings as G, terms, votes as V
from quorumlens.sources import buckets, io, report
from quorumlens.streaming import dispositions as S


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# -- buckets --------------------------------------------------------------------------------


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_an_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k long, v string, ts int"
    table = lambda *r: spark.createDataFrame(list(r), schema)
    buckets.upsert(spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("ts")), folder, ["k"], ["ts"], 16)
    before = files(folder)
    assert len(before) == 16
    touched = buckets.upsert(table((3, "new", 2), (3, "older", 1), (1000, "more", 1), (4, "late", 0)), folder, ["k"], ["ts"], 16)
    after = files(folder)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(before) - len(same) == len(touched) <= 3 and len(after) == 16
    got = {r["k"]: r["v"] for r in buckets.read(spark, folder, schema).collect()}
    assert len(got) == 501 and (got[3], got[4], got[1000]) == ("new", "old", "more")
    assert {r["k"] for r in buckets.read(spark, folder, schema, touched).collect()} < set(got)
    assert buckets.upsert(table(), folder, ["k"], ["ts"], 16) == [] and files(folder) == after
    assert buckets.read(spark, str(tmp_path / "none"), schema).isEmpty()


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k string, v string, ts int"
    batch = spark.createDataFrame([(None, "a", None), ("x", "b", 1), ("x", "c", 1), ("", None, 2)], schema)
    for _ in range(3):
        buckets.upsert(batch, folder, ["k"], ["ts"], 4)
        first = rows(buckets.read(spark, folder, schema))
        assert [r[0] for r in first] == ["", "x", None]
    assert rows(buckets.read(spark, folder, schema)) == first


def test_decisions_are_stamped_as_they_are_stored(spark, tmp_path):
    folder = str(tmp_path / "d")
    rows_ = [("f", "a", X.IGNORED, "h", "2024-01-01", None, 1, "somebody"), ("f", "b", X.OPEN, "h", "2024-01-01", None, 2, "else")]
    io.write_dispositions(spark.createDataFrame(rows_, "finding_id string, url string, status string, evidence_hash string, checked string, ts timestamp, seq long, written_by string"), folder, "me")
    got = io.read_dispositions(spark, folder).collect()
    assert [(r["url"], r["written_by"], r["written_at"] is not None) for r in got] == [("a", "me", True)]


# -- snapshots ------------------------------------------------------------------------------


def test_a_filter_opens_only_the_files_of_its_family_and_date(spark, tmp_path):
    folder = str(tmp_path / "snap")
    pages = spark.createDataFrame([(f"u{i}", "b", "nl", "fg"[i % 2], "k", f"t{i}", "", 200) for i in range(40)], "url string, bron_id string, taal string, familie string, familie_sleutel string, titel string, opgehaald_op string, http_status int")
    for date in ("2024-01-01", "2024-01-02"):
        io.write_snapshot(pages, folder, date)
    assert io.read_snapshots(spark, folder).count() == 80
    # A small family is one file, sorted by URL; every other one is spoilt.
    kept = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".json")]
    assert len(kept) == 4
    for path in kept:
        if not ("dt=2024-01-02" in path and "family=f" in path):
            os.remove(path)
            open(path, "w").write("spoilt")
    one = io.read_snapshots(spark, folder, mode="FAILFAST").where("family = 'f' and dt = '2024-01-02'")
    assert [r["url"] for r in one.collect()] == sorted(f"u{i}" for i in range(0, 40, 2))
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        io.read_snapshots(spark, folder, mode="FAILFAST").select("titel").collect()


# -- states ---------------------------------------------------------------------------------


def test_states_change_as_checks_and_decisions_arrive(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.STORE)
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    event = lambda kind, day, status=None, evidence="h", checked=None, url="a": ("f", url, kind, status, evidence, checked or f"2024-01-{day:02}", day)
    batches = [
        [event(S.DECISION, 1, X.IGNORED), event(S.DECISION, 1, X.IN_PROGRESS, url="never checked")],
        [event(S.CHECK, 2)],
        [event(S.CHECK, 3, evidence="other"), event(S.CHECK, 2)],
        [event(S.DECISION, 5, X.FIXED), event(S.DECISION, 4, X.OPEN)],
        [event(S.DECISION, 4, X.IN_PROGRESS)],  # late: changes nothing
        [event(S.CHECK, 9), event(S.DECISION, 10, X.OPEN)],
    ]
    try:
        for batch in batches:
            made = spark.createDataFrame(batch, "finding_id string, url string, kind string, status string, evidence_hash string, checked string, day int")
            made.select("finding_id", "url", "kind", "status", "evidence_hash", "checked", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("ts"), F.col("day").cast("long").alias("seq")).coalesce(1).write.mode("append").parquet(src)
            S.follow(S.read_updates(spark, src, S.EVENTS), out, mark).awaitTermination()
    finally:
        spark.conf.set(key, before)
    told = spark.read.schema(S.CHANGES).parquet(out)
    assert [(r["url"], r["change"], r["state"]) for r in told.orderBy("change").collect()] == [("a", 1, "genegeerd"), ("a", 2, "teruggekomen"), ("a", 3, "open"), ("a", 4, "gefixt"), ("a", 5, "aanwezig"), ("a", 6, "open")]
    assert rows(S.last_states(told)) == [("f", "a", "open", False)]


def test_a_page_takes_one_read_and_one_write_of_its_state():
    calls = []

    class Store:
        kept = None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    page = S.PageStates()
    page.init(Store())
    event = lambda kind, at, status=None: Row(at=at, seq=at, kind=kind, status=status, evidence_hash="h", checked=f"2024-01-{at:02}")
    told = lambda *events: [(r["change"], r["state"], r["handled"]) for r in page.handleInputRows(("f", "a"), iter(events), None)]
    assert told(event(S.DECISION, 3, X.IGNORED)) == []
    assert told(event(S.DECISION, 4, X.OPEN), event(S.CHECK, 2)) == [(1, "genegeerd", True), (2, "open", False)]
    assert told(event(S.DECISION, 3, X.IN_PROGRESS)) == []
    assert calls == ["get", "update"] * 3


# -- families -------------------------------------------------------------------------------


def sections(spark, family, steps, n=10):
    made = [(family, f"{family}{i:02}", o, s, "", 2, "") for i in range(n) for o, s in enumerate(steps(i))]
    return spark.createDataFrame(made, "family string, url string, ord int, step string, title string, level int, text string")


def test_pages_without_any_common_step_are_told(spark):
    got = D.step_plan({"section": sections(spark, "f", lambda i: [f"own {i}", f"more {i}"], 8)}).collect()
    assert {(r["detector"], r["n"], r["agree"]) for r in got} == {("steps_none", 8, 0)} and len(got) == 8
    assert {r["value"] for r in got} == {f"own {i} · more {i}" for i in range(8)}
    assert D.step_plan({"section": sections(spark, "f", lambda i: [f"own {i}"], 4)}).isEmpty()


def test_evidence_of_a_missing_step_is_what_the_page_has(spark):
    def evidence(own):
        away = D.step_plan({"section": sections(spark, "f", lambda i: ["one", "two"] + ([] if i == 3 else ["three"]) + ([own] if i == 3 else []))})
        _, pages = G.assemble(away.where("detector = 'steps_missing'"), "steps", None, ["family", "detector", "place"])
        return pages.collect()

    first, other = evidence("qqqq zzzz xxxx"), evidence("jjjj kkkk vvvv wwww")
    assert len(first) == 0 or first[0]["value"]  # renamed by place
    got = D.step_plan({"section": sections(spark, "f", lambda i: ["one", "two", "three"] if i != 3 else ["one", "two"])}).collect()
    assert [(r["detector"], r["value"], r["norm"]) for r in got] == [("steps_missing", "one · two", "three")]


def test_siblings_of_pages_without_a_plan(spark):
    got = D.step_plan({"section": sections(spark, "f", lambda i: ["one", "two"] if i != 3 else ["closed"])}).collect()
    assert [(r["url"], r["value"], [x["url"] for x in r["siblings"]]) for r in got] == [("f03", "closed", ["f00", "f01", "f02"])]


def test_siblings_of_a_page_with_a_step_more(spark):
    got = D.step_plan({"section": sections(spark, "f", lambda i: ["one", "two"] + (["more"] if i == 1 else []))}).collect()
    assert [(r["detector"], r["url"], r["value"], [x["url"] for x in r["siblings"]]) for r in got] == [("steps_extra", "f01", "more", ["f00", "f02", "f03"])]


def test_each_family_has_thresholds_and_detectors_of_its_own(spark):
    made = [(f, f"{f}{i}", 0, "Prijs", "€ 26,00" if i == 0 else "€27.00" if i == 1 else "€ 27,00") for f in ("a", "b", "c", "d") for i in range(6)]
    table = spark.createDataFrame(made, "family string, url string, ord int, label string, value_raw string")
    families = spark.createDataFrame([("a", 5, 0.8, ["table_values", "notation"]), ("b", 7, 0.8, ["table_values", "notation"]), ("c", 5, 0.9, ["notation"]), ("d", 5, 0.8, ["notation"])], "family string, min_members int, min_share double, detectors array<string>")
    kept, pages, over = G.check_families(families, {"table_row": table})
    assert sorted((r["family"], r["place"], r["rule"]) for r in kept.collect()) == [("a", 0, "table_values"), ("a", 1, "notation"), ("d", 0, "notation")]
    assert pages.count() == 3 and over.isEmpty()
    one = families.where("family = 'a'")
    alone = D.table_values({"table_row": table.where("family = 'a'")}, 5, 0.8)
    assert rows(D.table_values({"table_row": table}, one)) == rows(alone)
    with pytest.raises(KeyError):
        G.check_families(families.withColumn("detectors", F.array(F.lit("nothing"))), {"table_row": table})


def test_the_plan_does_not_grow_with_families(spark):
    table = spark.createDataFrame([("f0", "u", 0, "x", "1")], "family string, url string, ord int, label string, value_raw string")

    def size(n):
        families = spark.createDataFrame([(f"f{i}", 5, 0.8, ["table_values"]) for i in range(n)], "family string, min_members int, min_share double, detectors array<string>")
        return len(G.check_families(families, {"table_row": table})[0]._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert size(2) == size(400)


@pytest.mark.parametrize("detector", [D.step_plan, D.toggle_titles, D.standard_sentences])
def test_a_table_of_one_family_is_the_same_as_numbers(spark, detector):
    said = "Neem altijd uw oude paspoort mee naar de balie."
    made = [("f", f"u{i}", o, s, t, 3, said if i != 2 else "Neem altijd je oude paspoort mee naar de balie.") for i in range(10) for o, (s, t) in enumerate([("Stap", "Wat neemt u mee" if i else "Wat neem je mee"), ("Betaal", "")][: 1 if i == 4 else 2])]
    tables = {"section": spark.createDataFrame(made, "family string, url string, ord int, step string, title string, level int, text string")}
    families = spark.createDataFrame([("f", 5, 0.8), ("g", 1, 0.1)], "family string, min_members int, min_share double")
    assert rows(detector(tables, families)) == rows(detector(tables, 5, 0.8)) != []


# -- votes ----------------------------------------------------------------------------------


@given(st.data())
@settings(max_examples=6, deadline=None)
def test_counts_follow_a_snapshot(spark, data):
    snapshot = st.dictionaries(st.integers(0, 30), st.tuples(st.sampled_from("gh"), st.sampled_from(["a", "b", None])), max_size=20)
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "id int, g string, v string")
    before, after = frame(data.draw(snapshot)), frame(data.draw(snapshot))
    gone, come = V.changes(before, after, ["id"])
    now = V.advance(V.counts(before, ["g"], "v", ["id"]).where("v is not null"), gone.where("v is not null"), come.where("v is not null"), after.where("v is not null"), ["g"], "v", ["id"])
    want = V.counts(after.where("v is not null"), ["g"], "v", ["id"])
    assert rows(now.select("g", "v", "c", "first")) == rows(want.select("g", "v", "c", "first"))
    assert rows(V.norms(now, ["g"], "v", 2, 0.5)) == rows(C.consensus(after.where("v is not null"), ["g"], "v", ["id"], 2, 0.5))


# -- rules as a table -----------------------------------------------------------------------


def test_a_table_of_rules_finds_what_patterns_find(spark):
    pages = spark.createDataFrame([
        ("a", "nl", "De ID-kaart is geen éID-kaart. Uw ID-kaarten ook niet; identiteitskaart wel. " + "Id-kaart. " * 9), ("b", "en", "ID-kaart"), ("c", "nl", "kaart van de stad van de kaart van van de"), ("d", "nl", ""), ("e", "nl", None),
        ("f", "nl", "kaart  van\nde kaart van de, KAART VAN"), ("c", "nl", "kaart")], "url string, lang string, text string")
    listed = [terms.TermRule("id", "identiteitsbewijs", ("ID-kaart", "identiteitskaart"), ("nl",)), terms.TermRule("l", "x", ("kaart", "kaart van de", "van de kaart", "van"), ("nl", "en"))]
    names = ["rule_id", "term", "preferred", "url", "lang", "fragment", "position", "hits_on_page", "note", "owner"]
    for reported in (3, None):
        got, want = terms.hits_of_table(pages, terms.as_table(spark, listed), reported), terms.hits(pages, listed, reported)
        assert rows(got.select(*names)) == rows(want.select(*names)) != []
    with pytest.raises(ValueError, match="c\\+\\+"):
        terms.hits_of_table(pages, terms.as_table(spark, [terms.TermRule("c", "c", ("C++",))]))


def test_ten_thousand_rules_have_the_plan_of_ten(spark):
    pages = spark.createDataFrame([(f"u{i}", "en", f"word{i} and word{i + 1} x") for i in range(50)], "url string, lang string, text string")
    rule = lambda n: spark.range(n).select(F.concat(F.lit("r"), "id").alias("rule_id"), F.lit("en").alias("lang"), F.concat(F.lit("word"), "id").alias("variant"), F.lit("p").alias("preferred"), F.lit("").alias("note"), F.lit("o").alias("owner"))
    few, many = (terms.hits_of_table(pages, rule(n)) for n in (10, 10_000))
    lines = lambda f: len(f._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert lines(few) == lines(many) and (few.count(), many.count()) == (19, 100)
    assert terms.hits_of_table(pages, rule(0)).isEmpty() and terms.hits_of_table(pages.limit(0), rule(3)).isEmpty()


# -- similar texts and amounts --------------------------------------------------------------


def test_the_bound_is_never_below_the_similarity(spark):
    words = ["", "a", "tide", "diet", "wat neemt u mee", "wat neem je mee", "élan", "aaaa", "aab", "stap 1: betaal", None]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", similar.bound(F.col("a"), F.col("b")).alias("bound"), similar.similarity(F.col("a"), F.col("b")).alias("ratio")).collect():
        if r["a"] is None or r["b"] is None:
            assert r["ratio"] is None
        else:
            assert r["bound"] >= r["ratio"] - 1e-12 and r["bound"] == pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).quick_ratio())
    for least in (0.5, 0.75, 1.0):
        kept = rows(similar.similar(pairs, "a", "b", least).select("a", "b"))
        assert kept == sorted(((a, b) for a in words for b in words if a is not None and b is not None and difflib.SequenceMatcher(None, a, b).ratio() >= least), key=repr)


@pytest.mark.parametrize(("raw", "text", "written"), [
    ("€ 1.234,50", "1234.50", "nl"), ("€1,234.50", "1234.50", "en"), ("0,05", "0.05", "nl"), ("007", "7", "nl"), ("0", "0", "nl"), ("1.234", "1234.00", "nl"), ("1,234", "1234.00", "en"), ("12.34", "12.34", "en"), ("1234,5", None, None),
    ("1.23.456", None, None), ("1234.567", None, None), (" € 27,00 ", "27.00", "nl"), ("gratis", None, None), ("", None, None), (None, None, None), ("€", None, None), ("1.234.567", "1234567.00", "nl"), ("000,50", "0.50", "nl"), ("27,00 euro", None, None)])
def test_amounts(spark, raw, text, written):
    row = spark.createDataFrame([(raw,)], "raw string").select(T.amount_text(F.col("raw")).alias("t"), T.notation(F.col("raw")).alias("n")).collect()[0]
    assert (row["t"], row["n"]) == (text, written)


# -- panels ---------------------------------------------------------------------------------


def test_a_finding_on_very_many_pages_can_be_handled(spark):
    made = spark.range(10_000).select(F.lit("f").alias("family"), F.lit("d").alias("detector"), F.lit("p").alias("place"), F.concat(F.lit("u"), F.lpad("id", 5, "0")).alias("url"), F.lit("x").alias("value"), F.lit("y").alias("norm"), F.lit(20_000).alias("n"), F.lit(10_000).alias("agree"))
    found, pages = G.assemble(made, "steps", G.KIND_STRUCTURE, ["family", "detector", "place"])
    told = pages.select("finding_id", "url", "evidence_hash", F.lit(X.IGNORED).alias("status"), F.lit("2024-01-01").alias("checked"))
    text = report.panel(found, "f", "2024-02-01", None, pages, told)
    assert 'data-todo="0" data-handled="1"' in text and text.count("<li data-url=") == report.PAGES and "and 9800 more pages" in text
    text = report.panel(found, "f", "2024-02-01", None, pages, told.where("url <> 'u09999'"))
    assert 'data-todo="1" data-handled="0"' in text


def test_one_plan_makes_the_panels_of_all_families(spark):
    made = [(f, "d", f"p{i}", f"u{i}", "<x>", "y", 9, 8) for f in ("a", "b") for i in range(3)]
    found, pages = G.assemble(spark.createDataFrame(made, "family string, detector string, place string, url string, value string, norm string, n long, agree long"), "steps", G.KIND_STRUCTURE, ["family", "detector", "place"])
    family = F.get_json_object("location", "$.family")
    found = found.withColumns({"family": family, "dt": F.lit("2024-01-01")})
    dated = pages.withColumn("dt", F.lit("2024-01-01"))
    runs = spark.createDataFrame([(f, f.upper(), "2024-01-01", i, 9, ["w & w"] if f == "a" else []) for i, f in enumerate("abc")], "family string, name string, dt string, place int, pages long, warnings array<string>")
    got = {r["family"]: r for r in report.panels(found, runs, dated).collect()}
    assert [got[f]["findings"] for f in "abc"] == [3, 3, 0] and "Nothing deviates" in got["c"]["html"] and "w &amp; w" in got["a"]["html"]
    assert got["a"]["html"].count("<h3>") == 1 and got["a"]["html"].count("<article") == 3 and "&lt;x&gt;" in got["b"]["html"]


def test_a_small_table_of_rules_goes_to_the_texts(spark):
    """Texts are not dealt out by language or word, pieces stay in the page's row, and positions go on from hit to hit."""
    listed = [terms.TermRule("a", "a", ("the", "of the"), ("en",)), terms.TermRule("b", "b", ("the",), ("en",)), terms.TermRule("c", "c", ("le",), ("fr",))]
    texts = [(1, "en", "Of the one, THE other.\nthe " * 40), (1, "en", "the same url"), (2, "fr", "le the"), (3, "fr", None), (4, "en", ""), (5, None, "the")]
    pages = spark.createDataFrame(texts, "url int, lang string, text string")
    columns = ["rule_id", "term", "url", "lang", "hits_on_page"]
    found, want = terms.hits_of_table(pages, terms.as_table(spark, listed), None), terms.hits(pages, listed, None)
    assert rows(found.select(*columns, "position", "fragment")) == rows(want.select(*columns, "position", "fragment"))
    short = terms.hits_of_table(pages, terms.as_table(spark, listed), None, places=False)
    assert rows(short.select(*columns)) == rows(want.select(*columns))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2 and "Join LeftSemi, (lang" in plan and "Filter ((size(regexp_extract_all" not in plan
