"""Detectors: what they find, and what they keep silent about."""

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import consensus as C, detectors as D, disposition as X, findings as G, terms, urls
from quorumlens.operators.terms import ClaimRule, TermRule


def rows_of(spark, values, label="Legalisatie"):
    return spark.createDataFrame([("f", f"u{i}", i, label, v) for i, v in enumerate(values)], "family string, url string, ord int, label string, value_raw string")


def test_one_deviating_value(spark):
    got = D.table_values({"table_row": rows_of(spark, ["€ 27,00"] * 4 + ["€27.00", "€ 26,00"])}).collect()
    assert [(r["url"], r["value"], r["norm"], r["n"], r["agree"]) for r in got] == [("u5", "€ 26,00", "€ 27,00", 6, 5)]


@pytest.mark.parametrize("values", [["€ 27,00"] * 3 + ["€ 26,00"], ["€ 27,00"] * 6, ["€ 27,00"] * 3 + ["€ 26,00"] * 2, []])
def test_silence(spark, values):
    assert D.table_values({"table_row": rows_of(spark, values)}).isEmpty()


def test_mentions_count_but_pages_vote_once(spark):
    twice = spark.createDataFrame([("f", f"u{i % 5}", i, "x", "1" if i % 5 else "2") for i in range(10)], "family string, url string, ord int, label string, value_raw string")
    assert D.table_values({"table_row": twice}).isEmpty()
    assert D.table_values({"table_row": twice}, min_share=0.4).count() == 1


def test_mode_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "g string, v string, o int")
    assert C.mode(rows, ["g"], "v", ["o"]).collect()[0]["norm"] == "b"


def test_notation(spark):
    rows = [("f", f"u{i}", k, "x", "€ 1,00" if i else "€1.00") for i in range(6) for k in range(3)]
    got = D.notation({"table_row": spark.createDataFrame(rows, "family string, url string, ord int, label string, value_raw string")}).collect()
    assert [(r["url"], r["n"], r["agree"]) for r in got] == [("u0", 3, 0)]


def plan(spark, changes=None, n=10, steps=("Bereid voor", "Maak afspraak", "Betaal kosten", "Haal op", "Contact")):
    rows = []
    for i in range(n):
        for o, s in enumerate((changes or {}).get(i, steps)):
            rows.append(("f", f"u{i:02}", o, s, "", 2, ""))
    return {"section": spark.createDataFrame(rows, "family string, url string, ord int, step string, title string, level int, text string")}


def kinds(frame):
    return sorted((r["detector"], r["url"]) for r in frame.collect())


def test_steps(spark):
    steps = ["Bereid voor", "Maak afspraak", "Betaal kosten", "Haal op", "Contact"]
    assert D.step_plan(plan(spark)).isEmpty()
    assert kinds(D.step_plan(plan(spark, {3: steps[:2] + steps[3:]}))) == [("steps_missing", "u03")]
    assert kinds(D.step_plan(plan(spark, {3: steps[:2] + ["Betaal de kosten"] + steps[3:]}))) == [("steps_renamed", "u03")]
    assert kinds(D.step_plan(plan(spark, {3: steps + ["Iets anders"]}))) == [("steps_extra", "u03")]
    assert kinds(D.step_plan(plan(spark, {3: [steps[1], steps[0], *steps[2:]]}))) == [("steps_order", "u03")]
    assert kinds(D.step_plan(plan(spark, {3: ["Heel wat anders"]}))) == [("steps_none", "u03")]
    assert D.step_plan(plan(spark, {3: steps[:2]}, n=4)).isEmpty()


def test_extra_step_at_exactly_a_fifth_is_kept_silent(spark):
    steps = ["Bereid voor", "Maak afspraak", "Betaal kosten"]
    assert D.step_plan(plan(spark, {i: [*steps, "Extra"] for i in (1, 2)}, steps=steps)).isEmpty()


def test_toggles_and_sentences(spark):
    said = "Neem altijd uw oude paspoort mee naar de balie."
    rows = [("f", f"u{i}", 0, "Stap", "Wat neemt u mee" if i else "Wat neem je mee", 3, said if i != 2 else "Neem altijd je oude paspoort mee naar de balie.") for i in range(10)]
    tables = {"section": spark.createDataFrame(rows, "family string, url string, ord int, step string, title string, level int, text string")}
    got = D.toggle_titles(tables).collect()
    assert [(r["url"], r["value"], r["n"], r["agree"]) for r in got] == [("u0", "Wat neem je mee", 10, 9)]
    lines = D.standard_sentences(tables).collect()
    assert [(r["url"], r["n"], r["agree"]) for r in lines] == [("u2", 9, 8)]  # u0's accordion is another one
    assert lines[0]["value"] == f"1 of 1: “Neem altijd je oude paspoort mee naar de balie.” for “{said}”"
    assert [x["url"] for x in lines[0]["siblings"]] == ["u1", "u3", "u4"] and [x["url"] for x in got[0]["siblings"]] == ["u1", "u2", "u3"]


def family(spark, change=None, n=10):
    """Sibling pages of one country each: a step with two accordions, each with a heading inside."""
    section, inner, heading, page = [], [], [], []
    for i in range(n):
        land = f"Land{chr(65 + i)}"
        c = (change or {}).get(i, {})
        page.append(("f", f"u{i}", f"Paspoort als u in {land} woont", f"k{i}", f"Het duurt {c.get('weeks', 6)} weken"))
        heading += [("f", f"u{i}", 0, 1, f"Paspoort als u in {land} woont"), ("f", f"u{i}", 1, 2, f"Afspraak in {land}"), *[("f", f"u{i}", 9 + j, level, t) for j, (level, t) in enumerate(c.get("headings", []))]]
        section.append(("f", f"u{i}", 0, c.get("step", f"Afspraak in {land}"), "", 0, ""))
        for j, t in enumerate(c.get("toggles", [f"Wat neemt u mee naar {land}", "Kosten"])):
            section.append(("f", f"u{i}", 1 + j, c.get("step", f"Afspraak in {land}"), t, c.get("level", 3), c.get("text", f"Neem in {land} altijd uw paspoort mee.\nBetaal daarna contant of met de pas.")))
            inner.append(("f", f"u{i}", 1 + j, 0, c.get("inner", 4), "Let op", False))
    return {
        "page": spark.createDataFrame(page, "family string, url string, title string, variant string, text string"),
        "section": spark.createDataFrame(section, "family string, url string, ord int, step string, title string, level int, text string"),
        "section_heading": spark.createDataFrame(inner, "family string, url string, sec_ord int, ord int, level int, text string, is_toggle boolean"),
        "heading": spark.createDataFrame(heading, "family string, url string, ord int, level int, text string"),
    }


def test_siblings_of_several_countries_are_silent(spark):
    tables = family(spark)
    for detector in (D.step_plan, D.toggle_titles, D.heading_structure, D.standard_sentences):
        assert detector(tables).isEmpty()


def test_pages_without_a_plan_take_no_part(spark):
    odd = {3: {"step": "Gesloten", "toggles": ["Anders"], "level": 5, "inner": 6, "text": "Deze ambassade is helaas gesloten.", "weeks": 9}}
    tables = family(spark, odd)
    for detector in (D.toggle_titles, D.heading_structure, D.standard_sentences):
        assert detector(tables).isEmpty()
    assert [(r["detector"], r["value"], r["n"], r["agree"]) for r in D.step_plan(tables).collect()] == [("steps_none", "Gesloten", 10, 9)]
    rule = ClaimRule("duur", "Hoe lang", "pagina", {"weken": r"(\d+) weken"})
    assert D.claims(tables, [rule]).isEmpty()
    assert D.claims(family(spark, {3: {"weeks": 9}}), [rule]).count() == 1


def test_accordions_of_a_page(spark):
    def found(**change):
        return [(r["detector"], r["kind"], r["url"], r["value"]) for r in D.toggle_titles(family(spark, {2: change})).collect()]

    assert found(toggles=["Wat neemt u mee naar LandC"]) == [("toggles_missing", "structuur", "u2", None)]
    assert found(toggles=["Wat neem je mee naar LandC", "Kosten"]) == [("toggles_renamed", "schrijfrichtlijn", "u2", "Wat neem je mee naar LandC")]
    assert found(toggles=["Wat neemt u mee naar LandC"], headings=[(3, "Kosten")]) == []


def test_heading_levels_inside_and_of_titles(spark):
    def found(n=10, **change):
        return sorted((r["detector"], r["kind"], r["place"], r["value"], r["norm"], r["n"], r["agree"]) for r in D.heading_structure(family(spark, {2: change}, n)).collect())

    style = "schrijfrichtlijn"
    assert found(inner=5) == [("headings_inside", style, "inside:h5", "h5 “Let op”; h5 “Let op”", "h4", 10, 9)]
    assert found(inner=0) == []  # bold text that is nowhere a heading
    assert found(level=4) == [("headings_toggle", style, "toggle:h4", "h4 “Wat neemt u mee naar LandC”; h4 “Kosten”", "h3", 10, 9)]
    assert found(headings=[(4, "Los")]) == [("headings_jump", style, "jump", "h2 > h4 “Los”", None, 10, 9)]
    assert found(n=4, inner=5, level=4) == []


def test_similarity_compares_the_other_title_with_the_norm(spark):
    """The measure is not symmetric: what stands on the page comes first."""
    from difflib import SequenceMatcher

    missing = spark.createDataFrame([("f", "u", "tide", "T", 0)], "family string, url string, key string, title string, place int")
    loose = spark.createDataFrame([("f", "u", "diet", "D", 0)], "family string, url string, key string, title string, pos int")
    assert D.renamed_steps(missing, loose).collect()[0]["ratio"] == SequenceMatcher(None, "diet", "tide").ratio() != SequenceMatcher(None, "tide", "diet").ratio()


def test_headings(spark):
    rows = [("f", f"u{i}", o, level, t) for i in range(6) for o, (level, t) in enumerate([(1, "Titel"), (2, "Deel"), (3 if i else 4, "Onder")])]
    got = D.heading_structure({"heading": spark.createDataFrame(rows, "family string, url string, ord int, level int, text string")})
    assert kinds(got) == [("headings_jump", "u0"), ("headings_level", "u0")]


def test_claims(spark):
    rule = ClaimRule("duur", "Hoe lang", "stap:maak", {"weken": r"(\d+) weken"})
    for away, found in ((1, 1), (3, 0)):
        rows = [("f", f"u{i}", 0, "Maak afspraak", "", 2, f"Duurt {6 if i >= away else 8} weken") for i in range(10)]
        section = spark.createDataFrame(rows, "family string, url string, ord int, step string, title string, level int, text string")
        got = D.claims({"section": section, "page": section.select("family", "url", "text")}, [rule]).collect()
        assert len(got) == found
        assert not found or (got[0]["value"], got[0]["norm"]) == ("weken 8", "weken 6")
    assert D.claims({"section": section, "page": section.select("family", "url", "text")}, [ClaimRule("x", "X", "elders:x", {"a": "a"})]).isEmpty()


def test_terms(spark):
    pages = spark.createDataFrame([("a", "nl", "De ID-kaart is geen éID-kaart. Uw ID-kaarten ook niet; identiteitskaart wel. " + "Id-kaart. " * 9), ("b", "en", "ID-kaart")], "url string, lang string, text string")
    rule = TermRule("id", "identiteitsbewijs", ("ID-kaart", "identiteitskaart"), ("nl",))
    got = terms.hits(pages, [rule]).orderBy("position").collect()
    text = pages.collect()[0]["text"]
    assert [(r["term"], r["hits_on_page"]) for r in got] == [("ID-kaart", 11), ("identiteitskaart", 11), ("Id-kaart", 11)]
    assert all(text[r["position"] :].startswith(r["term"]) for r in got)
    assert got[0]["fragment"] == "De ID-kaart is geen éID-kaart."
    assert terms.summary(terms.hits(pages, [rule])).collect()[0][1:] == (11, 1)
    longest = TermRule("l", "x", ("kaart", "kaart van de"), ("nl",))
    one = terms.hits(spark.createDataFrame([("a", "nl", "kaart van de stad")], "url string, lang string, text string"), [longest]).collect()
    assert [r["term"] for r in one] == ["kaart van de"]


def test_findings_identity_and_cap(spark):
    def ids(values):
        return G.assemble(D.table_values({"table_row": rows_of(spark, values)}), "r", G.KIND_CONTENT, ["family", "place"])

    f1, p1 = ids(["1"] * 8 + ["2"])
    f2, p2 = ids(["1"] * 8 + ["3"])
    assert f1.collect()[0]["finding_id"] == f2.collect()[0]["finding_id"]
    assert p1.collect()[0]["evidence_hash"] != p2.collect()[0]["evidence_hash"]
    assert (f1.collect()[0]["certainty"], f1.collect()[0]["owner"]) == ("hoog", "kenniseigenaar")
    many = spark.range(120).select(F.lit("d").alias("rule"), F.col("id").cast("string").alias("finding_id"))
    kept, warned = G.cap(many)
    assert (kept.count(), warned.collect()[0]["found"]) == (50, 120)
    proof = ids(["1"] * 8 + ["2"])[0].collect()[0]["siblings"]
    assert [(x["url"], x["value"]) for x in proof] == [("u0", "1"), ("u1", "1"), ("u2", "1")]
    with pytest.raises(KeyError):
        G.registry.run(["nothing"], {})


def test_dispositions(spark):
    updates = spark.createDataFrame(
        [("f", "a", X.IGNORED, "h", "2024-01-01", 1, 1), ("f", "b", X.IGNORED, "old", "2024-01-01", 1, 2), ("f", "c", X.FIXED, "h", "2024-01-01", 1, 3), ("f", "d", X.FIXED, "h", "2024-02-01", 1, 4),
         ("f", "e", X.IN_PROGRESS, "h", "2024-01-01", 1, 5), ("f", "e", X.OPEN, "h", "2024-01-01", 2, 6)],
        "finding_id string, url string, status string, evidence_hash string, checked string, ts int, seq int")
    pages = spark.createDataFrame([("f", u, "h") for u in "abcdeg"], "finding_id string, url string, evidence_hash string")
    states = X.page_states(pages, X.latest(updates), "2024-02-01")
    assert {r["url"]: r["state"] for r in states.collect()} == {"a": "genegeerd", "b": "teruggekomen", "c": "aanwezig", "d": "gefixt", "e": "open", "g": "open"}
    assert X.finding_states(states).collect()[0][1:] == (6, 2, False)
    rules = spark.createDataFrame([("f", "h", None), ("g", None, "2020-01-01")], "fingerprint string, evidence_hash string, expires string")
    assert X.suppressed(pages, rules, "2024-01-01").isEmpty()


def test_disposition_stream(spark, tmp_path):
    from quorumlens.sources import buckets
    from quorumlens.streaming import dispositions as S

    schema = "finding_id string, url string, status string, evidence_hash string, checked string, ts long, seq long"
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for status, ts in (("gefixt", 1), ("negeren", 3), ("open", 2)):
        spark.createDataFrame([("f", "u", status, "h", "d", ts, ts)], schema).coalesce(1).write.mode("append").parquet(src)
        S.upsert(S.read_updates(spark, src, schema), out, mark).awaitTermination()
    assert [(r["status"], r["ts"]) for r in buckets.read(spark, out, schema).collect()] == [("negeren", 3)]


def test_activity_stream(spark, tmp_path):
    from quorumlens.streaming import dispositions as S

    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'gefixt' AS status UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'gefixt' UNION ALL SELECT timestamp'2024-01-05 00:00:00', 'negeren'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = S.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["status"], r["n"]) for r in spark.table("activity").collect()) == [("gefixt", 2), ("negeren", 1)]


def test_urls(spark):
    pages = spark.createDataFrame([(i, f"https://a.nl/{'x' if i % 2 else 'xy'}/{i:03}") for i in range(95)], "page_id int, url string")
    assert urls.scoped(pages, ["x/"]).count() == 47
    assert urls.family(pages, "/x").count() == 95 and urls.family(pages, "/x/").count() == 47
    assert sorted(r["page_id"] for r in urls.systematic_sample(pages, "page_id").collect()) == list(range(0, 90, 9))
    assert urls.systematic_sample(pages.limit(0), "page_id").isEmpty()
    maps = spark.createDataFrame([("s", "<sitemapindex><loc>a</loc><loc> b </loc><loc>s</loc></sitemapindex>"), ("a", "<urlset><loc>p1</loc></urlset>"), ("b", "<urlset><loc>p1</loc><LOC>p2</LOC></urlset>")], "sitemap_url string, xml string")
    assert sorted(r[0] for r in urls.expand_sitemaps(maps, ["s"]).collect()) == ["p1", "p2"]


def test_every_part_takes_part_in_step_rename(spark, tmp_path):
    from quorumlens.plans import catalog

    rows = [(5, "red apple", "B", "T", "C", 3), (12, "red apples", "B", "T", "C", 40), (19, "blue plum", "B", "T", "C", 3), (26, "blue plums", "B", "T", "C", 41), (33, "red apple", "B", "U", "C", 50)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_container string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["step_rename"](spark, str(tmp_path)).collect()
    assert {(r["key"], r["renamed_key"]) for r in got} == {("red apple", "red apples"), ("blue plum", "blue plums")}


def test_only_pairs_that_can_be_taken_are_grouped(spark):
    missing = spark.createDataFrame([("f", "u", "abcdefgh", "A", 0), ("f", "u", "qqqq", "Q", 1), ("f", "u", "wwww", "W", 2)], "family string, url string, key string, title string, place int")
    loose = spark.createDataFrame([("f", "u", "abcdefgx", "A2", 5), ("f", "u", "zzzzzzzzzzzzzzzzzzzz", "Z", 1), ("f", "u", "y", "Y", 7)], "family string, url string, key string, title string, pos int")
    got = D.renamed_steps(missing, loose).collect()
    assert {(r["key"], r["renamed_key"]) for r in got} == {("abcdefgh", "abcdefgx"), ("qqqq", "zzzzzzzzzzzzzzzzzzzz")}


def test_renamed_steps_take_many_pages_at_once(spark):
    """Python is called for batches of pages, not for each page; a step without a place takes none."""
    missing = spark.createDataFrame([("f", 1, "apply now", "Apply now", 0), ("f", 1, "pay", "Pay", 1), ("f", 2, "pay", "Pay", None), ("f", 3, "pay", "Pay", 2)], "family string, url int, key string, title string, place int")
    loose = spark.createDataFrame([("f", 1, "apply nou", "Apply nou", 4), ("f", 1, "xyz", "Xyz", 1), ("f", 2, "pay", "Pay", 1), ("f", 3, "zzz", "Zzz", 1)], "family string, url int, key string, title string, pos int")
    found = D.renamed_steps(missing, loose)
    assert sorted((r["url"], r["key"], r["renamed_key"], r["renamed_title"]) for r in found.collect()) == [(1, "apply now", "apply nou", "Apply nou"), (1, "pay", "xyz", "Xyz")]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_heading_are_dealt_out(spark):
    """A text that most rows have meets its key in many parts, and a family's norm goes to the rows."""
    texts = spark.range(400).select(F.lit("f").alias("family"), F.col("id").alias("url"), F.lit("Contact!").alias("text"), F.lit("").alias("name"), F.when(F.col("id") % 10 == 0, 4).otherwise(3).alias("level"), F.col("id").alias("at"))
    keyed = D._with_key(texts)
    assert keyed.columns == [*texts.columns, "key"] and keyed.where("key = 'contact'").count() == 400
    assert "part" in keyed._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    pages, away = D._wrong_levels(keyed, "x", "none", 0.8)
    assert pages.count() == away.count() == 40
    assert "strategy=broadcast" in away._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_group_meet_it_in_several_parts(spark):
    rows = spark.range(200).select(F.lit("g").alias("group"), F.col("id").alias("member"))
    few = spark.createDataFrame([("g", 1), ("other", 2)], "group string, x int")
    met = D.meet(rows, few, ["group"], "member")
    assert met.columns == ["group", "member", "x"] and {(r["member"], r["x"]) for r in met.collect()} == {(i, 1) for i in range(200)} and met.count() == 200
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert len({r[0] for r in D.meet(rows, few, ["group"], "member").select(F.spark_partition_id()).collect()}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert D.meet(rows, few, ["group"], "member", "left_anti").isEmpty()
    assert D.meet(rows, few.where("x = 2"), ["group"], "member", "left").where("x IS NULL").count() == 200
