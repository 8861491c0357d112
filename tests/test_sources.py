"""Parsers, files, configuration, fetching, reports, commands."""

import hashlib
import inspect
import json

import pytest
from pyspark.sql import functions as F

from quorumlens import cli
from quorumlens.sources import html, io, report, rules, web

PAGE = """<html><head><title>Kop</title></head><body><nav>menu</nav><main><h1>Titel</h1>
<h2>Stap 1: Bereid voor</h2><p>Lees dit .</p>
<h3><button aria-controls="p1">Wat neemt u mee</button></h3><div id="p1" data-testid="accordion-panel"><h4>Papieren</h4><p><b>Let op</b></p><ul><li>pas</li></ul></div>
<h2>Contact</h2><table><tr><th>Dienst</th><th>Prijs</th></tr><tr><td>Visum</td><td>€ 27,00</td></tr><tr><td>Leeg</td><td></td></tr></table></main><footer>x</footer></body></html>"""


@pytest.fixture
def parsed(spark):
    pages = spark.createDataFrame([("f", "u", PAGE), ("f", "two", "<main></main><main></main>"), ("f", "none", None)], "family string, url string, html string")
    return html.parse(pages).persist()


def test_html_records(parsed):
    assert {r["url"]: r["error"] for r in parsed.collect()} == {"u": None, "two": "2 main elements", "none": "0 main elements"}
    assert [(r["level"], r["text"]) for r in html.headings(parsed).orderBy("ord").collect()] == [(1, "Titel"), (2, "Stap 1: Bereid voor"), (3, "Wat neemt u mee"), (4, "Papieren"), (2, "Contact")]
    assert [(r["label"], r["value_raw"]) for r in html.table_rows(parsed).collect()] == [("Visum", "€ 27,00")]
    got = [(r["step"], r["title"], r["level"], r["text"]) for r in html.sections(parsed).orderBy("ord").collect()]
    assert got[0] == ("Stap 1: Bereid voor", "", 0, "Lees dit.")
    assert got[1][:3] == ("Stap 1: Bereid voor", "Wat neemt u mee", 3) and "pas" in got[1][3]
    assert got[2][0] == "Contact"
    assert [(r["level"], r["text"]) for r in html.section_headings(parsed).orderBy("ord").collect()] == [(4, "Papieren"), (0, "Let op")]


def test_plain_pages(spark):
    pages = spark.createDataFrame([("u", '<title>T</title><body><div class="cookie-bar">c</div><nav>n</nav><article><h1>K</h1><p>Tekst  hier</p><script>x</script></article></body>')], "url string, html string")
    row = html.plain_pages(pages).collect()[0]
    assert (row["title"], row["text"]) == ("K", "K\nTekst  hier")
    odd = '<title> T </title><body><p>a <b>b</b> c</p><div id="top-menu">m</div><p class="share-price">12</p><ul class="Social"><li>s</li></ul><iframe>i</iframe><template>t</template></body>'
    row = html.plain_pages(spark.createDataFrame([("u", odd)], "url string, html string")).collect()[0]
    assert (row["title"], row["text"].split("\n")) == ("T", ["T", "a", "b", "c", "12"][1:])


def sections_of(spark, body):
    parsed = html.parse(spark.createDataFrame([("f", "u", f"<main>{body}</main>")], "family string, url string, html string"))
    inside = {}
    for r in html.section_headings(parsed).orderBy("sec_ord", "ord").collect():
        inside.setdefault(r["sec_ord"], []).append((r["level"], r["text"], r["is_toggle"]))
    return [(r["step"], r["title"], r["level"], r["text"], inside.get(r["ord"], [])) for r in html.sections(parsed).orderBy("ord").collect()]


def test_sections(spark):
    toggle = lambda i, t: f'<h3><button aria-controls="{i}">{t}</button></h3>'
    got = sections_of(spark, f"""<h1>T</h1><p>Vooraf</p><h2>Een</h2><h3>Los kopje</h3><p>Tekst<br>meer .</p>{toggle("a", "A")}{toggle("b", "B")}
        <div id="a" data-testid="accordion-panel"><h4>In <i>a</i></h4><p><strong>Vet</strong></p><p><b>Half</b> vet</p><p><b>Twee</b><b>Delen</b></p>{toggle("x", "Binnen")}</div>
        <div id="accordion-panel-9">bij de laatste</div><button aria-controls="c">C</button><script>niet</script>
        <template><h2>Verborgen</h2></template><p>Fout: JavaScript staat uit. Zet aan. U ziet dan de filtertool.</p><h2>Twee</h2>""")
    assert got == [
        ("", "", 0, "Vooraf", []),
        ("Een", "", 0, "Los kopje\nTekst\nmeer.", [(3, "Los kopje", False)]),
        ("Een", "A", 3, "In a\nVet\nHalf vet\nTwee Delen\nBinnen", [(4, "In a", False), (0, "Vet", False), (3, "Binnen", True)]),
        ("Een", "B", 3, "bij de laatste", []),
        ("Een", "C", 0, "", []),
        ("Twee", "", 0, "", []),
    ]
    parsed = html.parse(spark.createDataFrame([("f", "u", "<main><h1>T</h1><noscript><h2>x</h2></noscript><h2><template>y</template>z</h2></main>")], "family string, url string, html string"))
    assert [r["text"] for r in html.headings(parsed).orderBy("ord").collect()] == ["T", "z"]


def test_files(spark, tmp_path):
    page = {"url": "u", "familie": "f", "familie_sleutel": "peru", "titel": "t", "tabellen": [{"index": 0, "kolomkoppen": [], "rijen": [{"label": "a", "waarde_rauw": "1"}]}]}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "f.jsonl").write_text(json.dumps(page) + "\n\n")
    tables = io.snapshot_tables(io.read_snapshot(spark, str(tmp_path / "s")))
    assert tables["table_row"].collect()[0]["value_raw"] == "1" and tables["section"].isEmpty()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.jsonl").write_text('{"url": "u", "tekst": "x"}\n')
    row = io.read_corpus(spark, str(tmp_path / "c")).collect()[0]
    assert (row["taal"], row["content_hash"]) == ("", "2d711642b726b044")
    rows = spark.createDataFrame([("f", 1), ("g", 2)], "family string, n int")
    for date in ("2024-01-02", "2024-01-10"):
        io.write_findings(rows.where("family = 'f'") if date.endswith("10") else rows, str(tmp_path / "out"), date)
    assert sorted((r["family"], r["dt"]) for r in io.latest(spark, str(tmp_path / "out")).collect()) == [("f", "2024-01-10"), ("g", "2024-01-02")]
    for made in ([("f", "old"), ("g", "kept")], [("f", "new")], [("h", "more")]):
        io.publish_panels(spark.createDataFrame([(f, f, "2024-01-01", 0, 1, h) for f, h in made], io.PANELS), str(tmp_path / "p"))
    assert sorted((r["family"], r["html"]) for r in io.read_panels(spark, str(tmp_path / "p")).collect()) == [("f", "new"), ("g", "kept"), ("h", "more")]


def test_what_is_written_can_be_read_back(spark, tmp_path):
    corpus = spark.createDataFrame([("u2", "nl", "s", "t", "tekst", "2024", "h"), ("u1", "en", "s", "", "", "", "")], io.CORPUS)
    io.write_corpus(corpus, str(tmp_path / "corpus"))
    got = {r["url"]: r for r in io.read_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert set(got) == {"u1", "u2"} and (got["u2"]["tekst"], got["u2"]["content_hash"]) == ("tekst", "h") and len(got["u1"]["content_hash"]) == 16
    io.write_corpus(corpus.limit(0), str(tmp_path / "empty"))
    assert io.read_corpus(spark, str(tmp_path / "empty")).isEmpty()
    parsed = html.parse(spark.createDataFrame([("f", "https://a.nl/x-peru", PAGE)], "family string, url string, html string"))
    from pyspark.sql import functions as F

    pages = html.snapshot_pages(parsed, "bron", "nl", "2024-01-01T00:00:00", F.lit(200), "x-")
    io.write_snapshot(pages, str(tmp_path / "snap"), "2024-01-01")
    tables = io.snapshot_tables(io.read_snapshot(spark, str(tmp_path / "snap")))
    assert [tuple(r)[1:] for r in tables["page"].select("family", "url", "variant", "title").collect()] == [("https://a.nl/x-peru", "peru", "Titel")]
    assert sorted(map(tuple, tables["table_row"].select("label", "value_raw").collect())) == [("Visum", "€ 27,00")]
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect()), key=repr) == sorted(map(tuple, b.select(*c).collect()), key=repr)
    assert same(tables["section"], html.sections(parsed), "step", "title", "level", "text")
    assert same(tables["section_heading"], html.section_headings(parsed), "level", "text", "is_toggle")
    assert same(tables["heading"], html.headings(parsed), "ord", "level", "text")


@pytest.mark.parametrize("text", [
    "", "regels: []", "regels: [x]", "regels: [{voorkeur: a, varianten: [b]}]", "regels: [{id: a, varianten: [b]}]", "regels: [{id: a, voorkeur: b}]",
    "regels: [{id: a, voorkeur: b, varianten: [c], talen: [xx]}]", "regels: [{id: a, voorkeur: b, varianten: [c]}, {id: a, voorkeur: b, varianten: [c]}]", "- x"])
def test_faulty_rules(tmp_path, text):
    (tmp_path / "r.yaml").write_text(text)
    with pytest.raises(ValueError):
        rules.load_terms(str(tmp_path / "r.yaml"))


def test_good_rules(tmp_path):
    (tmp_path / "r.yaml").write_text("regels: [{id: a, voorkeur: b, varianten: [c, c d]}]")
    assert rules.load_terms(str(tmp_path / "r.yaml"))[0].languages == ("nl", "en")
    (tmp_path / "s.yaml").write_text("sites: [{id: a, basis_url: 'https://a.nl/', taal: nl}]")
    sites, most = rules.load_sites(str(tmp_path / "s.yaml"))
    assert (sites[0].base_url, most) == ("https://a.nl", 200)
    with pytest.raises(ValueError):
        rules.load_sites(str(tmp_path / "missing.yaml"))


def test_fetching(spark):
    def transport(url, headers):
        if url.endswith("robots.txt"):
            return 200, {}, "User-agent: *\nDisallow: /secret"
        if headers.get("If-None-Match") == "e":
            return 304, {}, ""
        return (200, {"ETag": "n"}, "body") if url.endswith("/ok") else (404, {}, "")

    rows = spark.createDataFrame([("https://a.nl/ok", None), ("https://a.nl/secret", None), ("https://a.nl/gone", None), ("https://a.nl/same", "e")], "url string, etag string")
    got = {r["url"].rsplit("/", 1)[1]: r for r in web.fetch(rows, transport, pause=0).collect()}
    assert (got["ok"]["html"], got["ok"]["etag"]) == ("body", "n")
    assert got["secret"]["error"] == "forbidden by robots.txt" and got["gone"]["error"] == "status 404"
    assert (got["same"]["status"], got["same"]["error"]) == (304, None)
    assert web.permitted(rows, {"a.nl": "User-agent: *\nDisallow: /secret"}).count() == 3


def test_retries():
    answers = iter([(503, {"Retry-After": "0"}, ""), (200, {}, "x")])
    assert web.get("u", lambda *_: next(answers), pause=0)[2] == "x"


def test_reports():
    assert "No family" in report.families_report([])
    one, two = report.families_report([("a", "A", "<p>")]), report.families_report([("a", "A", "<p>"), ("b", "B", "<p>")])
    assert "<nav>" not in one and "<nav>" in two


def test_panels_tell_states_and_what_they_leave_out(spark, monkeypatch):
    from quorumlens.operators import findings as G

    rows = [("f", "d", f"p{i // 3}", f"u{i}", f"<{i}>", "norm", 9, 6) for i in range(6)]
    found, pages = G.assemble(spark.createDataFrame(rows, "family string, detector string, place string, url string, value string, norm string, n long, agree long"), "steps", G.KIND_STRUCTURE, ["family", "detector", "place"])
    first = pages.where("url < 'u3'").select("finding_id", "url", "evidence_hash")
    from pyspark.sql import functions as F

    told = first.withColumns({"status": F.lit("negeren"), "checked": F.lit("2024-01-01")})
    text = report.panel(found, "f", "2024-02-01", "Familie", pages, told, {"pages": 9, "warnings": ["a < b"]})
    assert 'data-todo="1" data-handled="1"' in text and text.count('data-state="genegeerd"') == 3 and text.count('data-state="open"') == 3
    assert "9 pages" in text and "a &lt; b" in text and "&lt;0&gt;" in text and "data-evidence=" in text
    monkeypatch.setattr(report, "PAGES", 2)
    assert report.panel(found, "f", "2024-02-01", "Familie", pages).count("and 1 more pages") == 2
    assert "Nothing deviates" in report.panel(found.limit(0), "f", "d")


SITE = {
    "https://a.nl/robots.txt": "User-agent: *\nDisallow: /visum/geheim\nSitemap: https://a.nl/leeg.xml\nSitemap: https://a.nl/index.xml",
    "https://a.nl/leeg.xml": "<urlset></urlset>",
    "https://a.nl/index.xml": "<sitemapindex><sitemap><loc>https://a.nl/1.xml</loc></sitemap><sitemap><loc>https://a.nl/index.xml</loc></sitemap><sitemap><loc>https://a.nl/2.xml</loc></sitemap></sitemapindex>",
    "https://a.nl/1.xml": "<urlset>" + "".join(f"<url><loc>https://a.nl/visum/land-{i}</loc></url>" for i in range(8)) + "<url><loc>https://a.nl/visum/geheim/x</loc></url></urlset>",
    "https://a.nl/2.xml": "<urlset><url><loc>https://a.nl/visumkosten</loc></url><url><loc>https://a.nl/over/ons</loc></url></urlset>",
} | {f"https://a.nl/visum/land-{i}": f"<main><h1>Visum</h1><table><tr><td>Legalisatie</td><td>€ 2{7 if i else 6},00</td></tr></table></main>" for i in range(7)}


def test_commands_over_a_site(spark, tmp_path, monkeypatch):
    """From sitemap to findings, report and panels, without a network."""
    site = dict(SITE)

    def over_a_site(url, headers):
        body = site.get(url)
        return (200, {}, body) if body is not None else (404, {}, "")

    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(web, "PAUSE", 0)
    for f in ("_controleer", "_invarianten", "_verken", "_crawl"):
        monkeypatch.setattr(cli, f, lambda s, a, run=getattr(cli, f): run(s, a, over_a_site))
    from quorumlens.sources import collect

    def at_once(run):
        def call(*args, **kwargs):
            bound = inspect.signature(run).bind(*args, **kwargs)
            bound.arguments["pause"] = 0
            return run(*bound.args, **bound.kwargs)

        return call

    for f in ("site_urls", "family_urls", "snapshot", "corpus"):
        monkeypatch.setattr(collect, f, at_once(getattr(collect, f)))
    at = lambda x: str(tmp_path / x)
    (tmp_path / "f.yaml").write_text("families: [{id: visum, naam: Visum, pad_prefix: /visum/, sleutel_strip: land-, sitemap: 'https://a.nl/1.xml', detectoren: [table_values]}]")
    (tmp_path / "s.yaml").write_text("sites: [{id: a, basis_url: 'https://a.nl', taal: nl, paden: [/visum]}]")
    run = ["controleer", "--rules", at("f.yaml"), "--familie", "visum", "--naar", at("out"), "--date", "2024-01-02"]
    assert cli.main(run) == 0
    text = (tmp_path / "out" / "report.html").read_text()
    assert "€ 26,00" in text and "7 pages" in text and "land-7: status 404" in text and "geheim/x" in text
    panel = spark.createDataFrame([("old", "Old", "2020-01-01", 0, 1, "<p>")], io.PANELS)
    io.publish_panels(panel, at("panels"))
    assert cli.main(["publiceer", "--rules", at("f.yaml"), "--van", at("out"), "--naar", at("panels")]) == 0
    assert {r["family"] for r in io.read_panels(spark, at("panels")).collect()} == {"old", "visum"}
    # What was decided about a page reaches the next report.
    decided = spark.read.parquet(at("out/pages")).selectExpr("finding_id", "url", "'negeren' AS status", "evidence_hash", "'2024-01-02' AS checked", "timestamp'2024-01-03 00:00:00' AS ts", "1L AS seq")
    assert 'data-todo="1" data-handled="0"' in text
    io.write_dispositions(decided, at("out/dispositions"), "me")
    assert cli.main(["rapport", "--rules", at("f.yaml"), "--van", at("out"), "--naar", at("again.html")]) == 0
    again = (tmp_path / "again.html").read_text()
    assert 'data-todo="0" data-handled="1"' in again and 'data-state="genegeerd"' in again
    fetched = spark.read.json(at("out/snapshots/dt=2024-01-02/family=visum")).collect()[0]["opgehaald_op"]
    assert fetched.endswith("+00:00") and len(fetched) == 25
    assert cli.main(["verken", "--sites", at("s.yaml")]) == 0
    assert cli.main(["verken", "--sites", at("s.yaml"), "--cache", at("maps")]) == 0
    site["https://a.nl/1.xml"] = None  # gone: what is known stands
    assert cli.main(["verken", "--sites", at("s.yaml"), "--cache", at("maps")]) == 0
    site["https://a.nl/1.xml"] = SITE["https://a.nl/1.xml"]
    crawl = ["crawl", "--sites", at("s.yaml"), "--uit", at("corpus"), "--cache", at("cache"), "--max-paginas", "3"]
    assert cli.main(crawl) == 0
    assert sorted(r["url"][-1] for r in io.read_corpus(spark, at("corpus")).collect()) == ["0", "1", "2"]
    (tmp_path / "r.yaml").write_text("regels: [{id: id, voorkeur: b, varianten: [Legalisatie]}]")
    (tmp_path / "uit").mkdir()
    assert cli.main(["check", "--corpus", at("corpus"), "--regels", at("r.yaml"), "--uit", at("uit"), "--sites", at("s.yaml"), "--strict"]) == 1
    assert "a: /visum" in (tmp_path / "uit" / "report.html").read_text()
    (tmp_path / "s2.yaml").write_text("sites: [{id: a, basis_url: 'https://a.nl', taal: nl}]")
    assert cli.main(["crawl", "--sites", at("s2.yaml"), "--uit", "x", "--cache", "y"]) == 2
    assert cli.main(["invarianten", "--rules", at("f.yaml"), "--familie", "visum", "--index", "https://a.nl/index.xml"]) == 1  # far too few of everything


def test_a_cache_is_asked_first(spark, tmp_path):
    def changing(url, headers):
        if url.endswith("robots.txt"):
            return 404, {}, ""
        if headers.get("If-None-Match"):
            return 304, {}, ""
        return (200, {"ETag": "e"}, "first") if url.endswith("a") else (404, {}, "")

    rows = spark.createDataFrame([("https://h.nl/a",), ("https://h.nl/b",)], "url string")
    fetch = lambda t, **k: {r["url"][-1]: (r["html"], r["error"]) for r in web.fetch_cached(rows, str(tmp_path / "c"), t, 0, **k).collect()}
    assert fetch(changing) == {"a": ("first", None), "b": (None, "status 404")}
    assert fetch(changing) == {"a": ("first", None), "b": (None, "status 404")}  # unchanged there: what is known
    later = lambda url, headers: (404, {}, "") if url.endswith("robots.txt") else (200, {}, "later")
    assert fetch(later, revalidate=False) == {"a": ("first", None), "b": ("later", None)}
    assert fetch(later) == {"a": ("later", None), "b": ("later", None)}


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.jsonl").write_text('{"url": "u", "taal": "nl", "tekst": "De ID-kaart."}\n')
    (tmp_path / "r.yaml").write_text("regels: [{id: id, voorkeur: b, varianten: [ID-kaart]}]")
    (tmp_path / "uit").mkdir()
    base = ["check", "--corpus", str(tmp_path / "c"), "--regels", str(tmp_path / "r.yaml"), "--uit", str(tmp_path / "uit")]
    assert cli.main(base) == 0 and cli.main([*base, "--strict"]) == 1
    assert "<mark>ID-kaart</mark>" in (tmp_path / "uit" / "report.html").read_text()
    assert cli.main(["check", "--corpus", str(tmp_path / "c"), "--regels", str(tmp_path / "no.yaml"), "--uit", "x"]) == 2
    (tmp_path / "f.yaml").write_text("families: [{id: f, pad_prefix: /, detectoren: [table_values, steps, notation]}]")
    pages = [{"url": f"u{i}", "familie": "f", "familie_sleutel": str(i), "titel": "t", "tabellen": [{"index": 0, "rijen": [{"label": "a", "waarde_rauw": "€ 1,00" if i else "€ 2,00"}]}]} for i in range(6)]
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "f.jsonl").write_text("\n".join(map(json.dumps, pages)))
    run = ["controleer", "--rules", str(tmp_path / "f.yaml"), "--snapshot", str(tmp_path / "snap"), "--naar", str(tmp_path / "out")]
    assert cli.main([*run, "--familie", "nope"]) == 1
    assert cli.main([*run, "--familie", "f"]) == 0
    more = ["--rules", str(tmp_path / "f.yaml"), "--van", str(tmp_path / "out"), "--naar"]
    assert cli.main(["rapport", *more, str(tmp_path / "r.html")]) == 0
    assert "€ 2,00" in (tmp_path / "r.html").read_text()
    assert cli.main(["publiceer", *more, str(tmp_path / "panels")]) == 0
    assert cli.main(["rapport", "--rules", str(tmp_path / "f.yaml"), "--van", str(tmp_path / "nothing"), "--naar", "x"]) == 1


def test_pages_of_one_finding_are_dealt_over_tasks(spark, tmp_path):
    """As many pages as values, less one: every page shows all values, and no single task hashes them."""
    urls, values = [f"page {i}" for i in range(2000)], [f"value {i}" for i in range(1999)]
    line = {"regel_id": "r", "urls": urls, "waargenomen": " | ".join(f"land {i}: {v}" for i, v in enumerate(values)), "vingerafdruk": "all"}
    own = {"regel_id": "r", "urls": ["a", "b"], "waargenomen": "x: 1 | y: 2", "vingerafdruk": "own"}
    empty = {"regel_id": "r", "urls": ["c"], "waargenomen": None, "vingerafdruk": "empty"}
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, (line, own, empty))))
    found = io.read_findings_json(spark, str(tmp_path / "f.json")).withColumn("task", F.spark_partition_id()).collect()
    whole = [r for r in found if r["finding_id"] == "all"]
    assert len({r["task"] for r in whole}) > 1
    digest = lambda *x: hashlib.sha1("|~|".join(x).encode()).hexdigest()
    assert {r["url"]: r["evidence_hash"] for r in whole} == {u: digest(u, *values) for u in urls}
    assert {r["variant"] for r in whole} == {"land 0"} and all(r["values"] == values for r in whole[:3])
    rest = sorted((r["url"], r["variant"], r["values"], r["evidence_hash"]) for r in found if r["finding_id"] != "all")
    assert rest == [("a", "x", ["1"], digest("a", "1")), ("b", "y", ["2"], digest("b", "2")), ("c", "c", [], digest("c"))]
