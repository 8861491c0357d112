"""Self-contained HTML reports.

Detectors keep at most ``findings.CAP`` findings each, so a family's panel has a bound; where a
report shows fewer rows than there are it says how many are left out. Tasks write the panels;
counters go over all pages of a finding, not over those that are listed.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import counted, escape_html, marked
from ..operators.disposition import finding_states, page_states
from ..operators.findings import CATEGORY_ORDER, OWNER_ORDER
from ..operators.terms import summary

#: Pages of a finding, and fragments of a term report, that are shown.
PAGES, FRAGMENTS = 200, 500
STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto}mark{background:#fe8}table{border-collapse:collapse}td,th{padding:.2rem .6rem;text-align:left}"


def _page(title: str, body: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def _html(*parts: str | Column) -> Column:
    """Markup (strings) and what is shown in it (columns), escaped; nulls are shown as nothing."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(escape_html(x.cast("string")), F.lit("")) for x in parts])


def _shown(pages: DataFrame) -> DataFrame:
    """(finding_id, items): the list of the first ``PAGES`` pages of each finding, with evidence and state."""
    top = pages.withColumn("__n", F.row_number().over(Window.partitionBy("finding_id").orderBy("url", "value"))).where(F.col("__n") <= PAGES)
    item = _html('<li data-url="', F.col("url"), '" data-evidence="', F.col("evidence_hash"), '" data-state="', F.col("state"), '">', F.col("url"), ": ", F.col("value"), "</li>")
    return top.groupBy("finding_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", item.alias("i")))), lambda x: x["i"]), "").alias("items"), F.count("*").alias("listed"))


def fragments(findings: DataFrame, pages: DataFrame | None = None, dispositions: DataFrame | None = None) -> DataFrame:
    """(family, dt, place..., handled, html) of findings (family, dt, ...): each one's part of a report.

    ``pages`` (finding_id, dt, url, value, evidence_hash) are their pages, ``dispositions`` what was decided
    about these. Whether a finding is handled is counted over all of its pages, however few are listed.
    """
    rows = findings
    if pages is None:
        listed = F.array_join(F.transform("examples", lambda x: _html('<li data-url="', x["url"], '">', x["url"], ": ", x["value"], "</li>")), "")
        rows = rows.withColumns({"items": listed, "listed": F.size(F.array_distinct(F.transform("examples", lambda x: x["url"]))), "handled": F.lit(False)})
    else:
        of = pages.join(findings.select("finding_id", "dt"), ["finding_id", "dt"], "left_semi")
        states = page_states(of, dispositions, F.col("dt")) if dispositions is not None else of.select("finding_id", "url", F.lit("open").alias("state"), F.lit(False).alias("handled"))
        rows = rows.join(_shown(of.join(states, ["finding_id", "url"])), "finding_id", "left").join(finding_states(states).select("finding_id", "handled"), "finding_id", "left")
        rows = rows.na.fill(False, ["handled"]).na.fill(0, ["listed"])
    if "siblings" not in rows.columns:
        rows = rows.withColumn("siblings", F.array().cast("array<struct<url: string, value: string>>"))
    proof = F.array_join(F.transform(F.coalesce("siblings", F.array().cast(dict(rows.dtypes)["siblings"])), lambda x: _html("<li>", x["url"], ": ", x["value"], "</li>")), "")
    left = F.col("deviating") - F.col("listed")
    norm = F.when(F.coalesce("norm", F.lit("")) == "", "").otherwise(_html(" on ", F.col("norm")))
    html = F.concat(
        _html('<article data-id="', F.col("finding_id"), '" data-date="', F.col("dt"), '" data-handled="', F.col("handled"), '"><h4>', F.col("location"), "</h4><p>", F.col("agree"), " of ", F.col("n"), " agree"), norm,
        _html("; ", F.col("deviating"), " deviate.</p><ul>"), F.coalesce("items", F.lit("")), F.lit("</ul>"), F.when(left > 0, _html("<p>and ", left, " more pages</p>")).otherwise(""),
        F.when(proof == "", "").otherwise(F.concat(F.lit("<p>Elsewhere:</p><ul>"), proof, F.lit("</ul>"))), F.lit("</article>"))
    return rows.select("family", "dt", "owner", "category", "location", "finding_id", "handled", html.alias("html"))


def panels(findings: DataFrame, runs: DataFrame, pages: DataFrame | None = None, dispositions: DataFrame | None = None) -> DataFrame:
    """(family, name, dt, place, findings, html) of each run (family, name, dt, place, pages, warnings): its part of the report.

    Findings by owner and category, each carrying its id, evidence, states and date, are put
    together by tasks; a family has at most ``CAP`` findings of each detector.
    """
    parts = fragments(findings.join(runs.select("family", "dt"), ["family", "dt"], "left_semi"), pages, dispositions)
    rank = lambda c, order: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(c)), F.lit(0)), F.lit(99))
    order = [rank("owner", OWNER_ORDER).alias("o"), rank("category", CATEGORY_ORDER).alias("c"), F.col("category"), F.col("location"), F.col("finding_id")]
    head = F.concat_ws("|", "owner", "category")
    before = F.lag(head).over(Window.partitionBy("family", "dt").orderBy(*order))
    titled = parts.withColumn("html", F.concat(F.when(before.eqNullSafe(head), "").otherwise(_html("<h3>", F.col("owner"), ": ", F.col("category"), "</h3>")), "html"))
    whole = titled.groupBy("family", "dt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "html"))), lambda x: x["html"]), "").alias("body"), F.count("*").alias("findings"), F.count_if("handled").alias("done"))
    rows = runs.join(whole, ["family", "dt"], "left").na.fill(0, ["findings", "done"])
    told = F.array_join(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: _html("<p>", w, "</p>")), "")
    title = F.concat(_html("<h2>", F.coalesce("name", "family"), "</h2><p>", F.col("dt")), F.when(F.col("pages").isNull(), "").otherwise(_html(", ", F.col("pages"), " pages")), F.lit("</p>"), told)
    opened = _html('<section data-family="', F.col("family"), '" data-date="', F.col("dt"), '" data-todo="', F.col("findings") - F.col("done"), '" data-handled="', F.col("done"), '">')
    silent = F.lit("<p>Nothing deviates. That does not prove the pages right: this check found nothing.</p>")
    html = F.concat(opened, title, F.when(F.col("findings") == 0, silent).otherwise(F.col("body")), F.lit("</section>"))
    return rows.select("family", "name", "dt", "place", F.col("findings").cast("long").alias("findings"), html.alias("html"))


def panel(findings: DataFrame, family: str, date: str, name: str | None = None, pages: DataFrame | None = None, dispositions: DataFrame | None = None, run: dict | None = None) -> str:
    """One family's panel: its findings of one date; ``run`` has the number of pages looked at and the warnings."""
    run = run or {}
    row = [(family, name or family, date, 0, run.get("pages"), list(run.get("warnings") or []))]
    runs = findings.sparkSession.createDataFrame(row, "family string, name string, dt string, place int, pages long, warnings array<string>")
    dated = lambda rows: rows.withColumns({"family": F.lit(family), "dt": F.lit(date)})
    return panels(dated(findings), runs, None if pages is None else dated(pages), dispositions).collect()[0]["html"]


def families_report(panels: list[tuple[str, str, str]]) -> str:
    """A tab for each (id, name, panel); the bar of tabs only where there are several."""
    if not panels:
        return _page("Consistency", "<p>No family has been checked yet.</p>")
    bar = "" if len(panels) == 1 else "<nav>" + " ".join(f'<a href="#{escape(i)}">{escape(n)}</a>' for i, n, _ in panels) + "</nav>"
    return _page("Consistency", bar + "".join(f'<div id="{escape(i)}">{html}</div>' for i, _, html in panels))


def totals(pages: DataFrame, found: DataFrame, fetched: str = "opgehaald_op") -> DataFrame:
    """One row: pages looked at, newest fetch, reported hits, pages with a hit."""
    seen = pages.agg(F.countDistinct("url").alias("pages"), F.max(fetched).alias("fetched") if fetched in pages.columns else F.lit(None).cast("string").alias("fetched"))
    return seen.crossJoin(found.agg(F.count("*").alias("hits"), F.countDistinct("url").alias("with_hits")))  # one row each


def terms_report(found: DataFrame, pages: DataFrame, scope: str = "") -> str:
    """Totals, a row for each rule, and the reported fragments with the term marked."""
    sums = totals(pages, found).collect()[0]
    rules = summary(found).select("rule_id", "hits", counted(F.col("pages"), "page", "pages").alias("where")).collect()
    shown = found.orderBy("rule_id", "url", "position").select("rule_id", "url", marked(F.col("fragment"), F.col("term")).alias("html")).limit(FRAGMENTS).collect()
    table = "".join(f"<tr><td>{escape(r['rule_id'])}</td><td>{r['hits']}</td><td>{escape(r['where'])}</td></tr>" for r in rules)
    parts = "".join(f"<p><b>{escape(r['rule_id'])}</b> {escape(str(r['url']))}<br>{r['html']}</p>" for r in shown)
    left = f"<p>{sums['hits'] - len(shown)} more are in the findings file.</p>" if sums["hits"] > len(shown) else ""
    when = f" Fetched up to {escape(sums['fetched'])}." if sums["fetched"] else ""
    head = f"<p>{sums['pages']} pages, {sums['with_hits']} with a discouraged term.{when} {escape(scope)}</p>"
    return _page("Terms", f"{head}<table><tr><th>rule</th><th>hits</th><th>where</th></tr>{table}</table>{parts or '<p>No discouraged term occurs.</p>'}{left}")
