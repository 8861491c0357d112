"""Commands: check siblings, check terms, explore paths, crawl, report, publish, invariants.

Exit codes: 0 fine, 1 nothing to work on (or findings, with --strict; or a failed invariant), 2 bad input.
"""

from __future__ import annotations

import argparse
import datetime
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detectors, findings, terms, urls
from .sources import collect, html, io, report, rules, web
from .sources.shared import checkpoint


def session() -> SparkSession:
    return SparkSession.builder.appName("quorumlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def now() -> str:
    """The time of fetching, in UTC, to the second."""
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def check(spark: SparkSession, families: Sequence[rules.Family], tables: dict[str, DataFrame], claims: Sequence = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, finding pages, warnings) of families: their detectors in their order, capped each."""
    table = spark.createDataFrame([(f.id, f.min_members, float(f.min_share), list(f.detectors)) for f in families], "family string, min_members int, min_share double, detectors array<string>")
    more = {"claims": lambda own, min_members, min_share: detectors.claims(own, list(claims), min_members, min_share)}
    return findings.check_families(table, tables, more)


def _controleer(spark: SparkSession, a: argparse.Namespace, transport: web.Transport = web.over_http) -> int:
    listed = rules.load_families(a.rules)
    family = next((f for f in listed if f.id == a.familie), None)
    if family is None:
        print(f"unknown family: {a.familie}", file=sys.stderr)
        return 1
    problems: list[str] = []
    if a.snapshot:
        pages = io.read_snapshot(spark, a.snapshot).where(F.col("familie") == family.id)
        if a.limiet:
            pages = pages.orderBy("url").limit(a.limiet)
    else:
        pages, errors = collect.snapshot(spark, family, f"{a.naar}/cache", now(), a.limiet, transport)
        io.write_snapshot(pages, f"{a.naar}/snapshots", a.date)
        pages = io.read_snapshot(spark, f"{a.naar}/snapshots/dt={a.date}/family={family.id}")
        failed = errors.orderBy("url").limit(findings.CAP).collect()
        problems = [f"{r['url']}: {r['error']}" for r in failed]
        if len(failed) == findings.CAP:
            problems.append(f"{errors.count()} pages could not be read in all")
    seen = pages.agg(F.count("*").alias("n"), F.max("opgehaald_op").alias("at")).collect()[0]
    if not seen["n"]:
        print("the snapshot has no pages", file=sys.stderr)
        return 1
    kept, of, warnings = check(spark, [family], io.snapshot_tables(pages), rules.load_claims(a.claims) if a.claims else ())
    io.write_findings(kept.withColumn("family", F.lit(family.id)), f"{a.naar}/findings", a.date)
    io.write_findings(of.withColumn("family", F.lit(family.id)), f"{a.naar}/pages", a.date)
    told = [f"{w['rule']}: {w['found']} findings, {findings.CAP} kept" for w in warnings.orderBy("place").collect()]
    io.write_run(spark, f"{a.naar}/runs", family.id, a.date, seen["n"], seen["at"], told + problems)
    print("\n".join(told + problems))
    return _write_report(spark, listed, a.naar, f"{a.naar}/report.html")


def _panels(spark: SparkSession, families: Sequence[rules.Family], folder: str) -> DataFrame:
    """The panels of the families that have a run, with what was decided about their pages (``dispositions`` in the folder)."""
    listed = spark.createDataFrame([(f.id, f.name, i) for i, f in enumerate(families)], "family string, name string, place int")
    runs = listed.join(io.latest(spark, f"{folder}/runs").select("family", "dt", "pages", "warnings"), "family")
    dated = lambda name: spark.read.option("partitionColumnTypeInference.enabled", "false").parquet(f"{folder}/{name}").withColumn("dt", F.col("dt").cast("string"))
    return report.panels(dated("findings").drop("place"), runs, dated("pages"), io.read_dispositions(spark, f"{folder}/dispositions"))


def _write_report(spark: SparkSession, families: Sequence[rules.Family], folder: str, path: str) -> int:
    panels = _panels(spark, families, folder).orderBy("place").collect()  # a bounded panel for each family of the rules
    with open(path, "w", encoding="utf-8") as f:
        f.write(report.families_report([(r["family"], r["name"], r["html"]) for r in panels]))
    return 0 if panels else 1


def _rapport(spark: SparkSession, a: argparse.Namespace) -> int:
    if not io.exists(spark, f"{a.van}/runs"):
        print("no family has been checked yet", file=sys.stderr)
        return 1
    return _write_report(spark, rules.load_families(a.rules), a.van, a.naar)


def _publiceer(spark: SparkSession, a: argparse.Namespace) -> int:
    if not io.exists(spark, f"{a.van}/runs"):
        print("no family has been checked yet", file=sys.stderr)
        return 1
    panels = checkpoint(_panels(spark, rules.load_families(a.rules), a.van))
    if panels.isEmpty():
        print("no family has been checked yet", file=sys.stderr)
        return 1
    io.publish_panels(panels, a.naar)
    return 0


def _invarianten(spark: SparkSession, a: argparse.Namespace, transport: web.Transport = web.over_http) -> int:
    family = next((f for f in rules.load_families(a.rules) if f.id == a.familie), None)
    if family is None:
        print(f"unknown family: {a.familie}", file=sys.stderr)
        return 1
    read = lambda rows: urls.strict_locations(web.fetch(rows, transport, 0).where("html is not null").select(F.col("url").alias("sitemap_url"), F.col("html").alias("xml")))
    index = read(spark.createDataFrame([(a.index,)], "url string")).where("is_index").select(F.col("loc").alias("url"))
    pages = read(spark.createDataFrame([(family.sitemap,)], "url string")).where("NOT is_index").select(F.col("loc").alias("url"))
    members = urls.family(pages, family.prefix, family.strip)
    sample = web.fetch(urls.systematic_sample(members, "url", urls.SAMPLE), transport, 0)
    parsed = html.parse(sample.where("html is not null").withColumn("family", F.lit(family.id)))
    tables = F.size(F.array_distinct(F.concat(F.transform("rows", lambda r: r["table_idx"]), F.transform("columns", lambda c: c["table_idx"]))))
    bad = [r["url"] for r in parsed.where("error is not null").collect()] + [r["url"] for r in sample.where("html is null").collect()]
    rows = urls.health(index, pages, members, parsed.where("error is null").select("url", tables.alias("tables"), F.size("rows").alias("rows"))).collect()
    for r in rows:
        print(f"{r['figure']}: {r['value']:g}" + ("" if r["ok"] else f", at least {r['floor']:g} expected"))
    print("\n".join(f"{u}: cannot be read" for u in bad))
    return 0 if all(r["ok"] for r in rows) and not bad else 1


def _verken(spark: SparkSession, a: argparse.Namespace, transport: web.Transport = web.over_http) -> int:
    sites, _ = rules.load_sites(a.sites)
    pages = collect.site_urls(spark, [s.base_url for s in sites], transport, cache=a.cache).persist()
    some = False
    for s in sites:
        for r in urls.path_stats(pages.where(F.col("base_url") == s.base_url), a.diepte).orderBy(F.desc("n"), "prefix").limit(a.top).collect():
            some = True
            print(f"{s.id} {r['n']:>8} {r['prefix']}")
    pages.unpersist()
    return 0 if some else 1


def _crawl(spark: SparkSession, a: argparse.Namespace, transport: web.Transport = web.over_http) -> int:
    sites, most = rules.load_sites(a.sites)
    if not a.hele_site and any(not s.paths for s in sites):
        print("a site has no paths; use --hele-site to take all of it", file=sys.stderr)
        return 2
    parts = [collect.corpus(spark, s, a.cache, now(), a.max_paginas or most, a.hele_site, transport) for s in sites]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    io.write_corpus(out, a.uit)
    return 1 if io.read_corpus(spark, a.uit).isEmpty() else 0


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    listed = rules.load_terms(a.regels)
    pages = io.read_corpus(spark, a.corpus)
    if pages.isEmpty():
        return 1
    scope = "; ".join(f"{s.id}: {', '.join(s.paths) or 'all'}" for s in rules.load_sites(a.sites)[0]) if a.sites else ""
    found = terms.hits(pages, listed, text="tekst", language="taal").persist()
    io.export_json(found, f"{a.uit}/findings", "rule_id", "url", "position")
    with open(f"{a.uit}/report.html", "w", encoding="utf-8") as f:
        f.write(report.terms_report(found, pages, scope))
    rows = terms.summary(found).collect()  # a row for each rule at most
    for r in rows:
        print(f"{r['rule_id']}: {r['hits']} hits on {r['pages']} pages")
    found.unpersist()
    return 1 if rows and a.strict else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quorumlens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    today = datetime.date.today().isoformat()

    def add(name, run, *options, **more):
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(o, required=True)
        for o, kw in more.items():
            s.add_argument(f"--{o.replace('_', '-')}", **kw)
        s.add_argument("--date", default=today)
        s.set_defaults(run=run)

    add("controleer", _controleer, "--familie", "--rules", "--naar", snapshot={}, claims={}, limiet={"type": int})
    add("rapport", _rapport, "--rules", "--van", "--naar")
    add("publiceer", _publiceer, "--rules", "--van", "--naar")
    add("invarianten", _invarianten, "--rules", "--familie", "--index")
    add("verken", _verken, "--sites", cache={}, diepte={"type": int, "default": 2}, top={"type": int, "default": 25})
    add("crawl", _crawl, "--sites", "--uit", "--cache", max_paginas={"type": int}, hele_site={"action": "store_true"})
    add("check", _check, "--corpus", "--regels", "--uit", sites={}, strict={"action": "store_true"})
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(session(), a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
