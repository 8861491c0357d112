"""Findings: one row per deviation, one row per page of it, identity, owner, cap and report order.

A finding row holds counts and at most three examples; its pages are rows of their own, so a
finding that a template change spreads over every page stays a distributed table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import canonical_location, evidence_hash, joined_hash

CAP = 50
EXAMPLES = 3

# Kinds, who owns them, and the order of owners and categories in a report.
KIND_CONTENT, KIND_STYLE, KIND_STRUCTURE, KIND_TERM = "inhoudelijk", "schrijfrichtlijn", "structuur", "terminologie"
OWNERS = {"schrijfrichtlijn": "webredactie", "structuur": "beoordelen"}
OWNER_ELSE = "kenniseigenaar"
OWNER_ORDER = ["kenniseigenaar", "webredactie", "beoordelen"]
CERTAIN, LIKELY = "hoog", "middel"
# The categories of a report by detector, and their order in it.
CATEGORIES = {
    "table_values": "Bedragen die afwijken van andere landen",
    "notation": "Bedragen in een afwijkende notatie",
    "steps": "Opbouw van het stappenplan",
    "toggles": "Ontbrekende of afwijkende uitklapparagrafen",
    "headings": "Koppenstructuur",
    "sentences": "Afwijkingen van standaardteksten",
    "claims": "Inhoudelijk mogelijk tegenstrijdig",
}
CATEGORY_ORDER = [CATEGORIES[d] for d in ("steps", "toggles", "headings", "sentences", "claims")]


def owner(kind: Column) -> Column:
    out = F.lit(OWNER_ELSE)
    for k, who in OWNERS.items():
        out = F.when(kind == k, who).otherwise(out)
    return out


def certainty(deviating: Column) -> Column:
    return F.when(deviating == 1, CERTAIN).otherwise(LIKELY)


def assemble(pages: DataFrame, rule: str, kind: str | None, location: Sequence[str], category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and their pages from deviations (location..., url, value, norm, n, agree).

    The fingerprint covers rule and location only, the evidence hash what was observed. With no
    ``kind`` each row's own is taken. ``siblings`` of the rows are kept as proof; several
    deviations of a page are one text.
    """
    none = F.array().cast("array<struct<url: string, value: string>>")
    pages = pages.withColumn("kind", F.col("kind") if kind is None else F.lit(kind)).withColumn("siblings", F.col("siblings") if "siblings" in pages.columns else none)
    place = canonical_location(**{c: F.col(c).cast("string") for c in location})
    pages = pages.withColumn("finding_id", joined_hash(F.lit(rule), place))
    first = F.array_sort(F.collect_list(F.struct("url", "value")))
    top = pages.select("finding_id", "url", "value").distinct().withColumn("__rank", F.row_number().over(Window.partitionBy("finding_id").orderBy("url", "value"))).where(F.col("__rank") <= EXAMPLES)
    top = top.groupBy("finding_id").agg(first.alias("examples"))
    counts = pages.groupBy("finding_id", *location).agg(
        F.min("kind").alias("kind"), F.min("norm").alias("norm"), F.max("n").alias("n"), F.max("agree").alias("agree"), F.countDistinct("url").alias("deviating"), F.max("siblings").alias("siblings"))
    findings = counts.join(top, "finding_id").select(
        "finding_id", F.lit(rule).alias("rule"), "kind", owner(F.col("kind")).alias("owner"), F.lit(category or CATEGORIES.get(rule, rule)).alias("category"),
        place.alias("location"), "examples", "siblings", "norm", "n", "agree", "deviating", (F.lit(CERTAIN) if rule == "notation" else certainty(F.col("deviating"))).alias("certainty"))
    texts = pages.groupBy("finding_id", "url").agg(F.array_join(F.array_sort(F.collect_set("value")), "; ").alias("value"))
    return findings, texts.select("finding_id", "url", "value", evidence_hash(F.col("url"), F.col("value")).alias("evidence_hash"))


def paired(urls: Column, variants: Column) -> Column:
    """array<struct<url, values>>: each URL with its variant where there are as many, or else with all of them."""
    alone = F.zip_with(urls, variants, lambda u, v: F.struct(u.alias("url"), F.array(v).alias("values")))
    return F.when(F.size(urls) == F.size(variants), alone).otherwise(F.transform(urls, lambda u: F.struct(u.alias("url"), variants.alias("values"))))


def cap(findings: DataFrame, detector: str | Sequence[str] = "rule", order: Sequence[str] = ("finding_id",), most: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` findings of each detector, and a warning (detector, found) where there were more."""
    by = [detector] if isinstance(detector, str) else list(detector)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = findings.withColumn("__rn", rn).where(F.col("__rn") <= most).drop("__rn")
    return kept, findings.groupBy(*by).agg(F.count("*").alias("found")).where(F.col("found") > most)


class Registry:
    """Detectors by name: functions from the normalised tables and thresholds to deviations."""

    def __init__(self) -> None:
        self.detectors: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str):
        def add(f):
            self.detectors[name] = f
            return f

        return add

    def run(self, names: Sequence[str], tables: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
        """Each named detector's result, in the order asked for; an unknown name is a KeyError."""
        unknown = [n for n in names if n not in self.detectors]
        if unknown:
            raise KeyError(f"unknown detectors: {', '.join(unknown)}")
        return {n: self.detectors[n](tables, **options) for n in names}


registry = Registry()


def check_families(families: DataFrame, tables: dict[str, DataFrame], more: dict[str, Callable[..., DataFrame]] | None = None, most: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, their pages, warnings) of all families at once.

    ``families`` is a table (family, min_members, min_share, detectors): each family's thresholds and
    its detectors in their order. A detector runs once, over the pages of all families that want it, so the plan
    does not grow with their number. ``more`` has detectors beside those registered. Findings
    carry ``family`` and ``place`` (the detector's number in its family); at most ``most`` of a family and
    detector are kept, by location, and a warning (family, rule, place, found) tells where there were more.
    """
    wanted = families.select("family", "min_members", "min_share", F.posexplode("detectors").alias("place", "rule"))
    known = registry.detectors | (more or {})
    names = [r["rule"] for r in wanted.groupBy("rule").agg(F.min("place").alias("p")).orderBy("p", "rule").limit(len(known) + 1).collect()]
    if unknown := [n for n in names if n not in known]:
        raise KeyError(f"unknown detectors: {', '.join(unknown)}")
    found, pages = None, None
    for name in names:
        mine = wanted.where(F.col("rule") == name).drop("rule", "place")
        own = {t: rows.join(mine.select("family"), "family", "left_semi") for t, rows in tables.items()}
        rows = known[name](own, min_members=mine, min_share=0.0).withColumn("value", F.coalesce("value", F.lit("")))
        some, of = assemble(rows, name, None, ["family", "detector", "place"])
        some = some.withColumn("family", F.get_json_object("location", "$.family")).join(wanted.select("family", "rule", "place"), ["family", "rule"])
        found, pages = (some, of) if found is None else (found.unionByName(some), pages.unionByName(of))
    kept, over = cap(found, ["family", "rule", "place"], ["location", "finding_id"], most)
    return kept, pages.join(kept.select("finding_id"), "finding_id", "left_semi"), over


def report_groups(findings: DataFrame, categories: Sequence[str] = tuple(CATEGORY_ORDER)) -> DataFrame:
    """(owner, category, findings, owner_rank, category_rank) in report order; unlisted categories come last, by name."""
    rank = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), c), F.lit(0)), F.lit(99)) if names else F.lit(99)
    return findings.groupBy("owner", "category").agg(F.count("*").alias("findings")).select(
        "owner", "category", "findings", rank(F.col("owner"), OWNER_ORDER).cast("int").alias("owner_rank"), rank(F.col("category"), list(categories)).cast("int").alias("category_rank"))
