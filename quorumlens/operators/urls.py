"""Operators over URL tables: scopes, prefixes, statistics, samples, sitemaps, source health."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.shared import checkpoint


def scoped(pages: DataFrame, paths: Sequence[str], url: str = "url") -> DataFrame:
    """Rows whose path is one of ``paths`` or below it, segment by segment; none or '/' means all."""
    allowed = [p if p.startswith("/") else f"/{p}" for p in ("/" + x.strip("/") for x in paths)]
    path = F.regexp_extract(U.path_of(F.col(url)), r"^([^?#]*)", 1)
    return pages.where(U.in_scope(path, F.array(*[F.lit(p) for p in allowed]) if allowed else F.array().cast("array<string>")))


def family(pages: DataFrame, prefix: str, strip: str = "", url: str = "url") -> DataFrame:
    """(url, variant): distinct URLs whose path starts with ``prefix``; a closing '/' makes it a folder."""
    return pages.where(U.path_of(F.col(url)).startswith(prefix)).select(F.col(url).alias("url"), U.variant_key(F.col(url), strip).alias("variant")).distinct()


def path_stats(pages: DataFrame, depth: int = 2, url: str = "url") -> DataFrame:
    """(prefix, n) of the first path segments; callers order it by falling n, then prefix."""
    return pages.where(F.col(url).isNotNull()).groupBy(U.path_prefix(F.col(url), depth).alias("prefix")).agg(F.count("*").alias("n"))


def ordered_distinct(rows: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(*([key] if isinstance(key, str) else key)).agg(F.min(order).alias(order))


def systematic_sample(rows: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Every (n // size)-th row by ``order``, ``size`` rows at most.

    Only the sort key is sorted, over range partitions; a row's place is its place in its
    partition plus the sizes of the partitions before, a list as long as the partitions.
    """
    keys = checkpoint(rows.select(order).orderBy(order).select(order, F.monotonically_increasing_id().alias("__m")))
    part = F.shiftright("__m", 33)
    sizes = keys.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).orderBy("__p").collect()
    n = sum(r["n"] for r in sizes)
    if not n:
        return rows.limit(0)
    stride, before, starts = max(1, n // size), 0, []
    for r in sizes:
        starts.append((r["__p"], before))
        before += r["n"]
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "__p long, __start long"))
    place = F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    picked = keys.withColumn("__p", part).join(start, "__p").where((place % stride == 0) & (place < stride * size)).select(order)
    return rows.join(picked.distinct(), order, "left_semi")


def invariants(pages: DataFrame, limits: dict[str, float], url: str = "url", html: str = "html") -> DataFrame:
    """One row: health figures of a source and whether each reaches its floor."""
    figures = pages.agg(
        F.countDistinct(url).alias("urls"), F.countDistinct(U.domain_of(F.col(url))).alias("hosts"),
        F.count_if(F.col(html).rlike("(?i)<p[ >]")).alias("with_text"), F.count("*").alias("pages"))
    checks = [(F.col(k) >= F.lit(v)).alias(f"{k}_ok") for k, v in limits.items()]
    return figures.select("urls", "hosts", "with_text", "pages", *checks)


# The floors of a healthy source, and the size of the sample.
HEALTH = {"sub_sitemaps": 3.0, "urls": 4000.0, "family_urls": 200.0, "with_tables": 0.3, "rows": 60.0}
SAMPLE = 10


def health(sub_sitemaps: DataFrame, urls: DataFrame, members: DataFrame, sample: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """(figure, value, floor, ok) of a source: sub-sitemaps, URLs, URLs of a family, and of its sample the share with tables and the rows.

    ``sample`` is (url, tables, rows) with the number of tables and rows of each sampled page.
    """
    floors = HEALTH | (floors or {})
    count = lambda rows, name: rows.select(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("figure"), "value")
    seen = sample.agg(F.coalesce(F.avg((F.col("tables") > 0).cast("double")), F.lit(0.0)).alias("with_tables"), F.coalesce(F.sum("rows"), F.lit(0)).cast("double").alias("rows"))
    both = seen.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in ("with_tables", "rows")])).alias("x")).select("x.*")
    rows = count(sub_sitemaps, "sub_sitemaps").unionByName(count(urls, "urls")).unionByName(count(members, "family_urls")).unionByName(both)
    floor = F.create_map(*[F.lit(x) for k, v in floors.items() for x in (k, float(v))])[F.col("figure")]
    return rows.select("figure", "value", floor.alias("floor"), (F.col("value") >= floor).alias("ok"))


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, is_index, loc) of every location in (sitemap_url, xml); lenient about namespaces and blanks."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return sitemaps.select("sitemap_url", F.col("xml").rlike("(?i)<sitemapindex").alias("is_index"), F.explode(locs).alias("loc")).where(F.trim("loc") != "")


def strict_locations(sitemaps: DataFrame) -> DataFrame:
    """Like ``sitemap_locations`` by an XML parser: only <loc> of <url> and <sitemap>; broken XML is an error."""
    locs = lambda parent: F.xpath("xml", F.lit(f"//*[local-name()='{parent}']/*[local-name()='loc']/text()"))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    both = F.concat(F.transform(locs("sitemap"), lambda x: F.struct(F.lit(True).alias("is_index"), bare(x).alias("loc"))), F.transform(locs("url"), lambda x: F.struct(F.lit(False).alias("is_index"), bare(x).alias("loc"))))
    return sitemaps.select("sitemap_url", F.explode(both).alias("x")).select("sitemap_url", "x.*").where("loc <> ''")


def expand(start: DataFrame, locations: Callable[[DataFrame], DataFrame], depth: int = 3) -> DataFrame:
    """(start, url): pages reachable from each sitemap of ``start`` (sitemap_url) through at most ``depth`` levels of indexes.

    ``locations`` gives (sitemap_url, is_index, loc) of a frame of sitemap_url; it is asked once for
    each level, for sitemaps not met before, and each level is kept by a checkpoint.
    """
    level = start.select(F.col("sitemap_url").alias("start"), "sitemap_url").distinct()
    seen, pages = level, None
    for _ in range(depth + 1):
        found = checkpoint(level.join(locations(level.select("sitemap_url").distinct()), "sitemap_url"))
        here = found.where(~F.col("is_index")).select("start", F.col("loc").alias("url"))
        pages = here if pages is None else pages.unionByName(here)
        level = found.where("is_index").select("start", F.col("loc").alias("sitemap_url")).distinct().join(seen, ["start", "sitemap_url"], "left_anti")
        seen = seen.unionByName(level)
        if level.isEmpty():
            break
    return pages.distinct()


def expand_sitemaps(sitemaps: DataFrame, start: Sequence[str], depth: int = 3) -> DataFrame:
    """(url): ``expand`` over stored sitemaps (sitemap_url, xml)."""
    edges = sitemap_locations(sitemaps)
    first = sitemaps.sparkSession.createDataFrame([(u,) for u in start], "sitemap_url string")
    return expand(first, lambda level: edges.join(level, "sitemap_url", "left_semi"), depth).select("url").distinct()


def candidates(sites: DataFrame) -> DataFrame:
    """(base_url, sitemap_url, rank) of (base_url, robots): its Sitemap lines in order, then the two usual places."""
    named = F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    usual = F.array(*[F.concat(F.regexp_extract("base_url", "^([A-Za-z]+://[^/]+)", 1), F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")])
    rows = sites.select("base_url", F.posexplode(F.concat(named, usual)).alias("rank", "sitemap_url"))
    return ordered_distinct(rows, ["base_url", "sitemap_url"], "rank")


def first_candidate(urls: DataFrame, *by: str) -> DataFrame:
    """Of (by..., rank, url) the URLs of the best-ranked candidate that has any, for each ``by``."""
    best = urls.groupBy(*by).agg(F.min("rank").alias("rank"))
    return urls.join(best, [*by, "rank"], "left_semi").select(*by, "url").distinct()
