"""From a site to stored pages: sitemaps, scope, robots rules, fetching, parsing.

Everything that fetches takes the transport as a parameter, so it runs without a network too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import urls
from . import html, web
from .rules import Family, Site


def site_urls(spark: SparkSession, sites: list[str], transport: web.Transport = web.over_http, pause: float = web.PAUSE, cache: str | None = None) -> DataFrame:
    """(base_url, url) of sites by the first of their candidate sitemaps that gives any URL; sitemaps come through a ``cache`` if there is one."""
    base = spark.createDataFrame([(s,) for s in sites], "base_url string")
    read = lambda rows: web.fetch_cached(rows, cache, transport, pause) if cache else web.fetch(rows, transport, pause)
    robots = read(base.select(F.concat(F.regexp_extract("base_url", "^([A-Za-z]+://[^/]+)", 1), F.lit("/robots.txt")).alias("url")).distinct())
    robots = robots.select(F.regexp_extract("url", "^([A-Za-z]+://[^/]+)", 1).alias("host"), F.col("html").alias("robots"))
    tried = urls.candidates(base.withColumn("host", F.regexp_extract("base_url", "^([A-Za-z]+://[^/]+)", 1)).join(robots, "host", "left"))
    pages = urls.expand(tried.select("sitemap_url"), lambda level: urls.sitemap_locations(read(level.select(F.col("sitemap_url").alias("url"))).where("html is not null").select(F.col("url").alias("sitemap_url"), F.col("html").alias("xml"))))
    return urls.first_candidate(tried.join(pages.withColumnRenamed("start", "sitemap_url"), "sitemap_url"), "base_url")


def family_urls(spark: SparkSession, family: Family, transport: web.Transport = web.over_http, pause: float = web.PAUSE) -> DataFrame:
    """(url, variant) of a family: the pages of its sitemap under its prefix."""
    start = spark.createDataFrame([(family.sitemap,)], "sitemap_url string")
    found = urls.expand(start, lambda level: urls.strict_locations(web.fetch(level.select(F.col("sitemap_url").alias("url")), transport, pause).where("html is not null").select(F.col("url").alias("sitemap_url"), F.col("html").alias("xml"))))
    return urls.family(found, family.prefix, family.strip)


def snapshot(spark: SparkSession, family: Family, cache: str, fetched: str, limit: int | None = None, transport: web.Transport = web.over_http, pause: float = web.PAUSE) -> tuple[DataFrame, DataFrame]:
    """(pages in the stored fields, (url, error) of pages that could not be fetched or read) of a family."""
    wanted = family_urls(spark, family, transport, pause).select("url")
    if limit:
        wanted = wanted.orderBy("url").limit(limit)
    got = web.fetch_cached(wanted, cache, transport, pause, revalidate=False)
    parsed = html.parse(got.where("error is null").withColumn("family", F.lit(family.id)))
    pages = html.snapshot_pages(parsed, family.source, family.language, fetched, F.lit(200), family.strip)
    errors = got.where("error is not null").select("url", "error").unionByName(parsed.where("error is not null").select("url", "error"))
    return pages, errors


def corpus(spark: SparkSession, site: Site, cache: str, fetched: str, most: int, whole: bool = False, transport: web.Transport = web.over_http, pause: float = web.PAUSE) -> DataFrame:
    """Pages of a site's scope as a term corpus: at most ``most``, by URL, after all filters."""
    wanted = urls.scoped(site_urls(spark, [site.base_url], transport, pause), [] if whole else site.paths)
    host = site.base_url.split("//", 1)[-1].split("/")[0]
    robots = web.fetch(spark.createDataFrame([(f"{site.base_url.split('//', 1)[0]}//{host}/robots.txt",)], "url string"), transport, pause).collect()
    allowed = web.permitted(wanted, {host: r["html"] for r in robots if r["html"]})
    got = web.fetch_cached(allowed.orderBy("url").limit(most), cache, transport, pause).where("html is not null")
    plain = html.plain_pages(got)
    return plain.select("url", F.lit(site.language).alias("taal"), F.lit(site.id).alias("site"), F.col("title").alias("titel"), F.col("text").alias("tekst"), F.lit(fetched).alias("opgehaald_op"), "content_hash")
