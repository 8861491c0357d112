"""Fetching pages inside Spark tasks: one host per task at a time, robots rules, a pause, retries.

The transport is a parameter (a function from URL and headers to status, headers and body),
so tests and offline runs use their own; the default is the standard library's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .shared import checkpoint

AGENT = "quorumlens"
PAUSE = 1.0
TRIES = 4
RETRIED = frozenset((429, 500, 502, 503, 504))

Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], str]]


def over_http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT, **headers}), timeout=30) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return e.code, dict(e.headers or {}), ""


def robots(host: str, transport: Transport) -> RobotFileParser:
    """A host's rules; if they cannot be read nothing is forbidden."""
    rules = RobotFileParser()
    try:
        status, _, body = transport(f"{host}/robots.txt", {})
        rules.parse(body.splitlines() if status == 200 else [])
    except (OSError, URLError):
        rules.parse([])
    return rules


def get(url: str, transport: Transport, etag: str | None = None, modified: str | None = None, tries: int = TRIES, pause: float = PAUSE) -> tuple[int, dict[str, str], str | None]:
    """(status, headers, body): 304 keeps what is known, 429 and 5xx are tried again, other errors give no body."""
    headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
    status, found = 0, {}
    for i in range(tries):
        try:
            status, found, body = transport(url, headers)
        except (OSError, URLError):
            status, found, body = 0, {}, ""
        if 200 <= status < 300:
            return status, found, body
        if status and status not in RETRIED:
            return status, found, None
        if i + 1 < tries:
            wait = found.get("Retry-After", "")
            time.sleep(float(wait) if wait.isdigit() else pause * 2**i)
    return status, found, None


def fetch(urls: DataFrame, transport: Transport = over_http, pause: float = PAUSE) -> DataFrame:
    """(url, status, html, etag, modified, error) of (url, etag, modified), each host in one partition.

    Rows that robots rules forbid, or that fail, come back with ``error``; none is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, RobotFileParser] = {}
        for b in batches:
            out = []
            for url, etag, modified in zip(b["url"], b["etag"], b["modified"], strict=True):
                parts = urlsplit(url)
                host = f"{parts.scheme}://{parts.netloc}"
                if host not in known:
                    known[host] = robots(host, transport)
                if not known[host].can_fetch(AGENT, url):
                    out.append((url, None, None, etag, modified, "forbidden by robots.txt"))
                    continue
                status, headers, body = get(url, transport, etag, modified, pause=pause)
                out.append((url, status, body, headers.get("ETag", etag), headers.get("Last-Modified", modified), None if body is not None or status == 304 else f"status {status}"))
                time.sleep(pause)
            yield pd.DataFrame(out, columns=["url", "status", "html", "etag", "modified", "error"])

    rows = urls.select("url", *[F.col(c).cast("string") if c in urls.columns else F.lit(None).cast("string").alias(c) for c in ("etag", "modified")])
    by_host = rows.repartition(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return by_host.mapInPandas(run, "url string, status int, html string, etag string, modified string, error string")


CACHE = "url string, html string, etag string, modified string"


def fetch_cached(urls: DataFrame, folder: str, transport: Transport = over_http, pause: float = PAUSE, revalidate: bool = True) -> DataFrame:
    """(url, status, html, error) of distinct URLs through a table of earlier answers under ``folder``.

    With ``revalidate`` known pages are asked for again with their tags, and an answer of 304 or a
    failure gives what is known; without it known pages are not asked for at all. Only the table's
    buckets of these URLs are read, and only those with new answers are written.
    """
    wanted = checkpoint(urls.select("url").distinct())
    known = buckets.read(urls.sparkSession, folder, CACHE, buckets.touched(wanted, ["url"]))
    rows = wanted.join(known, "url", "left")
    asked = rows if revalidate else rows.where("html is null")
    got = checkpoint(fetch(asked.select("url", "etag", "modified"), transport, pause))
    old = rows.select("url", F.col("html").alias("old"))
    out = checkpoint(old.join(got, "url", "left").select("url", "status", F.coalesce("html", "old").alias("html"), F.when(F.coalesce("html", "old").isNull(), F.coalesce("error", F.lit("no body"))).alias("error")))
    buckets.upsert(got.where("html is not null").select("url", "html", "etag", "modified"), folder, ["url"])
    return out


def permitted(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """URLs that their host's robots.txt (host to text; hosts without one forbid nothing) lets us fetch."""

    @F.pandas_udf("boolean")
    def allowed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, RobotFileParser] = {}
        for url in batches:
            out = []
            for u in url:
                host = urlsplit(u).netloc
                if host not in known and host in rules:
                    known[host] = RobotFileParser()
                    known[host].parse(rules[host].splitlines())
                out.append(host not in known or known[host].can_fetch(AGENT, u))
            yield pd.Series(out, dtype=bool)

    return urls.where(allowed("url"))
