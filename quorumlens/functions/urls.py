"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(url: Column) -> Column:
    """Everything from the first slash after the host on, the query included; '/' if there is none."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.coalesce(F.nullif(F.regexp_extract(rest, r"^[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))


def domain_of(url: Column) -> Column:
    """Host and port."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def clean_path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.trim(path), "^/+|/+$", ""))


def variant_key(url: Column, prefix: str = "") -> Column:
    """The last path segment without a prefix."""
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    if not prefix:
        return last
    return F.when(last.startswith(prefix), F.substring(last, F.lit(len(prefix) + 1), F.length(last))).otherwise(last)


def path_prefix(url: Column, depth: int) -> Column:
    """The first ``depth`` segments of the path; '/' for the root."""
    parts = F.filter(F.split(F.regexp_extract(path_of(url), r"^([^?#]*)", 1), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"))


def in_scope(path: Column, allowed: Column) -> Column:
    """Whether a path is one of ``allowed`` (an array) or below it; none or '/' allows all."""
    hit = F.exists(allowed, lambda p: (path == p) | (p == "/") | path.startswith(F.concat(p, F.lit("/"))))
    return (F.size(allowed) == 0) | hit
