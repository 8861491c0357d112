"""Rule and configuration files (YAML), checked as they are loaded; any fault is a ValueError that names its place."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import yaml

from ..operators.terms import LANGUAGES, ClaimRule, TermRule

MAX_PAGES = 200


@dataclass(frozen=True)
class Site:
    id: str
    base_url: str
    language: str
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Family:
    id: str
    name: str
    prefix: str
    detectors: tuple[str, ...]
    source: str = ""
    language: str = ""
    sitemap: str = ""
    strip: str = ""
    min_members: int = 5
    min_share: float = 0.8
    intro: str = ""


def _load(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
    except FileNotFoundError:
        raise ValueError(f"{path}: no such file") from None
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is expected at the top")
    return found


def _entries(found: dict, key: str, path: str) -> Iterable[tuple[str, dict]]:
    rows = found.get(key) or []
    if not rows:
        raise ValueError(f"{path}: no {key}")
    seen = set()
    for i, row in enumerate(rows, 1):
        if not isinstance(row, dict):
            raise ValueError(f"{path}: entry {i} of {key} is no mapping")
        name = str(row.get("id") or "").strip()
        if not name:
            raise ValueError(f"{path}: entry {i} of {key} has no id")
        if name in seen:
            raise ValueError(f"{path}: id {name} occurs twice")
        seen.add(name)
        yield name, row


def _language(value: str, where: str) -> str:
    if value not in LANGUAGES:
        raise ValueError(f"{where}: unknown language {value!r}")
    return value


def load_terms(path: str) -> list[TermRule]:
    out = []
    for name, row in _entries(_load(path), "regels", path):
        where = f"{path}: rule {name}"
        if not str(row.get("voorkeur") or "").strip():
            raise ValueError(f"{where} has no preferred term")
        variants = tuple(str(v).strip() for v in row.get("varianten") or [] if str(v).strip())
        if not variants:
            raise ValueError(f"{where} has no variants")
        languages = tuple(_language(v, where) for v in row.get("talen") or LANGUAGES)
        out.append(TermRule(name, str(row["voorkeur"]), variants, languages, str(row.get("toelichting") or ""), bool(row.get("hele_woorden", True)), str(row.get("eigenaar") or "redactie")))
    return out


def load_sites(path: str) -> tuple[list[Site], int]:
    found = _load(path)
    out = []
    for name, row in _entries(found, "sites", path):
        where = f"{path}: site {name}"
        base = str(row.get("basis_url") or "")
        if not base.startswith("http"):
            raise ValueError(f"{where}: the base URL must start with http")
        out.append(Site(name, base.rstrip("/"), _language(str(row.get("taal") or ""), where), tuple(row.get("paden") or ())))
    most = int(found.get("max_paginas_per_site", MAX_PAGES))
    if most < 1:
        raise ValueError(f"{path}: max_paginas_per_site must be 1 or more")
    return out, most


def load_families(path: str) -> list[Family]:
    return [
        Family(name, str(r.get("naam") or name), str(r.get("pad_prefix") or "/"), tuple(r.get("detectoren") or ()), str(r.get("bron_id") or ""), str(r.get("taal") or ""),
               str(r.get("sitemap") or ""), str(r.get("sleutel_strip") or ""), int(r.get("min_zusters", 5)), float(r.get("min_eensgezind", 0.8)), str(r.get("inleiding") or ""))
        for name, r in _entries(_load(path), "families", path)]


def load_claims(path: str) -> list[ClaimRule]:
    return [
        ClaimRule(name, str(r.get("titel") or name), str(r.get("zoek_in") or "pagina"), {str(k): str(v) for k, v in (r.get("varianten") or {}).items()}, str(r.get("anders") or "anders"), str(r.get("toelichting") or ""))
        for name, r in _entries(_load(path), "beweringen", path)]
