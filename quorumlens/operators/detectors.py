"""Detectors: from the normalised tables to deviations of pages from their siblings.

Tables (all keyed by family and url): ``table_row`` (label, value_raw, ord), ``section``
(ord, step, title, level, text), ``heading`` (ord, level, text), ``section_heading`` (sec_ord,
ord, level, text, is_toggle), ``page`` (title, variant). Every detector returns deviations:
family, detector, kind, place (what the norm is about), url, value (observed), norm, n, agree,
siblings (the first pages that agree, with their values).
Norms are small aggregates; pages meet them by equi-joins on family and step. ``min_members`` and
``min_share`` are numbers, or a table (family, min_members, min_share) stands for the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.similar import similar, similarity
from ..sources.shared import checkpoint
from .consensus import MIN_MEMBERS, MIN_SHARE, consensus, deviators, enough, evidence, first_k, first_siblings, large, last_votes, limited, member_consensus, mode, thresholds
from .findings import KIND_CONTENT, KIND_STRUCTURE, KIND_STYLE, registry
from .terms import ClaimRule

RENAMED_STEP = 0.75
RENAMED_TOGGLE = 0.8
CLOSE_SENTENCE = 0.6
#: Sentences that a finding shows of each page; examples of a page's amounts.
SHOWN = 3
#: Parts that the rows of one text are dealt over where they meet its key.
DEALT = 32
#: Pages of a family among which those without a rare step are looked for.
EARLY = 8
OUT = ["family", "detector", "kind", "place", "url", "value", "norm", "n", "agree", "siblings"]
SIBLINGS = "array<struct<url: string, value: string>>"
TAKEN = pa.list_(pa.struct([(n, pa.string()) for n in ("key", "title", "renamed_key", "renamed_title")] + [("ratio", pa.float64())]))


def _out(rows: DataFrame, detector: str | Column, kind: str | Column, place: Column, value: Column, norm: Column, n: Column, agree: Column, siblings: Column | None = None) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.array().cast(SIBLINGS)
    proof = none if siblings is None else F.coalesce(siblings.cast(SIBLINGS), none)
    return rows.select("family", col(detector).alias("detector"), col(kind).alias("kind"), place.alias("place"), "url", value.alias("value"), norm.alias("norm"), n.cast("long").alias("n"), agree.cast("long").alias("agree"), proof.alias("siblings"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _share_of(min_members: int | DataFrame, min_share: float) -> float | DataFrame:
    return min_members if isinstance(min_members, DataFrame) else min_share


def _pages(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family").agg(F.countDistinct("url").alias("pages"))


def _joined(rows: DataFrame, by: list[str], order: list[str], text: Column, mark: str = "; ") -> DataFrame:
    """One row for each ``by``: all its texts in order, as one."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), mark).alias("value"))


# -- tables ---------------------------------------------------------------------------------


@registry.register("table_values")
def table_values(tables: dict[str, DataFrame], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, **_) -> DataFrame:
    """One label, one value: pages whose last mention differs from the norm."""
    rows = tables["table_row"].select("family", "url", "ord", "value_raw", T.label_key(F.col("label")).alias("key"), T.value_key(F.col("value_raw")).alias("vote")).where("key <> ''")
    votes = last_votes(rows, ["family", "key"], "url", "vote", ["ord"], "value_raw")
    norms = member_consensus(votes, ["family", "key"], "vote", ["url", "ord"], min_members, min_share)
    agreeing = votes.join(norms.select("family", "key", "norm"), ["family", "key"]).where("vote = norm")
    shown = first_siblings(agreeing, ["family", "key"], "url", "value_raw")
    away = deviators(votes, norms, ["family", "key"], "vote").join(shown, ["family", "key"])
    return _out(away, "table_values", KIND_CONTENT, F.col("key"), F.col("value_raw"), F.col("siblings")[0]["value"], F.col("n"), F.col("agree"), F.col("siblings"))


@registry.register("notation")
def notation(tables: dict[str, DataFrame], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, **_) -> DataFrame:
    """Pages that write amounts in another notation than most pages do; n and agree count their amounts.

    One scan counts both notations of each page, and all but the examples works on that small
    table; a second scan fetches the first amounts of the pages that deviate.
    """
    rows = tables["table_row"].select("family", "url", "ord", "value_raw")
    written = T.notation(F.col("value_raw"))
    count = lambda v: F.count(F.when(F.col("__w") == v, 1)).alias(v)
    first = lambda v: F.min(F.when(F.col("__w") == v, F.struct("ord", "value_raw"))).alias(f"{v}_first")
    pages = checkpoint(rows.withColumn("__w", written).groupBy("family", "url").agg(count("nl"), count("en"), first("nl"), first("en")).where("nl + en > 0"))
    # Ties go to the notation that comes first on the page.
    dutch = (F.col("nl") > F.col("en")) | ((F.col("nl") == F.col("en")) & (F.col("nl_first.ord") < F.col("en_first.ord")))
    norms = thresholds(mode(pages.withColumn("own", F.when(dutch, "nl").otherwise("en")), ["family"], "own", ["url"]), min_members, min_share, unanimous=True).select("family", "norm")
    both = pages.join(norms, "family").withColumn("agree", F.when(F.col("norm") == "nl", F.col("nl")).otherwise(F.col("en"))).withColumn("n", F.col("nl") + F.col("en"))
    example = F.when(F.col("norm") == "nl", F.col("nl_first.value_raw")).otherwise(F.col("en_first.value_raw"))
    proof = first_siblings(both.where("agree > 0").withColumn("example", example), ["family"], "url", "example")
    away = both.where("agree < n").select("family", "url", "norm", "n", "agree")
    odd = rows.join(away.select("family", "url", "norm"), ["family", "url"]).where(written != F.col("norm"))
    shown = first_siblings(odd, ["family", "url"], "ord", "value_raw", SHOWN)
    away = away.join(proof, "family", "left").join(shown.select("family", "url", F.transform("siblings", lambda x: x["value"]).alias("examples")), ["family", "url"])
    return _out(away, "notation", KIND_STYLE, F.col("url").cast("string"), F.array_join("examples", "; "), F.col("norm"), F.col("n"), F.col("agree"), F.col("siblings"))


# -- steps ----------------------------------------------------------------------------------


def names(tables: dict[str, DataFrame]) -> DataFrame:
    """(family, url, name): the country of each page, which titles are compared without."""
    page = tables.get("page")
    if page is not None and {"title", "variant"} <= set(page.columns):
        return page.select("family", "url", T.country(F.col("title"), F.col("variant")).alias("name"))
    return next(tables[t] for t in ("page", "section", "heading") if t in tables).select("family", "url", F.lit("").alias("name")).distinct()


def steps(section: DataFrame, page: DataFrame | None = None) -> DataFrame:
    """(family, url, key, title, pos): each page's distinct steps, numbered in order from 0."""
    name = F.lit("")
    if page is not None:
        section = section.join(names({"page": page}), ["family", "url"])
        name = F.col("name")
    rows = section.where(F.trim("step") != "").withColumn("key", T.title_key(F.col("step"), name)).where("key <> ''")
    first = rows.groupBy("family", "url", "key").agg(F.min("ord").alias("ord"), F.min_by("step", "ord").alias("title"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("family", "url").orderBy("ord")) - 1).drop("ord")


def step_norm(found: DataFrame, pages: DataFrame, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(family, key, title, on_pages, pages, place): steps that enough of all pages have, in mean order."""
    each = found.groupBy("family", "key").agg(
        F.count("*").alias("on_pages"), F.avg("pos").alias("mean"), F.min_by("title", F.struct("url", "pos")).alias("title"), F.min(F.struct("url", "pos")).alias("first"))
    common = enough(each.join(pages, "family"), "pages", "on_pages", min_members, min_share)
    return common.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("mean", "first")) - 1).select("family", "key", "title", "on_pages", "pages", "place")


def with_plan(found: DataFrame, norm: DataFrame) -> DataFrame:
    """(family, url) of pages that have at least one step of the norm."""
    return found.join(norm.select("family", "key"), ["family", "key"], "left_semi").select("family", "url").distinct()


def planned_names(tables: dict[str, DataFrame], min_share: float | DataFrame = MIN_SHARE) -> DataFrame:
    """``names`` of the pages with a plan (all, if sections are not known); the other detectors of steps leave the rest out.

    ``min_share`` may be a table of families too; however few pages there are, they can have a plan.
    """
    if "section" not in tables:
        return names(tables)
    found = steps(tables["section"], tables.get("page"))
    pages = _pages(tables["page"] if "page" in tables else tables["section"])
    share = (min_share.withColumn("min_members", F.lit(1)), 0.0) if isinstance(min_share, DataFrame) else (1, min_share)
    return checkpoint(names(tables).join(with_plan(found, step_norm(found, pages, *share)), ["family", "url"], "left_semi"))


def missing_steps(found: DataFrame, norm: DataFrame, planned: DataFrame) -> DataFrame:
    """(family, url, key, title, place, on_pages, pages): norm steps that a page with a plan lacks."""
    due = planned.join(norm, "family")
    return due.join(found.select("family", "url", "key"), ["family", "url", "key"], "left_anti")


def extra_steps(found: DataFrame, norm: DataFrame, planned: DataFrame, min_share: float | DataFrame = MIN_SHARE) -> DataFrame:
    """Steps outside the norm whose share of pages is at most 1 - ``min_share`` (in doubles; a number or a table of families)."""
    share = found.groupBy("family", "key").agg(F.count("*").alias("on_pages")).join(planned.groupBy("family").agg(F.count("*").alias("planned")), "family")
    known, _, least = limited(share, min_share, 0.0) if isinstance(min_share, DataFrame) else limited(share, 0, min_share)
    rare = known.where(F.col("on_pages").cast("double") / F.col("planned") <= 1 - least).select(*share.columns)
    loose = found.join(norm.select("family", "key"), ["family", "key"], "left_anti").join(planned, ["family", "url"], "left_semi")
    return loose.join(rare, ["family", "key"])


def swapped_steps(found: DataFrame, norm: DataFrame) -> DataFrame:
    """(family, url, order): pages whose norm steps stand in another order than the norm's."""
    both = found.join(norm.select("family", "key", "place"), ["family", "key"])
    w = Window.partitionBy("family", "url").orderBy("pos")
    back = both.withColumn("before", F.lag("place").over(w)).groupBy("family", "url").agg(
        F.bool_or(F.col("before") > F.col("place")).alias("swapped"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), " > ").alias("order"))
    return back.where("swapped").select("family", "url", "order")


def renamed_steps(missing: DataFrame, loose: DataFrame, least: float = RENAMED_STEP) -> DataFrame:
    """(family, url, key, title, renamed_key, renamed_title, ratio): greedy pairing within a page.

    For each missing step in norm order: the most similar loose step of the page not yet
    taken, if similar enough, or else the loose step at the same place. Only pairs that can be
    taken reach a page's list: the similar ones and those of one place. A batch of pages is one call of Python.
    """
    pairs = missing.select("family", "url", "key", "title", "place").join(loose.select("family", "url", F.col("key").alias("loose"), F.col("title").alias("loose_title"), "pos"), ["family", "url"])
    scored = similar(pairs, "loose", "key", least, also=F.col("pos") == F.col("place"))

    pair = ["place", "key", "pos", "loose", "title", "loose_title", "ratio"]
    pages = scored.groupBy("family", "url").agg(F.array_sort(F.collect_list(F.struct(*pair))).alias("pairs"))

    def assign(pairs: list[dict]) -> list[dict]:
        """The pairs taken of one page's, which come by place, key, pos and loose key."""
        taken, out = set(), []
        for (place, _), group in groupby(pairs, key=lambda p: (p["place"], p["key"])):
            free = [p for p in group if p["loose"] not in taken] if place is not None else []
            best = max(free, key=lambda p: p["ratio"], default=None)
            if best and best["ratio"] < least:
                best = next((p for p in free if p["pos"] == place), None)
            if best:
                taken.add(best["loose"])
                out.append({"key": best["key"], "title": best["title"], "renamed_key": best["loose"], "renamed_title": best["loose_title"], "ratio": best["ratio"]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [assign(pairs) for pairs in b.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("family"), b.column("url"), pa.array(found, TAKEN)], ["family", "url", "taken"])

    kinds = dict(missing.dtypes)
    each = pages.mapInArrow(run, f"family {kinds['family']}, url {kinds['url']}, taken array<struct<key: string, title: string, renamed_key: string, renamed_title: string, ratio: double>>")
    return each.select("family", "url", F.explode("taken").alias("t")).select("family", "url", "t.*")


@registry.register("steps")
def step_plan(tables: dict[str, DataFrame], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, **_) -> DataFrame:
    """Pages without a plan, and missing, renamed, extra and swapped steps of the others.

    Where the pages of a family have no step in common, none of them has a plan. A page that lacks
    a step is shown with the steps it has, so its evidence changes when they do.
    """
    found = checkpoint(steps(tables["section"], tables.get("page")))
    everyone = (tables["page"] if "page" in tables else tables["section"]).select("family", "url").distinct()
    pages = everyone.groupBy("family").agg(F.count("*").alias("pages"))
    norm = checkpoint(step_norm(found, pages, min_members, min_share))
    planned = checkpoint(with_plan(found, norm))
    size = planned.groupBy("family").agg(F.count("*").alias("planned"))
    missing = missing_steps(found, norm, planned).drop("pages")
    loose = found.join(norm.select("family", "key"), ["family", "key"], "left_anti").join(planned, ["family", "url"], "left_semi")
    renamed = checkpoint(renamed_steps(missing, loose))
    having = first_siblings(found.join(norm.select("family", "key"), ["family", "key"]), ["family", "key"], "url", "title")
    sizes = norm.select("family", "key", "on_pages").join(size, "family").join(having, ["family", "key"])
    key, none = ["family", "url", "key"], F.lit(None).cast("string")

    without = large(everyone.join(planned, ["family", "url"], "left_anti").join(pages, "family"), "pages", min_members)
    having_plan = _joined(found.join(planned, ["family", "url"], "left_semi"), ["family", "url"], ["pos"], F.col("title"), " · ")
    without = without.join(size, "family", "left").na.fill(0, ["planned"]).join(first_siblings(having_plan, ["family"], "url", "value"), "family", "left")
    only = _joined(found, ["family", "url"], ["pos"], F.col("title"), " · ")
    without = without.join(only, ["family", "url"], "left")
    gone = missing.select(*key, "title").join(renamed.select(*key), key, "left_anti").join(sizes, ["family", "key"]).join(only, ["family", "url"])
    near = similarity(F.col("key"), F.col("renamed_key")) >= RENAMED_STEP
    other = renamed.join(sizes, ["family", "key"]).withColumn("kind", F.when(near, KIND_STYLE).otherwise(KIND_STRUCTURE))
    more = checkpoint(extra_steps(found, norm, planned, _share_of(min_members, min_share)).drop("planned").join(renamed.select("family", "url", F.col("renamed_key").alias("key")), key, "left_anti"))
    more = more.join(more.groupBy("family", "key").agg(F.count("*").alias("c")), ["family", "key"]).join(size, "family")
    # Up to three of a family's first pages that do not have the step.
    early = first_k(planned, ["family"], ["url"], EARLY).drop("rank")
    lack = more.select("family", "key").distinct().join(early, "family").join(found.select(*key), key, "left_anti").withColumn("has", F.lit("–"))
    more = more.join(first_siblings(lack, ["family", "key"], "url", "has"), ["family", "key"], "left")
    swapped = swapped_steps(found, norm).join(planned, ["family", "url"], "left_semi")
    swapped = swapped.join(swapped.groupBy("family").agg(F.count("*").alias("c")), "family").join(size, "family")
    return _union([
        _out(without, "steps_none", KIND_STRUCTURE, F.lit(""), F.col("value"), none, F.col("pages"), F.col("planned"), F.col("siblings")),
        _out(gone, "steps_missing", KIND_STRUCTURE, F.col("key"), F.col("value"), F.col("title"), F.col("planned"), F.col("on_pages"), F.col("siblings")),
        _out(other, "steps_renamed", F.col("kind"), F.concat_ws(" / ", "key", "renamed_key"), F.col("renamed_title"), F.col("title"), F.col("planned"), F.col("on_pages"), F.col("siblings")),
        _out(more, "steps_extra", KIND_STRUCTURE, F.col("key"), F.col("title"), none, F.col("planned"), F.col("planned") - F.col("c"), F.col("siblings")),
        _out(swapped, "steps_order", KIND_STRUCTURE, F.lit(""), F.col("order"), none, F.col("planned"), F.col("planned") - F.col("c")),
    ])


# -- accordions -----------------------------------------------------------------------------


def _keyed(section: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Sections with step_key and title_key, of the pages in ``named`` (of all, without a country, if there is none)."""
    if named is None:
        name = F.lit("")
    else:
        section, name = section.join(named, ["family", "url"]), F.col("name")
    return section.withColumns({"step_key": T.title_key(F.col("step"), name), "title_key": T.title_key(F.col("title"), name)})


def toggles(section: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(family, url, step_key, title_key, title, step, level, text, ord): accordions; the last section of a title counts."""
    rows = _keyed(section.where("title <> ''"), named)
    last = F.max_by(F.struct("title", "step", "level", "text"), "ord")
    return rows.groupBy("family", "url", "step_key", "title_key").agg(last.alias("x"), F.min("ord").alias("ord")).select("family", "url", "step_key", "title_key", "x.*", "ord")


def missing_toggles(found: DataFrame, on_step: DataFrame, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(family, step_key, title_key, title, url, has, pages): pages with the step that lack a common accordion."""
    size = on_step.groupBy("family", "step_key").agg(F.countDistinct("url").alias("pages"))
    each = found.groupBy("family", "step_key", "title_key").agg(F.count("*").alias("has"), F.min_by("title", "url").alias("title")).join(size, ["family", "step_key"])
    common = enough(each, "pages", "has", min_members, min_share).where("has < pages")
    due = on_step.select("family", "step_key", "url").distinct().join(common, ["family", "step_key"])
    return due.join(found.select("family", "step_key", "title_key", "url"), ["family", "step_key", "title_key", "url"], "left_anti")


@registry.register("toggles")
def toggle_titles(tables: dict[str, DataFrame], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, **_) -> DataFrame:
    """Accordions that a page lacks: renamed within the step, moved to another step, or missing.

    One that stands there as an ordinary heading is the heading detector's matter.
    """
    named = planned_names(tables, _share_of(min_members, min_share))
    found = checkpoint(toggles(tables["section"], named))
    on_step = _keyed(tables["section"].where("step <> ''"), named).select("family", "url", "step_key").distinct()
    gone = checkpoint(missing_toggles(found, on_step, min_members, min_share))
    near = gone.join(found.select("family", "url", "step_key", F.col("title_key").alias("other"), F.col("title").alias("other_title"), F.col("ord").alias("other_ord")), ["family", "url", "step_key"])
    near = similar(near, "other", "title_key", RENAMED_TOGGLE)
    renamed = near.groupBy("family", "url", "step_key", "title_key").agg(F.max_by("other_title", F.struct("ratio", (-F.col("other_ord")).alias("o"))).alias("renamed"))
    moved = found.groupBy("family", "url", "title_key").agg(F.min_by("step", "ord").alias("moved"))
    rows = gone.join(renamed, ["family", "url", "step_key", "title_key"], "left").join(moved, ["family", "url", "title_key"], "left")
    rows = rows.withColumn("how", F.when(F.col("renamed").isNotNull(), "renamed").when(F.col("moved").isNotNull(), "moved").otherwise("missing"))
    if "heading" in tables:
        plain = tables["heading"].join(named, ["family", "url"]).select("family", "url", T.title_key(F.col("text"), F.col("name")).alias("title_key"), F.lit("missing").alias("how")).distinct()
        rows = rows.join(plain, ["family", "url", "title_key", "how"], "left_anti")
    proof = first_siblings(found, ["family", "step_key", "title_key"], "url", "title")
    rows = rows.join(proof, ["family", "step_key", "title_key"])
    kind = F.when(F.col("how") == "renamed", KIND_STYLE).otherwise(KIND_STRUCTURE)
    value = F.coalesce("renamed", T.shorten(F.col("moved"), 50))
    return _out(rows, F.concat(F.lit("toggles_"), "how"), kind, F.concat_ws(" / ", "step_key", "title_key"), value, F.col("title"), F.col("pages"), F.col("has"), F.col("siblings"))


# -- headings -------------------------------------------------------------------------------


def level_jumps(heading: DataFrame) -> DataFrame:
    """(family, url, ord, level, before): headings more than one level below the one before."""
    w = Window.partitionBy("family", "url").orderBy("ord")
    return heading.withColumn("before", F.lag("level", 1, 0).over(w)).where((F.col("before") > 0) & (F.col("level") - F.col("before") > 1))


def heading_levels(heading: DataFrame, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(family, key, n, norm, agree, url, level): headings whose level differs from most of the same text.

    ``heading`` may bring its ``key``; without one the country is not known.
    """
    rows = heading if "key" in heading.columns else heading.withColumn("key", T.title_key(F.col("text"), F.lit("")))
    norms = consensus(rows, ["family", "key"], "level", ["url", "ord"], min_members, min_share)
    return deviators(rows, norms, ["family", "key"], "level")


def _wrong_levels(rows: DataFrame, label: str, none: str, min_share: float | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deviations of (family, url, at, level, text, key) from the family's commonest level, unless that is 0.

    Returns (family, url, place, value, norm), a row for each page and level, and the (family, url, key) reported.
    """
    share = (min_share.withColumn("min_members", F.lit(1)), 0.0) if isinstance(min_share, DataFrame) else (1, min_share)
    norms = F.broadcast(consensus(rows, ["family"], "level", ["url", "at"], *share).where("norm > 0"))  # a row for each family
    away = deviators(rows, norms, ["family"], "level").withColumn("place", F.concat(F.lit(f"{label}:h"), "level"))
    shown = F.concat(F.when(F.col("level") == 0, none).otherwise(F.concat(F.lit("h"), "level")), F.lit(" “"), T.shorten(F.col("text"), 40), F.lit("”"))
    pages = _joined(away, ["family", "url", "place", "norm"], ["at"], shown).withColumn("norm", F.concat(F.lit("h"), "norm"))
    proof = evidence(rows.withColumn("shown", T.shorten(F.col("text"), 40)), norms, ["family"], "level", "url", shown="shown")
    return pages.join(proof, "family", "left"), away.select("family", "url", "key")


def _with_key(rows: DataFrame) -> DataFrame:
    """Rows (url, text, name, ...) with the ``key`` of each text, worked out once for equal texts; the rows of a text are dealt over ``DEALT`` parts."""
    keys = rows.select("text", "name").distinct().withColumn("key", T.title_key(F.col("text"), F.col("name"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    same = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(DEALT)).cast("int"))
    return dealt.alias("r").join(keys.alias("k"), same("text") & same("name") & same("part")).select("r.*", "k.key").drop("part")


@registry.register("headings")
def heading_structure(tables: dict[str, DataFrame], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, **_) -> DataFrame:
    """Levels of headings inside accordions and of accordion titles, jumps, several h1, levels of equal texts.

    n is the number of pages with a plan (none is reported below ``min_members``), agree those of
    them that do not deviate.
    """
    named = planned_names(tables, _share_of(min_members, min_share))
    size = large(named.groupBy("family").agg(F.count("*").alias("pages")), "pages", min_members)
    named = named.join(F.broadcast(size.select("family")), "family", "left_semi")  # a row for each family
    keyed = lambda rows: _with_key(rows.join(named, ["family", "url"])).drop("name")
    heading = checkpoint(keyed(tables["heading"]))
    parts, told = [], []
    titled = tables["section"].where("title <> ''") if "section" in tables else None
    if titled is not None and "section_heading" in tables:
        inner = keyed(tables["section_heading"].where("NOT is_toggle").join(titled.select("family", "url", F.col("ord").alias("sec_ord")), ["family", "url", "sec_ord"], "left_semi"))
        # A bold paragraph is a heading only if the same text is a real one often enough.
        real = large(heading.groupBy("family", "key").agg(F.count("*").alias("c")), "c", min_members).select("family", "key")
        rows = inner.where("level > 0").unionByName(inner.where("level = 0").join(real, ["family", "key"], "left_semi"))
        pages, seen = _wrong_levels(rows.withColumn("at", F.struct("sec_ord", "ord")), "inside", "bold", _share_of(min_members, min_share))
        parts.append(pages.withColumn("detector", F.lit("headings_inside")))
        told.append(seen)
    if titled is not None:
        rows = keyed(titled.select("family", "url", F.col("ord").alias("at"), "level", F.col("title").alias("text")))
        pages, seen = _wrong_levels(rows, "toggle", "no heading", _share_of(min_members, min_share))
        parts.append(pages.withColumn("detector", F.lit("headings_toggle")))
        told.append(seen)
    plain = lambda rows, detector, place, norm: rows.select("family", "url", place.alias("place"), "value", F.lit(norm).cast("string").alias("norm"), F.lit(None).cast(SIBLINGS).alias("siblings"), F.lit(detector).alias("detector"))
    jump = F.concat(F.lit("h"), F.col("before"), F.lit(" > h"), F.col("level"), F.lit(" “"), T.shorten(F.col("text"), 40), F.lit("”"))
    parts.append(plain(_joined(level_jumps(heading), ["family", "url"], ["ord"], jump), "headings_jump", F.lit("jump"), None))
    h1 = heading.where("level = 1").groupBy("family", "url").agg(F.count("*").alias("c")).where("c > 1").withColumn("value", F.concat(F.col("c").cast("string"), F.lit(" h1")))
    parts.append(plain(h1, "headings_h1", F.lit("h1"), "1"))
    same = heading_levels(heading, min_members, min_share)
    for seen in told:  # what is reported already is not reported again
        same = same.join(seen.distinct(), ["family", "url", "key"], "left_anti")
    away = _joined(same, ["family", "url", "key", "norm"], ["ord"], F.concat(F.lit("h"), "level"))
    norms = same.select("family", "key", "norm").distinct()
    proof = evidence(heading, norms, ["family", "key"], "level", "url")
    away = away.join(proof.withColumn("siblings", F.col("siblings").cast(SIBLINGS)), ["family", "key"], "left")
    parts.append(away.select("family", "url", F.col("key").alias("place"), "value", F.concat(F.lit("h"), "norm").alias("norm"), "siblings", F.lit("headings_level").alias("detector")))
    rows = checkpoint(_union([p.select("family", "url", "place", "value", "norm", F.col("siblings").cast(SIBLINGS).alias("siblings"), "detector") for p in parts]))
    count = rows.groupBy("family", "detector", "place").agg(F.countDistinct("url").alias("c"))
    rows = rows.join(count, ["family", "detector", "place"]).join(size, "family")
    return _out(rows, F.col("detector"), KIND_STYLE, F.col("place"), F.col("value"), F.col("norm"), F.col("pages"), F.col("pages") - F.col("c"), F.col("siblings"))


# -- sentences and claims -------------------------------------------------------------------


def meet(rows: DataFrame, few: DataFrame, by: list[str], who: str, how: str = "inner") -> DataFrame:
    """Rows joined with the few rows of their group: these are copied to ``DEALT`` parts, over which a group's rows are dealt by ``who``."""
    copies = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return rows.withColumn("__part", F.pmod(F.xxhash64(who), F.lit(DEALT)).cast("int")).join(copies, [*by, "__part"], how).drop("__part")


def standard_set(lines: DataFrame, members: DataFrame, min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """(group, key, members, with_key, shown): keys that enough members of a group have.

    ``lines``: (group, member, key, text, ord); ``members``: (group, members).
    """
    each = lines.groupBy("group", "key").agg(F.countDistinct("member").alias("with_key"), F.max_by("text", F.struct("member", "ord")).alias("shown"))
    rows = each.join(members, "group")
    family = [F.col("group.family").alias("family")] if isinstance(min_members, DataFrame) else []
    return enough(rows.select("*", *family), "members", "with_key", min_members, min_share).select(*rows.columns)


def lacking(lines: DataFrame, everyone: DataFrame, standard: DataFrame) -> DataFrame:
    """(group, member, key, ...): standard keys that a member does not have."""
    return meet(everyone, standard, ["group"], "member").join(lines.select("group", "member", "key").distinct(), ["group", "member", "key"], "left_anti")


@registry.register("sentences")
def standard_sentences(tables: dict[str, DataFrame], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE, **_) -> DataFrame:
    """Accordions that lack standard sentences of that accordion, with the closest sentences they have instead.

    A member is one section; a page's row tells how many sentences it lacks and shows the most
    frequent ``SHOWN`` of them (ties by key).
    """
    named = planned_names(tables, _share_of(min_members, min_share))
    on_step = _keyed(tables["section"].where("step <> ''"), named).groupBy("family", "step_key").agg(F.countDistinct("url").alias("on_step"))
    found = _keyed(tables["section"].where("title <> ''"), named).withColumn("member", F.struct("url", "ord"))
    place = ["family", "step_key", "title_key"]
    size = found.groupBy(*place).agg(F.count("*").alias("members")).join(on_step, ["family", "step_key"], "left")
    known, members, share = limited(size, min_members, min_share)
    size = known.where((F.col("members") >= members) & (F.col("members").cast("double") / F.greatest(F.coalesce("on_step", F.lit(0)), F.lit(1)) >= share)).select(*size.columns)
    group = F.struct(*place).alias("group")
    rows = meet(found, size.select(*place), place, "member")
    lines = checkpoint(rows.select(group, "member", F.posexplode(T.sentences(F.col("text"), F.col("name"))).alias("ord", "s")).select("group", "member", "ord", "s.key", "s.text"))
    standard = checkpoint(standard_set(lines, size.select(group, "members"), min_members, min_share))
    gone = checkpoint(lacking(lines, rows.select(group, "member"), standard))
    own = meet(lines, standard.select("group", "key"), ["group", "key"], "member", "left_anti").join(gone.select("group", "member").distinct(), ["group", "member"], "left_semi")
    own = own.groupBy("group", "member", F.col("key").alias("other")).agg(F.min_by("text", "ord").alias("other_text"))
    near = similar(gone.join(own, ["group", "member"]), "other", "key", CLOSE_SENTENCE)
    best = near.groupBy("group", "member", "key").agg(F.max_by("other_text", F.struct("ratio", "other")).alias("instead"))
    text = F.concat(F.when(F.col("instead").isNull(), "missing: “").otherwise(F.concat(F.lit("“"), T.shorten(F.col("instead"), 90), F.lit("” for “"))), T.shorten(F.col("shown"), 90), F.lit("”"))
    each = gone.join(best, ["group", "member", "key"], "left").select("group", "member", "members", F.struct((-F.col("with_key")).alias("c"), "key", text.alias("t")).alias("x"))
    pages = each.groupBy("group", "member", "members").agg(F.array_sort(F.collect_list("x")).alias("x"), F.count("*").alias("k"))
    standards = standard.groupBy("group").agg(F.count("*").alias("standards"), F.min_by("shown", F.struct((-F.col("with_key")).alias("c"), "key")).alias("first"))
    away = pages.groupBy("group").agg(F.count("*").alias("away"))
    fine = meet(rows.select(group, "member").join(pages.select("group", "member"), ["group", "member"], "left_anti"), standards, ["group"], "member").select("group", F.col("member.url").alias("url"), T.shorten(F.col("first"), 80).alias("first"))
    shown = standards.join(away, "group").join(first_siblings(fine, ["group"], "url", "first"), "group", "left")
    out = meet(pages, shown, ["group"], "member")
    more = F.when(F.col("k") > SHOWN, F.concat(F.lit(" (+"), (F.col("k") - SHOWN).cast("string"), F.lit(" more)"))).otherwise("")
    value = F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("standards").cast("string"), F.lit(": "), F.array_join(F.transform(F.slice("x", 1, SHOWN), lambda x: x["t"]), "; "), more)
    out = out.withColumn("url", F.col("member.url")).withColumn("family", F.col("group.family"))
    return _out(out, "sentences", KIND_STRUCTURE, F.concat_ws(" / ", "group.step_key", "group.title_key"), value, F.lit(None).cast("string"), F.col("members"), F.col("members") - F.col("away"), F.col("siblings"))


def scope_texts(section: DataFrame, page: DataFrame, rules: list[ClaimRule]) -> DataFrame:
    """(family, url, t0, t1, ...): for each rule the text it is sought in, null where a page has no such part.

    ``section`` has step_key and title_key. All sections are read once, whatever the number of rules.
    """
    columns, parts = [], {}
    for i, rule in enumerate(rules):
        kind, _, wanted = rule.scope.partition(":")
        key = {"stap": "step", "uitklap": "title"}.get(kind)
        if key:
            here = F.contains(F.col(f"{key}_key"), T.casefold(F.lit(wanted)))
            here = here & (F.col("step") != "") if key == "step" else here
            found = F.array_sort(F.collect_list(F.when(here, F.struct("ord", "text"))))
            parts[f"t{i}"] = F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x["text"]), "\n"))
        columns.append(F.col("text") if kind == "pagina" else F.col(f"t{i}") if key else F.lit(None).cast("string"))
    rows = page
    if parts:
        rows = page.join(section.groupBy("family", "url").agg(*[c.alias(n) for n, c in parts.items()]), ["family", "url"], "left")
    return rows.select("family", "url", *[c.alias(f"t{i}") for i, c in enumerate(columns)])


def claim_answers(texts: DataFrame, rules: list[ClaimRule]) -> DataFrame:
    """(family, url, rule, answer) of (family, url, t0, t1, ...), without the parts that a page lacks."""
    said = [F.struct(F.lit(r.id).alias("rule"), T.answer(F.col(f"t{i}"), r.variants, r.other).alias("answer")) for i, r in enumerate(rules)]
    return texts.select("family", "url", F.explode(F.array(*said)).alias("x")).select("family", "url", "x.*").where("answer is not null")


def claims(tables: dict[str, DataFrame], rules: list[ClaimRule], min_members: int | DataFrame = MIN_MEMBERS, min_share: float = MIN_SHARE) -> DataFrame:
    """Pages with a plan whose answer to a claim differs from most of their siblings'."""
    named = planned_names(tables, _share_of(min_members, min_share))
    page = tables["page"].select("family", "url", "text").join(named.select("family", "url"), ["family", "url"], "left_semi")
    said = checkpoint(claim_answers(scope_texts(_keyed(tables["section"], named), page, rules), rules))
    norms = consensus(said, ["family", "rule"], "answer", ["url"], min_members, min_share)
    proof = evidence(said, norms, ["family", "rule"], "answer", "url")
    titles = F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.title)])
    away = deviators(said, norms, ["family", "rule"], "answer").join(proof.withColumn("siblings", F.col("siblings").cast(SIBLINGS)), ["family", "rule"], "left")
    return _out(away, F.concat(F.lit("claim_"), "rule"), KIND_CONTENT, titles[F.col("rule")], F.col("answer"), F.col("norm"), F.col("n"), F.col("agree"), F.col("siblings"))
