"""Discouraged terms: every hit is counted, the first few of a page and rule are reported.

A short list of rules is a parameter, so its patterns are part of the plan: pages are scanned once,
each page is searched with the patterns of its language only. Many rules are a table, which the
words of pages are joined with. Hits and their offsets come from Spark's own functions: no
Python worker runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fragment, sentence_ends
from ..sources.shared import checkpoint

LANGUAGES = ("nl", "en")
#: Hits of a page and rule that are reported.
REPORTED = 3


@dataclass(frozen=True)
class TermRule:
    id: str
    preferred: str
    variants: tuple[str, ...]
    languages: tuple[str, ...] = LANGUAGES
    note: str = ""
    whole_words: bool = True
    owner: str = "redactie"

    @property
    def pattern(self) -> str:
        """Longest variant first; word bounds hold for letters of any script."""
        inner = "|".join(re.escape(v).replace("\\ ", " ") for v in sorted(self.variants, key=lambda v: (-len(v), v)))
        return rf"(?iuU)\b(?:{inner})\b" if self.whole_words else rf"(?iuU)(?:{inner})"


def hits(pages: DataFrame, rules: Sequence[TermRule], reported: int | None = REPORTED, text: str = "text", url: str = "url", language: str = "lang") -> DataFrame:
    """(rule_id, term, preferred, url, lang, fragment, position, hits_on_page, note, owner); positions count from 0."""
    if not rules:
        raise ValueError("no rules")
    body = F.col("__text")

    def found(rule: TermRule) -> Column:
        """Hits and the pieces of text between them; null where the rule does not apply."""
        pieces = F.struct(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.preferred).alias("preferred"), F.lit(rule.note).alias("note"), F.lit(rule.owner).alias("owner"),
            F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0)).alias("hits"), F.split(body, rule.pattern, -1).alias("gaps"))
        return F.when(F.col("lang").isin(*rule.languages) & body.rlike(rule.pattern), pieces)

    rows = pages.select(F.col(url).alias("url"), F.col(language).alias("lang"), F.col(text).alias("__text"))
    rows = rows.select("*", sentence_ends(body).alias("__ends"), F.explode(F.array(*[found(r) for r in rules])).alias("r")).where("r is not null")
    n = F.size("r.hits")
    kept = n if reported is None else F.least(n, F.lit(reported))
    # An offset is the length of the gaps and hits before; both lists are cut to what is reported first.
    sizes = lambda a, last: F.transform(F.slice(a, F.lit(1), last), F.length)
    rows = rows.select("*", n.alias("hits_on_page"), F.posexplode(F.slice("r.hits", F.lit(1), kept)).alias("i", "term"), sizes(F.col("r.gaps"), kept).alias("__g"), sizes(F.col("r.hits"), kept).alias("__h"))
    total = lambda a, last: F.aggregate(F.slice(a, F.lit(1), last), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("position", total(F.col("__g"), F.col("i") + 1) + total(F.col("__h"), F.col("i")))
    return rows.select(
        "r.rule_id", "term", "r.preferred", "url", "lang", fragment(body, F.col("position"), F.length("term"), F.col("__ends")).alias("fragment"),
        "position", "hits_on_page", "r.note", "r.owner")


#: Words and what stands between them, in turn.
PIECES = r"(?U)\w+|\W+"


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule_id, lang, key, words, preferred, note, owner): rules (rule_id, lang, variant, preferred, note, owner) ready to be met by words.

    A variant is found by whole words in any case, so it must begin and end with one.
    """
    pieces = F.regexp_extract_all("variant", F.lit(PIECES), F.lit(0))
    out = rules.select("rule_id", "lang", F.lower("variant").alias("key"), pieces.alias("p"), "preferred", "note", "owner").where("key is not null and rule_id is not null")
    bad = out.where((F.size("p") == 0) | ~F.element_at("p", 1).rlike(r"(?U)\w") | ~F.element_at("p", -1).rlike(r"(?U)\w")).select("rule_id", "key").limit(3).collect()
    if bad:
        raise ValueError("variants that do not begin and end with a word: " + "; ".join(f"{r['rule_id']}: {r['key']!r}" for r in bad))
    return out.select("rule_id", "lang", "key", ((F.size("p") + 1) / 2).cast("int").alias("words"), "preferred", "note", "owner").dropDuplicates(["rule_id", "lang", "key"])


def _first_of_overlapping(found: DataFrame) -> DataFrame:
    """Of hits (page, rule_id, i, words, term) that overlap those that a reader from left to right meets, the longest at each place."""
    page = Window.partitionBy("page", "rule_id").orderBy("i")
    rows = found.groupBy("page", "rule_id", "i").agg(F.max(F.struct("words", "term")).alias("x")).select("page", "rule_id", "i", "x.*").withColumn("end", F.col("i") + 2 * F.col("words") - 1)
    before = F.max("end").over(page.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("apart", (before.isNull() | (F.col("i") >= before)).cast("int")).withColumn("cluster", F.sum("apart").over(page))
    each = rows.groupBy("page", "rule_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "words", "end", "term"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i: int, words: int, end: int, term: string>>").alias("kept"))
    taken = F.aggregate("hits", start, lambda s, x: F.when(x["i"] >= s["end"], F.struct(x["end"].alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))
    alone = F.when(F.size("hits") == 1, F.col("hits")).otherwise(taken["kept"])
    return each.select("page", "rule_id", F.explode(alone).alias("x")).select("page", "rule_id", "x.i", "x.words", "x.term")


#: Variants that every task may have a copy of; beyond that words are dealt out to meet them.
BROADCAST = 200_000


def hits_of_table(pages: DataFrame, rules: DataFrame, reported: int | None = REPORTED, text: str = "text", url: str = "url", language: str = "lang", places: bool = True) -> DataFrame:
    """``hits`` for rules that are a table (rule_id, lang, variant, preferred, note, owner), however many there are.

    Words and phrases of each page, of the lengths that variants have, meet the variants of its
    language by an equi-join, so the plan is the same for ten rules and for ten thousand. Texts
    take no part in that join; positions and fragments are worked out for what is reported.
    Without ``places`` these two are left out, and texts are read once.
    """
    table = checkpoint(rule_table(rules))
    sizes = table.groupBy("words").count().collect()  # as many rows as there are lengths of phrases
    lengths, small = sorted(r["words"] for r in sizes), sum(r["count"] for r in sizes) <= BROADCAST
    rows = pages.select(F.col(url).alias("url"), F.col(language).alias("lang"), F.col(text).alias("__text"))
    page = F.xxhash64("url", "lang", "__text").alias("page")
    pieces = F.regexp_extract_all("__text", F.lit(PIECES), F.lit(0))
    near = rows.join(F.broadcast(table.select("lang").distinct()), "lang", "left_semi") if small else rows
    cut = near.select(page, "lang", pieces.alias("p"))  # a filter on the pieces would cut every text twice
    first = F.when(F.get("p", F.lit(0)).rlike(r"(?U)\w"), 1).otherwise(2)

    def grams(m: int) -> Column:
        """Every phrase of ``m`` words and where it begins."""
        begins = F.when(F.size("p") >= first + 2 * m - 2, F.sequence(first, F.size("p") - (2 * m - 2), F.lit(2))).otherwise(F.array().cast("array<int>"))
        term = (lambda i: F.element_at("p", i)) if m == 1 else lambda i: F.array_join(F.slice("p", i, 2 * m - 1), "")
        return F.transform(begins, lambda i: F.struct(i.alias("i"), F.lit(m).alias("words"), term(i).alias("term")))

    phrases = F.flatten(F.array(*map(grams, lengths))) if lengths else F.array().cast("array<struct<i: int, words: int, term: string>>")
    said = cut.select("page", "lang", F.explode(phrases).alias("g")).select("page", "lang", "g.*", F.lower("g.term").alias("key"))
    keys = table.select("rule_id", "lang", "key")
    met = said.join(F.broadcast(keys) if small else keys, ["lang", "key"])
    chosen = _first_of_overlapping(met.select("page", "rule_id", "i", "words", "term"))
    by = Window.partitionBy("page", "rule_id")
    counted = chosen.withColumn("hits_on_page", F.count("*").over(by).cast("int")).withColumn("__n", F.row_number().over(by.orderBy("i")))
    counted = counted if reported is None else counted.where(F.col("__n") <= reported)
    named = table.groupBy("rule_id").agg(*[F.min(c).alias(c) for c in ("preferred", "note", "owner")])
    named = F.broadcast(named) if small else named
    told = counted.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("i", "rule_id", "term", "hits_on_page"))).alias("hits"))
    back = rows.withColumn("page", page).join(told, "page")
    if not places:
        out = back.select("url", "lang", F.explode("hits").alias("h")).select("url", "lang", "h.*").drop("i")
        return out.join(named, "rule_id").select("rule_id", "term", "preferred", "url", "lang", "hits_on_page", "note", "owner")
    # A page's hits are in order, so each position goes on from the one before; pieces stay in the page's row.
    start = F.struct(F.lit(1).alias("i"), F.lit(0).alias("position"), F.array().cast("array<int>").alias("all"))

    def go_on(s: Column, x: Column) -> Column:
        position = s["position"] + F.length(F.array_join(F.slice("p", s["i"], x["i"] - s["i"]), ""))
        return F.struct(x["i"].alias("i"), position.alias("position"), F.concat(s["all"], F.array(position)).alias("all"))

    back = back.select("url", "lang", "__text", "hits", pieces.alias("p")).withColumn("position", F.aggregate("hits", start, go_on)["all"])
    back = back.select("url", "lang", "__text", sentence_ends(F.col("__text")).alias("__ends"), F.explode(F.arrays_zip("hits", "position")).alias("h")).select("url", "lang", "__text", "__ends", "h.hits.*", "h.position")
    out = back.withColumn("fragment", fragment(F.col("__text"), F.col("position"), F.length("term"), F.col("__ends"))).drop("__text", "__ends", "i")
    return out.join(named, "rule_id").select("rule_id", "term", "preferred", "url", "lang", "fragment", "position", "hits_on_page", "note", "owner")


def as_table(spark: SparkSession, rules: Sequence[TermRule]) -> DataFrame:
    """Rules as a table, a row for each variant and language."""
    rows = [(r.id, lang, v, r.preferred, r.note, r.owner) for r in rules for lang in r.languages for v in r.variants]
    return spark.createDataFrame(rows, "rule_id string, lang string, variant string, preferred string, note string, owner string")


def summary(found: DataFrame) -> DataFrame:
    """(rule_id, hits, pages) over all hits, the most frequent first."""
    once = found.select("rule_id", "url", "hits_on_page").distinct()
    return once.groupBy("rule_id").agg(F.sum("hits_on_page").cast("long").alias("hits"), F.countDistinct("url").alias("pages")).orderBy(F.desc("hits"), "rule_id")


@dataclass(frozen=True)
class ClaimRule:
    id: str
    title: str
    scope: str
    variants: dict[str, str] = field(default_factory=dict)
    other: str = "anders"
    note: str = ""
