"""What people decided about findings, reconciled with the latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, search_key

# Stored states, and the states a page is shown in.
IN_PROGRESS, FIXED, IGNORED, OPEN = "in_behandeling", "gefixt", "negeren", "open"
SHOWN_IGNORED, SHOWN_BACK, SHOWN_PRESENT = "genegeerd", "teruggekomen", "aanwezig"


def latest(updates: DataFrame) -> DataFrame:
    """The last write of each (finding_id, url) by (ts, seq); a last write of 'open' removes the row."""
    last = F.max_by(F.struct("status", "evidence_hash", "checked", "ts"), F.struct("ts", "seq"))
    rows = updates.groupBy("finding_id", "url").agg(last.alias("x")).select("finding_id", "url", "x.*")
    return rows.where(F.col("status") != OPEN)


def page_states(pages: DataFrame, dispositions: DataFrame, check_date: str | Column) -> DataFrame:
    """(finding_id, url, state, handled) of each page of a finding.

    Ignoring holds while the evidence is the same; a fix holds until a later check still
    finds the page. Dates are compared as text, year first.
    """
    d = dispositions.select("finding_id", "url", "status", F.col("evidence_hash").alias("old"), "checked")
    rows = pages.join(d, ["finding_id", "url"], "left")
    state = (F.when(F.col("status").isNull(), OPEN).when(F.col("status") == IN_PROGRESS, IN_PROGRESS)
             .when(F.col("status") == IGNORED, F.when(F.col("old") == F.col("evidence_hash"), SHOWN_IGNORED).otherwise(SHOWN_BACK))
             .otherwise(F.when(F.lit(check_date) > F.col("checked"), SHOWN_PRESENT).otherwise(FIXED)))
    return rows.withColumn("state", state).withColumn("handled", F.col("state").isin(SHOWN_IGNORED, FIXED)).select("finding_id", "url", "state", "handled")


def finding_states(states: DataFrame) -> DataFrame:
    """(finding_id, pages, handled_pages, handled): a finding is handled once all of its pages are."""
    return states.groupBy("finding_id").agg(F.count("*").alias("pages"), F.count_if("handled").alias("handled_pages"), F.bool_and("handled").alias("handled"))


def counters(findings: DataFrame, states: DataFrame, *by: str) -> DataFrame:
    """(by..., todo, handled) of findings."""
    rows = findings.join(states.select("finding_id", F.col("handled").alias("__h")), "finding_id")
    return rows.groupBy(*by).agg(F.count_if(~F.col("__h")).alias("todo"), F.count_if("__h").alias("handled"))


def filtered(findings: DataFrame, states: DataFrame, show: str = "todo") -> DataFrame:
    """Findings still to do, handled, or all."""
    rows = findings.join(states.select("finding_id", F.col("handled").alias("__h")), "finding_id")
    return {"todo": rows.where(~F.col("__h")), "handled": rows.where("__h"), "all": rows}[show].drop("__h")


def searched(findings: DataFrame, words: str, *parts: str) -> DataFrame:
    """Findings whose ``parts`` (title, variants, URLs) hold ``words`` somewhere, in any case."""
    return findings.where(F.contains(search_key(*[F.col(p) for p in parts]), casefold(F.trim(F.lit(words)))))


def stamped(updates: DataFrame, user: str) -> DataFrame:
    """Updates with who wrote them and when, whatever they say themselves."""
    return updates.withColumn("written_by", F.lit(user)).withColumn("written_at", F.current_timestamp())


def merge(current: DataFrame, updates: DataFrame, *keys: str) -> DataFrame:
    """Upsert: rows of ``updates`` replace those of equal keys, nothing is deleted."""
    return current.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates)


def suppressed(pages: DataFrame, rules: DataFrame, today: str) -> DataFrame:
    """Without pages that a suppression (fingerprint, evidence_hash or null, expires or null) covers. An extension."""
    live = rules.where(F.col("expires").isNull() | (F.col("expires") >= F.lit(today))).select(F.col("fingerprint").alias("__f"), F.col("evidence_hash").alias("__e"))
    return pages.join(live, (F.col("finding_id") == F.col("__f")) & (F.col("__e").isNull() | (F.col("__e") == F.col("evidence_hash"))), "left_anti")
