"""Dispositions as a stream: merged into a table by key, or followed page by page as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.disposition import FIXED, IGNORED, IN_PROGRESS, OPEN, SHOWN_BACK, SHOWN_IGNORED, SHOWN_PRESENT
from ..sources import buckets

KEYS = ("finding_id", "url")


def read_updates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of updates as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def upsert(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the last write of each key in the table under ``folder``; a restart repeats a batch without harm.

    A batch rewrites the buckets that it touches and no others.
    """

    def apply(batch: DataFrame, number: int) -> None:
        buckets.upsert(batch, folder, KEYS, ("ts", "seq"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# What a page's state is made from: its last check (when, evidence) and the last decision about it.
EVENTS = "finding_id string, url string, kind string, status string, evidence_hash string, checked string, ts timestamp, seq long"
CHANGES = "finding_id string, url string, change long, state string, handled boolean"
CHECK, DECISION = "check", "decision"
#: The store that keeps such state; sessions name it in ``spark.sql.streaming.stateStore.providerClass``.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_state(check: tuple[str, str] | None, decision: tuple | None) -> str | None:
    """The state of a page by its last check (date, evidence) and decision (ts, seq, status, evidence, date); null before a check."""
    if check is None:
        return None
    date, evidence = check
    if decision is None or decision[2] == OPEN:
        return OPEN
    _, _, status, old, checked = decision
    if status == IN_PROGRESS:
        return IN_PROGRESS
    if status == IGNORED:
        return SHOWN_IGNORED if old == evidence else SHOWN_BACK
    return SHOWN_PRESENT if checked is not None and date > checked else FIXED


class PageStates(StatefulProcessor):
    """State of one (finding, page): its last check, the last decision, what was told last, and how often it changed.

    All of it is one value, so a page takes one read and one write of the store a batch.
    """

    VALUE = "has_check boolean, date string, evidence string, has_decision boolean, at long, seq long, status string, old string, checked string, state string, change long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", self.VALUE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.page.get()
        check = decision = state = None
        change = 0
        if known is not None:
            check, decision = tuple(known[1:3]) if known[0] else None, tuple(known[4:9]) if known[3] else None
            state, change = known[9:]
        for at, seq, kind, status, evidence, checked in sorted(((r["at"], r["seq"], r["kind"], r["status"], r["evidence_hash"], r["checked"]) for r in rows), key=lambda r: r[:2]):
            if kind == CHECK:
                check = max(check or (checked, evidence), (checked, evidence), key=lambda c: c[0])
            elif decision is None or (at, seq) >= decision[:2]:
                decision = at, seq, status, evidence, checked
            now = page_state(check, decision)
            if now is not None and now != state:
                state, change = now, change + 1
                yield Row(finding_id=key[0], url=key[1], change=change, state=state, handled=state in (SHOWN_IGNORED, FIXED))
        self.page.update((check is not None, *(check or (None,) * 2), decision is not None, *(decision or (None,) * 5), state, change))

    def close(self) -> None:
        pass


def state_changes(events: DataFrame) -> DataFrame:
    """(finding_id, url, change, state, handled): each change of a page's state as checks and decisions arrive.

    Events of a page that come in one batch are taken by (ts, seq), those without a time first; a
    decision older than the last one changes nothing. The session needs the RocksDB state store.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 63)))  # a number, which no time zone shifts
    rows = events.select(*KEYS, "kind", "status", "evidence_hash", "checked", at.alias("at"), "seq")
    return rows.groupBy(*KEYS).transformWithState(PageStates(), CHANGES, "Append", "None")


def last_states(changes: DataFrame) -> DataFrame:
    """(finding_id, url, state, handled): where each page has got to."""
    return changes.groupBy(*KEYS).agg(F.max_by(F.struct("state", "handled"), "change").alias("x")).select(*KEYS, "x.*")


def follow(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of states to Parquet files under ``folder``."""
    return state_changes(events).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)


def activity(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window, status, n): dispositions set per time window, with late updates up to ``late``. An extension."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
