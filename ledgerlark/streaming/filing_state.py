"""What has become of each filing, as state of a stream: read, paper, failed and tried again, recovered, expired.

A filing is a key with one value and two timers, in the time of the events: when to try a failed one
again, and when its year leaves the window. State grows with the filings in the window, not with
the stream, and no stored table is read or written again for a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: What tells of a filing: ``outcome`` is read, paper or error, ``at`` when it was tried.
OUTCOME = "chamber string, filing_id string, filing_date date, outcome string, at timestamp"
#: What comes of it; ``tries`` counts the failures so far.
EVENT = "chamber string, filing_id string, filing_date date, event string, tries int, at timestamp"
_STATE = "status string, tries int, filing_date date, again long, expires long"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expires(filed: date) -> int:
    """When a filing leaves the window, in milliseconds: with the second new year after its date."""
    return int(datetime(filed.year + 2, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


class Filings(StatefulProcessor):
    """One filing: its state, and what each outcome and timer makes of it."""

    def __init__(self, retry_ms: int):
        self.retry_ms, self.shape = retry_ms, StructType.fromDDL(_STATE)  # parsed on the driver

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filing", self.shape)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        status, tries, filed, again, ends = held or (None, 0, None, 0, 0)
        now, told = timerValues.getCurrentWatermarkInMs(), []
        known = pd.concat(list(rows)).sort_values("at", kind="stable")
        for row in known.itertuples(index=False):
            if filed is None:
                filed = pd.Timestamp(row.filing_date).date()
                ends = expires(filed)
            if ends <= now or status in ("read", "paper"):
                continue  # out of the window, or done with
            if row.outcome == "error":
                tries += 1
                told.append(("failed", tries, row.at))
                if again:
                    self.handle.deleteTimer(again)
                again = int(pd.Timestamp(row.at).timestamp() * 1000) + self.retry_ms
                self.handle.registerTimer(again)
                status = "failed"
            else:
                told.append(("recovered" if status == "failed" and row.outcome == "read" else row.outcome, tries, row.at))
                if again:
                    self.handle.deleteTimer(again)
                status, again = row.outcome, 0
        if status is not None:
            if held is None:
                self.handle.registerTimer(ends)
            self.state.update((status, tries, filed, again, ends))
        yield self._events(key, filed, told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, tries, filed, again, ends = self.state.get() if self.state.exists() else (None, 0, None, 0, 0)
        told = []
        if status is not None and at >= ends:
            told.append(("expired", tries, at))
            if again:
                self.handle.deleteTimer(again)
            self.state.clear()
        elif status == "failed" and at == again:
            told.append(("retry", tries, at))
            self.state.update((status, tries, filed, 0, ends))
        yield self._events(key, filed, told)

    def close(self) -> None:
        return

    @staticmethod
    def _events(key: Any, filed: date | None, told: list[tuple]) -> pd.DataFrame:
        moment = lambda t: pd.Timestamp(t, unit="ms") if isinstance(t, int) else pd.Timestamp(t)
        rows = [(*key, filed, event, tries, moment(at)) for event, tries, at in told]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENT.split(", ")])


def filing_events(outcomes: DataFrame, retry: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """EVENT of a stream of OUTCOME: read, paper, failed, recovered, retry (a failed one is due again) and expired.

    A filing that was read or is paper is done with: what comes of it later is left out, so repeated
    outcomes change nothing. A failed one is due ``retry`` after its last failure, and again only
    once it has failed again. Filings of before the year before the watermark's are left out; one
    whose year leaves the window is forgotten, and told so if it was known. Rows without a chamber,
    a filing_id, a date or a time are left out; so are those later than ``late``. An empty stream gives nothing.

    Timers and state need the RocksDB state store, which the session is set to.
    """
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    retry_ms = int(pd.Timedelta(retry).total_seconds() * 1000)
    known = outcomes.filter("chamber IS NOT NULL AND filing_id IS NOT NULL AND filing_date IS NOT NULL AND at IS NOT NULL AND outcome IN ('read', 'paper', 'error')")
    rows = known.select(*(c.split()[0] for c in OUTCOME.split(", "))).withWatermark("at", late)
    return rows.groupBy("chamber", "filing_id").transformWithStateInPandas(statefulProcessor=Filings(retry_ms), outputStructType=StructType.fromDDL(EVENT), outputMode="Append", timeMode="EventTime")


def filing_states(events: DataFrame) -> DataFrame:
    """(chamber, filing_id, filing_date, status, tries) of the filings in a table of EVENT: their last one, paper, read or failed; expired ones are gone.

    ``status`` of a recovered filing is read, of one that is due again failed.
    """
    known = events.withColumn("status", F.when(F.col("event") == "recovered", "read").when(F.col("event") == "retry", "failed").otherwise(F.col("event")))
    order = F.struct("at", "tries", F.col("event") != "retry")
    last = known.groupBy("chamber", "filing_id").agg(F.max_by(F.struct("filing_date", "status", "tries"), order).alias("s")).select("chamber", "filing_id", "s.*")
    return last.filter("status <> 'expired'")
