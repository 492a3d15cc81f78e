"""Events held by key until they are due: keyed state with timers, coalesced with what came meanwhile."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import TYPES

#: What comes in and goes out: one change event of an item.
EVENT = "item_id string, event_id string, event_type string, doc_version long, occurred_at timestamp, due timestamp, retry_count long"
RELEASED = "item_id string, event_id string, event_type string, doc_version long, retry_count long, members long"


class HoldUntilDue(StatefulProcessor):
    """One item's waiting events as a list, and a timer at the latest due time among them.

    An event that isn't due holds back the later ones of its item, as order within a key is kept; when time passes the last due
    time, one event goes on for all of them: a DELETE that nothing followed, or else the newest UPSERT after the last DELETE, or
    else the last event. Without an event waiting nothing is kept for an item.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "event string")
        self._until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        now = timerValues.getCurrentProcessingTimeInMs()
        until = self._until.get()[0] if self._until.exists() else 0
        latest = max(until, *(int(x.timestamp() * 1000) for x in new.due.dropna()), 0) if len(new) else until
        entries = [json.dumps({"id": r.event_id, "type": r.event_type, "version": None if pd.isna(r.doc_version) else int(r.doc_version), "at": r.occurred_at.timestamp() if not pd.isna(r.occurred_at) else 0.0, "retries": 0 if pd.isna(r.retry_count) else int(r.retry_count)}) for r in new.itertuples()]
        if latest > now:
            for e in entries:
                self._waiting.appendValue((e,))
            if latest != until:
                if until:
                    self._handle.deleteTimer(until)
                self._handle.registerTimer(latest)
                self._until.update((latest,))
            return
        yield self._released(key, entries)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._released(key, [])

    def _released(self, key, entries: list[str]) -> pd.DataFrame:
        """One event for all that waited and the new ones; the state is empty afterwards."""
        held = [e[0] for e in self._waiting.get()] if self._waiting.exists() else []
        self._waiting.clear()
        self._until.clear()
        events = [json.loads(e) for e in held + entries]
        if not events:
            return pd.DataFrame(columns=[c.split()[0] for c in RELEASED.split(", ")])
        versioned = all(e["version"] is not None for e in events)
        order = sorted(range(len(events)), key=lambda i: (events[i]["version"] if versioned else 0, events[i]["at"], i))
        ordered = [events[i] for i in order]
        since = max((i for i, e in enumerate(ordered) if e["type"] == TYPES[0]), default=-1)
        winner = next((e for e in reversed(ordered[since + 1 :]) if e["type"] == "UPSERT"), ordered[-1])
        return pd.DataFrame({"item_id": [key[0]], "event_id": [winner["id"]], "event_type": [winner["type"]], "doc_version": pd.array([winner["version"]], "Int64"), "retry_count": [max(e["retries"] for e in events)], "members": [len(events)]})

    def close(self) -> None:
        pass


def held_until_due(events: DataFrame) -> DataFrame:
    """A stream of EVENT rows as a stream of RELEASED rows; needs the RocksDB state store."""
    return events.groupBy("item_id").transformWithStateInPandas(HoldUntilDue(), RELEASED, outputMode="append", timeMode="processingTime")
