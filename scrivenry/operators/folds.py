"""Sequential behaviour over a key's ordered requests: rate windows, breaker, adaptive limit, token bucket.

What comes next depends on all that came before, so each key is a fold over its requests in (at, event_id) order; keys run
in parallel, and a key's rows stream through one task as batches, with a few numbers of state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[tuple, tuple], tuple[tuple, object]]


def fold(rows: DataFrame, columns: list[str], start: tuple, step: Step, out: str) -> DataFrame:
    """(event_id, …out): ``step(state, values)`` gives the next state and the output of each row.

    Rows are brought together by key and sorted within partitions, so a key of any length needs no list of its rows.
    """
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "event_id").select("key", "at", "event_id", *columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = start, None
        for pdf in parts:
            found = []
            for row in pdf.itertuples(index=False):
                if row[0] != key:
                    state, key = start, row[0]
                state, value = step(state, (row[1], *row[3:]))
                found.append(value)
            yield pd.DataFrame({"event_id": pdf.event_id, "value": found})

    return ordered.mapInPandas(run, f"event_id long, value {out}")


def rate_limited(rows: DataFrame, limit: int, window: float) -> DataFrame:
    """Whether each request is admitted: a window opens at a key's first request and admits ``limit`` of them."""

    def step(state, values):
        opened, count = state
        at = values[0]
        if opened is None or at - opened >= window:
            opened, count = at, 0
        return (opened, count + 1), count + 1 <= limit

    return fold(rows, [], (None, 0), step, "boolean")


def breaker(rows: DataFrame, failures: int = 3, cooldown: float = 86_400.0) -> DataFrame:
    """The breaker's state at each outcome: opens after ``failures`` in a row, lets one try through after ``cooldown``."""

    def step(state, values):
        count, opened = state
        at, ok = values
        if opened is not None and at - opened < cooldown:
            return state, "open"
        before = "half-open" if opened is not None else "closed"
        if ok:
            return (0, None), before
        count += 1
        return (count, at if count >= failures or before == "half-open" else None), before

    return fold(rows, ["ok"], (0, None), step, "string")


def adaptive_limit(rows: DataFrame, most: int = 8, raise_after: int = 8) -> DataFrame:
    """The limit after each outcome: halved by an overload, one more after ``raise_after`` successes in a row."""

    def step(state, values):
        limit, good = state
        if not values[1]:
            limit, good = max(1, limit // 2), 0
        else:
            good += 1
            if good >= raise_after:
                limit, good = min(most, limit + 1), 0
        return (limit, good), limit

    return fold(rows, ["ok"], (most, 0), step, "long")


def token_bucket(rows: DataFrame, rate: float, burst: float) -> DataFrame:
    """Seconds each request has to wait: its cost is taken at once, debt is paid back at ``rate``."""

    def step(state, values):
        tokens, last = state
        at, cost = values
        tokens = min(burst, tokens + (at - last) * rate) if last is not None else burst
        tokens -= cost
        return (tokens, at), round(max(0.0, -tokens / rate), 6)

    return fold(rows, ["cost"], (burst, None), step, "double")
