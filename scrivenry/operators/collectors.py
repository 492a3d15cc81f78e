"""Counters, histograms and gauges that come with a job: observed while its rows pass, not by a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .metrics import EDGES, bucket


class Collectors:
    """Metrics of the rows that pass through :meth:`watch` in one job; :meth:`values` waits for the job and gives them."""

    def __init__(self, name: str):
        self._seen = Observation(name)
        self._columns: dict[str, Column] = {}

    def counter(self, name: str, when: Column | None = None, amount: Column | None = None) -> Collectors:
        """How many rows meet ``when``, or their sum of ``amount``."""
        of = F.lit(1) if amount is None else amount
        self._columns[name] = F.coalesce(F.sum(of if when is None else F.when(when, of)), F.lit(0))
        return self

    def gauge(self, name: str, value: Column) -> Collectors:
        """The greatest value."""
        self._columns[name] = F.max(value)
        return self

    def histogram(self, name: str, value: Column) -> Collectors:
        """Rows in each of the fixed latency buckets, their number and their sum."""
        at = bucket(value)
        for i, edge in enumerate(EDGES):
            self._columns[f"{name}_{i}"] = F.count_if(at == F.lit(edge))
        self._columns[f"{name}_sum"] = F.sum(value)
        return self

    def watch(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._seen, *(c.alias(name) for name, c in self._columns.items()))

    def values(self) -> dict:
        return dict(self._seen.get)

    def buckets(self, name: str) -> list[tuple[float, int]]:
        """(upper edge, rows) of a histogram."""
        found = self.values()
        return [(edge, found[f"{name}_{i}"]) for i, edge in enumerate(EDGES)]
