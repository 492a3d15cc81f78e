"""Names of queries, the functions that plan them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``, with equivalent SQL where there is some."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return register
