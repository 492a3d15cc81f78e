"""Events that wait for their due time in keyed state."""

import time
from datetime import UTC, datetime, timedelta

import pytest

from scrivenry.streaming import timers

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_held_event_is_released_by_its_timer_and_coalesced(rocks, tmp_path):
    """D1 waits and meets a later event; D2 is due at once; a DELETE of D3 goes before the UPSERT that follows it."""
    at = lambda s: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s)
    source, found = f"{tmp_path}/in", []

    def put(*rows):
        rocks.createDataFrame([*rows], timers.EVENT).coalesce(1).write.mode("append").parquet(source)

    put(("D2", "e2", "ACL_CHANGE", 4, at(1), None, 0), ("D3", "e3", "DELETE", 1, at(1), at(1), 0), ("D3", "e4", "UPSERT", 2, at(2), None, 0))
    stream = timers.held_until_due(rocks.readStream.schema(timers.EVENT).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.foreachBatch(lambda df, i: found.extend((*r, time.time()) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while len(found) < 2 and time.time() < until and query.isActive:
            time.sleep(0.5)
        wait = datetime.now(UTC) + timedelta(seconds=15)
        put(("D1", "e1", "UPSERT", 1, at(1), wait, 2))
        put(("D1", "e5", "ACL_CHANGE", 2, at(5), None, 0))
        while len(found) < 3 and time.time() < until and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    rows = {r[0]: r[1:] for r in found}
    assert {k: v[:5] for k, v in rows.items()} == {"D1": ("e1", "UPSERT", 1, 2, 2), "D2": ("e2", "ACL_CHANGE", 4, 0, 1), "D3": ("e4", "UPSERT", 2, 0, 2)}
    assert rows["D1"][5] >= wait.timestamp() > rows["D2"][5]
