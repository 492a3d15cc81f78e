"""When messages are due, to the microsecond."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scrivenry.operators import ingest
from scrivenry.plans import fixtures as fx
from scrivenry.plans import ingest_queries as iq


def test_a_message_waits_until_the_last_microsecond(spark, tmp_path):
    """Parts of a second were left out, so what is due within the next second was due already."""
    now = datetime(2024, 1, 16) - timedelta(seconds=60)
    late = {0: -1, 5: 0, 10: 1, 15: 999_999, 1: 1}
    rows = [(i, i, "view", now + timedelta(microseconds=m), '{"k": 1}') for i, m in late.items()]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert dict(map(tuple, iq.b14(spark, str(tmp_path)).collect())) == {0: False, 5: False, 10: True, 15: True, 1: False}
    # Users 1 and 5 share a part: 1 comes before 5.
    assert dict(map(tuple, iq.i09(spark, str(tmp_path)).collect())) == {0: True, 5: True, 10: False, 15: False, 1: True}


def test_messages_are_held_back_without_sorting_a_partition(spark):
    """A partition was one task's work, and what is read from its messages too."""
    rows = [("a", 0, 3, 5), ("a", 0, 1, None), ("a", 0, 2, 4), ("a", 0, 4, 9), ("a", 0, 5, 1), ("a", 0, 6, None), ("a", None, 1, 9), ("a", None, 0, 1), (None, 1, 0, 5), (None, 1, 1, 6)]
    held = ingest.held_back(spark.createDataFrame(rows, "topic string, part int, off long, not_before long"), F.lit(5))
    assert "Window" not in held._jdf.queryExecution().optimizedPlan().toString()
    wanted = {("a", 0, 1): None, ("a", 0, 2): True, ("a", 0, 3): True, ("a", 0, 4): False, ("a", 0, 5): False, ("a", 0, 6): False, ("a", None, 0): True, ("a", None, 1): False, (None, 1, 0): True, (None, 1, 1): False}
    assert {(r.topic, r.part, r.off): r.due for r in held.collect()} == wanted


def test_offsets_are_counted_by_ranges(spark):
    sf = "/root/testdata/sf0.001"
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = fx.message(spark, sf, by_ranges=True)
        assert sorted(map(str, rows.collect())) == sorted(map(str, fx.message(spark, sf).select(rows.columns).collect()))
        few = spark.range(40).select((F.col("id") % 3).alias("g"), "id").where("g > 0").withColumn("g", F.expr("nullif(g, 2)"))
        assert {r.id: r.turn for r in ingest.numbered(few, F.desc("id"), within=("g",)).collect()} == {i: 1 + (39 - i) // 3 if i % 3 == 1 else 1 + (38 - i) // 3 for i in range(40) if i % 3}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
