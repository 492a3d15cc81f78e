"""Tables by key range, and metrics that come with a job."""

import random

import pytest
from pyspark.sql import functions as F

from scrivenry.operators import metrics
from scrivenry.operators.collectors import Collectors
from scrivenry.sources import layout


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    rng = random.Random(18)
    keys = rng.sample(range(100_000), 3_000)
    path = f"file://{tmp_path_factory.mktemp('laid')}/t"
    rows = spark.createDataFrame([*((f"K{k:06}", k) for k in keys), (None, -1)], "item_id string, n long")
    layout.lay_out(rows, path, "item_id", 24)
    return path, sorted((f"K{k:06}", k) for k in keys)


def scanned(df):
    """Rows that the file scans of a plan gave."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return out


def test_point_reads_open_few_files(spark, laid):
    path, rows = laid
    wanted = [rows[5][0], rows[6][0], rows[2_900][0], "K999999", "A"]
    found = layout.point_read(spark, path, "item_id", wanted)
    assert sorted(map(tuple, found.collect())) == [rows[5], rows[6], rows[2_900]]
    assert len(found.inputFiles()) == 2
    assert layout.point_read(spark, path, "item_id", ["A"]).collect() == [] and layout.point_read(spark, path, "item_id", []).collect() == []
    # Within the range of a file, a key that it lacks is told by the Bloom filter or the statistics: no row group is read.
    absent = next(f"K{k:06}" for k in range(int(rows[700][0][1:]), 100_000) if (f"K{k:06}", k) not in set(rows))
    assert scanned(layout.point_read(spark, path, "item_id", [absent])) == 0


def test_pages_open_few_files(spark, laid):
    path, rows = laid
    for after, size in ((None, 10), (rows[0][0], 100), (rows[1_234][0], 250), (rows[-3][0], 50), ("K9999999", 5)):
        found = layout.page_read(spark, path, "item_id", after, size)
        assert list(map(tuple, found.collect())) == [r for r in rows if after is None or r[0] > after][:size]
        assert len(found.inputFiles()) <= size // 100 + 3
    walked, at = [], None
    while page := [tuple(r) for r in layout.page_read(spark, path, "item_id", at, 700).collect()]:
        walked += page
        at = page[-1][0]
    assert walked == rows


def test_metrics_come_with_the_job(spark):
    rng = random.Random(19)
    rows = spark.createDataFrame([(rng.expovariate(1), rng.choice([200, 200, 503])) for _ in range(500)], "latency double, status int")
    seen = Collectors("job").histogram("latency", F.col("latency")).counter("failed", F.col("status") != 200).counter("seconds", amount=F.col("latency")).gauge("slowest", F.col("latency"))
    assert seen.watch(rows).where("status = 200").count() == rows.where("status = 200").count()
    found = seen.values()
    own = rows.collect()
    assert found["failed"] == sum(r.status != 200 for r in own) and found["slowest"] == max(r.latency for r in own)
    assert found["seconds"] == pytest.approx(sum(r.latency for r in own)) == pytest.approx(found["latency_sum"])
    plain = {r.edge: r.n for r in rows.groupBy(metrics.bucket(F.col("latency")).alias("edge")).agg(F.count("*").alias("n")).collect()}
    assert {e: n for e, n in seen.buckets("latency") if n} == plain
    empty = Collectors("none").counter("rows").gauge("g", F.col("latency"))
    empty.watch(rows.limit(0)).collect()
    assert empty.values() == {"rows": 0, "g": None}
