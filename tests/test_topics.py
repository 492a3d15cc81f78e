"""The topic format: offsets, commits, and queries that are stopped and started again."""

import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scrivenry.sources import topics


def put(path, part, first, n):
    (path / f"part={part}").mkdir(parents=True, exist_ok=True)
    rows = [{"key": f"k{part}-{i % 7}", "value": f"{part}/{i}", "retry_count": 0, "not_before": None, "origin": None} for i in range(first, first + n)]
    pq.write_table(pa.Table.from_pylist(rows, topics._ARROW), path / f"part={part}" / f"{first:020d}-{n}.parquet")


def held(path):
    """All messages of a topic, by partition in order."""
    out = {}
    for part, own in topics.segments(*topics.opened(str(path))).items():
        at = 0
        for first, n, f in own:
            assert first == at and pq.read_metadata(f).num_rows == n
            at += n
            out.setdefault(part, []).extend(pq.read_table(f)["value"].to_pylist())
    return out


def test_a_stopped_query_goes_on_without_loss_or_repeats(spark, tmp_path):
    spark.dataSource.register(topics.Topics)
    source, sink = tmp_path / "in", tmp_path / "out"
    for part in range(3):
        put(source, part, 0, 50)
        put(source, part, 50, 30)
    sent = {f"{p}/{i}" for p in range(3) for i in range(80)}

    def start():
        rows = spark.readStream.format("topic").option("path", str(source)).option("maxPerTrigger", 20).load().selectExpr(*topics.WRITTEN)
        return rows.writeStream.format("topic").option("path", str(sink)).option("parts", 4).option("writer", "copy").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()

    def wait(query, n):
        until = time.time() + 90
        while sum(map(len, held(sink).values())) < n and time.time() < until and query.isActive:
            time.sleep(0.2)

    query = start()
    wait(query, 60)
    query.stop()
    put(source, 1, 80, 40)
    put(source, 5, 0, 10)
    sent |= {f"1/{i}" for i in range(80, 120)} | {f"5/{i}" for i in range(10)}
    query = start()
    wait(query, len(sent))
    query.stop()
    found = [v for own in held(sink).values() for v in own]
    assert sorted(found) == sorted(sent)


def test_a_batch_is_committed_once_and_aborted_whole(tmp_path):
    writer = topics.TopicWriter(str(tmp_path), 2, "w")
    row = {"key": "a", "value": "1", "retry_count": 0, "not_before": None, "origin": None}
    first, again, other = (writer.write(iter([row, row | {"key": k}])) for k in ("b", "b", "c"))
    writer.commit([first, None], 0)
    before = held(tmp_path)
    writer.commit([again], 0)
    assert held(tmp_path) == before and sum(map(len, before.values())) == 2
    writer.abort([other], 1)
    assert held(tmp_path) == before and not list((tmp_path / "_aside").iterdir())


def test_reader_ranges(tmp_path):
    reader = topics.TopicReader(str(tmp_path / "none"), 0)
    assert reader.latestOffset() == reader.initialOffset() == {"0": 0} and reader.partitions({"0": 0}, {"0": 0}) == []
    put(tmp_path, 0, 0, 5)
    put(tmp_path, 0, 5, 5)
    put(tmp_path, 2, 0, 3)
    reader = topics.TopicReader(str(tmp_path), 4)
    assert reader.latestOffset() == {"0": 4, "2": 3}
    part = next(p for p in reader.partitions({"0": 3}, {"0": 7, "2": 3}) if p.part == 0)
    assert (part.start, part.end) == (3, 7)
    assert [(b["off"].to_pylist(), b["value"].to_pylist()) for b in reader.read(part)] == [([3, 4], ["0/3", "0/4"]), ([5, 6], ["0/5", "0/6"])]
    with pytest.raises(KeyError):
        topics.Topics({}).streamReader(None)
