"""Snapshots and restore, the job state machine, a backfill that is paused and taken up again."""

import uuid
from datetime import UTC, datetime, timedelta

import pytest

from scrivenry.operators import ingest
from scrivenry.sources.jobs import Backfill, Jobs
from scrivenry.sources.snapshots import Snapshots, counts
from scrivenry.sources.tables import VersionedTable

STATE = "item_id string, status string, doc_version long, content_hash string, state_hash string, embedding_model string, chunker_version string, attempts long, wave long"


def base(spark):
    return spark.conf.get("spark.checkpoint.dir") + "/j-" + uuid.uuid4().hex


def test_snapshots(spark):
    root = base(spark)
    table = VersionedTable(spark, f"{root}/chunks")
    snaps = Snapshots(spark, f"{root}/snapshots")
    assert snaps.list().isEmpty()
    with pytest.raises(ValueError):
        snaps.create({"chunks": table})
    names = []
    for i in range(3):
        table.write(spark.range(i + 1))
        names.append(snaps.create({"chunks": table}, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=i)))
    assert [r.name for r in snaps.list().collect()] == names[::-1]
    back = snaps.restore(names[1], root)
    assert counts(back) == {"restored_chunks": 2} and table.read().count() == 3
    assert snaps.prune(2) == names[:1]
    for call in (lambda: snaps.restore(names[0], root), lambda: snaps.restore(names[1], root, ["other"]), lambda: snaps.create({"chunks": table}, datetime(2024, 1, 3, tzinfo=UTC))):
        with pytest.raises(ValueError):
            call()


def test_backfill(spark):
    root = base(spark)
    jobs, states = Jobs(spark, f"{root}/jobs"), VersionedTable(spark, f"{root}/states")
    states.write(spark.createDataFrame([("i03", "INDEXED", 1, "h", "s", "m@1", "v1", 0, None), ("i04", "INDEXED", 1, "h", "s", "old", "v1", 2, 1)], STATE))
    items = spark.createDataFrame([(f"i{n:02d}",) for n in range(20)], "item_id string")
    assert jobs.request("w7", "backfill", 7).status == "REQUESTED"
    assert [r.job_id for r in jobs.requested().collect()] == ["w7"] and not jobs.ask("none", "PAUSED")
    left = iter([False, False, True])
    job = Backfill(spark, jobs, states, f"{root}/topic", pages=4, parts=3)
    paused = job.run("w7", items, 7, stop=lambda: next(left))
    assert paused.status == "PAUSED" and 0 < paused.scanned < 20 and paused.finished_at is None
    done = job.run("w7", items, 7)
    assert (done.status, done.scanned, done.published, done.skipped_up_to_date, done.cursor) == ("COMPLETED", 20, 19, 1, "i19")
    sent = ingest.parsed(spark.read.parquet(f"{root}/topic"))
    assert sent.where("reason IS NOT NULL").isEmpty()
    places = sorted((r.part, r.off) for r in sent.collect())
    assert len(set(places)) == 19 and all(off == 0 or (part, off - 1) in places for part, off in places)
    assert sorted(r.key for r in sent.collect()) == [f"i{n:02d}" for n in range(20) if n != 3]
    after = {r.item_id: (r.status, r.attempts, r.wave) for r in states.read().collect()}
    assert len(after) == 20 and after["i03"] == ("INDEXED", 0, 7) and after["i04"] == ("INDEXED", 2, 7) and after["i05"] == ("PENDING", 0, 7)
    assert jobs.request("w7", "backfill", 7, restart=True).cursor is None
    with pytest.raises(ValueError):
        jobs.finish("none", "FAILED")
