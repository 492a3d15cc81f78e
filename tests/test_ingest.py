"""Coalescing against a plain model, versioned tables, streaming replay, folds."""

import json
import random
import time
import uuid
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkRuntimeError
from pyspark.sql import functions as F

from scrivenry.functions import chunking
from scrivenry.operators import access, folds, ingest, metrics
from scrivenry.sources.keyed import KeyedTable
from scrivenry.sources.tables import ConflictError, VersionedTable, updated, upserted
from scrivenry.streaming import assemble, consumer

EVENTS = "event_id long, item_id string, event_type string, doc_version long, occurred_at long, arrival long"


def model(events):
    """The winner of each item, told plainly."""
    out = {}
    for item in {e[1] for e in events}:
        own = [e for e in events if e[1] == item]
        versioned = all(e[3] is not None for e in own)
        own.sort(key=lambda e: (e[3] if versioned else 0, e[4], e[5]))
        if own[-1][2] == "DELETE":
            out[item] = own[-1][0]
            continue
        last = max([i for i, e in enumerate(own) if e[2] == "DELETE"], default=-1)
        after = own[last + 1 :]
        upserts = [e for e in after if e[2] == "UPSERT"]
        out[item] = (upserts or after)[-1][0]
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["UPSERT", "DELETE", "ACL_CHANGE"]), st.sampled_from([None, 1, 2, 3]), st.integers(0, 3)), min_size=1, max_size=25))
def test_coalescing(spark, drawn):
    events = [(i, item, kind, version, at, i) for i, (item, kind, version, at) in enumerate(drawn)]
    got = {r.item_id: r.event_id for r in ingest.coalesced(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == model(events)


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        (None, "empty message value"), ("", "value is not valid JSON"), ("{", "value is not valid JSON"),
        ('{"schema_version":2,"event_type":"UPSERT","item_id":"a","occurred_at":"2024-01-01"}', "schema v1 violation: schema_version"),
        ('{"schema_version":1,"event_type":"X","item_id":"a","occurred_at":"2024-01-01"}', "schema v1 violation: event_type"),
        ('{"schema_version":1,"event_type":"UPSERT","item_id":"","occurred_at":"soon","doc_version":-1}', "schema v1 violation: item_id, doc_version, occurred_at"),
        ('{"schema_version":1,"event_type":"UPSERT","item_id":"a","occurred_at":"2024-01-01","more":1}', None),
    ],
)
def test_event_validation(spark, value, reason):
    assert ingest.parsed(spark.createDataFrame([(value,)], "value string")).first().reason == reason


def test_versions_switch_and_drop(spark):
    t = VersionedTable(spark, spark.conf.get("spark.checkpoint.dir") + "/t-" + uuid.uuid4().hex)
    with pytest.raises(ValueError, match="no version yet"):
        t.read()
    one = t.write(spark.range(3))
    two = t.write(spark.range(5), switch=False)
    assert t.read().count() == 3
    assert t.switch(two) == one
    assert t.read().count() == 5
    for args in ((two, 99), (one, 1)):
        with pytest.raises(ValueError, match="live|younger"):
            t.drop(*args)
    t.drop(one, 1, force=True)
    assert t.versions() == [two]
    with pytest.raises(ValueError, match="no version"):
        t.switch("v=unknown")


def test_upsert_and_update(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(map(tuple, upserted(old, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    again = upserted(upserted(old, new, "k"), new, "k")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, updated(old, new, "k").collect())) == [(1, "a"), (2, "B")]


def test_pointer_of_two_writers(spark):
    path = spark.conf.get("spark.checkpoint.dir") + "/t-" + uuid.uuid4().hex
    t, other = VersionedTable(spark, path), VersionedTable(spark, path)
    t.write(spark.range(1))
    number = t.pointer()
    version = t.write(spark.range(2), switch=False)
    other.write(spark.range(3))
    with pytest.raises(ConflictError):
        t.switch(version, expected=number)
    assert t.read().count() == 3

    seen = []

    def more(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            other.write(spark.range(7))  # comes first, so the change starts again
        return rows.union(spark.range(1))

    t.change(more)
    assert seen == [3, 7] and other.read().count() == 8
    with pytest.raises(ConflictError):
        t.change(lambda rows: other.write(rows) and rows, restarts=2)
    assert len(t.versions()) == len(set(t.versions())) and len(t._pointers()) == 2


def test_keyed_table(spark):
    schema = "k string, item string, v long"
    t = KeyedTable(spark, spark.conf.get("spark.checkpoint.dir") + "/k-" + uuid.uuid4().hex, schema, "k", bucket_by="item", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert t.read().count() == 0
    t.write(rows(*((f"k{i}", f"i{i % 5}", i) for i in range(20))))
    t.write(rows(("k3", "i3", 99), ("n", "i9", 1)), rows(("k4", "i4", 0), ("absent", "i4", 0)).drop("v"))
    expected = {f"k{i}": i for i in range(20) if i != 4} | {"k3": 99, "n": 1}
    for _ in range(2):
        assert {r.k: r.v for r in t.read().collect()} == expected
        some = t.read(spark.createDataFrame([("i3",), ("i4",), ("none",)], "item string"))
        assert {r.k for r in some.collect()} == {k for k in expected if k != "n" and int(k[1:]) % 5 in (3, 4)}
        t.compact()
        assert len(t.batches()) == 1
    guarded = KeyedTable(spark, t.path + "-v", schema, "k", order="v")
    guarded.write(rows(("a", "i", 5)))
    guarded.write(rows(("a", "late", 3)))
    assert [tuple(r) for r in guarded.read().collect()] == [("a", "i", 5)]


def test_compaction_keeps_each_rows_place_and_leaves_files_to_readers(spark):
    schema = "k string, item string, v long"
    t = KeyedTable(spark, spark.conf.get("spark.checkpoint.dir") + "/k-" + uuid.uuid4().hex, schema, "k", bucket_by="item", buckets=2)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    first = t.write(rows(("a", "i", 1), ("c", "i", 1)))
    late = f"_batch={int(first[7:27]) + 1:020d}-late"
    t.write(rows(("b", "i", 1)), rows(("c", "i", 0)).drop("v"))
    reading = t.read()
    t.compact()
    assert len(t.batches()) == 1 and len(t._finished()) == 3
    assert {(r.k, r.v) for r in reading.collect()} == {("a", 1), ("b", 1)}  # its files are still there
    # A batch that began after the first one and ends after the compaction: newer than the row of a, older than the deletion of c.
    t._fs.rename(t._at(t.write(rows(("a", "i", 2), ("c", "i", 2)))), t._at(late))
    assert {(r.k, r.v) for r in t.read().collect()} == {("a", 2), ("b", 1)}
    for _ in range(2):
        t.compact(keep=0)
        assert {(r.k, r.v) for r in t.read().collect()} == {("a", 2), ("b", 1)}
        assert len(t._finished()) == 1


def event(item, kind, version=None, second=0, event_id=None):
    fields = {"schema_version": 1, "event_type": kind, "item_id": item, "occurred_at": f"2024-01-01T00:00:{second:02}"} | ({"doc_version": version} if version is not None else {}) | ({"event_id": event_id} if event_id else {})
    return json.dumps(fields)


class Setting:
    """A worker over four documents, with its topics and tables in one folder."""

    def __init__(self, spark, **more):
        self.spark, self.root, self.at, self.sent = spark, spark.conf.get("spark.checkpoint.dir") + "/w-" + uuid.uuid4().hex, 1_000, 0
        self.states = KeyedTable(spark, f"{self.root}/states", consumer.STATE, "item_id", order="doc_version", buckets=2)
        self.chunks = KeyedTable(spark, f"{self.root}/chunks", consumer.CHUNK, "chunk_id", bucket_by="item_id", buckets=2)
        self.texts = {"a": (1, ["first page of a", "second page of a"]), "b": (1, ["page of b"]), "c": (1, ["..."])}
        self.groups = ["red"]

    def worker(self, **more):
        docs = [(i, v, f"t{i}{v}{p}", f"m{i}{self.groups}", i != "d", "type", ["x"], ["u"], self.groups, date(2024, 1, 1)) for i, (v, p) in self.texts.items()]
        documents = self.spark.createDataFrame(docs, "item_id string, version long, text_hash string, meta_hash string, usable boolean, doc_type string, tags array<string>, acl_users array<string>, acl_groups array<string>, created_at date")
        pages = self.spark.createDataFrame([(i, n, t) for i, (_, own) in self.texts.items() for n, t in enumerate(own, 1)], "item_id string, page_no long, page string")
        return consumer.Consumer(self.spark, documents, self.states, f"{self.root}/dlq", f"{self.root}/retry", self.chunks, pages, clock=lambda: self.at, **more)

    def run(self, *values, topic="live", **more):
        rows = [(topic, 0, self.sent + n, json.loads(v)["item_id"], v, 0, None, None) for n, v in enumerate(values)]
        self.sent += len(rows)
        if rows:
            consumer.send(self.spark.createDataFrame(rows, consumer.MESSAGE), f"{self.root}/{topic}")
        self.worker(**more).start(consumer.read_topic(self.spark, f"{self.root}/{topic}", 10), f"{self.root}/checkpoint-{topic}").awaitTermination()

    def content(self):
        return {(r.item_id, r.content) for r in self.chunks.read().collect()}

    def state(self, item):
        return next((r for r in self.states.read().collect() if r.item_id == item), None)


def test_worker_writes_refreshes_and_deletes_chunks(spark):
    s = Setting(spark)
    s.run(event("a", "UPSERT"), event("b", "UPSERT"), event("c", "UPSERT"))
    assert {i for i, _ in s.content()} == {"a", "b"} and s.state("a").status == "INDEXED" and s.state("c").status == "SKIPPED"
    assert all(len(r.embedding) == 8 and r.embedding_model == "m@1" and r.acl_groups == ["red"] for r in s.chunks.read().collect())
    before = {r.chunk_id for r in s.chunks.read().collect()}
    s.groups = ["blue"]
    s.run(event("a", "ACL_CHANGE"))
    rows = s.chunks.read().collect()
    assert {r.chunk_id for r in rows} == before
    assert {r.item_id: r.acl_groups for r in rows} == {"a": ["blue"], "b": ["red"]} and s.state("a").state_hash == "ma['blue']"
    s.texts["a"] = (2, ["another text"])
    s.run(event("a", "UPSERT", 2))
    assert {c for i, c in s.content() if i == "a"} == {"another text"} and s.state("a").doc_version == 2
    s.run(event("a", "UPSERT", 1, 1), event("b", "DELETE", 1, 2))  # late for a
    del s.texts["b"]
    s.run(event("b", "DELETE", 1, 3))
    assert {i for i, _ in s.content()} == {"a"} and s.state("b").status == "DELETED"


def test_worker_waits_for_a_missing_source(spark):
    s = Setting(spark)
    s.run(event("x", "UPSERT", 1, event_id="e1"))
    retry = lambda: spark.read.schema(consumer.MESSAGE).parquet(f"{s.root}/retry").orderBy("retry_count", "not_before").collect()
    assert s.state("x") is None
    assert [(r.retry_count, r.not_before, r.origin, r.key) for r in retry()] == [(1, 1_060, "live/0/0", "x")]
    s.run(topic="retry")  # not due yet: it comes back as it is
    assert [(r.retry_count, r.not_before) for r in retry()] == [(1, 1_060), (1, 1_060)]
    s.at, s.texts["x"] = 2_000, (1, ["text of x"])
    s.run(topic="retry")
    assert ("x", "text of x") in s.content() and s.state("x").status == "INDEXED"
    s.run(event("y", "UPSERT", 1, event_id="e2"))
    for n in range(ingest.MAX_RETRIES):
        s.at += 100
        s.run(topic="retry")
    assert s.state("y").status == "DELETED"
    assert max(r.retry_count for r in retry() if r.key == "y") == ingest.MAX_RETRIES


def test_one_batch_equals_many(spark):
    documents = spark.createDataFrame([(f"i{i}", 5, f"t{i}", f"m{i}", True) for i in range(6)], "item_id string, version long, text_hash string, meta_hash string, usable boolean")
    start = spark.createDataFrame([("i0", "INDEXED", 9, "m@1", "v1", "m0", "t0", 1, 0), ("i1", "FAILED", 1, None, None, None, None, 2, 3)], consumer.STATE)
    values = [(0, "UPSERT", 3), (1, "UPSERT", 5), (2, "DELETE", 2), (3, "UPSERT", 5), (7, "DELETE", 4), (4, "ACL_CHANGE", 1)]
    rows = [("live", 0, n, f"i{i}", event(f"i{i}", k, v, v), 0, 0, None) for n, (i, k, v) in enumerate(values)] + [("live", 0, 90, "i9", "{", 0, 0, None), ("live", 0, 91, "other", event("i1", "DELETE", 9), 0, 0, None)]
    results = []
    for files in (1, 4):
        base = spark.conf.get("spark.checkpoint.dir") + "/s-" + uuid.uuid4().hex
        consumer.send(spark.createDataFrame(rows, consumer.MESSAGE).repartition(files), f"{base}/live")
        states = KeyedTable(spark, f"{base}/states", consumer.STATE, "item_id", order="doc_version", buckets=2)
        states.write(start)
        worker = consumer.Consumer(spark, documents, states, f"{base}/dlq")
        for _ in range(2):  # the second run finds nothing new: a restart changes nothing
            worker.start(consumer.read_topic(spark, f"{base}/live"), f"{base}/checkpoint").awaitTermination()
        results.append(sorted((r.item_id, r.status, r.doc_version, r.attempts) for r in states.read().collect()))
        assert spark.read.parquet(f"{base}/dlq").count() == 2
    assert results[0] == results[1]
    assert ("i0", "INDEXED", 9, 0) in results[0]  # a late event changes nothing
    assert ("i1", "INDEXED", 5, 0) in results[0]
    assert ("i2", "PENDING", None, 0) in results[0]  # a delete older than the document


def test_numbered_rows(spark):
    rows = spark.range(1_000).select((F.col("id") * 7919 % 1_000).alias("x"), F.col("id"))
    got = ingest.numbered(rows, "x").collect()
    assert sorted(r.turn for r in got) == [*range(1, 1_001)] and all(r.turn == r.x + 1 for r in got)


def test_folds(spark):
    rows = [("a", float(t), i, ok) for i, (t, ok) in enumerate([(0, True), (10, False), (20, False), (30, False), (40, True), (99_999, True), (100_000, True)])]
    df = spark.createDataFrame(rows, "key string, at double, event_id long, ok boolean")
    value = lambda d: [r.value for r in d.orderBy("event_id").collect()]
    assert value(folds.rate_limited(df, 2, 60)) == [True, True, False, False, False, True, True]
    assert value(folds.breaker(df)) == ["closed"] * 4 + ["open", "half-open", "closed"]
    assert value(folds.adaptive_limit(df)) == [8, 4, 2, 1, 1, 1, 1]
    assert value(folds.token_bucket(df.withColumn("cost", F.lit(30.0)), 1.0, 50.0)) == [0.0, 0.0, 20.0, 40.0, 60.0, 0.0, 9.0]


def test_answer_stream():
    assert assemble.released(["NOT_", "FOUND", "."], 2) == ["", "", "", ""]
    assert "".join(assemble.released(["One [1", "]. Two [9]", ". Three"], 2)) == "One [1]. Two . Three"


@pytest.mark.parametrize(("error", "times", "calls"), [(OSError("gone"), 2, 3), (PySparkRuntimeError("lost"), 2, 3), (Py4JError("connection"), 1, 2), (OSError("gone"), 9, 3), (AnalysisException("no such column"), 9, 1), (ValueError("bug"), 9, 1)])
def test_passing_errors_are_tried_again(spark, tmp_path, error, times, calls):
    done, waits = [], []
    worker = consumer.Consumer(spark, None, None, str(tmp_path), pause=waits.append)

    def process(batch, batch_id):
        done.append(batch_id)
        if len(done) <= times:
            raise error

    worker._process = process
    if times < calls:
        worker.handle(None, 7)
    else:
        with pytest.raises(type(error)):
            worker.handle(None, 7)
    assert done == [7] * calls and waits == [2**i for i in range(calls - 1)]


def test_errors_of_spark_are_told_apart(spark, tmp_path):
    with pytest.raises(Exception) as missing:
        spark.read.schema("a int").parquet(str(tmp_path / "none")).count()
    assert consumer.is_permanent(missing.value)
    (tmp_path / "file").write_text("not a folder")
    with pytest.raises(Exception) as failing:
        spark.range(5).write.mode("append").parquet(str(tmp_path / "file" / "x"))
    assert not consumer.is_permanent(failing.value)


def test_reconcile_by_digests_joins_few_rows(spark):
    n = 3000
    documents = spark.range(n).selectExpr("concat('D', id) AS item_id", "id % 5 + 1 AS version", "concat('m', id) AS meta_hash")
    states = documents.selectExpr("item_id", "'INDEXED' AS status", "version AS doc_version", "'m@1' AS embedding_model", "'v1' AS chunker_version", "meta_hash AS state_hash")
    assert ingest.differing_ranges(documents, states, "m@1", "v1", 50).count() == 0
    changed = states.where("item_id NOT IN ('D7', 'D8')").withColumn("state_hash", F.when(F.col("item_id") == "D9", "old").otherwise(F.col("state_hash")))
    gone = spark.createDataFrame([("X1", "INDEXED", 1, "m@1", "v1", "x"), ("X2", "DELETED", 1, "m@1", "v1", "x")], states.schema)
    changed = changed.unionByName(gone)
    assert ingest.differing_ranges(documents, changed, "m@1", "v1", 50).count() <= 4
    got = {tuple(r) for r in ingest.reconciled_by_digest(documents, changed, "m@1", "v1").collect()}
    assert got == {tuple(r) for r in ingest.reconciled(documents, changed, "m@1", "v1").collect()}
    assert {r[1] for r in got} == {"missing_state", "permission_mismatch", "orphan"}
    assert ingest.reconciled_by_digest(documents.limit(0), gone, "m@1", "v1").count() == 1


def plain_rate(samples, start, over):
    """Increase by the rules, one window at a time."""
    s = sorted((t, v) for t, v in samples if start <= t < start + over)
    if len(s) < 2:
        return None
    grown = s[-1][1] - s[0][1] + sum(a[1] for a, b in zip(s, s[1:], strict=False) if b[1] < a[1])
    spread = s[-1][0] - s[0][0]
    mean = spread / (len(s) - 1)
    before, after = s[0][0] - start, start + over - s[-1][0]
    before, after = (x if x < 1.1 * mean else mean / 2 for x in (before, after))
    if grown > 0:
        before = min(before, spread * s[0][1] / grown)
    return grown * (spread + before + after) / spread


def test_counter_rates_with_resets(spark):
    rng = random.Random(16)
    rows = []
    for series in range(6):
        value, at = 0, rng.randrange(60)
        while at < 2000:
            rows.append((series, at, float(value)))
            at += rng.choice([15, 15, 16, 200])
            value = 0 if rng.random() < 0.1 else value + rng.randrange(4)
    found = {(r.series, r.start): (r.samples, r.increase, r.rate) for r in metrics.counter_rates(spark.createDataFrame([*rows, rows[0]], "series int, at long, value double"), 300, 60, ["series"]).collect()}
    for series in range(6):
        own = [(t, v) for s, t, v in rows if s == series]
        for start in range(-240, 2040, 60):
            wanted = plain_rate(own, start, 300)
            assert (found.get((series, start)) is None) == (wanted is None)
            if wanted is not None:
                assert found[series, start][1:] == (pytest.approx(wanted), pytest.approx(wanted / 300))
    with pytest.raises(ValueError):
        metrics.counter_rates(spark.createDataFrame([], "at long, value double"), 100, 60, [])


def test_rights_bitmaps_equal_lists(spark):
    rng = random.Random(17)
    rows = [(f"c{i}", [f"u{rng.randrange(9)}"] if rng.random() < 0.5 else None, [f"g{rng.randrange(5)}" for _ in range(rng.randrange(3))]) for i in range(500)]
    passages = spark.createDataFrame(rows, "chunk_id string, acl_users array<string>, acl_groups array<string>").repartition(3)
    people = spark.createDataFrame([(q, f"u{q}", [f"g{q % 5}"] * (q % 2)) for q in range(8)] + [(50, "nobody", [])], "qid long, user_id string, groups array<string>")
    index = access.rights_index(passages)
    seen = {(r.qid, r.chunk_id) for r in access.visible_pairs(passages, people).collect()}
    everything = people.select("qid").crossJoin(passages.select("chunk_id"))
    assert {tuple(r) for r in access.admitted_by_index(everything, index, people).collect()} == seen
    assert {r.qid: r.n for r in access.visible_counts(index, people).collect()} == {q: sum(a == q for a, _ in seen) for q in [*range(8), 50]}


def test_live_work_finishes_while_a_backfill_is_under_way(spark):
    """Two loops in one application, each with its pool and its share of files; both write the same tables."""
    s = Setting(spark)
    s.texts |= {f"old{i}": (1, [f"page of old{i}"]) for i in range(6)}
    pools, ended = {}, {}

    def loop(name, pause):
        def split(pages):
            pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            time.sleep(pause)
            return chunking.chunked(pages)

        return s.worker(split=split)

    for i in range(6):
        consumer.send(spark.createDataFrame([("backfill", 0, i, f"old{i}", event(f"old{i}", "UPSERT", 1), 0, None, None)], consumer.MESSAGE).coalesce(1), f"{s.root}/backfill")
    consumer.send(spark.createDataFrame([("live", 0, 0, "a", event("a", "UPSERT", 1), 0, None, None)], consumer.MESSAGE).coalesce(1), f"{s.root}/live")
    slow = loop("backfill", 4).start(consumer.read_topic(spark, f"{s.root}/backfill", 1), f"{s.root}/c-backfill", pool="backfill")
    fast = loop("live", 0).start(consumer.read_topic(spark, f"{s.root}/live", 100), f"{s.root}/c-live", pool="live")
    assert fast.awaitTermination(120)
    ended["live"] = slow.isActive
    slow.awaitTermination(240)
    assert ended["live"], "the backfill was over before the live event was done"
    assert pools == {"backfill": "backfill", "live": "live"} and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert {r.item_id: r.status for r in s.states.read().collect()} == {i: "INDEXED" for i in ("a", *(f"old{i}" for i in range(6)))}
    assert {r.item_id for r in s.chunks.read().collect()} == {"a", *(f"old{i}" for i in range(6))}
