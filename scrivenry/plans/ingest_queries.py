"""Queries over events, states and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.staging import scratch
from ..sources.tables import VersionedTable
from . import fixtures as fx
from .registry import query

MODEL, CHUNKER = "m@1", "v1"


def documents(spark, sf):
    return fx.meta(spark, sf).withColumn("usable", F.col("doc_id") % 37 != 0)


def work(spark, sf):
    return ingest.coalesced(fx.index_event(spark, sf))


_VALUE = """msg AS (SELECT event_id, item_id, key, CASE WHEN corrupt THEN '{"schema_version":' WHEN event_id % 53 = 0 THEN '{"schema_version":2,"event_type":"UPSERT","item_id":"' || item_id || '","occurred_at":"2024-01-01T00:00:00"}'
 WHEN event_id % 59 = 0 THEN '{"schema_version":1,"event_type":"MOVE","item_id":"","doc_version":-1,"occurred_at":"2024-01-01T00:00:00"}' ELSE '{"schema_version":1,"event_type":"' || event_type || '","item_id":"' || item_id || '","doc_version":' || doc_version || ',"occurred_at":"2024-01-01T00:00:00","extra":1}' END AS value, corrupt FROM message),
 checked AS (SELECT *, CASE WHEN corrupt THEN 'value is not valid JSON' WHEN event_id % 53 = 0 THEN 'schema v1 violation: schema_version' WHEN event_id % 59 = 0 THEN 'schema v1 violation: event_type, item_id, doc_version' END AS reason FROM msg)"""


def raw(spark, sf):
    value = F.expr("""CASE WHEN corrupt THEN '{"schema_version":' WHEN event_id % 53 = 0 THEN concat('{"schema_version":2,"event_type":"UPSERT","item_id":"', item_id, '","occurred_at":"2024-01-01T00:00:00"}')
 WHEN event_id % 59 = 0 THEN '{"schema_version":1,"event_type":"MOVE","item_id":"","doc_version":-1,"occurred_at":"2024-01-01T00:00:00"}' ELSE concat('{"schema_version":1,"event_type":"', event_type, '","item_id":"', item_id, '","doc_version":', doc_version, ',"occurred_at":"2024-01-01T00:00:00","extra":1}') END""")
    return ingest.parsed(fx.message(spark, sf).withColumn("value", value))


@query("b08_event_validation", fx.sql(f"WITH {_VALUE} SELECT event_id, reason FROM checked", "message"))
def b08(spark, sf):
    return raw(spark, sf).select("event_id", "reason")


@query("b09_key_check", fx.sql("SELECT event_id, key = item_id AS ok FROM message", "message"))
def b09(spark, sf):
    return fx.message(spark, sf).select("event_id", ingest.key_matches(F.col("key"), F.col("item_id")).alias("ok"))


@query("i03_invalid_to_dlq", fx.sql(f"WITH {_VALUE} SELECT event_id, sha256(value) AS original, coalesce(reason, 'key differs from item_id') AS reason FROM checked WHERE reason IS NOT NULL OR key <> item_id", "message"))
def i03(spark, sf):
    r = raw(spark, sf).withColumn("why", F.coalesce("reason", F.when(~ingest.key_matches(F.col("key"), F.col("event.item_id")), "key differs from item_id")))
    return r.where("why IS NOT NULL").select("event_id", F.sha2("value", 256).alias("original"), F.col("why").alias("reason"))


@query("b11_stale", fx.sql("SELECT item_id, version < s.doc_version AS stale FROM src_doc JOIN index_state s USING (item_id)", "src_doc", "index_state"))
def b11(spark, sf):
    j = fx.src_doc(spark, sf).join(fx.index_state(spark, sf), "item_id")
    return j.select("item_id", ingest.is_stale(F.col("version"), F.col("doc_version")).alias("stale"))


@query("b12_unchanged", fx.sql("SELECT item_id, status = 'INDEXED' AND content_hash = text_hash AND embedding_model = 'm@1' AND chunker_version = 'v1' AS same FROM meta JOIN index_state USING (item_id)", "meta", "index_state"))
def b12(spark, sf):
    j = fx.meta(spark, sf).join(fx.index_state(spark, sf), "item_id")
    return j.select("item_id", ingest.is_unchanged(F.col("content_hash"), F.col("text_hash"), MODEL, CHUNKER).alias("same"))


@query("b13_up_to_date", fx.sql("SELECT item_id, status = 'INDEXED' AND embedding_model = 'm@1' AND chunker_version = 'v1' AS current FROM index_state", "index_state"))
def b13(spark, sf):
    return fx.index_state(spark, sf).select("item_id", ingest.is_up_to_date(MODEL, CHUNKER).alias("current"))


_NOW = 1_705_363_200


@query("b14_not_due", fx.sql(f"SELECT event_id, not_before > {_NOW} AS waits FROM message", "message"))
def b14(spark, sf):
    return fx.message(spark, sf).select("event_id", (F.col("not_before") > _NOW).alias("waits"))


@query("i09_head_of_line", fx.sql(f"SELECT event_id, max(not_before) OVER (PARTITION BY topic, part ORDER BY off ROWS UNBOUNDED PRECEDING) <= {_NOW} AS due FROM message", "message"))
def i09(spark, sf):
    return ingest.held_back(fx.message(spark, sf), F.lit(_NOW)).select("event_id", "due")


_RETRY = """failed AS (SELECT event_id, retry_count, event_id % 3 <> 0 AS retryable FROM message WHERE event_id % 11 = 0)"""


def failures(spark, sf):
    failed = fx.message(spark, sf).where("event_id % 11 = 0").selectExpr("event_id", "retry_count", "event_id % 3 <> 0 AS retryable")
    return ingest.retried(failed, F.lit(_NOW))


@query("i08_retry_topic", fx.sql(f"WITH {_RETRY} SELECT event_id, retry_count + 1 AS retries, {_NOW} + 60 AS due_at FROM failed WHERE retryable AND retry_count < 5", "message"))
def i08(spark, sf):
    return failures(spark, sf).where(F.col("to") == "retry").select("event_id", "retries", "due_at")


@query("i10_dead_letter", fx.sql(f"WITH {_RETRY} SELECT event_id, CASE WHEN retryable THEN 'retries exhausted' ELSE 'non-retryable error' END AS reason FROM failed WHERE NOT retryable OR retry_count >= 5", "message"))
def i10(spark, sf):
    return failures(spark, sf).where(F.col("to") == "dlq").select("event_id", "reason")


@query("d17_dlq_by_reason", fx.sql("SELECT CASE event_id % 4 WHEN 0 THEN 'invalid event' WHEN 1 THEN 'retries exhausted' WHEN 2 THEN 'non-retryable error' ELSE 'unknown' END AS reason, count(*) AS n FROM message GROUP BY 1", "message"))
def d17(spark, sf):
    reason = F.expr("CASE event_id % 4 WHEN 0 THEN 'invalid event' WHEN 1 THEN 'retries exhausted' WHEN 2 THEN 'non-retryable error' END")
    return fx.message(spark, sf).groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


@query("i11_dlq_replay", fx.sql("SELECT event_id FROM message WHERE NOT corrupt AND key = item_id AND event_id % 10 = 0 AND event_id NOT IN (SELECT event_id FROM message WHERE event_id % 30 = 0)", "message"))
def i11(spark, sf):
    m = fx.message(spark, sf)
    return ingest.to_replay(m.where("event_id % 10 = 0"), m.where("event_id % 30 = 0")).select("event_id")


_ORDER = """placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN v THEN doc_version END, occurred_at, arrival) AS position FROM (SELECT *, bool_and(doc_version IS NOT NULL) OVER (PARTITION BY item_id) AS v FROM index_event)),
 marked AS (SELECT *, max(CASE WHEN event_type = 'DELETE' THEN position END) OVER (PARTITION BY item_id) AS last_del, count(*) OVER (PARTITION BY item_id) AS members FROM placed),
 pick AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN last_del = members THEN CASE WHEN position = last_del THEN 0 ELSE 9 END WHEN position > coalesce(last_del, 0) AND event_type = 'UPSERT' THEN 0 WHEN position > coalesce(last_del, 0) THEN 1 ELSE 9 END, position DESC) AS r FROM marked),
 w AS (SELECT item_id, event_id, event_type, doc_version, members FROM pick WHERE r = 1)"""


@query("f07_event_order", fx.sql(f"WITH {_ORDER} SELECT event_id, position FROM placed", "index_event"))
def f07(spark, sf):
    return ingest.ordered_events(fx.index_event(spark, sf)).select("event_id", "position")


@query("e05_after_last_delete", fx.sql(f"WITH {_ORDER} SELECT event_id FROM marked WHERE position > coalesce(last_del, 0)", "index_event"))
def e05(spark, sf):
    placed = ingest.ordered_events(fx.index_event(spark, sf))
    last = F.max(F.when(F.col("event_type") == "DELETE", F.col("position"))).over(Window.partitionBy("item_id"))
    return placed.withColumn("last", last).where(F.col("position") > F.coalesce("last", F.lit(0))).select("event_id")


@query("i05_coalesce", fx.sql(f"WITH {_ORDER} SELECT item_id, event_id, event_type, doc_version, members FROM w", "index_event"))
def i05(spark, sf):
    return work(spark, sf)


@query("d04_group_winner", fx.sql(f"WITH {_ORDER} SELECT item_id, event_id FROM w", "index_event"))
def d04(spark, sf):
    return work(spark, sf).select("item_id", "event_id")


@query("d05_group_retries", fx.sql("SELECT item_id, max(retry_count) AS retries, array_to_string(list_sort(list(DISTINCT topic || '/' || part)), ',') AS partitions FROM message GROUP BY item_id", "message"))
def d05(spark, sf):
    parts = F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "topic", "part"))), ",")
    return fx.message(spark, sf).groupBy("item_id").agg(F.max("retry_count").alias("retries"), parts.alias("partitions"))


@query("f06_work_priority", fx.sql(f"WITH {_ORDER} SELECT item_id, row_number() OVER (ORDER BY CASE event_type WHEN 'DELETE' THEN 0 WHEN 'ACL_CHANGE' THEN 1 ELSE 2 END, event_id) AS turn FROM w", "index_event"))
def f06(spark, sf):
    w = work(spark, sf)
    return ingest.numbered(w.select("item_id", ingest.priority(F.col("event_type")).alias("p"), "event_id"), "p", "event_id").select("item_id", "turn")


@query("i06_batch_priority", fx.sql(f"WITH {_ORDER} SELECT event_type, count(*) AS n, CASE event_type WHEN 'DELETE' THEN 0 WHEN 'ACL_CHANGE' THEN 1 ELSE 2 END AS priority FROM w GROUP BY event_type", "index_event"))
def i06(spark, sf):
    return work(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("priority", ingest.priority(F.col("event_type")).cast("int"))


@query("e06_committable", fx.sql("SELECT topic, part, coalesce(min(off) FILTER (WHERE off % 40 = 39), max(off) + 1) AS next FROM message GROUP BY topic, part", "message"))
def e06(spark, sf):
    return ingest.committable(fx.message(spark, sf).withColumn("done", F.col("off") % 40 != 39))


@query("i02_contiguous_commit", fx.sql("SELECT topic, part, coalesce(min(off) FILTER (WHERE corrupt), max(off) + 1) AS next FROM message GROUP BY topic, part", "message"))
def i02(spark, sf):
    return ingest.committable(fx.message(spark, sf).withColumn("done", ~F.col("corrupt")))


_OUT = f"""{_ORDER}, d AS (SELECT item_id, version, text_hash, meta_hash, doc_id % 37 <> 0 AS usable, true AS present FROM meta), s AS (SELECT item_id, status, doc_version AS stored, embedding_model, chunker_version, state_hash, content_hash FROM index_state),
 j AS (SELECT *, coalesce(version, doc_version) AS ver, coalesce(status = 'INDEXED' AND content_hash = text_hash AND embedding_model = 'm@1' AND chunker_version = 'v1', false) AS same FROM w LEFT JOIN d USING (item_id) LEFT JOIN s USING (item_id)),
 o AS (SELECT item_id, event_type, CASE WHEN event_type = 'DELETE' AND coalesce(version > doc_version, false) THEN 'stale' WHEN event_type = 'DELETE' THEN CASE WHEN coalesce(doc_version < stored, false) THEN 'stale' ELSE 'deleted' END
 WHEN present IS NULL AND members < 5 THEN 'missing' WHEN present IS NULL THEN CASE WHEN coalesce(doc_version < stored, false) THEN 'stale' ELSE 'deleted' END WHEN coalesce(ver < stored, false) THEN 'stale' WHEN NOT usable THEN 'skipped'
 WHEN same AND state_hash = meta_hash THEN 'unchanged' WHEN same THEN 'metadata_refreshed' ELSE 'indexed' END AS outcome, CASE WHEN event_type = 'DELETE' THEN doc_version ELSE ver END AS version FROM j)"""


def results(spark, sf):
    return ingest.outcomes(work(spark, sf), documents(spark, sf), fx.index_state(spark, sf), MODEL, CHUNKER, F.col("members") >= 5)


@query("i14_outcome", fx.sql(f"WITH {_OUT} SELECT item_id, event_type, outcome, version FROM o", "index_event", "meta", "index_state"))
def i14(spark, sf):
    return results(spark, sf)


@query("c06_event_source_state", fx.sql(f"WITH {_OUT} SELECT item_id, event_id, version, stored FROM j", "index_event", "meta", "index_state"))
def c06(spark, sf):
    d, s = fx.meta(spark, sf).select("item_id", "version"), fx.index_state(spark, sf).select("item_id", F.col("doc_version").alias("stored"))
    return work(spark, sf).join(d, "item_id", "left").join(s, "item_id", "left").select("item_id", "event_id", "version", "stored")


@query("i12_stale_events", fx.sql(f"WITH {_OUT} SELECT item_id FROM o WHERE outcome = 'stale'", "index_event", "meta", "index_state"))
def i12(spark, sf):
    return results(spark, sf).where("outcome = 'stale'").select("item_id")


@query("i13_missing_source", fx.sql("SELECT item_id, count(*) >= 60 AS exhausted FROM index_event WHERE item_id NOT IN (SELECT item_id FROM src_doc WHERE doc_id % 2 = 0) GROUP BY item_id", "index_event", "src_doc"))
def i13(spark, sf):
    present = fx.src_doc(spark, sf).where("doc_id % 2 = 0")
    return ingest.missing_sources(fx.index_event(spark, sf), present, 60).select("item_id", "exhausted")


@query("i15_state_transitions", fx.sql(f"""WITH {_OUT} SELECT item_id, CASE WHEN outcome IN ('indexed', 'unchanged', 'metadata_refreshed') THEN 'INDEXED' WHEN outcome = 'deleted' THEN 'DELETED' WHEN outcome = 'skipped' THEN 'SKIPPED' ELSE coalesce(status, 'PENDING') END AS status,
 CASE WHEN outcome IN ('indexed', 'deleted', 'skipped') THEN greatest(o.version, doc_version) ELSE doc_version END AS doc_version, wave, CASE WHEN outcome IN ('indexed', 'deleted', 'skipped') THEN 0 ELSE coalesce(attempts, 0) END AS attempts
 FROM index_state FULL JOIN o USING (item_id)""", "index_event", "meta", "index_state"))
def i15(spark, sf):
    return ingest.next_state(fx.index_state(spark, sf), results(spark, sf))


@query("c02_document_state", fx.sql("SELECT item_id, version, s.status FROM src_doc LEFT JOIN index_state s USING (item_id)", "src_doc", "index_state"))
def c02(spark, sf):
    return fx.src_doc(spark, sf).join(fx.index_state(spark, sf), "item_id", "left").select("item_id", "version", "status")


@query("c03_orphan_states", fx.sql("SELECT item_id FROM index_state WHERE item_id NOT IN (SELECT item_id FROM src_doc)", "src_doc", "index_state"))
def c03(spark, sf):
    return fx.index_state(spark, sf).join(fx.src_doc(spark, sf), "item_id", "left_anti").select("item_id")


@query("g04_candidates_minus_present", fx.sql("SELECT item_id FROM index_event EXCEPT SELECT item_id FROM index_state", "index_event", "index_state"))
def g04(spark, sf):
    return fx.index_event(spark, sf).select("item_id").subtract(fx.index_state(spark, sf).select("item_id"))


_KEEP = "keep AS (SELECT chunk_id FROM chunk WHERE chunk_no % 3 <> 1)"


@query("c04_stale_chunks", fx.sql(f"WITH {_KEEP} SELECT chunk_id FROM chunk WHERE doc_id % 2 = 0 AND chunk_id NOT IN (SELECT chunk_id FROM keep)", "chunk"))
def c04(spark, sf):
    c = fx.chunk(spark, sf)
    return c.where("doc_id % 2 = 0").join(c.where("chunk_no % 3 <> 1"), "chunk_id", "left_anti").select("chunk_id")


@query("g06_keep_set", fx.sql(f"WITH {_KEEP} SELECT chunk_id FROM chunk EXCEPT SELECT chunk_id FROM keep", "chunk"))
def g06(spark, sf):
    c = fx.chunk(spark, sf).select("chunk_id", "chunk_no")
    return c.join(c.where("chunk_no % 3 <> 1"), "chunk_id", "left_anti").select("chunk_id")


@query("g02_shingle_sets", fx.sql("SELECT doc_id, len(list_intersect(tags, ['en', 'long', 'x'])) AS common, len(list_distinct(list_concat(tags, ['en', 'long', 'x']))) AS together FROM src_doc", "src_doc"))
def g02(spark, sf):
    other = F.array(F.lit("en"), F.lit("long"), F.lit("x"))
    return fx.src_doc(spark, sf).select("doc_id", F.size(F.array_intersect("tags", other)).alias("common"), F.size(F.array_union("tags", other)).alias("together"))


@query("g03_page_overlap", "SELECT doc_id, list_has_any(range(doc_id % 9, doc_id % 9 + 3), range(doc_id % 5, doc_id % 5 + 2)) AS overlap FROM documents")
def g03(spark, sf):
    span = lambda m, n: F.expr(f"sequence(doc_id % {m}, doc_id % {m} + {n - 1})")
    return fx.table(spark, sf, "documents").select("doc_id", F.arrays_overlap(span(9, 3), span(5, 2)).alias("overlap"))


@query("g05_missing_indices", "SELECT doc_id, array_to_string(list_filter(range(doc_id % 9, doc_id % 9 + 6), lambda i: NOT list_contains(range(doc_id % 5, doc_id % 5 + 7), i)), ',') AS missing FROM documents")
def g05(spark, sf):
    span = lambda m, n: F.expr(f"sequence(doc_id % {m}, doc_id % {m} + {n - 1})")
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_except(span(9, 6), span(5, 7)), ",").alias("missing"))


@query("g07_distinct_in_order", "SELECT doc_id, CASE WHEN doc_id % 7 = doc_id % 3 THEN 'g' || (doc_id % 7) ELSE 'g' || (doc_id % 7) || ',g' || (doc_id % 3) END AS groups FROM documents")
def g07(spark, sf):
    return fx.src_doc(spark, sf).select("doc_id", F.array_join(F.array_distinct("acl_groups"), ",").alias("groups"))


@query("k10_backfill_split", fx.sql("SELECT item_id, coalesce(status = 'INDEXED' AND embedding_model = 'm@1' AND chunker_version = 'v1', false) AS skipped FROM src_doc LEFT JOIN index_state USING (item_id)", "src_doc", "index_state"))
def k10(spark, sf):
    return fx.src_doc(spark, sf).join(fx.index_state(spark, sf), "item_id", "left").select("item_id", ingest.is_up_to_date(MODEL, CHUNKER).alias("skipped"))


_DIFF = """diff AS (SELECT item_id, CASE WHEN status IS NULL THEN 'missing_state' WHEN status = 'FAILED' THEN 'failed' WHEN status = 'PENDING' THEN 'pending' WHEN status = 'DELETED' THEN 'resurrected' WHEN version <> doc_version THEN 'version_mismatch'
 WHEN status = 'INDEXED' AND (embedding_model <> 'm@1' OR chunker_version <> 'v1') THEN 'stale_model' WHEN status = 'INDEXED' AND state_hash <> meta_hash THEN 'permission_mismatch' END AS kind FROM meta LEFT JOIN index_state USING (item_id)),
 rec AS (SELECT item_id, kind, CASE WHEN kind = 'permission_mismatch' THEN 'ACL_CHANGE' ELSE 'UPSERT' END AS event_type, CASE WHEN kind = 'permission_mismatch' THEN 'live' ELSE 'backfill' END AS topic FROM diff WHERE kind IS NOT NULL
 UNION ALL SELECT item_id, 'orphan', 'DELETE', 'live' FROM index_state WHERE status <> 'DELETED' AND item_id NOT IN (SELECT item_id FROM meta))"""


@query("k11_reconcile", fx.sql(f"WITH {_DIFF} SELECT * FROM rec", "meta", "index_state"))
def k11(spark, sf):
    return ingest.reconciled(fx.meta(spark, sf), fx.index_state(spark, sf), MODEL, CHUNKER)


@query("k11_reconcile_digests", fx.sql(f"WITH {_DIFF} SELECT * FROM rec", "meta", "index_state"))
def k11_digests(spark, sf):
    """The same by digests of key ranges: only ranges that differ are joined row by row."""
    from ..sources.staging import staged

    return ingest.reconciled_by_digest(staged(fx.meta(spark, sf).select("item_id", "version", "meta_hash"), "meta"), staged(fx.index_state(spark, sf), "states"), MODEL, CHUNKER)


@query("d18_reconcile_counts", fx.sql(f"WITH {_DIFF} SELECT kind, count(*) AS n FROM rec GROUP BY kind", "meta", "index_state"))
def d18(spark, sf):
    return k11(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("d01_status_counts", fx.sql("SELECT coalesce(wave, -1) AS wave, status, count(*) AS n FROM index_state GROUP BY 1, 2", "index_state"))
def d01(spark, sf):
    return fx.index_state(spark, sf).groupBy(F.coalesce("wave", F.lit(-1)).alias("wave"), "status").agg(F.count("*").alias("n"))


@query("d02_wave_progress", fx.sql("""SELECT wave, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'INDEXED') AS indexed, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped, count(*) FILTER (WHERE status = 'FAILED') AS failed,
 count(*) FILTER (WHERE status = 'DELETED') AS deleted, count(*) AS total, round(100 * count(*) FILTER (WHERE status IN ('INDEXED', 'SKIPPED', 'DELETED')) / count(*), 1) AS percent_done FROM index_state GROUP BY wave""", "index_state"))
def d02(spark, sf):
    return ingest.wave_progress(fx.index_state(spark, sf))


@query("a12_bulk_upsert", fx.sql("SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM chunk WHERE doc_id % 4 = 0 OR doc_id % 3 <> 0", "chunk"))
def a12(spark, sf):
    from ..sources.tables import upserted

    c = fx.chunk(spark, sf).select("chunk_id", "doc_id")
    old, new = c.where("doc_id % 3 <> 0").withColumn("version", F.lit("old")), c.where("doc_id % 4 = 0").withColumn("version", F.lit("new"))
    return upserted(old, new, "chunk_id").select("chunk_id", "version")


@query("a13_delete_by_query", fx.sql("SELECT chunk_id FROM chunk WHERE NOT (doc_id % 2 = 0 AND chunk_no % 3 = 1)", "chunk"))
def a13(spark, sf):
    from ..sources.tables import without_stale

    c = fx.chunk(spark, sf)
    return without_stale(c, c.where("doc_id % 2 = 0").select("doc_id").distinct(), c.where("chunk_no % 3 <> 1").select("chunk_id")).select("chunk_id")


@query("a14_update_by_query", fx.sql("SELECT chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE doc_type END AS doc_type, CASE WHEN doc_id % 5 = 0 THEN 'g9' ELSE array_to_string(acl_groups, ',') END AS acl_groups, sha256(content) AS digest FROM chunk_index", "chunk_index"))
def a14(spark, sf):
    from ..sources.tables import updated

    changes = fx.src_doc(spark, sf).where("doc_id % 5 = 0").select("doc_id", F.lit("moved").alias("doc_type"), F.array(F.lit("g9")).alias("acl_groups"))
    return updated(fx.chunk_index(spark, sf), changes, "doc_id").select("chunk_id", "doc_type", F.array_join("acl_groups", ",").alias("acl_groups"), F.sha2("content", 256).alias("digest"))


@query("a15_register_wave", fx.sql("SELECT item_id, coalesce(s.status, 'PENDING') AS status, CASE WHEN d.item_id IS NOT NULL THEN 9 ELSE wave END AS wave FROM index_state s FULL JOIN (SELECT item_id FROM src_doc WHERE doc_type = 'src1') d USING (item_id)", "index_state", "src_doc"))
def a15(spark, sf):
    chosen = fx.src_doc(spark, sf).where("doc_type = 'src1'").select("item_id", F.lit(9).cast("long").alias("new"))
    return fx.index_state(spark, sf).join(chosen, "item_id", "full").select("item_id", F.coalesce("status", F.lit("PENDING")).alias("status"), F.coalesce("new", "wave").alias("wave"))


@query("a20_alias_switch", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def a20(spark, sf):
    """The live rows after a switch to a version that was written beside the live one."""
    t = VersionedTable(spark, scratch(spark, "alias"))
    d = fx.table(spark, sf, "documents").select("doc_id")
    t.write(d.where("doc_id % 2 = 0"))
    t.switch(t.write(d.where("doc_id % 3 <> 0"), switch=False), expected=1)
    return t.read()


@query("a21_drop_old_version", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def a21(spark, sf):
    """The live rows once the newer version was left and dropped."""
    t = VersionedTable(spark, scratch(spark, "drop"))
    d = fx.table(spark, sf, "documents").select("doc_id")
    t.write(d.where("doc_id % 2 = 0"))
    newer = t.write(d)
    t.switch(t.versions()[0])
    t.drop(newer, age_days=20)
    return t.read()


@query("i16_two_writers", "SELECT doc_id, doc_id % 2 = 0 AS first, true AS second FROM documents")
def i16(spark, sf):
    """A change that another writer comes before starts again from that writer's rows."""
    t = VersionedTable(spark, scratch(spark, "writers"))
    t.write(fx.table(spark, sf, "documents").select("doc_id", F.lit(False).alias("first"), F.lit(False).alias("second")))
    came = []

    def second(rows):
        if not came:
            came.append(t.write(rows.withColumn("first", F.col("doc_id") % 2 == 0)))
        return rows.withColumn("second", F.lit(True))

    t.change(second)
    return t.read()


@query("i20_backfill", fx.sql("SELECT item_id AS key, count(*) OVER (PARTITION BY part ORDER BY item_id) - 1 AS off, part FROM (SELECT d.item_id, 0 AS part FROM src_doc d LEFT JOIN index_state s USING (item_id) WHERE NOT coalesce(s.status = 'INDEXED' AND s.embedding_model = 'm@1' AND s.chunker_version = 'v1', false))", "src_doc", "index_state"))
def i20(spark, sf):
    """What a backfill of all documents publishes, in a topic of one partition."""
    from ..sources.jobs import Backfill, Jobs

    base = scratch(spark, "backfill")
    states = VersionedTable(spark, f"{base}/states")
    states.write(fx.index_state(spark, sf))
    job = Backfill(spark, Jobs(spark, f"{base}/jobs"), states, f"{base}/topic", MODEL, CHUNKER, pages=3, parts=1)
    job.run("all", fx.src_doc(spark, sf).select("item_id"), None)
    return spark.read.parquet(f"{base}/topic").select("key", "off", F.col("part").cast("int").alias("part"))


@query("a22_snapshot_prune", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r > 14")
def a22(spark, sf):
    from ..sources.tables import prunable

    snaps = fx.table(spark, sf, "orders").selectExpr("o_orderkey", "struct(o_orderdate, o_orderkey) AS name", "if(o_orderstatus = 'F', 'SUCCESS', 'PARTIAL') AS state")
    return prunable(snaps, 14).select("o_orderkey")


@query("e08_latest_snapshots", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 14")
def e08(spark, sf):
    return fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(14).select("o_orderkey")


@query("a23_jobs_listing", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def a23(spark, sf):
    return fx.table(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(100).select("o_orderkey", "o_orderstatus")


@query("e11_requested_oldest_first", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def e11(spark, sf):
    return fx.table(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("i24_session_windows", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, new FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) WHERE new = 1 GROUP BY user_id")
def i24(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).count().groupBy("user_id").agg(F.count("*").alias("sessions"))
