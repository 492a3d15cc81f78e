"""Change events: validation, coalescing, retry topics, outcomes, and the state they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "schema_version int, event_id string, event_type string, item_id string, doc_version bigint, occurred_at string, source string, priority string, wave bigint"
#: Event types in order of priority, states that end a document's work.
TYPES = ["DELETE", "ACL_CHANGE", "UPSERT"]
MAX_RETRIES = 5


def parsed(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages with ``event`` (null if invalid) and ``reason`` (null if valid), which names fields, never values."""
    # Columns of their own are made once; the checks would each parse the text again.
    rows = messages.withColumn("_event", F.from_json(F.col(value), EVENT)).withColumn("_whole", F.coalesce(F.size(F.from_json(F.col(value), "map<string,string>")) > 0, F.lit(False)))
    e, whole = F.col("_event"), F.col("_whole")
    checks = {
        "schema_version": e["schema_version"].eqNullSafe(F.lit(1)),
        "event_type": F.coalesce(e["event_type"].isin(*TYPES), F.lit(False)),
        "item_id": F.coalesce(F.length(e["item_id"]).between(1, 256), F.lit(False)),
        "doc_version": F.coalesce(e["doc_version"] >= 0, F.lit(True)),
        "occurred_at": F.try_to_timestamp(e["occurred_at"]).isNotNull(),
        "priority": F.coalesce(e["priority"].isin("live", "backfill"), F.lit(True)),
    }
    broken = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    reason = F.when(F.col(value).isNull(), "empty message value").when(~whole, "value is not valid JSON").when(F.size(broken) > 0, F.concat(F.lit("schema v1 violation: "), F.array_join(broken, ", ")))
    return rows.withColumn("reason", reason).withColumn("event", F.when(F.col("reason").isNull(), e)).drop("_event", "_whole")


def numbered(rows: DataFrame, *order: str | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``turn``, their place from 1 in the order of all rows, or of those that agree in the columns ``within``.

    Rows are dealt by ranges of the order; a range counts from where the ranges before it end, so no task sorts everything.
    """
    from ..sources.staging import staged

    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    dealt = staged(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range", *within).agg(F.count("*").alias("n"))
    earlier = sizes.select(F.col("_range").alias("r"), F.col("n").alias("m"), *(F.col(c).alias(f"_{c}") for c in within))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    before = sizes.join(earlier, [F.col("r") < F.col("_range"), *same], "left").groupBy("_range", *within).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    before = before.withColumnsRenamed({c: f"_{c}" for c in ("_range", *within)})
    at = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*keys))
    met = dealt.join(F.broadcast(before), [F.col("_range") == F.col("__range"), *same])
    return met.withColumn("turn", (F.col("before") + at).cast("long")).select(*rows.columns, "turn")


def key_matches(key: Column, item_id: Column) -> Column:
    return key.eqNullSafe(item_id)


def ordered_events(events: DataFrame) -> DataFrame:
    """Events with ``position`` in their item's order: by version if all of the item's have one, then time, then arrival."""
    item = Window.partitionBy("item_id")
    versioned = F.min(F.col("doc_version").isNotNull()).over(item)
    order = item.orderBy(F.when(F.col("versioned"), F.col("doc_version")), "occurred_at", "arrival")
    return events.withColumn("versioned", versioned).withColumn("position", F.row_number().over(order).cast("long")).drop("versioned")


def coalesced(events: DataFrame) -> DataFrame:
    """One event per item stands for all: a last DELETE; else, after the last DELETE, the last UPSERT, or else the last.

    Aggregations over (position, event) structs: an item with very many events is combined before the shuffle.
    """
    placed = ordered_events(events)
    fields = F.struct("position", "event_id", "event_type", "doc_version")
    last_delete = F.max(F.when(F.col("event_type") == "DELETE", F.col("position")))
    found = placed.groupBy("item_id").agg(
        F.max(fields).alias("last"), F.max(F.when(F.col("event_type") == "UPSERT", fields)).alias("upsert"), last_delete.alias("deleted"), F.count("*").alias("members"),
    )
    # An UPSERT before the last DELETE doesn't count.
    use = (F.col("last.event_type") != "DELETE") & (F.col("upsert.position") > F.coalesce("deleted", F.lit(0)))
    winner = F.when(use, F.col("upsert")).otherwise(F.col("last"))
    return found.select("item_id", winner.alias("w"), "members").select("item_id", "w.event_id", "w.event_type", "w.doc_version", "members")


def priority(event_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), event_type) - 1


def committable(done: DataFrame) -> DataFrame:
    """(topic, part, next): each partition's offset to commit: the first that isn't done, or one past the last.

    ``done`` has topic, part, off and a boolean ``done`` for every offset handed out.
    """
    waiting = F.min(F.when(~F.col("done"), F.col("off")))
    return done.groupBy("topic", "part").agg(F.coalesce(waiting, F.max("off") + 1).alias("next"))


def held_back(messages: DataFrame, now: Column) -> DataFrame:
    """Messages with ``due``: a message waits while any before it in its partition isn't due. ``now`` is the same for all.

    A partition's first message that isn't due parts it, so a row for each partition is all that the messages meet.
    """
    at = F.coalesce("off", F.lit(-(2**63)))
    first = messages.groupBy(F.col("topic").alias("_topic"), F.col("part").alias("_part")).agg(F.min(F.when(F.col("not_before") > now, at)).alias("_waits"), F.min(F.when(F.col("not_before").isNotNull(), at)).alias("_known"))
    met = messages.join(F.broadcast(first), F.col("topic").eqNullSafe(F.col("_topic")) & F.col("part").eqNullSafe(F.col("_part")))
    return met.withColumn("due", F.when((at >= F.col("_known")) & now.isNotNull(), F.coalesce(at < F.col("_waits"), F.lit(True)))).drop("_topic", "_part", "_waits", "_known")


def retried(failed: DataFrame, now: Column, delay: int = 60) -> DataFrame:
    """Where failed messages go: the retry topic with a count, a due time and their origin, or the dead letters."""
    count = F.col("retry_count") + 1
    to = F.when(~F.col("retryable"), "dlq").when(F.col("retry_count") >= MAX_RETRIES, "dlq").otherwise("retry")
    why = F.when(~F.col("retryable"), "non-retryable error").when(F.col("retry_count") >= MAX_RETRIES, "retries exhausted")
    return failed.withColumn("to", to).withColumn("reason", why).withColumn("retries", F.when(to == "retry", count).otherwise(F.col("retry_count"))).withColumn("due_at", F.when(to == "retry", now + delay))


def safe_error(kind: Column, message: Column, own: list[str]) -> Column:
    """What may be stored of an error: its type, and its message only for types whose messages are our own."""
    return F.when(kind.isin(own) & (F.length(message) > 0), F.concat_ws(": ", kind, message)).otherwise(kind)


def is_stale(version: Column, stored: Column) -> Column:
    """Both versions are known and the new one is lower."""
    return F.coalesce(version < stored, F.lit(False))


def is_unchanged(state_hash: Column, text_hash: Column, model: str, chunker: str) -> Column:
    return F.coalesce((F.col("status") == "INDEXED") & (state_hash == text_hash) & (F.col("embedding_model") == model) & (F.col("chunker_version") == chunker), F.lit(False))


def is_up_to_date(model: str, chunker: str) -> Column:
    return F.coalesce((F.col("status") == "INDEXED") & (F.col("embedding_model") == model) & (F.col("chunker_version") == chunker), F.lit(False))


def outcomes(events: DataFrame, documents: DataFrame, states: DataFrame, model: str, chunker: str, exhausted: Column) -> DataFrame:
    """(item_id, event_type, outcome, version) of each event, given the source document and the stored state of its item.

    ``documents`` has item_id, version, text_hash, meta_hash, usable; ``states`` the columns of the state table.
    """
    d = documents.select("item_id", "version", "text_hash", "meta_hash", "usable", F.lit(True).alias("present"))
    s = states.select("item_id", "status", F.col("doc_version").alias("stored"), "embedding_model", "chunker_version", "state_hash", "content_hash")
    j = events.join(d, "item_id", "left").join(s, "item_id", "left")
    version = F.coalesce("version", "doc_version")
    gone = F.when(is_stale(F.col("doc_version"), F.col("stored")), "stale").otherwise("deleted")
    outcome = (
        F.when((F.col("event_type") == "DELETE") & F.coalesce(F.col("version") > F.col("doc_version"), F.lit(False)), "stale")
        .when(F.col("event_type") == "DELETE", gone)
        .when(F.col("present").isNull() & ~exhausted, "missing")
        .when(F.col("present").isNull(), gone)
        .when(is_stale(version, F.col("stored")), "stale")
        .when(~F.col("usable"), "skipped")
        .when(is_unchanged(F.col("content_hash"), F.col("text_hash"), model, chunker) & (F.col("state_hash") == F.col("meta_hash")), "unchanged")
        .when(is_unchanged(F.col("content_hash"), F.col("text_hash"), model, chunker), "metadata_refreshed")
        .otherwise("indexed")
    )
    return j.select("item_id", "event_type", outcome.alias("outcome"), F.when(F.col("event_type") == "DELETE", F.col("doc_version")).otherwise(version).alias("version"))


def next_state(states: DataFrame, results: DataFrame) -> DataFrame:
    """The state table after the results (item_id, outcome, version): versions never go back, waves stay.

    A failure counts an attempt and keeps the version; success clears the attempts.
    """
    r = results.select("item_id", "outcome", F.col("version").alias("v"))
    j = states.join(r, "item_id", "full")
    status = (
        F.when(F.col("outcome").isin("indexed", "unchanged", "metadata_refreshed"), "INDEXED").when(F.col("outcome") == "deleted", "DELETED").when(F.col("outcome") == "skipped", "SKIPPED")
        .when(F.col("outcome") == "failed", "FAILED").otherwise(F.coalesce("status", F.lit("PENDING")))
    )
    moved = F.col("outcome").isin("indexed", "deleted", "skipped")
    version = F.when(moved, F.greatest("v", "doc_version")).otherwise(F.col("doc_version"))
    attempts = F.when(F.col("outcome") == "failed", F.coalesce("attempts", F.lit(0)) + 1).when(moved, 0).otherwise(F.coalesce("attempts", F.lit(0)))
    return j.select("item_id", status.alias("status"), version.alias("doc_version"), "wave", attempts.cast("long").alias("attempts"))


def difference(model: str, chunker: str) -> Column:
    """What is wrong with a document (version, meta_hash) given its state (``stored`` is its version); null if nothing."""
    return (
        F.when(F.col("status").isNull(), "missing_state")
        .when(F.col("status") == "FAILED", "failed")
        .when(F.col("status") == "PENDING", "pending")
        .when(F.col("status") == "DELETED", "resurrected")
        .when(F.col("version") != F.col("stored"), "version_mismatch")
        .when((F.col("status") == "INDEXED") & ((F.col("embedding_model") != model) | (F.col("chunker_version") != chunker)), "stale_model")
        .when((F.col("status") == "INDEXED") & ~F.col("state_hash").eqNullSafe(F.col("meta_hash")), "permission_mismatch")
    )


def reconciled(documents: DataFrame, states: DataFrame, model: str, chunker: str) -> DataFrame:
    """(item_id, kind, event_type, topic) of the events that bring the index in line with the source."""
    s = states.select("item_id", "status", F.col("doc_version").alias("stored"), "embedding_model", "chunker_version", "state_hash")
    ahead = documents.join(s, "item_id", "left").withColumn("kind", difference(model, chunker)).where("kind IS NOT NULL")
    permission = F.col("kind") == "permission_mismatch"
    ahead = ahead.select("item_id", "kind", F.when(permission, "ACL_CHANGE").otherwise("UPSERT").alias("event_type"), F.when(permission, "live").otherwise("backfill").alias("topic"))
    gone = states.where("status <> 'DELETED'").join(documents, "item_id", "left_anti").select("item_id", F.lit("orphan").alias("kind"), F.lit("DELETE").alias("event_type"), F.lit("live").alias("topic"))
    return ahead.unionByName(gone)


def wave_progress(states: DataFrame) -> DataFrame:
    """Counts by status of each wave (null: none), their total and the percentage done."""
    names = ["PENDING", "INDEXED", "SKIPPED", "FAILED", "DELETED"]
    n = [F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in names]
    done = F.round(100 * (F.col("indexed") + F.col("skipped") + F.col("deleted")) / F.col("total"), 1)
    return states.groupBy("wave").agg(*n, F.count("*").alias("total")).withColumn("percent_done", F.when(F.col("total") > 0, done).otherwise(0.0))


def _digested(rows: DataFrame, ranges: int, *columns: Column) -> DataFrame:
    """(range, n, total, mixed): a digest of each key range's rows that doesn't depend on their order."""
    one = F.xxhash64(*columns)
    keyed = rows.select(F.pmod(F.xxhash64("item_id"), F.lit(ranges)).alias("range"), one.cast("decimal(38,0)").alias("one"), F.xxhash64(F.lit(1), *columns).alias("other"))
    return keyed.groupBy("range").agg(F.count("*").alias("n"), F.sum("one").alias("total"), F.bit_xor("other").alias("mixed"))


def differing_ranges(documents: DataFrame, states: DataFrame, model: str, chunker: str, ranges: int) -> DataFrame:
    """(range) of the key ranges in which source and index may differ.

    A document that needs nothing and its state digest to the same; deleted states without a document count on neither side. Only
    digests are shuffled: one row for each range and task.
    """
    wanted = _digested(documents, ranges, F.col("item_id"), F.col("version").cast("long"), F.col("meta_hash"), F.lit("INDEXED"), F.lit(model), F.lit(chunker))
    live = states.where("status IS NULL OR status <> 'DELETED'")
    held = _digested(live, ranges, F.col("item_id"), F.col("doc_version").cast("long"), F.col("state_hash"), F.col("status"), F.col("embedding_model"), F.col("chunker_version"))
    other = held.select("range", F.col("n").alias("m"), F.col("total").alias("total2"), F.col("mixed").alias("mixed2"))
    both = wanted.join(other, "range", "full")
    same = F.col("n").eqNullSafe(F.col("m")) & F.col("total").eqNullSafe(F.col("total2")) & F.col("mixed").eqNullSafe(F.col("mixed2"))
    return both.where(~same).select("range")


def reconciled_by_digest(documents: DataFrame, states: DataFrame, model: str, chunker: str, rows_per_range: int = 64) -> DataFrame:
    """What :func:`reconciled` finds, with rows joined only in key ranges whose digests differ.

    Ranges are hash ranges of the key of about ``rows_per_range`` documents, so few differences make for few rows to join; the ranges
    that differ are a table like any other and leave both sides where they are if Spark finds it small.
    """
    ranges = max(1, -(-documents.count() // rows_per_range))
    differ = differing_ranges(documents, states, model, chunker, ranges)
    within = lambda rows: rows.join(differ, F.pmod(F.xxhash64("item_id"), F.lit(ranges)) == differ["range"], "left_semi")
    return reconciled(within(documents), within(states), model, chunker)


def to_replay(dead: DataFrame, ledger: DataFrame) -> DataFrame:
    """The dead letters (event_id, key, item_id, …) that may go back to their topic: whole messages under their own key, once each.

    ``ledger`` has the event_id of every letter that was replayed before; what is replayed now belongs in it.
    """
    whole = dead.where(~F.col("corrupt") & key_matches(F.col("key"), F.col("item_id")))
    return whole.join(ledger.select("event_id").distinct(), "event_id", "left_anti").dropDuplicates(["event_id"])


def missing_sources(events: DataFrame, documents: DataFrame, tries: int = MAX_RETRIES) -> DataFrame:
    """(item_id, seen, exhausted) of events' items without a source document: after ``tries`` events the item counts as deleted."""
    return events.join(documents, "item_id", "left_anti").groupBy("item_id").agg(F.count("*").alias("seen")).withColumn("exhausted", F.col("seen") >= tries)
