"""Queries over normalised documents, chunks, loaders and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, normalize
from ..sources import loaders, topics
from ..sources.keyed import KeyedTable
from ..sources.staging import scratch, staged
from ..streaming import assemble, consumer
from . import fixtures as fx
from .registry import query


def pages(spark, sf):
    return fx.src_page(spark, sf)


@query("k01_normalize_document")
def k01(spark, sf):
    return normalize.normalised_pages(pages(spark, sf)).select("doc_id", "page_no", F.sha2("page", 256).alias("digest"))


@query("k02_chunk_document")
def k02(spark, sf):
    return chunking.chunked(pages(spark, sf), chunking.Sizes(120, 160, 20, 15)).select("chunk_id", "page_start", "page_end", "section_title", "token_count", "is_table")


@query("k03_index_documents")
def k03(spark, sf):
    """Chunks with their vectors, as the index holds them."""
    from ..functions import hashing, text

    c = chunking.chunked(pages(spark, sf))
    v = hashing.hash_vector(text.embedding_text(F.col("section_title"), F.col("content")), 8)
    return c.select("chunk_id", "item_id", F.transform(v, lambda x: F.round(x, 6)).alias("embedding"))


@query("a16_question_loader", "SELECT 'q' || item_id AS id, text AS question FROM benchmark WHERE item_id % 2 = 0")
def a16(spark, sf):
    """The questions of the dev slice; the others are in the test slice."""
    path = scratch(spark, "questions")
    rows = fx.table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.col("text").alias("question"), F.expr("if(item_id % 2 = 0, 'dev', 'test')").alias("slice"))
    rows.write.json(path)
    return loaders.load_questions(spark, path).select("id", "question")


@query("a17_query_loader", "SELECT item_id, trim(replace(text, chr(10), ' ')) AS question FROM benchmark")
def a17(spark, sf):
    path = scratch(spark, "queries")
    b = fx.table(spark, sf, "benchmark").select("item_id", F.trim(F.translate("text", "\n", " ")).alias("question"))
    b.select(F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct("question", F.lit("u1").alias("as_user")))).otherwise(F.col("question"))).write.text(path)
    return loaders.load_queries(spark, path).distinct().join(b, "question").select("item_id", "question").distinct()


@query("i22_answer_stream")
def i22(spark, sf):
    words = F.posexplode(F.split("answer", "(?<= )")).alias("seq", "piece")
    parts = fx.answer_text(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), words).withColumn("seq", F.col("seq").cast("long"))
    return assemble.assembled(parts, 3)


def messages(spark, sf):
    m = fx.message(spark, sf, by_ranges=True)
    value = F.expr("""if(corrupt, '{"schema', concat('{"schema_version":1,"event_id":"', event_id, '","event_type":"', event_type, '","item_id":"', item_id, '","doc_version":', doc_version, ',"occurred_at":"', date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss"), '"}'))""")
    return m.select("topic", F.col("part").cast("int").alias("part"), "off", "key", value.alias("value"), F.col("retry_count").cast("int").alias("retry_count"), F.col("not_before").cast("long").alias("not_before"), F.lit(None).cast("string").alias("origin"))


def put(spark, sf, base):
    """Each topic's messages in a folder of its own."""
    own = staged(messages(spark, sf), "messages")
    for topic in ("live", "backfill"):
        consumer.send(own.where(F.col("topic") == topic), f"{base}/topics/{topic}")


@query("a10_stream_source", fx.sql("SELECT topic, part, off, key FROM message", "message"))
def a10(spark, sf):
    """The topics read as a stream and sent on to another one."""
    base = scratch(spark, "topics")
    put(spark, sf, base)
    out = consumer.read_topic(spark, f"{base}/topics/*", 1_000).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    out.format("parquet").option("path", f"{base}/copy").start().awaitTermination()
    return spark.read.schema(consumer.MESSAGE).parquet(f"{base}/copy").select("topic", F.col("part").cast("long").alias("part"), "off", "key")


@query("a11_topic_sink", fx.sql("SELECT topic, key, count(*) AS n, 0 AS gaps FROM message GROUP BY topic, key", "message"))
def a11(spark, sf):
    """Both topics written to topics with offsets and read back: messages of each key, and offsets of its partition that lack or repeat."""
    spark.dataSource.register(topics.Topics)
    base = scratch(spark, "topics")
    put(spark, sf, base)
    out = None
    for topic in ("live", "backfill"):
        sent = consumer.read_topic(spark, f"{base}/topics/{topic}", 1_000).selectExpr(*topics.WRITTEN).writeStream.format("topic").option("path", f"{base}/log/{topic}")
        sent.option("parts", 4).option("writer", "copy").option("checkpointLocation", f"{base}/sent-{topic}").trigger(availableNow=True).start().awaitTermination()
        read = spark.readStream.format("topic").option("path", f"{base}/log/{topic}").load().writeStream.format("parquet").option("path", f"{base}/read/{topic}")
        read.option("checkpointLocation", f"{base}/read-{topic}").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(topics.READ).parquet(f"{base}/read/{topic}").withColumn("topic", F.lit(topic))
        out = rows if out is None else out.unionByName(rows)
    gaps = out.groupBy("topic", "part").agg((F.max("off") + 1 - F.count("*")).alias("lacking"), (F.count("*") - F.countDistinct("off")).alias("again")).select("topic", "part", (F.abs("lacking") + F.col("again")).alias("gaps"))
    return out.groupBy("topic", "part", "key").agg(F.count("*").alias("n")).join(gaps, ["topic", "part"]).groupBy("topic", "key").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"))


@query("a18_report_sink", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def a18(spark, sf):
    """A report written as one JSON file, read back."""
    path = scratch(spark, "report")
    loaders.save_report(fx.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("lang string, n long, chars long").json(path)


_SENT = """ev AS (SELECT * FROM message WHERE NOT corrupt AND key = item_id),
 placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN v THEN doc_version END, date_trunc('second', occurred_at), off) AS position FROM (SELECT *, bool_and(doc_version IS NOT NULL) OVER (PARTITION BY item_id) AS v FROM ev)),
 marked AS (SELECT *, max(CASE WHEN event_type = 'DELETE' THEN position END) OVER (PARTITION BY item_id) AS last_del, count(*) OVER (PARTITION BY item_id) AS members, max(retry_count) OVER (PARTITION BY item_id) AS retries FROM placed),
 w AS (SELECT item_id, event_type, doc_version, retries FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN last_del = members THEN CASE WHEN position = last_del THEN 0 ELSE 9 END WHEN position > coalesce(last_del, 0) AND event_type = 'UPSERT' THEN 0 WHEN position > coalesce(last_del, 0) THEN 1 ELSE 9 END, position DESC) AS r FROM marked) WHERE r = 1),
 d AS (SELECT item_id, version, true AS present FROM meta WHERE doc_id % 3 <> 0),
 o AS (SELECT item_id, CASE WHEN event_type = 'DELETE' AND coalesce(version > doc_version, false) THEN 'stale' WHEN event_type = 'DELETE' THEN 'deleted' WHEN present IS NULL AND retries < 5 THEN 'missing' WHEN present IS NULL THEN 'deleted' ELSE 'indexed' END AS outcome FROM w LEFT JOIN d USING (item_id))"""


_STATES = _SENT[: _SENT.index(" d AS (SELECT")] + """ r AS (SELECT item_id, CASE WHEN event_type = 'DELETE' THEN w.doc_version ELSE coalesce(m.version, w.doc_version) END AS v, CASE WHEN event_type = 'DELETE' AND coalesce(m.version > w.doc_version, false) THEN 'stale'
  WHEN event_type = 'DELETE' OR m.version IS NULL THEN CASE WHEN coalesce(w.doc_version < s.doc_version, false) THEN 'stale' ELSE 'deleted' END WHEN coalesce(coalesce(m.version, w.doc_version) < s.doc_version, false) THEN 'stale'
  WHEN coalesce(status = 'INDEXED' AND s.content_hash = m.text_hash AND embedding_model = 'm@1' AND chunker_version = 'v1', false) THEN CASE WHEN s.state_hash = m.meta_hash THEN 'unchanged' ELSE 'metadata_refreshed' END ELSE 'indexed' END AS outcome
  FROM w LEFT JOIN (SELECT item_id, version, text_hash, meta_hash FROM meta) m USING (item_id) LEFT JOIN index_state s USING (item_id))"""


@query("i01_consumer_stream", fx.sql(f"""WITH {_STATES} SELECT item_id, CASE WHEN outcome IN ('indexed', 'unchanged', 'metadata_refreshed') THEN 'INDEXED' WHEN outcome = 'deleted' THEN 'DELETED' ELSE coalesce(status, 'PENDING') END AS status,
 CASE WHEN outcome IN ('indexed', 'deleted') THEN greatest(v, doc_version) ELSE doc_version END AS doc_version, CASE WHEN outcome IN ('indexed', 'deleted') THEN 0 ELSE coalesce(attempts, 0) END AS attempts FROM index_state FULL JOIN r USING (item_id)""", "message", "meta", "index_state"))
def i01(spark, sf):
    """All events of both topics through the streaming consumer in a batch; the result is the state table."""
    base = scratch(spark, "stream")
    put(spark, sf, base)
    states = KeyedTable(spark, f"{base}/states", consumer.STATE, "item_id", order="doc_version")
    states.write(fx.index_state(spark, sf))
    documents = fx.meta(spark, sf).withColumn("usable", F.lit(True))
    worker = consumer.Consumer(spark, documents, states, f"{base}/dlq")
    worker.start(consumer.read_topic(spark, f"{base}/topics/*", 1_000), f"{base}/checkpoint").awaitTermination()
    return states.read().select("item_id", "status", "doc_version", "attempts")


@query("i01_indexed_chunks", fx.sql(f"WITH {_SENT} SELECT chunk_id, doc_type FROM chunk_index WHERE item_id IN (SELECT item_id FROM o WHERE outcome = 'indexed') UNION ALL SELECT 'OLD-' || item_id, 'old' FROM d WHERE item_id NOT IN (SELECT item_id FROM w) OR item_id IN (SELECT item_id FROM o WHERE outcome IN ('stale', 'missing'))", "message", "meta", "chunk_index"))
def i01_chunks(spark, sf):
    """The chunk table after all events of both topics in one batch, over a table in which each document has one old chunk."""
    base = scratch(spark, "stream")
    put(spark, sf, base)
    states = KeyedTable(spark, f"{base}/states", consumer.STATE, "item_id", order="doc_version")
    chunks = KeyedTable(spark, f"{base}/chunks", consumer.CHUNK, "chunk_id", bucket_by="item_id")
    documents = fx.meta(spark, sf).where("doc_id % 3 <> 0").withColumn("usable", F.lit(True))
    old = documents.select(F.concat(F.lit("OLD-"), "item_id").alias("chunk_id"), "item_id", F.lit("old").alias("doc_type"))
    chunks.write(old.select(*(F.col(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema)))

    def split(pages):
        return fx.windows_of(pages.select("item_id", "page_no", "page")).withColumn("chunk_id", F.concat_ws(":", "item_id", "chunk_no", F.substring(F.sha2("content", 256), 1, 16))).withColumn("section_title", F.lit(None).cast("string"))

    pages = fx.src_page(spark, sf)
    worker = consumer.Consumer(spark, documents, states, f"{base}/dlq", f"{base}/retry", chunks, pages, split=split)
    worker.start(consumer.read_topic(spark, f"{base}/topics/*", 1_000), f"{base}/checkpoint").awaitTermination()
    return chunks.read().select("chunk_id", "doc_type")
