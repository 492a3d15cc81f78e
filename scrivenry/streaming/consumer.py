"""The change-event consumer as a structured stream: topics are directories, a micro-batch is the unit of commit.

A batch is validated, coalesced to one event per item, joined with source and state, and what follows is appended to the
tables of chunks and states; then the checkpoint moves on. A batch that is run again appends the same again, so
at-least-once delivery does no harm. Only items of the batch are read and written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException, ParseException, PySparkException, PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chunking, hashing, text
from ..operators import ingest
from ..sources.keyed import KeyedTable
from ..sources.staging import staged

#: A message as topics hold it; ``origin`` is where a message stood that came back.
MESSAGE = "topic string, part int, off long, key string, value string, retry_count int, not_before long, origin string"
#: The columns of a state table and of a chunk table.
STATE = "item_id string, status string, doc_version long, embedding_model string, chunker_version string, state_hash string, content_hash string, wave long, attempts long"
CHUNK = "chunk_id string, item_id string, chunk_no long, content string, section_title string, page_start long, page_end long, embedding array<double>, embedding_model string, doc_type string, tags array<string>, acl_users array<string>, acl_groups array<string>, created_at date"
#: What a chunk takes over from its document.
METADATA = ["doc_type", "tags", "acl_users", "acl_groups", "created_at"]


def read_topic(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A topic directory as a stream; newer files join as they appear."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def send(rows: DataFrame, path: str) -> None:
    """Append messages to a topic; the write is whole or absent."""
    rows.write.mode("append").parquet(path)


def hash_embeddings(chunks: DataFrame) -> DataFrame:
    """The built-in embedder: chunks with ``embedding``, a vector made of a digest. Others have the same form."""
    return chunks.withColumn("embedding", hashing.hash_vector(text.embedding_text(F.col("section_title"), F.col("content")), 8))


#: Java classes whose errors come again however often a batch is tried: wrong plans, casts and arguments.
PERMANENT = ("AnalysisException", "ParseException", "IllegalArgumentException", "ArithmeticException", "DateTimeException", "NumberFormatException", "ArrayIndexOutOfBoundsException", "UnsupportedOperationException")


def is_permanent(error: Exception) -> bool:
    """Whether trying again is of no use: an error of the plan or the data, not of storage, network or a lost executor."""
    if isinstance(error, (AnalysisException, ParseException, IllegalArgumentException, ArithmeticException, NumberFormatException, PySparkTypeError, PySparkValueError)):
        return True
    java = getattr(error, "java_exception", None)
    return java is not None and java.getClass().getSimpleName() in PERMANENT


@dataclass
class Consumer:
    """One consumer group: where it reads sources, keeps states and chunks, and sends what fails.

    ``documents`` has item_id, version, text_hash, meta_hash, usable and, with a chunk table, the METADATA columns;
    ``pages`` has item_id, page_no and page. ``split`` makes chunks of pages, ``embed`` gives them vectors.
    """

    spark: SparkSession
    documents: DataFrame
    states: KeyedTable
    dead_letters: str
    retries: str | None = None
    chunks: KeyedTable | None = None
    pages: DataFrame | None = None
    model: str = "m@1"
    chunker: str = "v1"
    split: Callable[[DataFrame], DataFrame] = chunking.chunked
    embed: Callable[[DataFrame], DataFrame] = hash_embeddings
    attempts: int = 3
    delay: int = 60
    clock: Callable[[], float] = field(default=time.time)
    pause: Callable[[float], None] = field(default=time.sleep)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; what fails for a passing reason is tried again, then fails the batch, which will be run again."""
        for attempt in range(self.attempts):
            try:
                return self._process(batch, batch_id)
            except (OSError, PySparkException, Py4JError) as error:
                if attempt + 1 == self.attempts or is_permanent(error):
                    raise
                self.pause(min(30, 2**attempt))

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        now = int(self.clock())
        timed = ingest.held_back(batch.withColumn("not_before", F.coalesce("not_before", F.lit(0))), F.lit(now))
        checked = ingest.parsed(timed).withColumn("reason", F.coalesce("reason", F.when(~ingest.key_matches(F.col("key"), F.col("event.item_id")), "key differs from item_id")))
        checked = staged(checked.withColumn("event_id", F.coalesce("event.event_id", F.concat_ws("/", "topic", "part", "off"))), "checked")
        good = checked.where("reason IS NULL AND due").select(
            "event_id", "event.item_id", "event.event_type", "event.doc_version", F.try_to_timestamp("event.occurred_at").alias("occurred_at"), F.col("off").alias("arrival"), "retry_count",
        )
        retries = good.groupBy("item_id").agg(F.max(F.coalesce("retry_count", F.lit(0))).alias("retries"))
        work = staged(ingest.coalesced(good).join(retries, "item_id"), "work")
        states = staged(self.states.read(work), "states")
        can_wait = F.lit(True) if self.retries is None else F.col("retries") >= ingest.MAX_RETRIES
        results = staged(ingest.outcomes(work, self.documents, states, self.model, self.chunker, can_wait), "results")
        missing = results.where("outcome = 'missing'").select("item_id")
        done = results.where("outcome <> 'missing'")
        if self.chunks is not None:
            done = self._index(done)
        self._note(states, done)
        if self.retries is not None:
            again = work.join(missing, "item_id", "left_semi").select("event_id")
            self._send_back(checked.where("reason IS NULL AND due").join(again, "event_id", "left_semi").dropDuplicates(["event_id"]), 1, now + self.delay)
            self._send_back(checked.where("NOT due"), 0, None)
        bad = checked.where("reason IS NOT NULL AND due").select("topic", "part", "off", "key", "value", "reason", F.lit(batch_id).alias("batch_id"))
        bad.write.mode("overwrite").parquet(f"{self.dead_letters}/batch={batch_id}")

    def _send_back(self, rows: DataFrame, more: int, not_before: int | None) -> None:
        """Messages to the retry topic, with their count, due time and the place where they stood first."""
        due = F.col("not_before") if not_before is None else F.lit(not_before).cast("long")
        origin = F.coalesce("origin", F.concat_ws("/", "topic", "part", "off"))
        if not rows.isEmpty():
            send(rows.select(F.lit("retry").alias("topic"), "part", "off", "key", "value", (F.coalesce("retry_count", F.lit(0)) + more).alias("retry_count"), due.alias("not_before"), origin.alias("origin")), self.retries)

    def _index(self, done: DataFrame) -> DataFrame:
        """Write what the outcomes mean for chunks; items without a chunk are skipped. New chunks and deletions appear at once."""
        indexed = done.where("outcome = 'indexed'").select("item_id")
        made = self.embed(self.split(self.pages.join(indexed, "item_id", "left_semi"))).withColumn("embedding_model", F.lit(self.model))
        meta = self.documents.select("item_id", *METADATA)
        names = [f for f in self.chunks.schema.names if f not in METADATA]
        made = staged(made.select(*(F.col(c) if c in made.columns else F.lit(None).cast(self.chunks.schema[c].dataType).alias(c) for c in names)), "made")
        stored = staged(self.chunks.read(done.where("outcome <> 'unchanged' AND outcome <> 'stale'").select("item_id")), "stored")
        refreshed = done.where("outcome = 'metadata_refreshed'").select("item_id")
        kept = stored.join(refreshed, "item_id", "left_semi").drop(*METADATA)
        gone = stored.join(refreshed, "item_id", "left_anti").join(made.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "item_id")
        self.chunks.write(made.unionByName(kept.select(*names)).join(meta, "item_id"), gone)
        empty = indexed.join(made.select("item_id").distinct(), "item_id", "left_anti").withColumn("none", F.lit(True))
        out = done.join(empty, "item_id", "left").withColumn("outcome", F.when(F.col("none"), "skipped").otherwise(F.col("outcome"))).drop("none")
        return staged(out, "outcomes")

    def _note(self, states: DataFrame, done: DataFrame) -> None:
        """Append the states that follow."""
        after = ingest.next_state(states, done)
        kept = states.select("item_id", *(c for c in states.columns if c not in after.columns))
        hashes = done.where("outcome IN ('indexed', 'metadata_refreshed')").join(self.documents, "item_id").select("item_id", F.when(F.col("outcome") == "indexed", F.col("text_hash")).alias("h"), F.col("meta_hash").alias("m"))
        full = after.join(kept, "item_id", "left").join(hashes, "item_id", "left").join(done.select("item_id"), "item_id", "left_semi")
        full = full.withColumn("content_hash", F.coalesce("h", "content_hash")).withColumn("state_hash", F.coalesce("m", "state_hash"))
        for name, value in (("embedding_model", self.model), ("chunker_version", self.chunker)):
            full = full.withColumn(name, F.when(F.col("h").isNotNull(), value).otherwise(F.col(name)))
        self.states.write(full)

    def start(self, topic: DataFrame, checkpoint: str, name: str | None = None, pool: str | None = None) -> StreamingQuery:
        """Run until the topic has nothing new; live, retry and backfill topics are queries with their own checkpoints.

        ``pool`` is the scheduler pool of the query's jobs, so that a backfill leaves live work its share; how many files a batch takes
        is for each topic to say.
        """
        out = topic.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        # A query takes over its starter's properties; the starter's own jobs stay in their pool.
        before = self.spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            return (out.queryName(name) if name else out).start()
        finally:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
