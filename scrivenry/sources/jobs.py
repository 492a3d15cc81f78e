"""Job records with their state machine, and the backfill that publishes a wave's events range by range.

The table of jobs has a row per job and is rewritten on each change. A range of keys is one Spark job whatever its size:
bounds come from a range partitioning, the driver holds only them, and the cursor is the last key of a finished range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest
from ..streaming.consumer import send
from .tables import VersionedTable, upserted

#: A job record's fields, and those that a restart clears.
JOB = (
    "job_id string, kind string, wave bigint, status string, desired string, cursor string, scanned bigint, published bigint, "
    "skipped_up_to_date bigint, last_error string, started_at timestamp, updated_at timestamp, finished_at timestamp"
)
_CLEARED = {"cursor": None, "scanned": 0, "published": 0, "skipped_up_to_date": 0}


class Jobs:
    """Jobs are REQUESTED, RUNNING, PAUSED, COMPLETED or FAILED; ``desired`` is what an operator asked of a running one."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.table, self.clock = spark, VersionedTable(spark, path), clock

    def all(self) -> DataFrame:
        return self.spark.createDataFrame([], JOB) if self.table.current() is None else self.table.read()

    def get(self, job_id: str) -> Row | None:
        return self.all().where(F.col("job_id") == job_id).first()

    def _put(self, record: dict) -> Row:
        new = self.spark.createDataFrame([tuple((record | {"updated_at": self.clock()})[f.strip().split(" ")[0]] for f in JOB.split(","))], JOB)
        self.table.write(upserted(self.all(), new, "job_id").coalesce(1))
        return self.get(record["job_id"])

    def update(self, job_id: str, **fields) -> Row:
        found = self.get(job_id)
        if found is None:
            raise ValueError(f"no job {job_id}")
        return self._put(found.asDict() | fields)

    def _enter(self, status: str, job_id: str, kind: str, wave: int | None, restart: bool) -> Row:
        found = self.get(job_id)
        fields = {"status": status, "desired": "RUNNING", "last_error": None, "finished_at": None}
        if found is None:
            return self._put({"job_id": job_id, "kind": kind, "wave": wave, "started_at": self.clock()} | fields | _CLEARED)
        return self._put(found.asDict() | fields | (_CLEARED if restart else {}))

    def request(self, job_id: str, kind: str, wave: int | None, restart: bool = False) -> Row:
        """Queue a job; one that waits or runs stays as it is, a finished or paused one goes on from its cursor."""
        found = self.get(job_id)
        return found if found and found.status in ("REQUESTED", "RUNNING") else self._enter("REQUESTED", job_id, kind, wave, restart)

    def start(self, job_id: str, kind: str, wave: int | None, restart: bool = False) -> Row:
        """Run a new job, or an old one from its cursor; ``restart`` clears cursor and counters."""
        return self._enter("RUNNING", job_id, kind, wave, restart)

    def finish(self, job_id: str, status: str, error: str | None = None) -> Row:
        """PAUSED, COMPLETED or FAILED."""
        ended = {} if status == "PAUSED" else {"finished_at": self.clock()}
        return self.update(job_id, status=status, **ended, **({"last_error": error[:256]} if error else {}))

    def ask(self, job_id: str, desired: str) -> bool:
        """Ask a job to be RUNNING or PAUSED; False if there is none."""
        if self.get(job_id) is None:
            return False
        self.update(job_id, desired=desired)
        return True

    def requested(self) -> DataFrame:
        return self.all().where("status = 'REQUESTED'").orderBy("started_at", "job_id").limit(100)

    def listing(self) -> DataFrame:
        return self.all().orderBy(F.col("started_at").desc(), F.col("job_id").desc()).limit(100)


def registered(states: DataFrame, items: DataFrame, wave: int | None) -> DataFrame:
    """States with the items' wave set; items without a state get one, PENDING and without attempts."""
    known = states.join(items.select("item_id", F.lit(True).alias("_in")), "item_id", "left")
    known = known.withColumn("wave", F.when(F.col("_in"), F.lit(wave).cast(states.schema["wave"].dataType)).otherwise(F.col("wave"))).select(*states.columns)
    fresh = {"item_id": F.col("item_id"), "wave": F.lit(wave), "status": F.lit("PENDING"), "attempts": F.lit(0)}
    new = items.select("item_id").join(states, "item_id", "left_anti")
    return known.unionByName(new.select(*(fresh.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in states.schema)))


def ranges(items: DataFrame, after: str | None, number: int) -> list[str]:
    """Upper ends of at most ``number`` consecutive key ranges, of about equal size, of the items after the cursor."""
    left = items.select("item_id").where(F.col("item_id").isNotNull())
    if after is not None:
        left = left.where(F.col("item_id") > after)
    parts = left.repartitionByRange(number, "item_id").groupBy(F.spark_partition_id().alias("part"))
    return sorted(r.high for r in parts.agg(F.max("item_id").alias("high")).collect())


@dataclass
class Backfill:
    """Publishes an UPSERT event for each item of a wave that isn't up to date; a crash repeats one range at most."""

    spark: SparkSession
    jobs: Jobs
    states: VersionedTable
    topic: str
    model: str = "m@1"
    chunker: str = "v1"
    pages: int = 64
    parts: int = 16

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(self.parts)).cast("int").alias("part")

    def messages(self, items: DataFrame, wave: int | None, base: dict[int, int]) -> DataFrame:
        event = F.struct(
            F.lit(1).alias("schema_version"), F.uuid().alias("event_id"), F.lit("UPSERT").alias("event_type"), "item_id",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("occurred_at"), F.lit("backfill").alias("source"), F.lit("backfill").alias("priority"), F.lit(wave).cast("long").alias("wave"),
        )
        # Offsets go on where the topic's partition ends; ``base`` holds the next one of each.
        dealt = items.select("item_id", self._part())
        first = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in base.items() for x in pair)), F.col("part")), F.lit(0)) if base else F.lit(0)
        off = first.cast("long") + F.row_number().over(Window.partitionBy("part").orderBy("item_id")) - 1
        return dealt.select(
            F.lit("backfill").alias("topic"), "part", off.cast("long").alias("off"), F.col("item_id").alias("key"), F.to_json(event).alias("value"),
            F.lit(0).alias("retry_count"), F.lit(None).cast("long").alias("not_before"), F.lit(None).cast("string").alias("origin"),
        )

    def next_offsets(self) -> dict[int, int]:
        """The offset that follows the last one of each partition of the topic: ``parts`` rows at most."""
        topic = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.topic)
        if not topic.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(topic):
            return {}
        return {r.part: r.off + 1 for r in self.spark.read.parquet(self.topic).groupBy("part").agg(F.max("off").alias("off")).collect()}

    def run(self, job_id: str, items: DataFrame, wave: int | None, restart: bool = False, stop: Callable[[], bool] = lambda: False) -> Row:
        """Scan ``items`` (item_id, unique) from the cursor until done, stopped or asked to pause."""
        record = self.jobs.start(job_id, "backfill", wave, restart)
        low, scanned, published, skipped = record.cursor, record.scanned, record.published, record.skipped_up_to_date
        try:
            self.states.write(registered(self.states.read(), items.where("item_id IS NOT NULL"), wave))
            done = self.states.read().where(ingest.is_up_to_date(self.model, self.chunker)).select("item_id")
            base = self.next_offsets()
            for high in ranges(items, low, self.pages):
                if stop() or self.jobs.get(job_id).desired == "PAUSED":
                    return self.jobs.finish(job_id, "PAUSED")
                part = items.where(F.col("item_id") <= high) if low is None else items.where((F.col("item_id") > low) & (F.col("item_id") <= high))
                todo = part.join(done, "item_id", "left_anti")
                dealt = {r.part: r.n for r in todo.groupBy(self._part()).agg(F.count("*").alias("n")).collect()}
                n, m = part.count(), sum(dealt.values())
                if m:
                    send(self.messages(todo, wave, base), self.topic)
                    base = {p: base.get(p, 0) + dealt.get(p, 0) for p in {*base, *dealt}}
                low, scanned, published, skipped = high, scanned + n, published + m, skipped + n - m
                self.jobs.update(job_id, cursor=low, scanned=scanned, published=published, skipped_up_to_date=skipped)
        except Exception as error:
            self.jobs.finish(job_id, "FAILED", type(error).__name__)
            raise
        return self.jobs.finish(job_id, "COMPLETED")
