"""Tables of rows by key that grow by appended batches: a batch costs what it holds, not what the table holds."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """Parquet batches under ``path``, in buckets by a hash of ``bucket_by``; of a key's rows the newest one counts.

    A batch is one directory that appears whole or not at all, and may delete keys beside writing others. Newest is by
    ``order`` (for instance a version that never goes back, so that two writers can't undo each other) and then by batch.
    A batch of :meth:`compact` keeps for each row, deleted ones too, the batch that it came from, so a batch that began
    before and ends after it takes its place among them all the same.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, bucket_by: str | None = None, order: str | None = None, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.bucket_by, self.order, self.buckets = bucket_by or key, order, buckets
        self.schema: StructType = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def _finished(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        found = [s.getPath() for s in self._fs.listStatus(self._at("")) if s.isDirectory()]
        return sorted(p.getName() for p in found if self._fs.exists(self._at(f"{p.getName()}/_SUCCESS")))

    def _replaced(self, finished: list[str]) -> set[str]:
        """Batches that a finished one stands for."""
        lists = [f"{self.path}/{b}/_replaces" for b in finished if self._fs.exists(self._at(f"{b}/_replaces"))]
        return {name for at in lists for name in self._text(at).split("\n")}

    def _text(self, path: str) -> str:
        stream = self._fs.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def batches(self) -> list[str]:
        """Directories of finished batches that count, oldest first."""
        finished = self._finished()
        gone = self._replaced(finished)
        return [b for b in finished if b not in gone]

    def write(self, rows: DataFrame, gone: DataFrame | None = None) -> str:
        """Append rows, and delete the rows of ``gone`` (at least key, bucket and order column); both at once."""
        names = self.schema.names
        out = rows.select(*names, F.lit(False).alias("_gone"), F.lit(None).cast("string").alias("_from"))
        if gone is not None:
            filled = [F.col(f.name) if f.name in gone.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
            out = out.unionByName(gone.select(*filled, F.lit(True).alias("_gone"), F.lit(None).cast("string").alias("_from")))
        return self._append(out)

    def _append(self, out: DataFrame) -> str:
        batch = f"_batch={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        out.withColumn("_bucket", self._bucket()).repartition("_bucket", self.bucket_by).write.partitionBy("_bucket").parquet(f"{self.path}/{batch}")
        return batch

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows; of ``keys`` (with the bucket column) only those in the buckets that they touch."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self._newest(done, keys).where("NOT _gone").select(*self.schema.names)

    def _newest(self, done: list[str], keys: DataFrame | None = None) -> DataFrame:
        """The newest row of each key in some batches, whether it is deleted, and the batch that it came from."""
        schema = StructType(list(self.schema.fields)).add("_gone", "boolean").add("_from", "string").add("_batch", "string").add("_bucket", "integer")
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/{b}" for b in done))
        if keys is not None:
            touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
            rows = rows.where(F.col("_bucket").isin(touched)).join(keys.select(self.bucket_by).distinct(), self.bucket_by, "left_semi")
        rows = rows.withColumn("_from", F.coalesce("_from", "_batch"))
        rank = F.struct(*([F.col(self.order)] if self.order else []), "_from")
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names, "_gone", "_from"), rank).alias("row"))
        return newest.select("row.*")

    def compact(self, keep: float = 3_600.0) -> None:
        """One batch instead of all that there are now.

        Batches that it stands for are left to readers under way for ``keep`` seconds: the first compaction after that deletes them.
        """
        finished = self._finished()
        gone = self._replaced(finished)
        old = [b for b in finished if b not in gone]
        if len(old) > 1:
            batch = self._append(self._newest(old))
            out = self._fs.create(self._at(f"{batch}/_replaces"), True)
            out.write("\n".join(finished).encode())
            out.close()
        # A batch names all that there were before it, so nothing comes back when one of those is deleted.
        settled = [b for b in self._finished() if self._age(b) >= keep]
        for name in self._replaced(settled).intersection(finished):
            self._fs.delete(self._at(name), True)

    def _age(self, batch: str) -> float:
        """Seconds since a batch was finished."""
        return time.time() - self._fs.getFileStatus(self._at(f"{batch}/_SUCCESS")).getModificationTime() / 1_000
