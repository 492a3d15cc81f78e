"""Intermediate tables that every executor can read and that outlive an executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for unset local masters."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("-")[0].startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/scrivenry/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_delete_all)
    _WRITTEN.setdefault("paths", []).append(path)
    return path


def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    drop(spark, *_WRITTEN.get("paths", []))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _WRITTEN.get("paths", []):
            _WRITTEN["paths"].remove(path)


def paths_of(*staged: DataFrame) -> list[str]:
    """The folders of staged tables."""
    return [t._staged_at for t in staged]


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def text_column(df: DataFrame, name: str = "text") -> Column:
    """A text column with nulls as empty strings."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def rows_that_stay(docs: DataFrame, digest: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those decided against, all columns as they are.

    ``decided`` has own_id, own_digest and kept for each row; a row is known by its doc_id (null or not) and ``digest``. Of
    rows that agree in both, which are rare, one stays. What goes is usually little, so Spark may broadcast it by its own
    size check; beyond that the tables are joined by sort and merge.
    """
    name = unused(docs, "digest")
    gone = stage_table(decided.where("NOT kept").select("own_id", "own_digest").distinct(), "gone")
    often = stage_table(decided.where("kept").groupBy("own_id", "own_digest").agg(F.count("*").alias("n")).where("n > 1").select("own_id", "own_digest"), "often")
    tagged = docs.withColumn(name, digest)
    same = tagged["doc_id"].cast("long").eqNullSafe(F.col("own_id")) & (tagged[name] == F.col("own_digest"))
    out = tagged.join(gone, same, "left_anti")
    if not often.isEmpty():
        out = out.join(often, same, "left_anti").unionByName(tagged.join(often, same, "left_semi").dropDuplicates(["doc_id", name]))
    return out.select(docs.columns)


#: What a Python worker is sent of a table at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, as long texts come ten thousand at a time else."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
