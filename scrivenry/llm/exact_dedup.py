"""Exact duplicates: static filters per immutable snapshot, exact buckets for what passes, byte checks at the end."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .store import rows_that_stay, stage_table, text_column

#: Distinct digests that a bucket, and so a filter, holds on average.
BUCKET_KEYS = 65_536


def normalised(text: Column) -> Column:
    """The text with each run of white space (0x20, 0x09 to 0x0D) as one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """(doc_id, sha, group_key): the SHA-256 of each normalised text and the key of its group.

    ``digest_bits`` below 256 shortens the group key only (tests use it to force collisions).
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(text_column(docs)), 256).alias("sha"))
    return out.withColumn("group_key", F.substring("sha", 1, digest_bits // 4)).withColumn("sha", F.unhex("sha"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("group_key")
    return groups.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned(key, 20), F.lit(buckets)).cast("int"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def _filters(exact: DataFrame, name: int) -> DataFrame:
    """One binary-fuse filter for each exact bucket."""

    def filtered(keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [keys.bucket.iloc[0]], "blob": [fuse.build(keys.key.to_numpy())]})

    return exact.select("bucket", "key").groupBy("bucket").applyInPandas(filtered, "bucket int, blob binary").withColumn("snapshot", F.lit(name))


def save_snapshot(docs: DataFrame, path: str) -> None:
    """Write the digests of ``docs`` as an immutable snapshot: exact buckets and filters under ``path``, for later batches."""
    rows = digests(docs)
    buckets = max(1, math.ceil(rows.count() / BUCKET_KEYS))
    _keyed(_grouped(rows), buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/exact")
    _filters(docs.sparkSession.read.parquet(f"{path}/exact"), 0).write.parquet(f"{path}/filters")


def seen_before(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(doc_id, text_sha256, old_id) of documents whose digest a saved snapshot has, old_id the smallest doc_id there.

    A batch's own duplicates are left to ``exact_duplicates``. Null texts count as empty; a null doc_id stays null; an empty
    batch, or no snapshot, gives an empty table.
    """
    spark = docs.sparkSession
    rows = stage_table(digests(docs), "batch")
    found = rows.select("group_key", F.col("doc_id").alias("old_id")).limit(0)
    for path in paths:
        exact = spark.read.parquet(f"{path}/exact")
        first = exact.select("buckets").first()
        if first is not None:
            passed = screen(_keyed(_grouped(rows), first.buckets), spark.read.parquet(f"{path}/filters"))
            found = found.unionByName(passed.select("group_key", "bucket").join(exact.select("group_key", "bucket", F.col("first_id").alias("old_id")), ["group_key", "bucket"]).select("group_key", "old_id"))
    least = found.groupBy("group_key").agg(F.min("old_id").alias("old_id"))
    return rows.join(least, "group_key").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "old_id")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming distinct digests that some snapshot's filter lets pass, once for each such snapshot."""

    def probed(keys: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        found = [keys[fuse.contains(blob, keys.key.to_numpy())].assign(snapshot=number) for blob, number in zip(blobs.blob, blobs.snapshot, strict=True)] if len(keys) else []
        return pd.concat(found) if found else keys.assign(snapshot=0).head(0)

    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probed, "group_key string, first_id long, n long, key long, bucket int, snapshot int")


def exact_duplicates(docs: DataFrame, snapshots: int = 2, digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space is normalised; nulls count as empty. The smallest doc_id
    of equal texts stays; rows without an id stay only where all of their group lack one, and keep_id is null then. Rows
    that repeat an id and a text are counted and marked each (``without_duplicates`` leaves one of them); an id with
    several texts is in the group of each; other columns are ignored; an empty table gives an empty one.

    The table is taken in ``snapshots`` parts by doc_id, as they would arrive: each part is grouped by itself, its distinct
    digests are screened by the filters of the parts before it, what passes is joined with their exact buckets, and
    then the part becomes a snapshot. Groups whose digest agrees are checked byte by byte at the end, against
    the text of the row that stays; rows that differ are grouped by their text.
    """
    rows = stage_table(digests(docs, digest_bits), "digests")
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if not count:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    low, high = low or 0, high or 0
    buckets = max(1, math.ceil(count / snapshots / BUCKET_KEYS))
    width = (high - low) // snapshots + 1
    part = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(0))
    exacts: list[DataFrame] = []
    filters: DataFrame | None = None
    merged: list[DataFrame] = []
    for i in range(snapshots):
        exact = stage_table(_keyed(_grouped(rows.where(part == i)), buckets), "exact")
        if filters is not None:
            passed = screen(exact.select("group_key", "first_id", "n", "key", "bucket"), filters)
            for k, before in enumerate(exacts):
                hits = passed.where(F.col("snapshot") == k).select("group_key", F.col("bucket"), "first_id", "n")
                merged.append(hits.join(before.select("bucket", "group_key", F.col("first_id").alias("old_id"), F.col("n").alias("old_n")), ["bucket", "group_key"]).select("group_key", F.lit(k).alias("old"), "old_id", "old_n"))
        exacts.append(exact)
        if i + 1 < snapshots:
            own = stage_table(_filters(exact, i), "filters")
            filters = own if filters is None else filters.unionByName(own)
    own = None
    for i, exact in enumerate(exacts):
        now = exact.select("group_key", "first_id", "n", F.lit(i).alias("part"))
        own = now if own is None else own.unionByName(now)
    if merged:
        links = merged[0]
        for m in merged[1:]:
            links = links.unionByName(m)
        crossed = stage_table(links.select("group_key").distinct(), "crossed")
        together = own.join(crossed, "group_key", "left_semi").groupBy("group_key").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
        own = own.join(crossed, "group_key", "left_anti").select("group_key", "first_id", "n").unionByName(together)
    groups = stage_table(own.select("group_key", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")), "groups")
    joined = stage_table(rows.join(groups, "group_key"), "joined")
    differing = stage_table(_differing(docs, joined), "differing")
    if differing.isEmpty():
        final = joined.select("doc_id", "keep_id", "group_size", "sha")
    else:
        final = _regrouped(joined, differing)
    return final.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _differing(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of groups whose texts aren't all the same byte for byte: doc_id, sha, group_key, text."""
    several = joined.where("group_size > 1").select("doc_id", "sha", "group_key").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), normalised(text_column(docs)).alias("text")).withColumn("own_sha", F.unhex(F.sha2("text", 256)))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha") == F.col("sha"))
    members = texts.join(several, same).select("doc_id", "sha", "group_key", "text")
    # Of equal texts one is enough to compare; a group's copies meet in the map-side part of this aggregation.
    kinds = members.groupBy("group_key", F.sha2("text", 512).alias("d")).agg(F.max("text").alias("high"), F.min("text").alias("low"))
    odd = kinds.groupBy("group_key").agg(F.count("*").alias("kinds"), F.max(F.expr("high <> low")).alias("mixed")).where("kinds > 1 or mixed")
    return members.join(odd.select("group_key"), "group_key", "left_semi")


def _regrouped(joined: DataFrame, differing: DataFrame) -> DataFrame:
    """Groups by text where a digest covers several texts."""
    kinds = differing.groupBy("group_key", "text").agg(F.min("doc_id").alias("k"), F.count("*").alias("g"))
    fixed = differing.join(kinds, ["group_key", "text"]).select(F.col("doc_id").alias("own_id"), F.col("sha").alias("own_sha"), "k", "g").distinct()
    out = joined.join(fixed, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha") == F.col("sha")), "left")
    new = F.col("g").isNotNull()
    return out.select("doc_id", F.when(new, F.col("k")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(new, F.col("g")).otherwise(F.col("group_size")).alias("group_size"), "sha")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, one for each text, all columns as they are.

    A row is known by its id (null or not) and its text's digest, so an id that repeats with another text is decided for
    each text. Of rows that agree in both, which are rare, one is kept.
    """
    decided = stage_table(exact_duplicates(docs), "decided").select(F.col("doc_id").alias("own_id"), F.unhex("text_sha256").alias("own_digest"), "kept")
    return rows_that_stay(docs, F.unhex(F.sha2(normalised(text_column(docs)), 256)), decided)
