"""Raw source documents (JSON of any shape) as typed rows: schema on read that tolerates what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "array<struct<page_no:bigint,text:string>>"


def _kind(v: Column) -> Column:
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _whole_number(v: Column) -> Column:
    """An integer from a number or a string of digits; booleans are none."""
    kind = _kind(v)
    digits = F.trim(F.try_variant_get(v, "$", "string"))
    from_text = F.when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("bigint"))
    return F.when(kind == "STRING", from_text).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double").try_cast("bigint"))


def _scalar(v: Column) -> Column:
    """A string or an integer as trimmed text; blank is null."""
    value = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when(_kind(v).isin("STRING", "BIGINT") & (F.length(value) > 0), value)


def _texts(v: Column) -> Column:
    """A list's entries, or the one value, as trimmed texts without blank ones."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)), F.array().cast("array<variant>"))
    shown = F.transform(items, lambda x: F.when(~F.is_variant_null(x), F.trim(F.try_variant_get(x, "$", "string"))))
    return F.filter(shown, lambda x: F.length(x) > 0)


def map_source(raw: DataFrame, source: str = "source", max_pages: int = 5_000, max_chars: int = 20_000_000) -> DataFrame:
    """``raw`` with pages, text, truncated and the document's fields read from the JSON in ``source``.

    Page entries without text are skipped; a page without a number from 1 on has its place in the list. Pages stop at the
    first that goes over ``max_pages`` or, all in all, ``max_chars``, and ``truncated`` says so. A document without pages has
    its text, cut at ``max_chars``. Lists may be single values; what doesn't fit a field is null. Broken JSON gives an
    empty document.
    """
    v = F.col("_v")
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    listed = F.coalesce(F.try_variant_get(v, "$.pages", "array<variant>"), F.array().cast("array<variant>"))
    entry = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")

    def page(x: Column, i: Column) -> Column:
        number, text = _whole_number(entry(x, "page_no")), entry(x, "text")
        return F.struct(F.when(number >= 1, number).otherwise((i + 1).cast("bigint")).alias("page_no"), F.when(_kind(text) == "STRING", F.try_variant_get(text, "$", "string")).alias("text"))

    found = F.filter(F.transform(listed, page), lambda p: p["text"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        stop = acc["stop"] | (acc["n"] >= max_pages) | (acc["chars"] + F.length(p["text"]) > max_chars)
        return F.struct((acc["n"] + F.when(stop, 0).otherwise(1)).alias("n"), (acc["chars"] + F.when(stop, 0).otherwise(F.length(p["text"]))).cast("bigint").alias("chars"), stop.alias("stop"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("chars"), F.lit(False).alias("stop"))
    own = F.when(_kind(field("text")) == "STRING", F.try_variant_get(v, "$.text", "string"))
    out = raw.withColumn("_v", F.try_parse_json(F.col(source))).withColumn("_found", found)
    out = out.withColumn("_n", F.aggregate("_found", start, step, lambda acc: acc["n"]))
    paged = F.col("_n") > 0
    return out.select(
        *raw.columns, F.slice("_found", 1, F.col("_n")).cast(PAGE).alias("pages"), F.when(paged, "").otherwise(F.coalesce(F.substring(own, 1, max_chars), F.lit(""))).alias("text"),
        (F.when(paged, F.col("_n") < F.size("_found")).otherwise(F.coalesce(F.length(own) > max_chars, F.lit(False)) | ((F.size("_found") > 0) & own.isNull()))).alias("truncated"),
        *(_scalar(field(c)).alias(c) for c in ("doc_type", "owner", "language")), _whole_number(field("version")).alias("version"), F.try_to_timestamp(F.try_variant_get(v, "$.created_at", "string")).alias("created_at"),
        *(_texts(field(c)).alias(c) for c in ("tags", "acl_users", "acl_groups")),
    )
