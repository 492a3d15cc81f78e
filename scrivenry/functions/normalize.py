"""Normalising paged documents: running headers and footers away, lines of a paragraph joined."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.staging import staged
from . import text


def edge_lines(pages: DataFrame, edges: int = 2) -> DataFrame:
    """(doc_id, page_no, line_no, line): a page's first and last non-empty lines, ``edges`` each but at most a third of them."""
    rows = pages.select("doc_id", "page_no", F.filter(F.split("page", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("l")).select("doc_id", "page_no", F.size("l").alias("n"), F.posexplode("l").alias("line_no", "line"))
    width = F.least(F.lit(edges), F.floor(F.col("n") / 3))
    return rows.where((F.col("line_no") < width) | (F.col("line_no") >= F.col("n") - width)).select("doc_id", "page_no", "line_no", "line")


def edge_positions(lines: Column, edges: int = 3) -> Column:
    """Indexes in ``lines`` of the first and last non-empty ones, ``edges`` each but at most a third of them."""
    filled = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("(?U)\\S"), i)), lambda i: i.isNotNull())
    width = F.least(F.lit(edges), F.floor(F.size(filled) / 3))
    return F.filter(filled, lambda x, i: (i < width) | (i >= F.size(filled) - width))


def repeated_edges(pages: DataFrame, share: float = 0.4, least_pages: int = 4) -> DataFrame:
    """(doc_id, key, n): keys of the edge lines that are on at least 40% and two of a document's pages; ``pages`` has lines and edge."""
    many = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    keys = F.array_distinct(F.transform("edge", lambda i: text.edge_key(F.get("lines", i))))
    counted = pages.select("doc_id", F.explode(keys).alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n")).join(many, "doc_id")
    return counted.where(F.col("n") >= F.greatest(F.lit(2), share * F.col("pages"))).select("doc_id", "key", "n")


def with_edges(pages: DataFrame, edges: int = 3) -> DataFrame:
    """The pages with their lines, and the indexes of those at the edges."""
    return pages.withColumn("lines", F.split("page", "\n")).withColumn("edge", edge_positions(F.col("lines"), edges))


def reflowed(lines: Column, short: int = 50) -> Column:
    """The lines as a text in which those of a paragraph are joined; tables, headings and list items keep their own lines.

    A hyphen at a line's end goes when a letter stands before it and the next line begins in lower case. A paragraph
    ends with a heading, or with a sentence while all of it is shorter than ``short``. Between blocks one blank line stays.
    """

    def known(raw: Column) -> Column:
        # Each a lambda's variable, so that it is found once and not for every use.
        return text.once(text.is_table_line(raw), lambda row: text.once(F.when(row, raw).otherwise(text.collapse_spaces(raw)), lambda one: text.once(text.trimmed(one), lambda line: F.struct(
            line.alias("line"), (F.length(line) == 0).alias("blank"), row.alias("row"), (row | text.is_list_item(line) | text.is_heading(line)).alias("own"),
        ))))

    def step(s: Column, x: Column) -> Column:
        gap = s["gap"] | s["closed"] | x["own"]
        hyphen = F.endswith(s["last"], F.lit("-")) & s["last"].rlike("\\p{L}-$") & x["line"].rlike("^\\p{Ll}")
        joined = F.when(hyphen, F.concat(F.substring(s["last"], F.lit(1), F.length(s["last"]) - 1), x["line"])).otherwise(F.concat(s["last"], F.lit(" "), x["line"]))
        last = F.when(s["last"].isNull() | gap, x["line"]).otherwise(joined)
        out = F.when(s["last"].isNull() | ~gap, s["out"]).otherwise(F.concat(s["out"], s["last"], F.when(s["gap"], "\n\n").otherwise("\n")))

        def next_state(last: Column) -> Column:
            closed = x["row"] | text.is_table_line(last) | text.ends_paragraph(last, short)
            return F.struct(out.alias("out"), last.alias("last"), closed.alias("closed"), F.lit(False).alias("gap"))

        following = F.get(F.transform(F.array(last), next_state), F.lit(0))
        return F.when(x["blank"], s.withField("gap", s["last"].isNotNull())).otherwise(following)

    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(True).alias("closed"), F.lit(False).alias("gap"))
    return F.aggregate(F.transform(lines, known), start, step, lambda s: F.concat(s["out"], F.coalesce(s["last"], F.lit(""))))


def normalised_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, page): normal form C, characters cleaned, repeated edges dropped, lines reflowed.

    All of it is native but normal form, which Spark lacks: pages beyond ASCII go through Arrow batches once for it.
    """
    # One shuffle before the work on lines, so that it has all cores however few row groups the pages come in.
    pages = pages.repartition("doc_id", "page_no")
    ascii_only = ~F.col("page").rlike("[^\\x00-\\x7f]")
    composed = pages.withColumn("page", F.when(ascii_only, F.col("page")).otherwise(_composed("page")))
    cut = composed.withColumn("lines", F.split(text.clean_characters(F.col("page")), "\n")).withColumn("edge", edge_positions(F.col("lines")))
    cut = staged(cut.drop("page"), "pages")
    running = repeated_edges(cut).groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    joined = cut.join(running, "doc_id", "left")
    kept = F.filter("lines", lambda x, i: ~(F.array_contains("edge", i) & F.coalesce(F.array_contains("gone", text.edge_key(x)), F.lit(False))))

    return joined.select("doc_id", "page_no", reflowed(kept).alias("page"))


@F.pandas_udf(StringType())
def _composed(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: unicodedata.normalize("NFC", p), na_action="ignore")
