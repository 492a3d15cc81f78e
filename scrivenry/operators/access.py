"""Access rights: the predicate every read of passages carries, and a check that a plan carries it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


class AccessDeniedError(ValueError):
    """No identity, or a plan that reads passages without its filter."""


@dataclass(frozen=True)
class Identity:
    """A caller; groups are sorted and distinct. A blank user is refused."""

    user: str
    groups: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.user.strip():
            raise AccessDeniedError("an identity needs a user")
        object.__setattr__(self, "groups", tuple(sorted(set(self.groups))))

    def predicate(self) -> Column:
        """The user is named, or one of the groups is; empty lists admit nobody."""
        named = F.array_contains("acl_users", self.user)
        return named | F.arrays_overlap("acl_groups", F.array(*map(F.lit, self.groups))) if self.groups else named


def visible(passages: DataFrame, who: Identity) -> DataFrame:
    """Only what the caller may see."""
    return passages.where(F.coalesce(who.predicate(), F.lit(False)))


def _signed(names: str, sign: str) -> Column:
    return F.coalesce(F.transform(names, lambda x: F.concat(F.lit(sign), x)), F.array().cast("array<string>"))


def rights_of(users: str = "acl_users", groups: str = "acl_groups") -> Column:
    """Tokens of whom a passage admits."""
    return F.concat(_signed(users, "u:"), _signed(groups, "g:"))


def tokens_of(user: str = "user_id", groups: str = "groups") -> Column:
    """Tokens of what a caller is."""
    return F.array_union(F.array(F.concat(F.lit("u:"), user)), _signed(groups, "g:"))


def visible_pairs(passages: DataFrame, principals: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(qid, key) of everything each principal (qid, user_id, groups) may see.

    Rights are exploded into tokens on both sides, so it is an equi-join however many principals there are. The result is as
    large as what they see: to filter ranked passages use :func:`admitted`.
    """
    rights = passages.select(key, F.explode(rights_of()).alias("token"))
    held = principals.select("qid", F.explode(tokens_of()).alias("token"))
    return rights.join(held, "token").select("qid", key).distinct()


def admitted(scored: DataFrame, passages: DataFrame, principals: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of ``scored`` (qid, key, …) whose passage the question's caller may see; passages left out are seen by nobody.

    Rights are looked up for scored rows only, so the work is theirs and not callers times passages.
    """
    rows = scored.join(passages.select(key, rights_of().alias("_rights")), key).join(principals.select("qid", tokens_of().alias("_held")), "qid")
    return rows.where(F.arrays_overlap("_rights", "_held")).select(*scored.columns)


def only_admitted(hits: DataFrame, rights: str = "_rights", held: str = "_held") -> DataFrame:
    """``hits`` without its columns of the passage's and the caller's tokens; a row whose caller may not see its passage fails the job.

    It is a second look at what was filtered before, on rows that are joined anyway: an index that is out of date or a
    leg without its filter can't leak a passage. Missing lists admit nobody.
    """
    seen = F.coalesce(F.arrays_overlap(rights, held), F.lit(False))
    return hits.where(F.when(seen, F.lit(True)).otherwise(F.raise_error(F.lit("access denied: a hit that its caller may not see")).cast("boolean"))).drop(rights, held)


def verify_access(df: DataFrame) -> None:
    """Refuse a plan that joins, aggregates, sorts or cuts passages before their access filter.

    Walks the analyzed plan: on the way down from the root, every relation with an ``acl_users`` column must lie under a
    filter on it, with nothing between filter and relation but projections, filters and aliases.
    """
    nodes = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    at = 0

    def walk(guarded: bool) -> None:
        nonlocal at
        node = nodes[at]
        at += 1
        kind = node["class"].rsplit(".", 1)[-1]
        if kind == "Filter":
            guarded = guarded or ("acl_users" in json.dumps(node["condition"]) and "ArrayContains" in json.dumps(node["condition"]))
        elif kind not in ("Project", "SubqueryAlias", "View"):
            leaf = node["num-children"] == 0
            if leaf and "acl_users" in json.dumps(node.get("output", "")) and not guarded:
                raise AccessDeniedError("a relation with access lists is read without its filter")
            if not leaf:
                guarded = False
        for _ in range(node["num-children"]):
            walk(guarded)

    walk(False)


@dataclass(frozen=True)
class RightsIndex:
    """(key, number) of the passages and (token, bucket, bits): which numbers of a bucket each token opens."""

    numbers: DataFrame
    bitmaps: DataFrame
    key: str


def rights_index(passages: DataFrame, key: str = "chunk_id") -> RightsIndex:
    """Number the passages and keep a bitmap of 32,768 of them for each token and bucket of numbers in which it opens some."""
    numbers = staged(passages.select(key, rights_of().alias("rights")).withColumn("number", F.monotonically_increasing_id()), "numbers")
    opened = numbers.select("number", F.explode(F.array_distinct("rights")).alias("token"))
    bits = opened.groupBy("token", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    return RightsIndex(numbers.select(key, "number"), staged(bits, "bitmaps"), key)


def opened_to(index: RightsIndex, principals: DataFrame) -> DataFrame:
    """(qid, bucket, bits) of what each principal (qid, user_id, groups) may see: the union of the bitmaps of its tokens."""
    held = principals.select("qid", F.explode(tokens_of()).alias("token"))
    return held.join(index.bitmaps, "token").groupBy("qid", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def visible_counts(index: RightsIndex, principals: DataFrame) -> DataFrame:
    """(qid, n): how many passages each principal may see, counted on bitmaps alone."""
    counts = opened_to(index, principals).groupBy("qid").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return principals.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def admitted_by_index(rows: DataFrame, index: RightsIndex, principals: DataFrame) -> DataFrame:
    """The rows (qid, key, …) whose passage the question's caller may see, as :func:`admitted` finds them, by the caller's bit."""
    placed = rows.join(index.numbers, index.key).withColumn("bucket", F.bitmap_bucket_number("number"))
    at = F.bitmap_bit_position("number").cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, int(bitmap_bit_position(number) div 8) + 1, 1)")), 16, 10).cast("int")
    is_open = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
    return placed.join(opened_to(index, principals), ["qid", "bucket"]).where(is_open).select(*rows.columns)
