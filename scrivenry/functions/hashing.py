"""Digests that name contents, scopes and users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, RECORD = "\x1f", "\x1e"


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def chunk_id(item_id: Column, number: Column, digest: Column) -> Column:
    return F.concat_ws(":", item_id, number, digest)


def pages_hash(pages: Column) -> Column:
    """SHA-256 over page number and text of each page; pages are (page_no, page)."""
    parts = F.transform(pages, lambda p: F.concat(p["page_no"].cast("string"), F.lit(UNIT), p["page"], F.lit(RECORD)))
    return F.sha2(F.array_join(parts, ""), 256)


def metadata_hash() -> Column:
    """SHA-256 over a document's filter and access fields, lists sorted."""
    parts = [F.col("item_id"), F.col("doc_type"), F.array_join(F.sort_array("tags"), ","), F.array_join("acl_users", ","), F.array_join(F.sort_array("acl_groups"), ",")]
    return F.sha2(F.concat_ws(UNIT, *parts), 256)


def scope_key(user: Column, groups: Column) -> Column:
    """32 hex digits that name an access scope."""
    return short_hash(F.concat(user, F.lit(UNIT), F.array_join(F.sort_array(F.array_distinct(groups)), ",")), 32)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, *parts), 256)


def hash_vector(text: Column, dims: int = 32) -> Column:
    """A deterministic unit vector from the bytes of the text's SHA-256."""
    from .vectors import normalised

    def raw(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") - 127.5)

    # As lambdas' variables the digest and its bytes are computed once.
    return F.transform(F.transform(F.array(F.sha2(text, 256)), raw), lambda v: normalised(v))[0]
