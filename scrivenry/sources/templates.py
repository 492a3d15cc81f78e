"""Strict mappings: which fields a table of documents has, and what is wrong with documents that have others."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Fields and their kinds for tables named like ``pattern`` (``*`` for anything).

    Kinds are keyword, keywords (a list, or one value), text, integer, long, boolean, date and ``vector:<dims>``. Keywords longer
    than ``longest`` characters aren't kept, as they aren't in an index.
    """

    pattern: str
    fields: Mapping[str, str]
    longest: int = 256

    def matches(self, name: str) -> bool:
        return re.fullmatch(".*".join(map(re.escape, self.pattern.split("*"))), name) is not None


def physical_name(prefix: str, version: str, model: str) -> str:
    """A table's name with the version and the model that it was made with."""
    return f"{prefix}_{version}_{re.sub(r'[^a-z0-9]', '', model.lower())}"


def _read(v: Column, kind: str, longest: int) -> tuple[Column, Column]:
    """The value of a field of some kind, and whether it can't be one."""
    of = F.when(v.isNotNull(), F.schema_of_variant(v))
    given = v.isNotNull() & ~F.is_variant_null(v)
    plain = F.try_variant_get(v, "$", "string")
    if kind == "keyword":
        return F.when(F.length(plain) <= longest, plain), given & of.rlike("^(ARRAY|OBJECT)")
    if kind == "text":
        return plain, given & (of != "STRING")
    if kind == "keywords":
        listed = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.when(given & ~of.rlike("^(ARRAY|OBJECT)"), F.array(plain)))
        return F.filter(listed, lambda x: F.length(x) <= longest), given & listed.isNull()
    if kind in ("integer", "long"):
        number = F.when(of.rlike("^(STRING|BIGINT)"), F.trim(plain).try_cast("int" if kind == "integer" else "bigint"))
        return number, given & number.isNull()
    if kind == "boolean":
        return F.when(of == "BOOLEAN", plain == "true"), given & (of != "BOOLEAN")
    if kind == "date":
        at = F.try_to_timestamp(plain)
        return at, given & at.isNull()
    if kind.startswith("vector:"):
        values = F.try_variant_get(v, "$", "array<double>")
        sound = (F.size(values) == int(kind[7:])) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(values, lambda x: x != 0)
        return F.when(sound, values), given & ~F.coalesce(sound, F.lit(False))
    raise ValueError(f"unknown kind {kind}")


def strictly_mapped(raw: DataFrame, template: Template, source: str = "source") -> DataFrame:
    """``raw`` with the template's fields read from the JSON in ``source``, and ``problem``: why the document is refused, or null.

    A document is refused that is no JSON object, has fields that weren't planned, or a value that its field can't have; all
    reasons are named, in order, and the fields of a refused document are null. Fields may be missing or null.
    """
    taken = [c for c in template.fields if c in raw.columns or c == "problem"]
    if taken:
        raise ValueError(f"fields that are columns already: {', '.join(taken)}")
    v = F.col("_v")
    names = F.json_object_keys(F.col(source))
    read = {name: _read(F.try_variant_get(v, f"$.{name}", "variant"), kind, template.longest) for name, kind in template.fields.items()}
    unplanned = F.array_sort(F.array_distinct(F.array_except(names, F.array(*map(F.lit, template.fields)))))
    reasons = F.concat(
        F.transform(unplanned, lambda n: F.concat(F.lit("unplanned "), n)), F.filter(F.array(*(F.when(bad, F.lit(f"bad {name}")) for name, (_, bad) in read.items())), lambda x: x.isNotNull()),
    )
    whole = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT") & names.isNotNull()
    problem = F.when(~F.coalesce(whole, F.lit(False)), "no object").when(F.size(reasons) > 0, F.array_join(reasons, ", "))
    out = raw.withColumn("_v", F.try_parse_json(F.col(source))).withColumn("problem", problem)
    return out.select(*raw.columns, *(F.when(F.col("problem").isNull(), value).alias(name) for name, (value, _) in read.items()), "problem")
