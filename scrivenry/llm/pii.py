"""Personal data: spans of fixed kinds, and terms that disclose a protected entity, by corpus co-occurrence.

Everything here is DataFrame functions. A kind's matches come from ``regexp_extract_all``; their places come from splitting the
text by the same pattern, as a match begins where the pieces and matches before it end.

Sanitisation is information-theoretic: an entity (a value found in the corpus) has the information content
``-log2 p(entity)``; a term reveals ``log2(p(entity, term) / (p(entity) p(term)))`` of it, probabilities being shares of all
documents. Both are looked for in whole documents, however far apart, terms outside the spans of fixed kinds. A term that
reveals at least ``generalise`` of an entity's content is replaced by its kind, from ``remove`` on it is taken out, in every
document that has the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage_table, text_column

#: Kinds in the order that breaks ties, each with the pattern's Java form. The quantifiers that never have to
#: give back are possessive, so that long runs need no recursion and no second try; a match begins at the start of its run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: What a text must have for a kind's pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words of a term: letters, their marks and digits, found by what stands between them.
WORD, GAP = r"[\p{L}\p{M}\p{N}]++", r"[^\p{L}\p{M}\p{N}]++"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(x), then)[0]


SPAN = "array<struct<start:int,end:int,value:string>>"


def _located(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None, run: int = 128) -> Column:
    """(start, end, value) of all matches, or those with a ``wanted`` value, in code points.

    Matches are added up in runs of ``run``, each from 0, and then moved to where their run begins, so the work grows
    with the number of matches and not with its square.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(SPAN)
    zipped = _bound(found, lambda values: F.arrays_zip(F.slice(pieces, 1, F.size(values)).alias("piece"), values.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["value"])
        more = F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))))
        return F.struct(end.alias("at"), (F.when(wanted(x["value"]), more).otherwise(acc["spans"]) if wanted else more).alias("spans"))

    def added(matches: Column) -> Column:
        return F.aggregate(matches, F.struct(F.lit(0).alias("at"), F.coalesce(F.lit(None).cast(SPAN), empty).alias("spans")), step)

    def moved(runs: Column) -> Column:
        begins = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        shift = lambda r, by: F.transform(r["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(runs, _bound(begins, lambda x: F.slice(x, 1, F.size(runs))), shift))

    def all_of(matches: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / run).cast("int")), lambda i: added(F.slice(matches, i * run + 1, run)))
        return F.when(F.size(matches) <= run, added(matches)["spans"]).otherwise(_bound(runs, moved))

    return _bound(zipped, all_of)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, kind, end, value) over all kinds, by start and then kind."""

    def of(rank: int, kind: str) -> Column:
        found = F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        shaped = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        possible = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike("[0-9](?:[ -]?[0-9]){13}")
        return F.when(possible, shaped).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>"))

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _replaced(text: Column, spans: Column, shown: Callable[[Column, Column], Column], many: int = 256) -> Column:
    """The text with ``shown`` (of a span and where the ones before it end) in place of each span, by start.

    Pieces of a text with up to ``many`` spans are cut from the string; with more, from an array of its characters, as to find
    a place in a string means to walk there.
    """

    def joined(piece: Callable[[Column, Column], Column], whole: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            before = F.greatest(s["start"] - acc["at"], F.lit(0))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], before), shown(s, acc["at"]))).alias("out"))

        def added(own: Column, at: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(own, start, step, lambda acc: F.struct(acc["at"].alias("at"), F.array_join(acc["out"], "").alias("out")))

        def rest(last: Column) -> Column:
            return F.array_join(F.concat(last["out"], F.array(piece(last["at"], F.greatest(whole - last["at"], F.lit(0))))), "")

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / 128).cast("int")), lambda i: F.slice(spans, i * 128 + 1, 128))
        one = lambda acc, own: _bound(added(own, acc["at"]), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))
        return F.aggregate(runs, start, one, rest)

    direct = joined(lambda at, n: F.substring(text, at + 1, n), F.length(text))
    by_letter = _bound(F.split(text, ""), lambda x: joined(lambda at, n: F.array_join(F.slice(x, at + 1, n), ""), F.length(text)))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= many, direct).otherwise(by_letter)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with as many spaces as a span has code points in its place."""
    return _replaced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))


def _words(text: Column) -> Column:
    """Distinct lower-case words. One or two cased letters alone (``to``, ``of``) are none; two digits or caseless letters are."""
    found = F.array_distinct(F.transform(F.array_distinct(F.split(text, GAP)), lambda w: F.lower(w)))
    return F.filter(found, lambda w: (F.length(w) >= 3) | w.rlike(r"[\p{N}\p{Lo}]"))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["value"])))


def disclosing_terms(found: DataFrame, documents: int, support: int = 2, generalise: float = 0.5) -> DataFrame:
    """(row, term, share) of terms that reveal ``generalise`` or more of the information content of an entity that the row has.

    ``found`` has row, spans and ``rest`` (the text without its spans) of all documents. Entities, terms and pairs of them
    are counted by whole documents. Terms stand with an entity in ``support`` documents or more: what occurs with a value
    once says nothing about the corpus. As a pair is in no more documents than its entity, a share of ``generalise`` needs
    n_term <= n_entity^generalise * documents^(1 - generalise), which prunes pairs before they are made.
    """
    owned = found.where(F.size("spans") > 0).select("row", F.explode(_entities(F.col("spans"))).alias("entity"))
    of_entity = owned.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    bound = F.pow("n_entity", F.lit(generalise)) * F.pow(F.lit(float(documents)), F.lit(1 - generalise)) * (1 + 1e-9)
    known = stage_table(owned.join(of_entity, "entity").withColumn("bound", bound), "known")
    words = found.select("row", F.explode(_words(F.col("rest"))).alias("term"))
    most = known.agg(F.max("bound")).first()[0] or 0.0
    of_term = words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term").between(support, most))
    holders = found.where(F.size("spans") > 0).join(known.select("row").distinct(), "row", "left_semi")
    near = holders.select("row", F.explode(_words(F.col("rest"))).alias("term")).join(of_term, "term")
    pairs = stage_table(near.join(known, "row").where(F.col("n_term") <= F.col("bound")).select("row", "entity", "n_entity", "term", "n_term"), "pairs")
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).where(F.col("n_both") >= support)
    content = -F.log2(F.col("n_entity") / documents)
    revealed = F.log2(F.col("n_both") * documents / (F.col("n_entity") * F.col("n_term")))
    share = F.when(content > 0, revealed / content).otherwise(0.0)
    terms = both.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    return pairs.select("row", "entity", "term").join(terms, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words of a text that are keys of ``terms``; values are their shares."""
    hit = _located(text, WORD, lambda value: F.map_contains_key(terms, F.lower(value)))
    return F.transform(hit, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def personal_data(docs: DataFrame, support: int = 2, generalise: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans are the leftmost non-overlapping matches of each kind over the whole text, failing ones dropped; ``spans`` has
    them and the disclosing terms, as kind:start:end in code points, end exclusive, by start and then kind. Null texts
    count as empty and have no spans; repeated rows count as documents each; other columns are ignored; an empty table
    gives an empty one.
    """
    out = _with_terms(docs, support, generalise)
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, support: int = 2, generalise: float = 0.5, remove: float = 0.8) -> DataFrame:
    """(doc_id, text): base spans as their kind in brackets, disclosing terms as ``[TERM]`` or, from ``remove`` on, taken out."""
    found = _with_terms(docs, support, generalise)

    def shown(s: Column, at: Column) -> Column:
        taken = F.element_at("shares", F.lower(s["value"])) >= remove
        mark = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(taken, F.lit("")).otherwise(F.lit("[TERM]"))
        return F.when(s["start"] < at, F.lit("")).otherwise(mark)

    return found.select("doc_id", _replaced(F.col("text"), F.col("spans"), shown).alias("text"))


def _with_terms(docs: DataFrame, support: int, generalise: float) -> DataFrame:
    """doc_id, text, spans with terms, shares by term."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    spotted = whole.withColumn("spans", base_spans(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    blanked = F.when(F.size("spans") > 0, _blanked(F.col("text"), F.col("spans")))
    found = stage_table(spotted.withColumn("blanked", blanked), "spans").withColumn("rest", F.coalesce("blanked", "text"))
    held, none = found.where(F.size("spans") > 0), found.where(F.size("spans") == 0)
    terms = disclosing_terms(found, found.count(), support, generalise)
    shares = terms.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    spans = F.when(F.col("shares").isNotNull(), F.array_sort(F.concat("spans", _term_spans(F.col("rest"), F.col("shares"))))).otherwise(F.col("spans"))
    # Dealt by a fixed number: what one row takes doesn't show in its bytes, by which small partitions would be merged.
    dealt = held.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    more = dealt.join(shares, "row", "left").withColumn("spans", spans).select("doc_id", "text", "spans", "shares")
    return none.select("doc_id", "text", "spans", F.lit(None).cast("map<string,double>").alias("shares")).unionByName(more)
