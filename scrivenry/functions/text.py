"""Column functions on text: clean-up, sentences, predicates on lines, snippets, citations, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the clean-up: ligatures and their letters, characters that go, characters that are a space.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
REMOVED = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SPACES = "[ \\t\u00a0\u2000-\u200a\u202f\u205f\u3000]+"
#: What ends a sentence, a numbered title, a list marker, a table line.
SENTENCE_GAP = "(?<=[.!?])\\s+(?=[\"'(\\[]?[A-Z0-9])"
NUMBERED = "^\\d+(?:\\.\\d+)*\\.?\\s+\\S"
LIST_MARKER = "^\\s*(?:\\(?\\d{1,3}[.)]|\\(?[a-zA-Z][.)]|[-\u2022*\u2013])\\s+"
TABLE_LINE = "\\t|\\S {2,}\\S|\\S\\s*\\|\\s*\\S.*\\|"
NOT_FOUND = "NOT_FOUND"


def clean_characters(text: Column) -> Column:
    """Ligatures to letters, invisible and control characters away, line breaks to newlines. Input is NFC already."""
    out = F.translate(text, REMOVED, "")
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, "\r\n|\r|\u2028", "\n")
    return F.regexp_replace(out, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def collapse_spaces(text: Column) -> Column:
    # Most lines have single spaces only.
    return F.when(text.rlike("  |" + SPACES.replace(" ", "", 1).removesuffix("+")), F.regexp_replace(text, SPACES, " ")).otherwise(text)


def sentences(text: Column) -> Column:
    """Sentences of a text: a new one begins after . ! ? and white space before a capital or a digit."""
    return F.split(text, SENTENCE_GAP, -1)


def word_spans(text: Column) -> Column:
    """The runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit("(?U)\\S+"), F.lit(0))


def trimmed(line: Column) -> Column:
    """The line without white space of any kind at its ends."""
    ends = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1)).rlike("(?U)\\s")
    return F.when(ends, F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")).otherwise(line)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once, as a lambda's variable, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(words: Column) -> Column:
    """The distinct words of an array as (term, tf), in order: runs of equal words in the sorted array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
        return once(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("long").alias("tf"))))

    return once(F.array_sort(words), runs)


def token_count(text: Column) -> Column:
    return F.size(word_spans(text))


def has_text(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s", "")) > 0


def _letters(line: Column) -> Column:
    return F.regexp_replace(line, "\\P{L}", "")


def shouting(line: Column) -> Column:
    """At least three letters, none of them other than upper case."""
    return (F.length(_letters(line)) >= 3) & ~_letters(line).rlike("[^\\p{Lu}\\p{Lt}]")


def is_title(line: Column) -> Column:
    return (F.length(line) <= 80) & ~line.rlike("[.!?,;]$") & (shouting(line) | line.rlike(NUMBERED))


def is_heading(line: Column) -> Column:
    return F.endswith(line, F.lit(":")) | ((F.length(line) <= 80) & shouting(line))


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_MARKER)


def is_table_line(line: Column) -> Column:
    # What each of the forms has is looked for first: it takes no pattern.
    return (F.contains(line, F.lit("\t")) | F.contains(line, F.lit("  ")) | F.contains(line, F.lit("|"))) & line.rlike(TABLE_LINE)


def ends_paragraph(line: Column, short: int = 50) -> Column:
    return is_heading(line) | ((F.length(line) < short) & line.rlike("[.!?]$"))


def edge_key(line: Column) -> Column:
    """What a running header or footer has in common on all pages."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(line), "\\s+", " ")), "\\d+", "#")


def has_alphanumeric(text: Column) -> Column:
    return text.rlike("[\\p{L}\\p{N}]")


def query_terms(query: Column) -> Column:
    """Distinct lower-case words of three characters or more, in order."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.length(w) >= 3)


def found_terms(content: Column, query: Column) -> Column:
    """(position, term) of the query's terms in the content, by position and term."""
    low = F.lower(F.trim(content))
    hits = F.transform(query_terms(query), lambda w: F.struct(F.instr(low, w).alias("at"), w.alias("term")))
    return F.array_sort(F.filter(hits, lambda x: x["at"] > 0))


def local_snippet(content: Column, query: Column, limit: int = 240) -> Column:
    """A window of the content around the first query term, with dots where it was cut."""
    text, found = F.trim(content), found_terms(content, query)
    start = F.when(F.size(found) > 0, F.greatest(F.lit(0), found[0]["at"] - 1 - limit // 4)).otherwise(0)
    window = F.trim(F.substring(text, start + 1, F.lit(limit)))
    return F.concat(F.when(start > 0, "...").otherwise(""), window, F.when(start + limit < F.length(text), "...").otherwise(""))


def marked_terms(fragment: Column) -> Column:
    """Distinct lower-case terms that a highlighted fragment marks."""
    found = F.regexp_extract_all(fragment, F.lit("(?s)<em>(.*?)</em>"), F.lit(1))
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.array_distinct(F.transform(found, lambda x: F.lower(plain(x))))


def citation_snippet(text: Column, limit: int = 240) -> Column:
    """The beginning of a passage on one line, cut back to a word."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), F.lit("...")))


def citation_refs(answer: Column) -> Column:
    """Distinct numbers cited, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d{1,3})\\]"), F.lit(1)), lambda x: x.cast("int")))


def without_refs_over(answer: Column, known: Column) -> Column:
    """The answer without references above ``known``, runs of blanks collapsed."""
    pattern = "\\[(\\d{1,3})\\]"
    pieces, refs = F.split(answer, pattern, -1), F.regexp_extract_all(answer, F.lit(pattern), F.lit(0))
    kept = F.transform(refs, lambda r: F.when(F.regexp_replace(r, "[\\[\\]]", "").cast("int").between(F.lit(1), known), r).otherwise(""))
    joined = F.array_join(F.flatten(F.zip_with(pieces, kept, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    return F.trim(F.regexp_replace(joined, "[ \\t]{2,}", " "))


def is_not_found(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, "^\\s+|\\s+$", ""), "^\\.+|\\.+$", "").eqNullSafe(F.lit(NOT_FOUND))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Some denied pattern occurs, whatever the case."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?iu)" + p)
    return out


def context_label(doc_id: Column, title: Column, first: Column, last: Column) -> Column:
    """Document, title if any, page or pages."""
    pages = F.when(first.isNull(), None).when(F.coalesce(last, first) <= first, F.concat(F.lit("page "), first)).otherwise(F.concat(F.lit("pages "), first, F.lit("-"), last))
    return F.concat_ws(", ", doc_id, F.when(F.length(title) > 0, title), pages)


def page_list(first: Column, last: Column, most: int = 50) -> Column:
    """Page numbers from first to last, ``most`` at most; empty without a first page."""
    end = F.greatest(first, F.coalesce(last, first))
    return F.when(first.isNull(), F.array().cast("array<bigint>")).otherwise(F.slice(F.sequence(first.cast("long"), end.cast("long")), 1, most))


def embedding_text(title: Column, content: Column) -> Column:
    """The title before the content, unless the content begins with it."""
    return F.when((F.length(title) > 0) & ~F.startswith(content, title), F.concat(title, F.lit("\n"), content)).otherwise(content)


def model_slug(model: Column) -> Column:
    return F.regexp_replace(F.lower(model), "[^a-z0-9]", "")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A prompt with its ``{{name}}`` places filled in one pass: a value is never expanded again.

    The names in the template and the given ones must be the same.
    """
    import re

    parts = re.split(r"\{\{(\w+)\}\}", template)
    if set(parts[1::2]) != set(values):
        raise ValueError(f"template names {sorted(set(parts[1::2]))}, values {sorted(values)}")
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def string_list(values: Column) -> Column:
    """Trimmed entries without blank ones."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
