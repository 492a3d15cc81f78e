"""Masking of personal data with validated patterns, natively: pieces between matches, and matches replaced where valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels in their order and patterns (look-arounds as Java has them).
PATTERNS = {
    "EMAIL": "(?U)\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b",
    "IBAN": "(?U)\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\\b",
    "CARD": "(?U)(?<![\\d-])(?:\\d[ -]?){13,19}(?![\\d-])",
    "PAN": "(?U)\\b[A-Z]{5}\\d{4}[A-Z]\\b",
    "AADHAAR": "(?U)(?<![\\d-])(?<!\\d )[2-9]\\d{3}[ -]?\\d{4}[ -]?\\d{4}(?![\\d-])(?! \\d)",
    "PHONE": "(?U)(?<![\\w-])(?<!\\d )(?:\\+\\d{1,3}[ -]?)?(?:\\(\\d{2,4}\\)[ -]?)?\\d{2,5}[ -]?\\d{3,5}(?:[ -]?\\d{3,5})?(?!\\w)(?! \\d)",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def iban_valid(x: Column) -> Column:
    """15 to 34 characters whose rearranged number leaves 1 when divided by 97, folded character by character."""
    compact = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.length(compact).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1)


def valid(label: str, x: Column) -> Column:
    if label == "IBAN":
        return iban_valid(x)
    if label == "CARD":
        return F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x))
    if label == "AADHAAR":
        return F.length(_digits(x)) == 12
    if label == "PHONE":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


#: What a text must hold for a label's pattern to be tried at all.
HINTS = {"EMAIL": "@"}
DIGIT = "(?U)\\d"


def _with_label(state: Column, label: str) -> Column:
    """(text, n): the valid matches of one pattern replaced by its label, and added to n."""
    pattern, sign = PATTERNS[label], f"[{label}]"

    def replaced(s: Column) -> Column:
        shown = F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), lambda m: F.when(valid(label, m), F.lit(sign)).otherwise(m))

        def joined(found: Column) -> Column:
            parts = F.zip_with(F.split(s["text"], pattern, -1), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
            return F.struct(F.array_join(parts, "").alias("text"), (s["n"] + F.size(F.filter(found, lambda m: m == sign))).alias("n"))

        done = F.transform(F.array(shown), joined)[0]
        possible = F.contains(s["text"], F.lit(HINTS[label])) if label in HINTS else s["text"].rlike(DIGIT)
        return F.when(possible, done).otherwise(F.struct(s["text"].alias("text"), s["n"].alias("n")))

    # As a lambda's variable the text is computed once, however many labels came before.
    return F.transform(F.array(state), replaced)[0]


def _unmasked(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(0).alias("n"))


def mask_label(text: Column, label: str) -> Column:
    """The text with the valid matches of one pattern replaced by its label."""
    return _with_label(_unmasked(text), label)["text"]


def masked(text: Column) -> Column:
    """(text, n): all labels in their order, an earlier one's replacement being what a later one sees, and how many there are."""
    out = _unmasked(text)
    for label in PATTERNS:
        out = _with_label(out, label)
    return out


def mask(text: Column) -> Column:
    return masked(text)["text"]


def masked_count(text: Column) -> Column:
    """How many replacements :func:`mask` makes."""
    return masked(text)["n"]
