"""Text functions against plain Python on small examples."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from scrivenry.functions import masking, normalize, text, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("write to a.b@example.com now", "write to [EMAIL] now"),
        ("card 4539 1488 0343 6467 ok", "card [CARD]ok"),  # the pattern takes the separator after the last digit too
        ("card 4539 1488 0343 6468 bad", "card 4539 1488 0343 6468 bad"),
        ("iban DE89 3704 0044 0532 0130 00.", "iban [IBAN]."),
        ("call +49 30 901820123 today", "call [PHONE] today"),
        ("version 1.2.3 of 2024-01-02", "version 1.2.3 of 2024-01-02"),
        ("", ""),
    ],
)
def test_masking(spark, given_text, expected):
    assert one(spark, masking.mask(F.col("t")), t=given_text) == expected


@pytest.mark.parametrize(("line", "title"), [("INTRODUCTION", True), ("2.1 Scope of work", True), ("A sentence.", False), ("Plain words", False), ("AB", False), ("X" * 81, False)])
def test_titles(spark, line, title):
    assert one(spark, text.is_title(F.col("t")), t=line) is title


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t='One. Two! "Three" is it? (4) no. lower') == ["One.", "Two!", '"Three" is it?', "(4) no. lower"]


def test_refs_and_not_found(spark):
    assert one(spark, text.citation_refs(F.col("t")), t="a [2] b [1] c [2] [9999]") == [2, 1]
    assert one(spark, text.without_refs_over(F.col("t"), F.lit(2)), t="a [2]  b [7] c") == "a [2] b c"
    assert one(spark, text.is_not_found(F.col("t")), t=" NOT_FOUND. ") is True
    assert one(spark, text.is_not_found(F.col("t")), t="NOT FOUND") is False


def test_template_names_must_agree():
    with pytest.raises(ValueError, match="names"):
        text.fill_template("{{a}} {{b}}", {"a": F.lit("x")})


def test_shingles(spark):
    assert one(spark, vectors.shingles(F.col("t")), t="a b c d") == ["a b c", "b c d"]
    assert one(spark, vectors.shingles(F.col("t")), t="a b") == ["a b"]
    assert one(spark, vectors.shingles(F.col("t")), t="") == []




def plain_reflow(page, short=50):
    """The rules line by line."""
    heading = lambda x: x.endswith(":") or (len(x) <= 80 and len(re.sub(r"[\W\d_]", "", x)) >= 3 and re.sub(r"[\W\d_]", "", x).isupper())
    is_row = lambda x: bool(re.search(text.TABLE_LINE, x))
    blocks = []
    for filled, own in itertools.groupby(page.split("\n"), lambda x: bool(x.strip())):
        out, closed = [], True
        for raw in own if filled else []:
            row = is_row(raw)
            line = (raw if row else re.sub(text.SPACES, " ", raw)).strip()
            if closed or row or re.match(text.LIST_MARKER, line) or heading(line):
                out.append(line)
            elif re.search(r"[^\W\d_]-$", out[-1]) and line[:1].islower():
                out[-1] = out[-1][:-1] + line
            else:
                out[-1] += " " + line
            closed = row or is_row(out[-1]) or heading(out[-1]) or (out[-1][-1] in ".!?" and len(out[-1]) < short)
        if out:
            blocks.append("\n".join(out))
    return "\n\n".join(blocks)


def reflow(spark, *pages):
    rows = spark.createDataFrame([*enumerate(pages)], "i int, page string").select("i", normalize.reflowed(F.split("page", "\n")).alias("p"))
    return [r.p for r in rows.orderBy("i").collect()]


def test_reflow_follows_the_rules(spark):
    rng = random.Random(15)
    word = lambda: rng.choice(["alpha", "beta.", "gamma", "Delta", "x1", "end!", "co-", "é-", "Über", "(a)", "9", "two  gaps", "nbsp\u00a0gap"])
    line = lambda: rng.choice(["", " ", "TITLE LINE", "HEAD:", "a | b | c", "x\ty", "- item", "1. item", "  ", *[" ".join(word() for _ in range(rng.choice([1, 2, 5, 12]))) for _ in range(8)]])
    pages = ["\n".join(line() for _ in range(rng.randrange(12))) for _ in range(800)]
    letters = lambda s: [c for c in s if c.isalnum()]
    for page, found in zip(pages, reflow(spark, *pages), strict=True):
        assert found == plain_reflow(page)
        assert letters(found) == letters(page)


def test_reflow_joins_a_hyphenated_word(spark):
    assert reflow(spark, "a long exam-\nple of text", "HEADING:\ntext") == ["a long example of text", "HEADING:\ntext"]


def test_reflow_keeps_tables_and_ends_paragraphs(spark):
    table = "Item    Qty    Price\nBolts    10    2.50\nNuts    20    1.10"
    assert reflow(
        spark, table, "a | b | c\nd | e | f\n\n\nx\ty\nz\tw", "Qty    Price\n10    2.50\nTotal paid in full\nby the buyer",
        "A first line that is long enough to go on\nand ends here.\nMore of it", "It ends.\n  More\u00a0of it\n- item\n- other item",
    ) == [
        table, "a | b | c\nd | e | f\n\nx\ty\nz\tw", "Qty    Price\n10    2.50\nTotal paid in full by the buyer",
        "A first line that is long enough to go on and ends here. More of it", "It ends.\nMore of it\n- item\n- other item",
    ]


def test_pages_are_composed_and_tables_kept(spark):
    page = "Cafe\u0301 menu of the\nhouse\n\nName  Qty  Price\nBolt  4  1.20"
    got = normalize.normalised_pages(spark.createDataFrame([(1, 1, page)], "doc_id long, page_no long, page string")).first().page
    assert got == "Caf\u00e9 menu of the house\n\nName  Qty  Price\nBolt  4  1.20"


def test_running_headers_of_several_lines_go(spark):
    """Up to three non-empty lines at either edge, a third of the page at most, on four pages or more."""
    head, foot = ["ACME REPORT", "Volume 7", "confidential copy"], ["all rights reserved", "page {n}"]
    body = ["some words of number {n} and others.", "more text that stands here {n} alone."]
    own = [f"line {c} of this page says {c * 3}." for c in "abcdefgh"]

    def document(pages, lines):
        return [(n, "\n".join(x.format(n=n) for x in lines(n))) for n in range(1, pages + 1)]

    docs = {
        1: document(5, lambda n: [*head, "", *own[n:], *body, *own[:n], "", *foot]),
        2: document(4, lambda n: ["", " ", head[0], "", own[n], own[n + 1], body[0], "", foot[1], "  ", ""]),
        3: document(6, lambda n: [head[0], foot[1]]),
        4: document(6, lambda n: [head[0]]),
        5: document(3, lambda n: [*head, *own, *foot]),
        6: document(10, lambda n: [head[0] if n <= 4 else own[n % 8], head[1] if n <= 3 else own[n % 7], *(f"{x} {chr(96 + n)}" for x in own), foot[0] if n % 2 else f"end {chr(96 + n)}"]),
        7: document(4, lambda n: ["", "", ""]),
    }

    def key(line):
        return re.sub(r"\d+", "#", re.sub(r"\s+", " ", line.strip().lower()))

    def edges(lines):
        filled = [i for i, x in enumerate(lines) if x.strip()]
        size = min(3, len(filled) // 3)
        return set(filled[:size] + filled[len(filled) - size :])

    expected = {}
    for d, pages in docs.items():
        split = [(n, p.split("\n")) for n, p in pages]
        keys = [{key(lines[i]) for i in edges(lines)} for _, lines in split]
        gone = {k for ks in keys for k in ks if len(pages) >= 4 and sum(k in x for x in keys) >= max(2, 0.4 * len(pages))}
        for n, lines in split:
            expected[d, n] = plain_reflow("\n".join(x for i, x in enumerate(lines) if i not in edges(lines) or key(x) not in gone))
    table = spark.createDataFrame([(d, n, p) for d, pages in docs.items() for n, p in pages], "doc_id long, page_no long, page string")
    got = {(r.doc_id, r.page_no): r.page for r in normalize.normalised_pages(table).collect()}
    assert got == expected
    assert not any(x in got[1, 2] for x in ("ACME", "Volume", "confidential", "rights", "page 2"))
    assert "ACME" not in got[2, 1] and "ACME" in got[3, 1] and "ACME" in got[4, 1] and "Volume" in got[5, 1]
