"""Keyword scores in two passes over the passages, and chunks made inside of a document's row: nothing but results is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from scrivenry.functions import text
from scrivenry.operators import access, context, retrieval
from scrivenry.plans import QUERIES
from scrivenry.plans import fixtures as fx
from scrivenry.plans import search_queries as sq
from scrivenry.sources.staging import staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def passages(spark):
    pick = random.Random(5)
    rows = [(f"c{i:04d}", i // 4, " ".join(pick.choices(["Ab", "cd", "ef", "gh", "x1"], k=pick.randrange(9))), pick.choice([None, "", "ab cd", "ef"]), [f"u{i % 3}"], [f"g{i % 2}"]) for i in range(300)]
    rows += [(f"d{i:04d}", 500, "ab cd copy", None, ["u1"], None) for i in range(200)]
    rows = spark.createDataFrame(rows, "chunk_id string, doc_id long, content string, section_title string, acl_users array<string>, acl_groups array<string>").repartition(5)
    return staged(rows, "passages")


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(1, "AB ab gh", "u1", ["g1"]), (2, "copy", "u0", ["g0"]), (3, "", "u1", []), (4, "nothing", "u1", []), (5, "cd x1 copy", "u1", None)]
    return spark.createDataFrame(rows, "qid long, query string, user_id string, groups array<string>")


def test_no_posting_is_shuffled(passages, questions):
    """Each posting went through four shuffles before."""
    assert "Exchange" not in plan(retrieval.best_field(passages, questions))


def test_best_words_are_the_first_of_all_scores(passages, questions):
    all_scores = retrieval.best_field(passages, questions).withColumn("score", F.round("score", 6))
    assert {r.qid for r in all_scores.collect()} == {1, 2, 5}
    for only in (None, F.col("doc_id") % 2 == 0):
        allowed = passages if only is None else passages.where(only)
        want = retrieval.ranked(access.admitted(all_scores, allowed, questions), 7)
        for block in (1_024, 2):
            got = retrieval.best_words(passages, questions, 7, among=only, block=block)
            assert sorted(map(tuple, got.select("qid", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "chunk_id", "score", "rank").collect()))
    by_document = all_scores.join(passages.select("chunk_id", "doc_id"), "chunk_id").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    want = retrieval.ranked(by_document, 9, key="doc_id").select("qid", "doc_id", "rank")
    got = retrieval.best_words(passages, questions, 9, key="doc_id", everyone=True).select("qid", "doc_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_words_by_number_give_the_scores_of_texts(spark, passages, questions):
    words = retrieval.words_of(passages, questions, ["chunk_id", "doc_id", "acl_users", "acl_groups"])
    assert words.terms == sorted({"ab", "gh", "copy", "nothing", "cd", "x1"}) and "content" not in words.rows.columns
    for only in (None, F.col("doc_id") % 2 == 0):
        for block in (1_024, 2):
            want = retrieval.best_words(passages, questions, 7, among=only).collect()
            assert want and sorted(map(tuple, retrieval.best_words(words, questions, 7, among=only, block=block).collect())) == sorted(map(tuple, want))
    scored = lambda rows: sorted((r.qid, r.chunk_id, round(r.score, 9)) for r in retrieval.best_field(rows, questions).collect())
    assert scored(words) == scored(passages)
    blank = questions.where("qid = 3")
    assert retrieval.best_words(passages, blank).isEmpty() and retrieval.best_words(retrieval.words_of(passages, blank, ["chunk_id"]), blank).isEmpty()


@pytest.mark.parametrize("name", ["c01_rrf_merge", "d03_reciprocal_rank_sum", "f02_candidates", "f05_rerank_head_tail"])
def test_no_chunk_text_is_written(spark, monkeypatch, name):
    """All chunks with their texts were staged before, as much as the documents have."""
    seen = []

    def recorded(rows, label):
        seen.append((label, set(rows.columns)))
        return staged(rows, label)

    for module in (retrieval, sq):
        monkeypatch.setattr(module, "staged", recorded, raising=False)
    monkeypatch.setattr("scrivenry.sources.staging.staged", recorded)
    assert not QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
    assert "words" in dict(seen) and not any({"content", "section_title", "text"} & columns for _, columns in seen)


def test_chunks_in_a_row_are_those_of_pages(spark, tmp_path):
    texts = ["", "One. Two. Three.", None, "\n".join(f"Line {i}. Next {i}! no break? Yes" for i in range(47)), "a" * 50, "\n" * 35, "Äh. 1 Two\n.. B"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(7).withColumnRenamed("id", "vec_id").write.parquet(str(tmp_path / "embeddings.parquet"))
    cols = ["doc_id", "item_id", "page_no", "chunk_no", "content", "section_title"]
    want = fx.windows_of(fx.src_page(spark, str(tmp_path)), "doc_id").select(*cols)
    found = fx.chunk_index(spark, str(tmp_path))
    assert sorted(map(tuple, found.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert plan(found).count("Exchange") == 1


def test_terms_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "b", "c"],), (["x"],), ([],), (None,)], "w array<string>")
    got = [r.t for r in rows.select(text.counted(F.col("w")).alias("t")).collect()]
    assert [t if t is None else [tuple(x) for x in t] for t in got] == [[("a", 1), ("b", 3), ("c", 1)], [("x", 1)], [], None]


def test_term_postings_are_not_shuffled(spark):
    """Only texts are, to spread the work, and the questions' terms, to have them once."""
    found = plan(sq.c16(spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(chunk_id" not in found and "hashpartitioning(doc_id" in found


def test_near_classes_by_prefixes_lose_no_link(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [pick.choices(words, k=pick.randrange(1, 60)) for _ in range(25)]
    texts = [" ".join(w if pick.random() > 0.02 else "z" for w in pick.choice(base)) for _ in range(160)]
    rows = staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "texts")
    members, links = context.near_classes(rows, 0.85)
    sets = {i: frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) for i, w in ((i, t.split()) for i, t in enumerate(texts))}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    assert {(r.doc_id, r.rep) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    heads = sorted(first.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in heads for b in heads if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in links.collect()} == want and len(want) > 20
    hashed = spark.createDataFrame([(1, [5, 7, 9], 3), (2, [], 0)], "doc_id long, s array<bigint>, n int")
    assert "Exchange" not in plan(context._prefixes(hashed, 0.85))


def test_lines_are_what_their_patterns_say(spark):
    pick = random.Random(11)
    lines = ["".join(pick.choices("ab \t| 　 \u0085x", k=pick.randrange(12))) for _ in range(3_000)] + [None, ""]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.col("x").rlike(text.TABLE_LINE).alias("t"), F.regexp_replace("x", text.SPACES, " ").alias("s"), F.regexp_replace("x", "(?U)^\\s+|\\s+$", "").alias("e"))
    x = F.col("x")
    wrong = rows.where(~(text.is_table_line(x).eqNullSafe(F.col("t")) & text.collapse_spaces(x).eqNullSafe(F.col("s")) & text.trimmed(x).eqNullSafe(F.col("e"))))
    assert wrong.count() == 0
