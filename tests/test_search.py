"""Access isolation in every mode, rank fusion, filters, context selection."""

import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from scrivenry.operators import access, ann, context, keyword, retrieval
from scrivenry.sources.staging import staged

PASSAGES = [
    ("c1", ["ann"], []), ("c2", [], ["red"]), ("c3", [], ["blue"]), ("c4", [], []), ("c5", ["bob"], ["red", "blue"]), ("c6", ["anna"], []),
]
CALLERS = {
    ("ann", ("red",)): {"c1", "c2", "c5"}, ("ann", ()): {"c1"}, ("anna", ()): {"c6"}, ("zed", ("red", "blue")): {"c2", "c3", "c5"}, ("zed", ()): set(), ("red", ()): set(),
}


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(c, "common words here", [1.0, float(i)], u, g) for i, (c, u, g) in enumerate(PASSAGES)]
    return spark.createDataFrame(rows, "chunk_id string, content string, vector array<double>, acl_users array<string>, acl_groups array<string>").cache()


@pytest.mark.parametrize(("who", "expected"), CALLERS.items())
def test_isolation_in_all_modes(spark, passages, who, expected):
    user, groups = who
    assert {r.chunk_id for r in access.visible(passages, access.Identity(user, groups)).collect()} == expected
    q = spark.createDataFrame([(1, "common", user, list(groups), [1.0, 0.0])], "qid long, query string, user_id string, groups array<string>, vector array<double>")
    seen = access.visible_pairs(passages, q)
    assert {r.chunk_id for r in seen.collect()} == expected
    passages = passages.withColumn("section_title", F.lit("titles"))
    words = keyword.top(keyword.build(passages), q, passages, 100)
    vector = retrieval.nearest(passages, q, 100)
    assert {r.chunk_id for r in words.collect()} == expected
    assert {r.chunk_id for r in vector.collect()} == expected
    assert {r.chunk_id for r in retrieval.fused(words, vector).collect()} == expected


def test_a_hit_that_its_caller_may_not_see_fails_the_search(spark):
    hits = lambda *rows: access.only_admitted(spark.createDataFrame(list(rows), "qid long, _rights array<string>, _held array<string>"))
    good = (1, ["u:ann", "g:red"], ["u:zed", "g:red"])
    assert [tuple(r) for r in hits(good).collect()] == [(1,)]
    for bad in ((2, ["u:ann"], ["u:zed"]), (2, [], ["u:zed"]), (2, None, ["u:zed"]), (2, ["u:ann"], None), (2, ["g:zed"], ["u:zed"])):
        with pytest.raises(Exception, match="access denied"):
            hits(good, bad).collect()


def test_search_with_an_index_that_is_out_of_date_fails_closed(spark, passages, monkeypatch):
    rows = passages.withColumn("doc_id", F.col("chunk_id")).withColumn("doc_type", F.lit("t")).withColumn("tags", F.array(F.lit("x"))).withColumn("created_at", F.lit(date(2024, 1, 1))).withColumn("section_title", F.lit(None).cast("string"))
    q = spark.createDataFrame([(1, "common", "ann", [], None)], "qid long, query string, user_id string, groups array<string>, vector array<double>")
    index = keyword.build(rows)
    assert {r.chunk_id for r in retrieval.search(rows, q, "bm25", index=index).collect()} == {"c1"}
    # A leg that has lost its filter.
    monkeypatch.setattr(keyword, "top", lambda index, questions, allowed, most: retrieval.ranked(retrieval.bm25(allowed, questions), most))
    with pytest.raises(Exception, match="access denied"):
        retrieval.search(rows, q, "bm25", index=index).collect()


def test_search_modes_and_fallbacks(spark, passages):
    rows = passages.withColumn("doc_id", F.col("chunk_id")).withColumn("doc_type", F.lit("t")).withColumn("tags", F.array(F.lit("x"))).withColumn("created_at", F.lit(date(2024, 1, 1))).withColumn("section_title", F.lit(None).cast("string"))
    schema = "qid long, query string, user_id string, groups array<string>, vector array<double>"
    q = spark.createDataFrame([(1, "common words", "zed", ["red", "blue"], [1.0, 3.0]), (2, "common", "ann", [], None)], schema)
    shown = lambda found: {(r.qid, r.chunk_id, r.mode_used) for r in found.collect()}
    seen = {(1, "c2"), (1, "c3"), (1, "c5"), (2, "c1")}
    assert shown(retrieval.search(rows, q)) == {(i, c, "hybrid" if i == 1 else "bm25") for i, c in seen}
    assert shown(retrieval.search(rows, q, "bm25")) == {(i, c, "bm25") for i, c in seen}
    assert shown(retrieval.search(rows, q.where("qid = 1"), "vector", top_k=2)) == {(1, "c3", "knn"), (1, "c5", "knn")}
    assert shown(retrieval.search(rows, q, filters=retrieval.Filters(tags=("y",)))) == set()
    again = retrieval.search(rows, q, rerank=lambda h: F.when(h["qid"] == 2, F.lit(None)).otherwise((h["chunk_id"] == "c5").cast("double")))
    assert {(r.qid, r.mode_used) for r in again.collect()} == {(1, "hybrid+rerank"), (2, "bm25")}
    assert again.where("qid = 1 AND rank = 1").first().chunk_id == "c5"
    for bad in (lambda: retrieval.search(rows, q, "vector"), lambda: retrieval.search(rows, q, "other"), lambda: retrieval.search(rows, q.withColumn("query", F.lit(" ")))):
        with pytest.raises(ValueError):
            bad()


def test_nearest_in_blocks_equals_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [(f"c{i:03}", [rng.choice([0.0, 1.0]) for _ in range(3)], [f"u{i % 3}"], ["g"] if i % 5 else []) for i in range(300)]
    queries = [(q, f"u{q % 4}", ["g"] if q % 2 else [], [rng.random() for _ in range(3)]) for q in range(9)]
    p = spark.createDataFrame(rows, "chunk_id string, vector array<double>, acl_users array<string>, acl_groups array<string>").repartition(3)
    q = spark.createDataFrame(queries, "qid long, user_id string, groups array<string>, vector array<double>")

    def cosine(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0

    expected = {}
    for i, user, groups, v in queries:
        seen = [(-cosine(v, w), c) for c, w, users, own in rows if user in users or set(groups) & set(own)]
        expected[i] = [c for _, c in sorted(seen)[:7]]
    got = {i: [] for i in expected}
    for r in retrieval.nearest(p, q, 7, block=2).orderBy("qid", "rank").collect():
        got[r.qid].append(r.chunk_id)
    assert got == expected


def test_closer_forbidden_neighbours_do_not_displace(spark):
    rows = [(f"f{i:02}", [1.0, 0.0], [], ["secret"]) for i in range(30)] + [(f"ok{i}", [0.5, 1.0], [], ["red"]) for i in range(3)]
    p = spark.createDataFrame(rows, "chunk_id string, vector array<double>, acl_users array<string>, acl_groups array<string>")
    q = spark.createDataFrame([(1, "u", ["red"], [1.0, 0.0])], "qid long, user_id string, groups array<string>, vector array<double>")
    assert {r.chunk_id for r in retrieval.nearest(p, q, 3).collect()} == {"ok0", "ok1", "ok2"}


def test_identity_and_plan_check(spark, passages):
    with pytest.raises(access.AccessDeniedError):
        access.Identity("  ")
    path = passages.sparkSession.conf.get("spark.checkpoint.dir") + "/acl-check"
    passages.write.mode("overwrite").parquet(path)
    stored = passages.sparkSession.read.parquet(path)
    access.verify_access(access.visible(stored, access.Identity("ann")).groupBy("chunk_id").count())
    with pytest.raises(access.AccessDeniedError):
        access.verify_access(stored.orderBy("chunk_id").limit(3))
    with pytest.raises(access.AccessDeniedError):
        access.verify_access(access.visible(stored.limit(3), access.Identity("ann")))


def test_filters_and_sizes():
    with pytest.raises(ValueError, match="128"):
        retrieval.Filters(tags=("",))
    with pytest.raises(ValueError, match="after"):
        retrieval.Filters(created_from=date(2024, 2, 2), created_to=date(2024, 1, 1))
    assert retrieval.page_size(None, "x") == 10
    assert retrieval.page_size(500, "x") == 50
    for top_k, query in ((0, "x"), (5, "  ")):
        with pytest.raises(ValueError, match="query"):
            retrieval.page_size(top_k, query)


def plain_context(hits, most, per_doc, alike):
    """Ranks of the context's passages, told plainly."""

    def grams(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    near = lambda a, b: bool(grams(a) and grams(b)) and len(grams(a) & grams(b)) >= alike * len(grams(a) | grams(b))
    taken, left = [], []
    for rank, doc, text in hits:
        if any(near(text, t) for _, _, t in taken):
            continue
        (left if any(d == doc for _, d, _ in taken) else taken).append((rank, doc, text))
    for rank, doc, text in left:
        if len(taken) < most and sum(d == doc for _, d, _ in taken) < per_doc and not any(near(text, t) for _, _, t in taken):
            taken.append((rank, doc, text))
    return sorted(r for r, _, _ in taken[:most])


@pytest.mark.parametrize(("most", "per_doc"), [(1, 3), (4, 2), (8, 3)])
def test_context_selection(spark, most, per_doc):
    rng = random.Random(most)
    texts = ["one two three four", "one two three five", "six seven eight nine", "", "ten", "Ten", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t u"] + [f"own words {i} here" for i in range(6)]
    hits = {q: [(r, rng.choice([1, 2, 3]), rng.choice(texts)) for r in range(1, rng.randint(2, 16))] for q in range(20)}
    df = spark.createDataFrame([(q, r, d, f"{q}-{r}", t) for q, own in hits.items() for r, d, t in own], "qid long, rank long, doc_id long, chunk_id string, content string")
    got = {}
    for r in context.select_context(df, most, per_doc).orderBy("qid", "ref").collect():
        got.setdefault(r.qid, []).append((r.ref, r["rank"]))
    assert got == {q: [*enumerate(plain_context(own, most, per_doc, 0.85), 1)] for q, own in hits.items()}


def test_near_pairs_of_copies_and_near_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(8)]
    for t in list(texts):
        for changes in (0, 0, 1, 3):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(40)] = "new"
            texts.append(" ".join(w))
    texts += ["", "one", "One", None, "one two"]

    def grams(text):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    classes = {}
    for i, t in enumerate(texts):
        if grams(t):
            classes.setdefault(frozenset(grams(t)), []).append(i)
    near = lambda x, y: len(x & y) >= 0.85 * len(x | y)
    links = {x: sum(near(x, y) for y in classes if y != x) for x in classes}
    expected = {(i, min(own), len(own), links[x]) for x, own in classes.items() for i in own}
    got = context.near_membership(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 0.85).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_budget_cuts_the_last_passage(spark):
    rows = [(1, i, f"c{i}", "label", " ".join(["w"] * 30)) for i in range(1, 5)]
    p = spark.createDataFrame(rows, "qid long, ref long, chunk_id string, label string, content string")
    got = [(r.ref, r.tokens) for r in context.budgeted(p, 90).orderBy("ref").collect()]
    assert got == [(1, 30), (2, 30)]
    assert [(r.ref, r.tokens) for r in context.budgeted(p, 95).orderBy("ref").collect()] == [(1, 30), (2, 30), (3, 23)]


def test_best_per_document_keeps_order(spark):
    hits = spark.createDataFrame([(1, "a1", "a", 1), (1, "b1", "b", 2), (1, "a2", "a", 3), (1, "c1", "c", 4)], "qid long, chunk_id string, doc_id string, rank long")
    assert [(r.chunk_id, r["rank"]) for r in retrieval.best_per_document(hits).orderBy(F.col("rank")).collect()] == [("a1", 1), ("b1", 2), ("c1", 3)]


# --- keyword index, approximate vectors, texts that hold items


def plain_bm25(rows, query, fields):
    """Scores of everything by the best of the fields."""
    toks = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    best = {}
    for name, weight in fields.items():
        own = [(r["chunk_id"], toks(r[name])) for r in rows if toks(r[name])]
        mean = sum(len(w) for _, w in own) / max(1, len(own))
        for t in set(toks(query)):
            df = sum(t in w for _, w in own)
            for c, w in own:
                if t in w:
                    tf = w.count(t)
                    part = math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                    best.setdefault((c, name), []).append(weight * part)
    out = {}
    for (c, _), parts in best.items():
        out[c] = max(out.get(c, 0), math.fsum(parts))
    return out


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows = [
        {"chunk_id": f"c{i:04}", "doc_id": f"d{i // 3}", "content": " ".join(rng.choices(words, k=rng.randint(0, 60))), "section_title": rng.choice([None, "", " ".join(rng.choices(words, k=3))]), "vector": [rng.gauss(m, 0.4) for m in ((i % 7), (i % 3), 1 + i % 5, -(i % 2))],
         "acl_users": [f"u{i % 4}"], "acl_groups": [f"g{i % 9}"], "doc_type": f"t{i % 2}", "tags": ["x"], "created_at": date(2024, 1, 1)} for i in range(900)
    ]
    asked = [(q, " ".join(rng.choices(words, k=rng.choice([1, 4, 30]))), f"u{q % 5}", [f"g{q}", f"g{(q * 5) % 9}"], [rng.gauss(2, 2) for _ in range(4)]) for q in range(12)]
    schema = "chunk_id string, doc_id string, content string, section_title string, vector array<double>, acl_users array<string>, acl_groups array<string>, doc_type string, tags array<string>, created_at date"
    passages = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    questions = spark.createDataFrame([*asked, (50, "unknown", "u1", [], None), (51, "w1", "nobody", [], None)], "qid long, query string, user_id string, groups array<string>, vector array<double>")
    return rows, asked + [(50, "unknown", "u1", [], None), (51, "w1", "nobody", [], None)], staged(passages, "library"), questions


def may_see(r, user, groups):
    return user in r["acl_users"] or bool(set(groups) & set(r["acl_groups"]))


@pytest.mark.parametrize("most, block", [(5, 16), (40, 256), (2000, 256)])
def test_pruned_keyword_search_equals_scoring_everything(spark, monkeypatch, library, most, block):
    monkeypatch.setattr(keyword, "BLOCK", block)
    rows, asked, passages, questions = library
    found = {}
    for r in keyword.top(keyword.build(passages), questions, passages, most).collect():
        found.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.score))
    for qid, query, user, groups, _ in asked:
        scores = plain_bm25(rows, query, retrieval.BM25_FIELDS)
        seen = sorted((-round(scores[r["chunk_id"]], 6), r["chunk_id"]) for r in rows if r["chunk_id"] in scores and may_see(r, user, groups))[:most]
        assert [(c, pytest.approx(-s, abs=2e-6)) for s, c in seen] == [(c, s) for _, c, s in sorted(found.get(qid, []))]


def test_common_terms_are_hardly_read(spark):
    """Nine in ten postings are of a term that all passages have: what only it brings is not read beyond its best blocks."""
    rng = random.Random(13)
    rows = [(f"c{i:05}", "the of " * rng.randint(1, 30) + " ".join(f"x{rng.randrange(300)}" for _ in range(3)), "", ["all"], []) for i in range(6000)]
    passages = staged(spark.createDataFrame(rows, "chunk_id string, content string, section_title string, acl_users array<string>, acl_groups array<string>"), "many")
    questions = spark.createDataFrame([(q, f"the of x{q} x{q + 9}", "all", []) for q in range(5)], "qid long, query string, user_id string, groups array<string>")
    index = keyword.build(passages)
    for r in keyword.postings_read(index, questions, passages, 10).collect():
        assert r.read < 0.3 * r.postings
    plain = retrieval.ranked(retrieval.best_field(passages, questions).withColumn("score", F.round("score", 6)), 10)
    assert sorted(map(tuple, keyword.top(index, questions, passages, 10).select("qid", "rank", "chunk_id").collect())) == sorted(map(tuple, plain.select("qid", "rank", "chunk_id").collect()))


def test_approximate_vectors_keep_rights_filters_and_recall(spark, library):
    rows, asked, passages, questions = library
    index = ann.build(passages, cells=30)
    exact = {(r.qid, r.chunk_id): r.score for r in retrieval.nearest(passages, questions, 10).collect()}
    found = {(r.qid, r.chunk_id): r.score for r in ann.nearest(index, questions, 10).collect()}
    assert len(set(exact) & set(found)) >= 0.9 * len(exact)
    assert all(found[k] == pytest.approx(exact[k], abs=1e-6) for k in set(exact) & set(found))
    people = {q: (user, groups) for q, _, user, groups, _ in asked}
    by_id = {r["chunk_id"]: r for r in rows}
    assert all(may_see(by_id[c], *people[q]) for q, c in found)
    only = retrieval.Filters(doc_types=("t1",))
    few = ann.nearest(index, questions, 10, only.predicate()).collect()
    assert few and all(by_id[r.chunk_id]["doc_type"] == "t1" for r in few)
    # All cells probed, all rows rescored: the exact result.
    assert {(r.qid, r.chunk_id) for r in ann.nearest(index, questions, 400, probes=30).collect()} == {(r.qid, r.chunk_id) for r in retrieval.nearest(passages, questions, 400).collect()}
    hits = retrieval.search(passages, questions.where("qid < 12"), index=keyword.build(passages), vectors=index)
    assert {r.qid for r in hits.collect()} == set(range(12)) and hits.columns == ["qid", "doc_id", "chunk_id", "score", "rank", "mode_used"]


def test_index_of_few_vectors(spark, library):
    *_, passages, questions = library
    assert ann.nearest(ann.build(passages.limit(0)), questions, 3).collect() == []
    one = passages.where("chunk_id = 'c0001'").withColumn("acl_users", F.array(F.lit("u1")))
    assert [(r.qid, r.chunk_id) for r in ann.nearest(ann.build(one), questions.where("user_id = 'u1' AND vector IS NOT NULL AND qid = 1"), 3).collect()] == [(1, "c0001")]


def test_documents_that_hold_an_item(spark):
    rng = random.Random(14)
    word = lambda: rng.choice(["ab", "b", "cab", "d.", "é"])
    docs = [(i, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(40)))) for i in range(80)] + [(100, None), (101, "")]
    items = [(q, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6])))) for q in range(60)] + [(70, docs[3][1]), (71, "ab  b"), (72, "x" * 30)]
    found = context.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(80, " "), (81, None)], "qid long, item string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(d, q) for d, t in docs for q, x in items if t and x.strip() and x in t}
    assert context.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "qid long, item string")).collect() == []


@pytest.mark.parametrize("tile", [1, 3, 128])
def test_all_pairs_of_copies_and_near_copies(spark, monkeypatch, tile):
    """Every pair of documents is there with what the two share, copies too, however few sets are compared in one group."""
    monkeypatch.setattr(context, "TILE", tile)
    monkeypatch.setattr(context, "WORDS", 100 * tile)
    rng = random.Random(22)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=40)) for _ in range(6)]
    for t in list(texts):
        for changes in (0, 0, 1, 2, 3):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(40)] = rng.choice(["new", "Ké", "old"])
            texts.append(" ".join(w))
    texts += ["", "one", "One", None, "one two", "one two.", "K one"]

    def grams(text):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [(i * 7 % 101, grams(t)) for i, t in enumerate(texts)]
    expected = sorted((i, j, len(x & y)) for i, x in sets for j, y in sets if i < j and x and len(x & y) >= 0.85 * len(x | y))
    got = context.near_pairs(spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "doc_id long, text string"), 0.85)
    assert got.columns == ["a", "b", "shared"] and sorted(map(tuple, got.collect())) == expected


def test_query_of_near_pairs_tells_which_documents(spark, tmp_path):
    """A row for each pair: the number of links alone doesn't say which documents are near."""
    from scrivenry.plans import QUERIES

    spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (2, "a B c d"), (4, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["c13_near_pairs"](spark, str(tmp_path)).collect())) == [(1, 2, 2), (1, 3, 2), (2, 3, 2)]


def test_sets_of_shingles_are_not_written(spark):
    """What near classes write is less than half of the hashes of all shingles, which don't compress."""
    import os

    from scrivenry.sources.staging import scratch

    home = os.path.dirname(scratch(spark, "x")).removeprefix("file:")
    used = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(home) for f in files)
    rng = random.Random(23)
    texts = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))) for i in range(300)]
    rows, before = staged(spark.createDataFrame([*texts, (999, texts[5][1] + " more")], "doc_id long, text string"), "texts"), used()
    links = context.near_classes(rows, 0.85)[1]
    assert [tuple(r) for r in links.collect()] == [(5, 999, 1998)]
    assert used() - before < 0.5 * 8 * 1998 * len(texts)


def test_overlap_shuffles_no_pairs(spark, library):
    """Words shared with each question, title and content together; a key's rows count as one, and only such pairs are grouped."""
    rows, asked, passages, questions = library
    twice = staged(passages.unionByName(passages.where("chunk_id < 'c0020'")), "twice")
    toks = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    expected = {}
    for r in [*rows, *(r for r in rows if r["chunk_id"] < "c0020")]:
        for qid, query, *_ in asked:
            n = sum(w in set(toks(query)) for w in toks(r["content"]) + toks(r["section_title"]))
            if n:
                expected[qid, r["chunk_id"]] = expected.get((qid, r["chunk_id"]), 0) + n
    found = retrieval.overlaps(retrieval.words_of(twice, questions, ["chunk_id"]), questions, block=5)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(expected) and {(q, c): s for q, c, s in got} == expected
    once = retrieval.overlaps(retrieval.words_of(passages, questions, ["chunk_id"]), questions)
    once.collect()
    assert once.count() and "hashpartitioning(_key" not in once._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows, group", [(4_096, 1 << 20), (50, 100), (7, 3)])
def test_ranks_of_all_pairs_without_shuffling_them(spark, monkeypatch, library, rows, group):
    """The ranks of a window over all scored pairs, with many ties, however passages lie in blocks and scores in groups; no window over pairs is planned."""
    monkeypatch.setattr(retrieval, "ROWS", rows)
    monkeypatch.setattr(retrieval, "GROUP", group)
    *_, passages, questions = library
    many = staged(passages.unionByName(passages.where("chunk_id < 'c0300'").withColumn("chunk_id", F.concat("chunk_id", F.lit("b")))), "many")
    plain = retrieval.ranked(retrieval.best_field(many, questions).withColumn("score", F.round("score", 6))).select("qid", "chunk_id", "rank").collect()
    found = retrieval.field_ranks(retrieval.words_of(many, questions, ["chunk_id"]), questions, size=7)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["qid", "chunk_id", "rank"] and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain))
    nobody = questions.where("qid = 50").withColumn("query", F.lit(""))
    assert retrieval.field_ranks(retrieval.words_of(many, nobody, ["chunk_id"]), nobody).collect() == []


def test_packed_numbers():
    for values in ([], [5], [9, 9, 3, 0], [2**40, 7, -3]):
        assert retrieval.unpacked(retrieval.packed(retrieval.np.array(values, "int64")), len(values)).tolist() == values


def test_index_keeps_rights_and_makes_blocks_without_a_shuffle(spark, library):
    """An index that keeps rights needs no second table of passages, and no posting is shuffled to make it: blocks hold them as they lie in tasks."""
    *_, passages, questions = library
    index = keyword.build(passages, keep=("acl_users", "acl_groups"))
    assert {"offsets", "tfs", "lengths"} <= set(index.blocks.columns) and "content" not in index.numbers.columns
    read = lambda rows: sorted(map(tuple, keyword.postings_read(index, questions, rows, 10).collect()))
    assert read(None) == read(passages) != []
