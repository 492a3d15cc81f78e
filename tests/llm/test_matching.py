"""Search, periodic runs and repeated passages against brute force, with nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from scrivenry.llm import passages, rindex, runs, treaps

DOCS = "doc_id long, text string, lang string, source string, row int, h string, w string, part int, low int, item_id int"
ITEMS = "item_id long, text string, doc_id string, row int, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 3, "h", "w", 1, 2, 9) for i, t in rows], DOCS)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 1) for i, t in rows], ITEMS)


# --- ranked search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    rows = [(i, terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in rows), sum(len(w) for _, w in rows)
    out = []
    for item, text in items:
        scored = []
        for place, (doc, w) in enumerate(rows):
            score = 0
            for t in set(terms_of(text)) & set(w):
                df = sum(t in x for _, x in rows)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 10 + 90 * len(w) * n_docs // n_terms
                score += weight * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def same(found, wanted):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(found, key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_search_equals_scoring_everything(spark, monkeypatch, block):
    monkeypatch.setattr(treaps, "BLOCK_POSTINGS", block)
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "Ærø", "ærø", "x1", "x_1", "naïve", *(f"w{i}" for i in range(40))]
    text = lambda n: rng.choice([" ", "-", "\n", " … "]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(rng.randrange(10**9), text(rng.randint(1, 60))) for _ in range(80)]
    docs += [docs[0], (docs[1][0], docs[0][1]), (None, docs[2][1]), (5, None), (6, ""), (7, "\x7f - _"), (8, "w1 " * 5000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(3, "w1 w2"), (None, "w5 w6 zzz"), (50, None), (51, "!"), (52, "unseen")]
    for k in (1, 10):
        found = treaps.ranked_search(table(spark, docs), asked(spark, items), k)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        same([tuple(r) for r in found.collect()], plain_search(docs, items, k))


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(treaps, "BLOCK_BYTES", 20)
    docs, items = [(1, "a b c"), (2, "b b d"), (3, "e")], [(i, t) for i, t in enumerate(["a", "b c", "d e", "f", "b d e a c b d"])]
    same([tuple(r) for r in treaps.ranked_search(table(spark, docs), asked(spark, items)).collect()], plain_search(docs, items, 10))


def test_search_of_empty_tables(spark):
    assert treaps.ranked_search(table(spark, []), asked(spark, [(1, "a")])).collect() == []
    assert treaps.ranked_search(table(spark, [(1, "a")]), asked(spark, [])).collect() == []


def test_treaps_leave_out_ranges():
    """Of many documents few are looked at, and a score to reach only leaves out what is below it."""
    rng = np.random.default_rng(5)
    docs = np.tile(np.arange(3000), 4)
    impacts = rng.pareto(1.2, len(docs)).astype(np.int64) + 1
    index = treaps.InvertedTreaps(np.repeat(np.arange(4), 3000), docs, impacts)
    looked = 0

    class Counted(list):
        def __getitem__(self, i):
            nonlocal looked
            looked += 1
            return super().__getitem__(i)

    sums = np.bincount(docs, impacts)
    best = sorted(((-int(s), d) for d, s in enumerate(sums)))[:10]
    index.impacts = Counted(index.impacts)
    assert index.top([0, 1, 2, 3], 10) == [(d, -s) for s, d in best]
    assert looked < len(docs) / 2
    assert index.top([0, 1, 2, 3], 10, -best[4][0]) == [(d, -s) for s, d in best if s <= best[4][0]]


# --- periodic runs


def plain_runs(words, least, exponent):
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, t - s, p) for (s, t), p in found.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (4, 3), (20, 2)])
def test_runs_equal_every_period_tried(least, exponent):
    rng = random.Random(6)
    for _ in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            if words:
                b, q = rng.randrange(len(words)), rng.randrange(1, 7)
                for i in range(max(b, q), min(len(words), b + rng.randrange(30))):
                    words[i] = words[i - q]
        words *= rng.randrange(1, 3)
        assert runs.runs(words, least, exponent) == plain_runs(words, least, exponent)
        hashes = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        parts = runs.stretches(hashes, np.array([0, len(words)]), least, exponent)
        assert sorted((b + s, n, p) for b, e in parts for s, n, p in runs.runs(words[b:e], least, exponent)) == sorted(plain_runs(words, least, exponent))


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    for least, exponent in ((2, 2), (2, 3)):
        assert runs.runs(list(map(ord, b)), least, exponent) == plain_runs(list(b), least, exponent)


def plain_report(doc, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 6, 4)
    dropped = {i for s, k, p in found for i in range(s + p, s + k)}
    best = min(((-k, s, p) for s, k, p in found), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc, len(found), *longest, digest("".join(f"{s},{k},{p}\n" for s, k, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_run_report_equals_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for i in range(400):
        words = [rng.choice(["a", "A", "é", "bb", "c,", "d"]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.4:
            words += words[-rng.randint(1, 4) :] * rng.randint(3, 9) + ["x"] * rng.choice([0, 5, 6])
        docs.append((i, rng.choice([" ", "\n\t", "\x0b", "\xa0 "]).join(words)))
    docs += [docs[3], (None, docs[4][1]), (900, None), (901, ""), (902, " \n"), (903, "w " * 30_000), (904, " ".join(f"v{i % 700}" for i in range(20_000)))]
    docs += [(i, docs[i % 400][1]) for i in range(1000, 1300) if zlib.crc32(str(i).encode()) % 10 == 0]
    found = runs.run_report(runs.periodic_runs(runs.spliced(table(spark, docs))))
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    same([tuple(r) for r in found.collect()], [plain_report(i, t) for i, t in docs])
    assert runs.periodic_runs(table(spark, [])).collect() == []


def test_collapsed_texts_keep_words_as_they_are(spark):
    rows = runs.periodic_runs(table(spark, [(1, "  É a\x0bb a b a b a b  z "), (2, "x " * 6 + "y")])).orderBy("doc_id").collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(10, [(1, 8, 2)], "É a b z"), (7, [(0, 6, 1)], "x y")]
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(table(spark, []), 6, 1)


# --- repeated passages


def plain_passages(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, x in raw:
        for p in range(len(x) - length + 1):
            g = x[p : p + length]
            first[g] = min(first.get(g, math.inf), math.inf if i is None else i)
    out = []
    for i, x in raw:
        gone = [False] * len(x)
        for p in range(len(x) - length + 1):
            if (math.inf if i is None else i) > first[x[p : p + length]]:
                gone[p : p + length] = [True] * length
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((i, len(x), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def passage_docs():
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [piece(rng.choice([20, 30, 48, 49, 50, 51, 90, 300])) for _ in range(12)] + ["x" * 120, "xy" * 80]
    docs = [(i, "".join(rng.choice([piece(rng.randrange(80)), rng.choice(shared)]) for _ in range(rng.randrange(7)))) for i in range(120)]
    docs += [(rng.randrange(120), docs[3][1]), (300, docs[7][1]), (None, docs[8][1]), (None, shared[5] * 2), (301, None), (302, ""), (303, "x" * 50), (304, "x" * 49)]
    docs += [(-5, shared[6] + "z" + shared[7]), (305, piece(200_000) + shared[7] + piece(70_000))]
    docs += [(400 + i, docs[5][1] + shared[7]) for i in range(150)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("length, chunk, hot", [(50, 4 << 20, 256), (50, 3000, 256), (50, 3000, 0), (28, 20_000, 2)])
def test_passages_equal_brute_force(spark, monkeypatch, passage_docs, length, chunk, hot):
    monkeypatch.setattr(passages, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(passages, "FILES", 8)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(passages, "BUCKET_ANCHORS", 100)
    monkeypatch.setattr(passages, "HOT", hot)
    found = passages.without_repeated_passages(table(spark, passage_docs), length)
    wanted = plain_passages(passage_docs, length)
    same([(r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in found.collect()], wanted)


def test_passage_report(spark):
    docs = [(2, "é" * 30 + "tail"), (1, "é" * 26)]
    found = passages.passage_report(passages.without_repeated_passages(table(spark, docs)))
    assert [t for _, t in found.dtypes] == ["bigint"] * 4 + ["string"]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    same([tuple(r) for r in found.collect()], [(1, 52, 0, 0, digest("é" * 26)), (2, 64, 60, 1, digest("tail"))])
    assert passages.without_repeated_passages(table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="bytes or more"):
        passages.without_repeated_passages(table(spark, docs), 20)


def test_index_finds_longest_matches_and_first_owners():
    rng = random.Random(9)
    cat = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.cumsum([0, *map(len, xs)]))
    for depth in [8, 9, 12, 16, 20] * 40:
        texts = [bytes(rng.choice(b"ab\xf4\x00") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 8))]
        texts += [x[rng.randrange(3) :] + x for x in texts]
        owners = np.array([rng.randrange(10) for _ in texts])
        asked_for = [bytes(rng.choice(b"ab\xf4\x00c") for _ in range(rng.randrange(30))) for _ in range(5)] + [x[7:] + x[:9] for x in texts]
        index = rindex.RunLengthIndex(*cat(texts), owners, depth)
        lengths, places = index.statistics(*cat(asked_for))
        first = index.earliest(lengths, places, 99)
        at = [(x, p) for x in asked_for for p in range(len(x))]
        assert lengths.tolist() == [max(k for k in range(len(x) - p + 1) if any(x[p : p + k] in t for t in texts)) for x, p in at]
        assert first.tolist() == [min((o for t, o in zip(texts, owners, strict=True) if x[p : p + depth] in t), default=99) if p + depth <= len(x) else 99 for x, p in at]


def test_suffixes_are_sorted_in_blocks_of_groups(monkeypatch):
    rng = random.Random(12)
    for block in [1, 3, 64] * 20:
        monkeypatch.setattr(rindex, "_BLOCK", block)
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(4)] + [b"a" * 70, b"ab" * 30, b"ab" * 30]
        offsets = np.cumsum([0, *map(len, texts)])
        codes, starts = rindex._coded(np.frombuffer(b"".join(texts), np.uint8), offsets)
        room = (np.repeat(starts + np.diff(offsets), np.diff(offsets) + 1) - np.arange(len(codes))).astype(np.int32)
        depth = rindex._first_bytes(len(codes)) * 4
        order, rank = rindex.suffix_order(codes, room, depth)
        suffix = [bytes(codes[i : i + room[i]]) for i in range(len(codes))]
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: (suffix[i], i))
        cut = [x[:depth] for x in suffix]
        assert all((rank[i] == rank[j]) == (cut[i] == cut[j]) for i, j in zip(order, order[1:], strict=False))


def test_index_is_smaller_for_copies():
    rng = np.random.default_rng(10)
    text = rng.integers(97, 101, 3000, dtype=np.uint8)
    one = rindex.RunLengthIndex(text, np.array([0, 3000]), np.zeros(1, np.int64), 50)
    many = rindex.RunLengthIndex(np.tile(text, 40), np.arange(41) * 3000, np.zeros(40, np.int64), 50)
    assert len(many.starts) <= len(one.starts) + 2
    assert len(rindex.RunLengthIndex(np.zeros(0, np.uint8), np.array([0, 0]), np.zeros(1, np.int64), 50).statistics(text, np.array([0, 3000]))[0]) == 3000


def test_windows_of_a_text_longer_than_a_block(monkeypatch):
    rng = np.random.default_rng(11)
    data, offsets = rng.integers(97, 99, 5000, dtype=np.uint8), np.array([0, 30, 30, 4000, 4060, 5000])
    whole = [np.concatenate(x) for x in zip(*passages.windows(data, offsets, 50), strict=True)]
    monkeypatch.setattr(passages, "_WINDOWS", 64)
    parts = [np.concatenate(x) for x in zip(*passages.windows(data, offsets, 50), strict=True)]
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    assert whole[0].tolist() == [p for b, e in zip(offsets, offsets[1:], strict=False) for p in range(b, e - 49)]
