"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and repeats."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivenry.llm import components, decontam, exact_dedup, fuse, line_dedup, near_dedup, packing, pii, pretok, quality, textnum, token_counts, toxicity, warc
from scrivenry.llm.store import new_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)
#: The Thue-Morse word of 1,024 letters and its complement.
TWINS = ["".join("ab"[(i.bit_count() + c) & 1] for i in range(1024)) for c in (0, 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, bands string, low int, token string, row int"
VOCABULARY = [a + b for a, b in itertools.product("bdfglmnprst", ["a", "ee", "ion", "ou", "É", "or"])]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def table(spark, rows):
    """Documents with more columns, whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", 1, "t", 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, short, empty and null ones, and one very long."""
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randint(20, 60))) for _ in range(25)]
    for t in list(texts):
        w = t.split(" ")
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                v[rng.randrange(len(v))] = rng.choice(VOCABULARY)
            texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(v))
    texts += [None, "", " \n ", "one", "one", "one two", "ONE two", "a b c", " ".join(words(rng, 30_000)), texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_components(sets, percent):
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, 32), (5, 80, 32), (3, 85, 1)])
def test_near_duplicates(spark, corpus, monkeypatch, k, percent, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # at 1 all buckets take the way of the large ones
    sets = {i: decontam.shingle_set(plain_words(t), k) for i, t in corpus}
    expected = {i: (len(sets[i]), c, c == i) for i, c in plain_components(sets, percent).items()}
    got = near_dedup.near_duplicates(table(spark, corpus), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected
    assert len(got) == len(corpus)


def test_block_links_join_what_links_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1000, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 1000, 60), base)) for _ in range(40)]
    parts, side = np.arange(40), np.arange(40) % 2
    links = near_dedup.spanning_links(parts, parts, side, sets, 70)
    true = [(i, j) for i in range(0, 40, 2) for j in range(1, 40, 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
    assert true and {*map(frozenset, links)} <= {*map(frozenset, true)}

    def joined(edges):
        label = list(range(40))
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return [[x == y for y in label] for x in label]

    assert joined(links) == joined(true)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_duplicates(spark, corpus, bits):
    """With four bits of digest nearly all groups hold several texts, which the byte check has to part."""
    rows = corpus + [(i + 1000, t) for i, t in corpus[::3]]
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in sorted(norm.items()):
        groups.setdefault(t, []).append(i)
    expected = {i: (groups[t][0], len(groups[t]), groups[t][0] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    got = exact_dedup.exact_duplicates(table(spark, rows), 3, bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == expected


@pytest.mark.parametrize("n", [0, 1, 2, 50, 30_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    blob = fuse.build(np.concatenate([keys, keys[:5]]))
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, np.arange(100_000)).mean() < 3e-4


def test_pre_tokens_equal_the_library():
    rng = random.Random(0)
    alphabet = [*"ab1'stremvld  \n\t!.é٣　", "'re", "'ll", "<|endoftext|>", "͸", "中", "🙂"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(5_000)] + ["", "'", "'s", " ", "x" * 5_000]
    expected = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    data, offsets = textnum.buffers(pa.array(texts))
    starts, ends, bounds, odd = pretok.split(data, offsets)
    for cache in (50, pretok.CACHE):
        lengths = pretok.Encoder(BPE, token_counts.length_table(BPE, ["a", " ab", "é"]), cache=cache)
        ids = pretok.Encoder(BPE, ids=True, cache=cache)
        for _ in range(2):
            n, place, whole = lengths.numbers(data, starts, ends), ids.numbers(data, starts, ends), ids.whole(data, offsets, odd)
            for i, own in enumerate(expected):
                entries = place[bounds[i] : bounds[i + 1]]
                assert whole.get(i, [x for p in entries for x in ids.ids[ids.begins[p] : ids.begins[p] + ids.lengths[p]].tolist()]) == own
                assert i in whole or n[bounds[i] : bounds[i + 1]].sum() == len(own)


def test_hash_table_against_a_dict():
    rng = np.random.default_rng(4)
    table, plain = pretok.Table(1), {}
    for _ in range(30):
        codes, checks = rng.integers(0, 50, 40).astype(np.uint64), rng.integers(0, 9, 40).astype(np.uint64)
        keys = [*zip(codes.tolist(), checks.tolist(), strict=True)]
        assert table.find(codes, checks).tolist() == [plain.get(k, -1) for k in keys]
        new = [i for i, k in enumerate(keys) if k not in plain and k not in keys[:i]]
        table.put(codes[new], checks[new], np.arange(len(new), dtype=np.int32))
        plain |= {keys[i]: n for n, i in enumerate(new)}


def test_fingerprints_of_structured_words():
    """Sequences on which any polynomial over 64-bit integers collides, and slices of all lengths."""
    data, offsets = textnum.buffers(pa.array([x for t in TWINS for x in (t, t[1:], t[:64], t[:63])] + ["", "a", "a\0", "a" * 8, "a" * 16]))
    for seed in (0, 1):
        assert len(set(textnum.slice_hashes(data, offsets[:-1], offsets[1:], seed).tolist())) == len(offsets) - 1
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 4_000).astype(np.uint8)
    starts = rng.integers(0, 4_000, 3_000)
    ends = np.minimum(4_000, starts + rng.integers(0, 90, 3_000))
    found = textnum.slice_hashes(data, starts, ends).tolist()
    by_text = {}
    for h, a, b in zip(found, starts, ends, strict=True):
        by_text.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(x) == 1 for x in by_text.values()) and len(set(found)) == len(by_text)


def test_different_words_of_one_fingerprint_family(spark):
    docs = table(spark, [(1, TWINS[0]), (2, TWINS[1])])
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, BPE).collect()}
    for r in packing.pack(docs, BPE, capacity=4_096).collect():
        ids = np.array([*LIBRARY.encode(TWINS[r.doc_id - 1], add_special_tokens=False).ids, 0], "<u4")
        assert (r.ids_crc32, r.doc_tokens, rows[r.doc_id].n_tokens) == (zlib.crc32(ids.tobytes()), len(ids), len(ids) - 1)
    assert {r.component_id for r in near_dedup.near_duplicates(docs, 3, 85).collect()} == {1, 2}
    assert [r.n_removed for r in line_dedup.repeated_lines(docs).collect()] == [0, 0]


def test_token_counts(spark, corpus):
    t = LIBRARY
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(table(spark, corpus), BPE).collect()}
    for i, text in corpus:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512)


def test_packing(spark, corpus):
    t = LIBRARY
    rows = packing.pack(table(spark, corpus), BPE, capacity=256, group_docs=30).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert own[-1].offset + own[-1].length <= 256
    assert len(by_sequence) <= 1.1 * sum(r.length for r in rows) / 256 + 5


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 300)
    free, bins = [], np.zeros(300, int)
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
        free[at:] = [*free[at:], 100][: max(1, len(free) - at)] if at < len(free) else [100]
        free[at] -= lengths[i]
        bins[i] = at
    assert (packing.first_fit_decreasing(lengths, 100)[0] == bins).all()
    with pytest.raises(ValueError, match="capacity"):
        packing.first_fit_decreasing(np.array([101]), 100)


def test_warc_round_trip(spark):
    rng = random.Random(4)
    pages = [(i, f"http://x/{i}", " ".join(words(rng, 300))) for i in range(40)] + [(50, None, "same"), (51, "http://a\r\nb", "same"), (52, "u", None), (53, "u", ""), (54, "u", "é" * 9), (55, "u", "long " * 600_000), (None, "u", "same"), (None, "v", "no id")]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, digest int, original string")
    path = new_path(spark, "warc-test")
    warc.write_archives(df.unionByName(df.where("page_id = 3")), path, archive_bytes=1 << 20)
    again = warc.read_archives(spark, path)
    assert again.count() == len(pages) + 1 and again.where("page_id = 3").select("record_type").distinct().count() == 1
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in again.where("page_id is null").collect()) == [(4, "revisit", 51), (5, "response", None)]
    pages = [p for p in pages if p[0] is not None]
    got = {r.page_id: r for r in again.where("page_id is not null").collect()}
    latest = {}
    for i, _, html in pages:
        latest[html or ""] = max(i, latest.get(html or "", 0))
    assert len(got) == len(pages)
    for i, url, html in pages:
        body = (html or "").encode()
        r = got[i]
        assert (r.error, r.payload_bytes, r.payload_digest) == (None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if latest[html or ""] == i else ("revisit", latest[html or ""]))
        assert r.url == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body


def test_warc_unsound_records_fail_the_job(spark):
    ok, bad = (1, None), (None, "payload differs")
    schema = "page_id long, error string"
    assert [tuple(r) for r in warc.sound_records(spark.createDataFrame([ok], schema)).collect()] == [(1,)]
    assert warc.sound_records(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="archive record: payload differs"):
        warc.sound_records(spark.createDataFrame([ok, bad], schema)).collect()
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "some page")], "page_id long, url string, html string"), path)
    assert [r.page_id for r in warc.sound_records(warc.read_archives(spark, path, payloads=False)).collect()] == [1]


def test_warc_checks_headers_and_lengths():
    good = warc.record(1, "u", b"body", 4, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), 1)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (b"", good[:-1], good.replace(b"WARC/1.1", b"HTML/1.1"), good.replace(b"body", b"bodx"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 4", b"Content-Length: x"), good.replace(b"urn:page", b"urn:other"), good + b"x"):
        with pytest.raises(ValueError, match="."):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    skip = warc.SEPARATOR.encode()
    assert [r["error"] for r in warc.parse_archive(memoryview(frame + skip + frame))] == [None, None]
    assert [r["error"] for r in warc.parse_archive(memoryview(frame + frame[:-3]))] == [None, "cut frame"]
    assert [r["error"] for r in warc.parse_archive(memoryview(b"nonsense"))] == ["unknown frame"]
    assert [r["page_id"] for r in warc.parse_archive(memoryview(zstandard.ZstdCompressor().compress(b"x") + frame))] == [None, 1]
    assert list(warc.parse_archive(memoryview(b""))) == []


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 20, 40, 90, 300, 300])] + [(50, None), (51, ""), (52, "X y"), (53, "x Y")]
    docs = []
    for i in range(60):
        w = words(rng, rng.choice([3, 50, 400, 4_000]))
        for _, text in rng.sample(items, 2):
            v = (text or "").split()
            if v and rng.random() < 0.6:
                v[rng.randrange(len(v))] = rng.choice(VOCABULARY)
            at = rng.randrange(len(w))
            w[at:at] = v[: len(v) // 2] + (words(rng, 30) if rng.random() < 0.3 else []) + v[len(v) // 2 :]
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    docs += [(100, None), (101, ""), (102, items[8][1])]
    expected = set()
    for d, text in docs:
        for i, item in items:
            q = decontam.shingle_set(plain_words(item), 5)
            if q:
                width = len(next(iter(q)))
                own = decontam.shingle_set(plain_words(text), width) if len(plain_words(text)) >= width else set()
                if len(q & own) >= 0.8 * len(q):
                    expected.add((d, i, len(q), len(q & own)))
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (5, 1000):
        got = decontam.contained_items(table(spark, docs), b, block_items=block).collect()
        assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got} == expected
    kept = decontam.decontaminated(table(spark, docs), b)
    assert kept.columns == table(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in expected}


def plain_matches(docs):
    """Numbers of the lines that match an earlier one, by document."""
    seen, out = [], {}
    for d, text in docs:
        out[d] = []
        for n, line in enumerate((text or "").split("\n")):
            w = {x for x in re.split(r"[\x20\x09-\x0d]+", line.lower()) if x}
            if w and any(100 * len(w & v) >= 80 * len(w | v) for v in seen):
                out[d].append(n)
            if w:
                seen.append(w)
    return out


def lines_corpus(seed, families=8, size=6):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (1, 3, 4, 5, 8, 12, 20, 40)[:families] for _ in range(size)]
    docs = []
    for d in range(30):
        lines = []
        for _ in range(rng.randint(0, 8)):
            w = list(rng.choice(base))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            lines.append(" ".join(w))
        docs.append((d, "\n".join(lines)))
    return [*docs, (90, None), (91, "\n\n"), (92, docs[3][1]), (93, "  ")]


def test_repeated_lines(spark):
    docs = [*lines_corpus(6), (94, " ".join(words(random.Random(1), 60_000)) + "\nx"), (95, "x " + "y" * 100_000)]
    expected = plain_matches(docs)
    got = {r.doc_id: r for r in line_dedup.repeated_lines(table(spark, docs)).collect()}
    assert {d: list(r.removed_lines) for d, r in got.items()} == expected
    texts = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(table(spark, docs)).collect()}
    assert texts[5] == "\n".join(x for n, x in enumerate(docs[5][1].split("\n")) if n not in expected[5])


@pytest.mark.parametrize("sizes", [(3, 2, 0), (6, 2, 1), (50, 4, 1), (10_000, 32, 4)])
def test_lines_of_large_groups(spark, monkeypatch, sizes):
    """Groups that are split by a second token, and groups that meet their earliest line first."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1 / 100)
    rng = random.Random(sizes[0])
    shared = words(rng, 30)
    family = []
    for i in range(60):
        w = list(shared)
        for _ in range(i % 4):
            w[rng.randrange(30)] = f"new{rng.randrange(40)}"
        family.append((200 + i, " ".join(w)))
    docs = [*lines_corpus(sizes[0] + 1, 8, 4), *family]
    got = line_dedup.matched_lines(line_dedup._texts(table(spark, docs))[1], 80, sizes).where("later").collect()
    assert {(r.doc, r.line_no) for r in got} == {(d, n) for d, own in plain_matches(docs).items() for n in own}


def test_bitmaps_never_overstate_how_far_sets_are_apart(spark):
    """Of sets around the size from which bitmaps are wide, in numpy and in the join's filter."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[a : a + size], rng.integers(0, 2**63, extra).astype(np.uint64)])) for size in (5, 50, 58, 62, 64, 66, 90, 200) for a in (0, 1, 3) for extra in (0, 1, 4)]
    n = np.array([len(x) for x in sets])
    words = line_dedup.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    rows = np.stack([np.zeros(len(sets), np.int64), np.arange(len(sets)), n.astype(np.int64) << 32, *(w.view(np.int64) for w in words)])
    both = lambda a, b: len(np.intersect1d(a, b))
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * both(sets[i], sets[j]) >= 80 * len(np.union1d(sets[i], sets[j]))}
    for most in (10, 1_000):
        found = line_dedup.candidates(rows, 80, 0, None, (1_000, most, 1_000))[0]
        assert true <= {tuple(sorted(p)) for p in found.T.tolist()} and len(found.T) < 1.3 * len(true)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rows.T], ", ".join(f"{c} long" for c in line_dedup.ROW)).withColumn("known", F.lit(0))
    other = df.select(F.col("k").alias("j"), *line_dedup._other("o"))
    joined = df.join(other, F.col("k") < F.col("j")).where(line_dedup._possible("o", 80)).select("k", "j").collect()
    assert {tuple(r) for r in joined} == {tuple(sorted(p)) for p in found.T.tolist()}


def test_candidates_of_chunks():
    """Keys that are parted by chunks are large in all of them."""
    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([rng.integers(0, 50, 500), np.full(900, 20)]))
    rows = np.stack([key, np.arange(len(key)), np.full(len(key), 10 << 32), *rng.integers(0, 2**62, (4, len(key)))])
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, a : a + 70]], line_dedup.ROW) for a in range(0, len(key), 70)]
    found = [*line_dedup._chunks(iter(batches), 200)]
    assert (np.concatenate([x for x, _ in found], axis=1) == rows).all()
    large = np.concatenate([x[1][line_dedup.candidates(x, 80, 0, begun, (100, 5, 2))[2]] for x, begun in found])
    assert large.tolist() == np.flatnonzero(key == 20).tolist()


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_personal_data(spark):
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y", "p@q.r@s.t", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "00001.2.3.255", "4539 1488 0343 6467", "4539148803436467", "4539148803436468", "+49 (30) 901820123", "+1", "+12345678901234567", "🙂é", "@", "..", "-", " ", "\n", "word", "7", "+"]
    docs = [(i, "".join(rng.choice([p, p + " "]) for p in rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "1 " * 20_000), (1003, "a." * 20_000), (1004, "9" * 30_000), (1005, "a@" + "b." * 9_000 + "c")]
    got = {r.doc_id: r for r in pii.personal_data(table(spark, docs)).collect()}
    for i, text in docs:
        spans = []
        for rank, (kind, (pattern, ok)) in enumerate(RULES.items()):
            spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in RULES], text[:200]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in joined.split(",") if s]


def test_texts_of_very_many_matches(spark):
    """Runs of matches are put together at their places, and spans that overlap are replaced once."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["a@b.cd", "é", "+1 (234) 567-8901", "1.2.3.4", "word", "4539148803436467 "]) for _ in range(n)) for n in (127, 128, 129, 400, 3_000)]
    rows = [*enumerate(texts), (9, texts[2]), (9, texts[2])]
    got = pii.personal_data(table(spark, rows)).collect()
    clean = {r.doc_id: r.text for r in pii.sanitised(table(spark, rows), generalise=2.0).collect()}
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        spans = sorted((m.start(), rank, kind, m.end()) for rank, (kind, (pattern, ok)) in enumerate(RULES.items()) for m in re.finditer(pattern, text) if ok(m[0]))
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        out, at = "", 0
        for a, _, kind, b in spans:
            out += text[at:a] + ("" if a < at else f"[{kind.upper()}]")
            at = max(at, b)
        assert clean[r.doc_id] == out + text[at:]


def test_disclosing_terms_are_sanitised(spark):
    rows = [(i, f"Colonel Zanzibar wrote to spy@agency.org about the weather {i}") for i in range(3)] + [(i, f"the weather about town was wrote number {i}") for i in range(3, 60)]
    spans = {r.doc_id: r.spans for r in pii.personal_data(table(spark, rows)).collect()}
    assert spans[0] == "term:0:7,term:8:16,email:26:40"
    assert spans[5] == ""
    texts = {r.doc_id: r.text for r in pii.sanitised(table(spark, rows)).collect()}
    assert texts[0] == "  wrote to [EMAIL] about the weather 0"
    assert texts[7] == rows[7][1]


def test_disclosing_terms_of_whole_documents(spark):
    """Terms far from their entity, of three letters, caseless ones and codes; counts by whole documents."""
    rng = random.Random(12)
    names = ["Lee", "Ana", "李明", "A4711", "47", "Zanzibar", "İnce"]
    docs, mails = [], ["a1@x.org", "lee@agency.org", "c@y.org"]
    for i in range(90):
        w = words(rng, rng.choice([3, 40, 200]))
        for m, name in zip(mails * 3, names, strict=False):
            if rng.random() < 0.1:
                w.insert(rng.choice([0, len(w)]), name)
                w.insert(rng.randrange(len(w) + 1), m)
        docs.append((i, " ".join(w) if i % 30 else " ".join(w) + ", LEE."))
    docs += [(200, None), (201, "")] + [(300 + i, f"Kim Zanzibar {'so it goes ' * 40}far@z.org") for i in range(3)]
    held = {i: {m[0] for m in re.finditer(RULES["email"][0], t or "")} for i, t in docs}
    rest = {i: re.sub(RULES["email"][0], lambda m: " " * len(m[0]), t or "") for i, t in docs}
    found = {i: [(m[0].lower(), m.span()) for m in re.finditer(r"\w+", t)] for i, t in rest.items()}
    n = len(docs)
    n_term, n_entity, n_both = (collections.Counter() for _ in range(3))
    for i, _ in docs:
        own = {w for w, _ in found[i] if len(w) >= 3 or any(unicodedata.category(c) in ("Nd", "Lo") for c in w)}
        n_term.update(own)
        n_entity.update(held[i])
        n_both.update(itertools.product(held[i], own))
    shares = {k: math.log2(b * n / (n_entity[k[0]] * n_term[k[1]])) / -math.log2(n_entity[k[0]] / n) for k, b in n_both.items() if b >= 2}
    terms = {k for k, v in shares.items() if v >= 0.5}
    assert {"kim", "zanzibar", "李明", "a4711", "47"} <= {t for _, t in terms}
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term")] for r in pii.personal_data(table(spark, docs)).collect()}
    assert got == {i: [f"term:{a}:{b}" for w, (a, b) in found[i] if any((e, w) in terms for e in held[i])] for i, _ in docs}
    assert "Kim" not in {r.doc_id: r.text for r in pii.sanitised(table(spark, docs)).collect()}[300]


def labelled(spark, rng, n, bad):
    """Documents of which every fourth holds ``bad``, and their labels."""
    rows = []
    for i in range(n):
        w = words(rng, rng.randint(30, 80))
        marked = i % 4 == 0
        if marked:
            w = bad(rng, w)
        rows.append((i, " ".join(w), marked))
    docs = table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(not m), int(m)) for i, _, m in rows] + [(10**6, 1, 1), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: m for i, _, m in rows}


def test_toxicity_chain(spark):
    def insult(rng, w):
        for _ in range(3):
            w[rng.randrange(len(w))] = "vilest" + rng.choice(VOCABULARY)
        return w

    docs, labels, truth = labelled(spark, random.Random(8), 800, insult)
    chain = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    assert chain.categories[-1] == "toxic" and len(chain.weights[-1]) == 1 + 4 + len(chain.features)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs, chain).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert sum(got[i] == truth[i] for i in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in got.items() if not t}
    odd = [(1, None), (2, ""), (3, "vilest" * 5_000), (4, rows_of(docs)[0]), (4, rows_of(docs)[0]), (None, rows_of(docs)[0])]
    scores = toxicity.score(table(spark, odd), chain).collect()
    base = plain_chain(chain, set())
    for r in scores:
        text = dict(odd)[r.doc_id] or ""
        assert np.allclose([r[f"p_{c}"] for c in chain.categories], plain_chain(chain, plain_features(text)), atol=1e-5)
    assert all(np.allclose(r[1:-1], base) for r in scores if r.doc_id in (1, 2)) and len(scores) == len(odd)


def rows_of(docs):
    return [r.text for r in docs.orderBy("doc_id").limit(1).collect()]


def plain_features(text):
    """Hashes of all words and of their beginnings of four to six bytes."""
    one = lambda x: textnum.slice_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
    out = set()
    for w in re.findall(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.translate(decontam._LOWER)):
        raw = w.encode()
        out.add(int(one(raw)[0]))
        out |= {int(textnum.mix(one(raw[:n]) + np.uint64(n))[0]) for n in (4, 5, 6) if len(raw) > n}
    return out


def plain_chain(chain, features):
    """Each category's probability, one after another, from its weights alone."""
    out = []
    has = [float(int(f) in features) for f in chain.features]
    for w in chain.weights:
        z = w[0] + sum(p * x for p, x in zip(out, w[1:], strict=False)) + sum(h * x for h, x in zip(has, w[1 + len(out) :], strict=True))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_chain_learns_from_out_of_fold_probabilities(monkeypatch):
    """Later models see, for each row, what models that didn't learn from it said of earlier categories."""
    rng = np.random.default_rng(6)
    x = (rng.random((40, 5)) < 0.4).astype(np.float32)
    y = (rng.random((40, 3)) < 0.4).astype(np.float32)
    folds = np.arange(40) % 4
    given, fit = [], toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda a, b: given.append((a.copy(), b.copy())) or fit(a, b))
    chain = toxicity.fit_chain(x, y, folds, ["a", "b", "c"], np.arange(5, dtype=np.uint64))
    seen = np.zeros((40, 0))
    for c in range(3):
        full = np.hstack([seen, x]).astype(np.float32)
        assert np.allclose(given[5 * c][0], full, atol=1e-6) and (given[5 * c][1] == y[:, c]).all()
        held = np.zeros((40, 1))
        for f in range(4):
            own = folds != f
            assert (given[5 * c + 1 + f][0] == given[5 * c][0][own]).all()
            w = fit(full[own], y[own, c])
            held[~own, 0] = 1 / (1 + np.exp(-(w[0] + full[~own] @ w[1:])))
        seen = np.hstack([seen, held])
    assert [len(w) for w in chain.weights] == [6, 7, 8]


def plain_score(net, text):
    """The network's probability, chunk by chunk and byte by byte."""
    count = max(1, -(-max(len(text) - quality.CHUNK, 0) // quality.STRIDE) + 1)
    best = np.full(quality.FILTERS, -np.inf)
    for i in range(count):
        own = text[i * quality.STRIDE : i * quality.STRIDE + quality.CHUNK]
        own = own + bytes(quality.CHUNK - len(own))
        x = [v for b in own for v in net.embedding[b]] + [sum(own[j] == own[j + lag] for j in range(quality.CHUNK - lag)) / (quality.CHUNK - lag) for lag in range(1, quality.LAGS + 1)]
        best = np.maximum(best, np.array(x) @ net.filters + net.bias)
    return 1 / (1 + math.exp(-(np.maximum(best, 0) @ net.output + net.shift)))


def test_quality_scores_and_gradients_against_plain_ones(spark):
    rng = np.random.default_rng(4)
    shape = lambda *n: rng.normal(0, 0.3, n).astype(np.float32)
    net = quality.Network(shape(256, quality.WIDTH), shape(quality.CHUNK * quality.WIDTH + quality.LAGS, quality.FILTERS), shape(quality.FILTERS), shape(quality.FILTERS), 0.1)
    texts = [None, "", "a", "ab" * 40, "é" * 300, "word " * 3_000, "word " * 3_000, "\0\n"]
    got = quality.quality_scores(table(spark, [*enumerate(texts)]), net).collect()
    for r in got:
        text = (texts[r.doc_id] or "").encode()
        assert abs(r.score - plain_score(net, text)) < 1e-4
    raw = [b"abc" * 50, b"x" * 20, b"hello world " * 20]
    data, offsets = textnum.buffers(pa.array([t.decode() for t in raw]))
    own, again, bounds = quality.chunks(data, offsets)
    y = np.array([1, 0, 1], np.float32)

    def loss():
        p = quality.forward(net, own, again, bounds)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + quality.FILTER_DECAY / 2 * (net.filters**2).sum() + quality.OUTPUT_DECAY / 2 * (net.output**2).sum()

    net = quality.Network(*(getattr(net, k).astype(np.float64) for k in ("embedding", "filters", "bias", "output")), net.shift)
    found = quality.gradients(net, own, again, bounds, y)
    for name, grad in zip(("embedding", "filters", "bias", "output"), found[:4], strict=True):
        values, flat = getattr(net, name).reshape(-1), grad.reshape(-1)
        for i in [*np.argsort(-np.abs(flat))[:4], *rng.integers(0, len(flat), 4)]:
            old = values[i]
            values[i] = old + 1e-3
            high = loss()
            values[i] = old - 1e-3
            low = loss()
            values[i] = old
            assert abs((high - low) / 2e-3 - flat[i]) < 2e-3


def test_quality_network(spark):
    docs, labels, truth = labelled(spark, random.Random(9), 800, lambda rng, w: [rng.choice(["x###", "y***", "%%"]) if i % 2 else x.upper() + "!!" for i, x in enumerate(w)])
    rows = quality.quality_scores(docs, quality.train(docs, labels, max_rows=500)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (not truth[r.doc_id]) for r in held) >= 0.97 * len(held)


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    """Junk in the middle of a long text reaches the network, and a document of any length keeps its chunks."""
    rng = random.Random(14)
    texts = {i: " ".join(words(rng, 700)) + (" x### %% y***" * 20 if i % 2 else "") + " " + " ".join(words(rng, 2_000)) for i in range(40)}
    docs = table(spark, list(texts.items()))
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in texts], "doc_id long, quality int")
    given, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **more: given.append((x, list(y))) or fit(x, y, epochs=1))
    quality.train(docs, labels)
    free = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    assert given == [([texts[i].encode() for i in free], [i % 2 ^ 1 for i in free])]
    for text in (b"", b"a", b"ab" * 32, *given[0][0][:3]):
        own, again, _ = quality.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        view, counts = quality._packed(text)
        assert (view == own).all() and (quality._rates(counts) == again).all()


def test_repeated_lines_of_odd_texts(spark):
    same = "a b c d e f g h i j\n\nA B C D E F G H I j k"
    rows = [(1, None, "x"), (2, "", None), (3, "\n\n", ""), (4, same, ""), (4, same, ""), (5, "x\na b c d e f g h i\nÉ é z w\n", ""), (6, "é z w\nÉ\nX", ""), (7, "x", ""), (7, "X", ""), (7, "own\nline", ""), (None, "own", ""), (None, "nobody's", "")]
    rows = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, tokens string")).collect()
    got = sorted((r.doc_id, r.n_lines, list(r.removed_lines)) for r in rows if r.doc_id)
    assert sorted((r.n_lines, list(r.removed_lines)) for r in rows if not r.doc_id) == [(1, []), (1, [0])]
    assert got == [(1, 1, []), (2, 1, []), (3, 3, []), (4, 3, [2]), (4, 3, [2]), (5, 4, [1]), (6, 3, [0, 2]), (7, 1, [0]), (7, 1, [0]), (7, 2, [])]


def test_chunks_cover_all_bytes():
    for n in (0, 1, 63, 64, 65, 96, 97, 1_000):
        data = np.random.default_rng(n).integers(1, 255, n).astype(np.uint8)
        own, again, bounds = quality.chunks(np.concatenate([data, data[:3]]), np.array([0, n, n + len(data[:3])]))
        assert again.shape == (len(own), quality.LAGS) and len(bounds) == 3
        flat = np.concatenate([own[0], *(c[-quality.STRIDE :] for c in own[1 : bounds[1]])])
        assert (flat[:n] == data).all() and not flat[n:].any()


def test_empty_tables(spark):
    docs = table(spark, []).limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    chain, net = toxicity.train(docs, none), quality.train(docs, none)
    frames = [
        exact_dedup.exact_duplicates(docs), near_dedup.near_duplicates(docs), token_counts.token_counts(docs, BPE), packing.pack(docs, BPE), decontam.contained_items(docs, items), decontam.decontaminated(docs, items),
        line_dedup.repeated_lines(docs), pii.personal_data(docs), toxicity.score(docs, chain), quality.quality_scores(docs, net),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    path = new_path(spark, "empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
    assert uuid.UUID(path.rsplit("-", 1)[1])


def test_pipeline_stages(spark):
    """The stages' decisions on a small table, against what each was given."""
    import corpus_pipeline

    base = spark.conf.get("spark.checkpoint.dir") + "/sf-" + uuid.uuid4().hex
    rng = random.Random(10)
    texts = [" ".join(words(rng, 60)) for _ in range(60)]
    for i in range(0, 60, 4):
        w = texts[i].split()
        for _ in range(3):
            w[rng.randrange(60)] = "vilest" + rng.choice(VOCABULARY)
        texts[i] = " ".join(w)
    near = texts[1].split()
    near[30] = "changed"
    item = " ".join(words(rng, 25))
    extra = [texts[1], texts[2].replace(" ", "  "), " ".join(near), " ".join(words(rng, 40)) + " " + item + " " + " ".join(words(rng, 200))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs, gone = spark.read.parquet(f"{base}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns
        have, docs = {r.doc_id for r in docs.collect()}, spark.createDataFrame(out.collect(), docs.schema)
        gone.append(have - {r.doc_id for r in docs.collect()})
    assert gone == [set(range(0, 60, 4)), {60, 61}, {62}, {63}]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, base).select("doc_id").distinct().collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def plain_near(rows, k, percent):
    """Each row's component, and the positions that stay: the smallest (no id, id, text hash) of each."""
    sets = {n: decontam.shingle_set(plain_words(t), k) for n, (_, t) in enumerate(rows)}
    return {n: c if sets[n] else None for n, c in plain_components(sets, percent).items()}


ODD = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y z"), (3, "x  y z"), (3, "z only here"), (None, "a b c d e f g"), (None, "null twice"), (None, "null twice"), (None, "NULL  twice"), (4, None), (5, ""), (4, None), (6, "null alone"), (None, "x y z w")]


def test_ids_that_repeat_or_lack(spark):
    docs = table(spark, ODD)
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in ODD]
    groups = {t: [i for (i, _), x in zip(ODD, norm, strict=True) if x == t] for t in norm}
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    expected = sorted(((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(ODD, norm, strict=True)), key=str)
    for bits in (256, 4):
        assert sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs, 2, bits).collect()), key=str) == expected
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.without_duplicates(docs).collect()), key=str)
    assert [(i, re.sub(" +", " ", t or "")) for i, t in kept] == sorted(((keep[t], t) for t in groups), key=str)

    parts = plain_near(ODD, 3, 85)
    least = {c: min((ODD[n][0] for n in parts if parts[n] == c and ODD[n][0] is not None), default=None) for c in parts.values()}
    expected = sorted(((i, i if parts[n] is None else least[parts[n]]) for n, (i, _) in enumerate(ODD)), key=str)
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.without_near_duplicates(docs, 3, 85).collect()
    assert near_dedup.without_near_duplicates(docs, 3, 85).columns == docs.columns
    words_of = lambda t: " ".join(plain_words(t))
    assert sorted((words_of(r.text), r.doc_id) for r in kept if words_of(r.text) and r.doc_id) == [("a b c d e f g", 1), ("null alone", 6), ("x y z", 2), ("z only here", 3)]
    assert sorted(words_of(r.text) for r in kept if words_of(r.text) and not r.doc_id) == ["null twice", "x y z w"]
    assert len([r for r in kept if not words_of(r.text)]) == 3


def test_later_batches_meet_saved_snapshots(spark, corpus):
    path = new_path(spark, "snapshot")
    exact_dedup.save_snapshot(table(spark, corpus), path)
    batch = [(9_001, corpus[0][1]), (9_002, "never seen"), (None, corpus[1][1]), (9_003, None)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    least = {}
    for i, t in corpus:
        least[norm(t)] = min(i, least.get(norm(t), i))
    got = {r.doc_id: r.old_id for r in exact_dedup.seen_before(table(spark, batch), [path]).collect()}
    assert got == {i: least[norm(t)] for i, t in batch if norm(t) in least}
    assert exact_dedup.seen_before(table(spark, batch), []).count() == 0


def test_rows_without_ids_and_repeated_rows_of_texts(spark):
    """Counting, packing and decontamination take each row as it comes."""
    rows = [(1, "some words here"), (1, "some words here"), (1, "others"), (None, "no id at all"), (None, None), (2, "")]
    docs = table(spark, rows)
    n = lambda t: len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, BPE).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, n(t)) for i, t in rows), key=str)
    packed = packing.pack(docs, BPE, capacity=4).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packed if r.start == 0) == sorted((i or 0, n(t) + 1) for i, t in rows)
    assert sum(r.length for r in packed) == sum(n(t) + 1 for _, t in rows)
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    for (a, x, m), (b, y, _) in itertools.pairwise(places):
        assert (y == x + m) if a == b else y == 0
    items = spark.createDataFrame([(7, "words here"), (None, "no id"), (8, None), (8, "others")], "item_id long, text string")
    found = decontam.contained_items(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted([(1, 7), (1, 7), (1, 8), (None, None)], key=str)
    assert sorted(((r.doc_id, r.text) for r in decontam.decontaminated(docs, items).collect()), key=str) == [(2, ""), (None, None)]


def test_components_raise_when_they_are_cut_short(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connected_components(chain, rounds=1)


def test_rows_that_repeat(spark, corpus):
    rows = corpus[:6] + corpus[:2]
    assert near_dedup.near_duplicates(table(spark, rows)).count() == 8
    assert exact_dedup.exact_duplicates(table(spark, rows)).where(F.col("doc_id") == rows[0][0]).count() == 2
    assert token_counts.token_counts(table(spark, rows), BPE).count() == 8


def test_equal_pieces_spread_over_groups(spark):
    """20,000 rows without id and text: one piece each, ten groups of about as many."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    packed = packing.pack(docs, BPE)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.2 * min(sizes) and sum(sizes) == 20_000
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("places"))
    assert full.where("n > 1024 OR n <> places").count() == 0 and full.count() == sum(-(-n // 1024) for n in sizes)


def test_items_in_blocks_of_bytes(spark, corpus, monkeypatch):
    items = spark.createDataFrame([(i, " ".join((t or "").split()[:30])) for i, t in corpus[:40]], "item_id long, text string")
    whole = sorted(map(tuple, decontam.contained_items(table(spark, corpus), items).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2_000)
    assert len(list(decontam.item_blocks(items, 20_000))) > 2
    assert sorted(map(tuple, decontam.contained_items(table(spark, corpus), items).collect()), key=str) == whole


@pytest.fixture()
def pipeline_tables(spark):
    """Writes the tables of a pipeline run; documents have more columns, whose names stages use themselves."""

    def write(rows, items=(), labels=()):
        base = spark.conf.get("spark.checkpoint.dir") + "/sf-" + uuid.uuid4().hex
        table(spark, rows).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        return base

    return write


def test_pipeline_of_odd_rows(spark, pipeline_tables):
    """Nulls, empties, repeats, rows without ids, a very long text, and columns whose names clash."""
    import corpus_pipeline

    rng = random.Random(21)
    long = " ".join(words(rng, 40_000))
    item = " ".join(words(rng, 25))
    clean = [(100 + i, " ".join(words(rng, 30))) for i in range(20)]
    rows = [*clean, clean[0], (1, None), (2, ""), (None, None), (None, "lone row without id"), (3, long), (4, long + " end"), (5, item), (6, clean[3][1].replace(" ", "\n"))]
    base = pipeline_tables(rows, [(1, item), (None, None)], [(100, None, 0), (101, 1, 0), (None, 1, 1), (102, 0, None)])
    docs = spark.read.parquet(f"{base}/documents.parquet")
    toxic_out = corpus_pipeline.toxicity_stage(spark, docs, base)
    assert toxic_out.columns == docs.columns and toxic_out.count() == len(rows)
    assert corpus_pipeline.exact_stage(spark, docs, base).columns == docs.columns
    out = corpus_pipeline.run(spark, base)
    kept = sorted(((r.doc_id, r.doc_tokens) for r in out.where("start = 0").collect()), key=str)
    n = lambda t: len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1
    # Null and empty texts are equal, and so is 6, white space aside: the one with the smallest id stays.
    expected = [(i, n(t)) for i, t in clean if i != 103] + [(1, 1), (6, n(rows[-1][1])), (None, n("lone row without id")), (3, n(long))]
    assert kept == sorted(expected, key=str)


def test_pipeline_of_empty_tables(spark, pipeline_tables):
    import corpus_pipeline

    base = pipeline_tables([])
    assert corpus_pipeline.run(spark, base).count() == 0
    base = pipeline_tables([(1, "only one"), (1, "only one")])
    assert [(r.doc_id, r.start) for r in corpus_pipeline.run(spark, base).collect()] == [(1, 0)]


def test_toxicity_of_odd_rows(spark):
    docs = table(spark, [(1, "kind words"), (2, None), (3, ""), (None, None), (1, "kind words"), (4, "w " * 60_000)])
    chain = toxicity.train(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.without_toxic(docs, chain).count() == 6 and toxicity.score(docs, chain).count() == 6
    assert toxicity.without_toxic(docs.limit(0), chain).collect() == []
