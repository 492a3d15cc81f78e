"""Near-duplicate lines by an exact set-similarity join: rarity order, prefix, length and positional filters, verification.

A line's tokens are its distinct words; a token is a 64-bit value, its rarity (a logarithm of the number of times that
its cell of a table of fixed size occurs in the corpus) in the top bits and a hash of the word below, so sorting tokens
orders them by rarity. Any order common to all lines keeps the join exact; rarity only keeps the candidates few. Words
become sorted tokens in numpy, batch by batch; what crosses the network are rows of a few long integers.

Rows of one prefix token meet in one task, which pairs groups of a bounded number of rows with the filters and a parity
bitmap. Tokens of more rows are split: two lines that match share a second token after their first common one, within a
prefix that is one token longer, so such rows meet again by both tokens. What is still large, and groups in which nearly
everything is alike, first meets their earliest line only; lines that are then without an earlier match meet the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .store import stage_table, text_column

#: Cells of the table of word counts, a power of two: its size is the same for any corpus.
CELLS = 1 << 16
#: Tokens whose cell has at least this share of all words may be in very many prefixes: they are split at once.
HOT_SHARE = 1 / 2048
#: Most rows of a key that one task pairs; up to the second number all pairs that pass the filters are kept, beyond it the
#: third times the rows: a group with more is alike all through.
GROUPS = (4_096, 32, 4)
_HASH_BITS = 55
#: A prefix token is shuffled as 48 bits of a hash and, above them, whether it is hot.
_HOT = 1 << 48
PLACE = ["doc", "tie", "line_no"]
#: Words of a line's bitmap: which cells hold an odd number of its tokens. Lines of under WIDE tokens use the first word only,
#: with cells that are four of the others; all words of either, combined by exclusive or, give those 64 cells.
BITS, WIDE = ["b0", "b1", "b2", "b3"], 64
ROW = ["key", "k", "size_at", *BITS]


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, and doc and tie, which tell rows apart and order them: by id, those without one last.

    Where ids repeat or lack, a hash of the text breaks ties; rows that agree in both are one document, which the second
    table has once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    clean = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()
    tie = F.lit(0).cast("long") if clean else F.xxhash64("text")
    out = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), tie.alias("tie"))
    return out, out if clean else stage_table(out.dropDuplicates(["doc", "tie"]), "texts")


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for _, data, offsets in textnum.slices(batches, "text"):
        hashes = textnum.words(data, offsets)[2]
        counts += np.bincount((hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["cell", "n"])


def rarity(lowered: DataFrame) -> tuple[bytes, int]:
    """Four times the logarithm of how often each cell's words occur in the corpus, a byte each; the level of hot cells."""
    cells = lowered.select("text").mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    for row in cells.collect():
        counts[row.cell] = row.n
    levels = np.minimum(254, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    return levels.tobytes(), math.ceil(4 * math.log2(max(2.0, counts.sum() * HOT_SHARE)))


def line_tokens(data: np.ndarray, offsets: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's first line number in the batch, distinct tokens line by line in rarity order, and bounds by line."""
    breaks = np.flatnonzero(data == 0x0A)
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    starts = np.full(first[-1] + 1, len(data), np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[first[:-1]] = offsets[:-1]
    starts[:-1][inner] = breaks + 1
    _, _, hashes, bounds = textnum.words(data, starts)
    line = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    level = levels[(hashes & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    tokens = (level << np.uint64(_HASH_BITS)) | (hashes & np.uint64((1 << _HASH_BITS) - 1))
    order = np.argsort(tokens)
    # Line numbers of a slice mostly fit 16 bits, which numpy sorts by radix.
    order = order[np.argsort(line[order].astype(np.uint16 if len(starts) <= 1 << 16 else np.int64), kind="stable")]
    tokens, line = tokens[order], line[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
    return first, tokens[new], np.searchsorted(line[new], np.arange(len(starts)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def bitmaps(mixed: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The four words of each set's bitmap; sets begin at ``at`` among the scrambled tokens and have ``n`` of them."""
    if not len(at):
        return [np.zeros(0, np.uint64)] * 4
    bit, word = np.uint64(1) << (mixed >> np.uint64(58)), mixed >> np.uint64(56) & np.uint64(3)
    words = [np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at) for w in range(4)]
    folded = words[0] ^ words[1] ^ words[2] ^ words[3]
    return [np.where(n < WIDE, folded, words[0]), *(np.where(n < WIDE, np.uint64(0), w) for w in words[1:])]


def _keyed(levels: bytes, hot: int, percent: int):
    """Each line with a word: size, fingerprint and bitmap of its set, and the prefix if it can match an unequal set.

    A match needs ceil(percent% of the size) common tokens, so one of the rarest size - that + 1 is common, and a second one
    of the rarest size - that + 2. A set that the task has met lately gets no second prefix.
    """
    short = math.ceil(100 / (100 - percent)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels, np.uint8)
        met = np.zeros(1 << 17, np.uint64)
        for part, data, offsets in textnum.slices(batches, "text"):
            first, tokens, bounds = line_tokens(data, offsets, table)
            per_text, sizes = np.diff(first), np.diff(bounds)
            full = sizes > 0
            at = bounds[:-1][full]
            n = sizes[full]
            mixed = textnum.mix(tokens)
            keys = textnum.mix(np.add.reduceat(mixed, at) + n.astype(np.uint64)) if len(at) else mixed
            bits = bitmaps(mixed, at, n)
            slots = (keys & np.uint64(len(met) - 1)).astype(np.int64)
            new = np.zeros(len(keys), bool)
            new[np.unique(keys, return_index=True)[1]] = True
            new &= met[slots] != keys
            met[slots] = keys
            keep = np.where(new & (n >= short), np.minimum(n, n - (n * percent + 99) // 100 + 2), 0)
            inside = np.arange(len(tokens)) - np.repeat(at, n) < np.repeat(keep, n)
            prefix = (mixed[inside] & np.uint64(_HOT - 1)) | np.where(tokens[inside] >> np.uint64(_HASH_BITS) >= hot, np.uint64(_HOT), np.uint64(0))
            row = np.repeat(np.arange(len(per_text)), per_text)[full]
            number = (np.arange(first[-1]) - np.repeat(first[:-1], per_text))[full]
            columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keys.view(np.int64)), *(pa.array(b.view(np.int64)) for b in bits), _lists(prefix, keep)]
            yield pa.RecordBatch.from_arrays(columns, [*PLACE, "n", "k", *BITS, "prefix"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], room: int = 1 << 18) -> Iterator[tuple[np.ndarray, int | None]]:
    """Rows (key, k, size_at, bitmap), sorted by key, in chunks that end with a key, and a key that began in an earlier one.

    Only a key of more than ``room`` rows is parted.
    """
    held: list[np.ndarray] = []
    count, begun = 0, None
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        count += batch.num_rows
        if count >= room:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if cut:
                yield rows[:, :cut], begun
                begun, held, count = None, [rows[:, cut:]], rows.shape[1] - cut
            else:
                yield rows, int(rows[0, 0])
                begun, held, count = int(rows[0, 0]), [], 0
    if held:
        yield np.concatenate(held, axis=1), begun


def candidates(rows: np.ndarray, percent: int, known: int, begun: int | None = None, groups: tuple[int, int, int] = GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places that may match, places in groups that are alike all through, and places in groups too large.

    ``known`` counts the common tokens before the one at the row's place in its line.
    """
    key, k, size_at = rows[:3]
    words = rows[3:].view(np.uint64)
    bits = words[0] ^ words[1] ^ words[2] ^ words[3]
    n, at = size_at >> 32, size_at & 0xFFFFFFFF
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    most, all_of, dense = groups
    large = (sizes > most) | (False if begun is None else key[starts] == begun)

    def possible(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = n[i] + n[j]
        need = -(-both * percent // (100 + percent))
        # Of a matching pair's common tokens the first, at least, leaves room for the overlap behind both places.
        wide = np.flatnonzero((n[i] >= WIDE) & (n[j] >= WIDE))
        apart[wide] = np.maximum(apart[wide], np.bitwise_count(words[:, i[wide]] ^ words[:, j[wide]]).sum(axis=0, dtype=np.int64))
        ok = (k[i] != k[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - at[i], n[j] - at[j]) + known >= need) & (both - apart >= 2 * need)
        return i[ok], j[ok]

    pairs = [(np.zeros(0, np.int64),) * 2]
    few = (sizes > 1) & (sizes <= all_of) & ~large
    left = np.repeat(np.where(few, sizes, 0), sizes) - 1 - (np.arange(len(key)) - np.repeat(starts, sizes))
    live, step = np.flatnonzero(left > 0), 1
    while len(live):
        i, j = live, live + step
        apart = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64)
        near = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        pairs.append(possible(i[near], j[near], apart[near]))
        step += 1
        live = live[left[live] >= step]
    alike = []
    for g in np.flatnonzero((sizes > all_of) & ~large).tolist():
        a, size = int(starts[g]), int(sizes[g])
        own = []
        by_size = a + np.argsort(n[a : a + size], kind="stable")
        lengths, maps = n[by_size], bits[by_size]
        for low in range(0, size, 256):
            high = min(low + 256, size)
            # Only sizes from percent% on can match; the block's widest bound comes before each pair's own.
            last = int(np.searchsorted(lengths, lengths[high - 1] * 100 // percent, "right"))
            apart = np.bitwise_count(maps[low:high, None] ^ maps[None, low:last])
            x, y = np.nonzero(apart <= min(64, int((lengths[high - 1] + lengths[last - 1]) * (100 - percent) // (100 + percent))))
            later = y > x
            x, y = x[later], y[later]
            own.append(possible(by_size[low + x], by_size[low + y], apart[x, y].astype(np.int64)))
            if sum(len(i) for i, _ in own) > dense * size:
                alike.append(np.arange(a, a + size))
                own = []
                break
        pairs += own
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return np.stack([join([x for x, _ in pairs]), join([y for _, y in pairs])]), join(alike), np.flatnonzero(np.repeat(large, sizes))


def _paired(percent: int, known: int, groups: tuple[int, int, int]):
    """Candidate pairs (kind 0: k and other), rows of groups that are alike (1) and of groups too large (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begun in _chunks(batches):
            pairs, alike, large = candidates(rows, percent, known, begun, groups)
            ends = np.sort(rows[1][pairs], axis=0)
            ends = np.unique(ends, axis=1) if ends.shape[1] else ends
            none = np.zeros((len(BITS) + 1, ends.shape[1]), np.int64)
            kinds = np.repeat(np.array([0, 1, 2], np.int32), [ends.shape[1], len(alike), len(large)])
            more = rows[:, np.concatenate([alike, large])]
            columns = [np.concatenate(x) for x in zip((ends[1], ends[0], *none), more, strict=True)]
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, columns)], ["kind", *ROW])

    return run


def _cut(levels: bytes):
    """The token arrays of the wanted lines (parallel lists ``numbers`` and ``ks``) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels, np.uint8)
        for part, data, offsets in textnum.slices(batches, "text"):
            numbers, keys = part.column(3), part.column(4).flatten()
            per_text = np.diff(numbers.offsets.to_numpy())
            breaks = np.flatnonzero(data == 0x0A)
            # Lines of a slice are numbered through: a text's first line is one more than the breaks and texts before it.
            first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
            line = np.repeat(first[:-1], per_text) + numbers.flatten().to_numpy()
            begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
            ends = np.append(begins[1:], len(data))
            sizes = ends[line] - begins[line]
            at = np.concatenate([[0], np.cumsum(sizes)])
            wanted = data[np.repeat(begins[line] - at[:-1], sizes) + np.arange(at[-1])]
            # A line's break, which the piece may still end with, is white space to its words.
            wanted[wanted == 0x0A] = 0x20
            _, tokens, bounds = line_tokens(wanted, at, table)
            sizes, place = np.diff(bounds), slice(None)
            yield pa.RecordBatch.from_arrays([keys, _lists(tokens[place], sizes)], ["k", "tokens"])

    return run


def _meeting(rows: DataFrame, percent: int, known: int, groups: tuple[int, int, int], label: str) -> DataFrame:
    """Rows (key, k, size_at, bitmap) dealt by key and paired."""
    dealt = rows.select(*ROW).repartition("key").sortWithinPartitions("key")
    return stage_table(dealt.mapInArrow(_paired(percent, known, groups), "kind int, " + ", ".join(f"{c} long" for c in ROW)), label)


def _size_at(at: Column) -> Column:
    return F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(at.cast("long")).alias("size_at")


def matched_lines(texts: DataFrame, percent: int = 80, sizes: tuple[int, int, int] = GROUPS) -> DataFrame:
    """(doc, tie, line_no, n_tokens, later) for each line with a word; ``texts`` has doc, tie and text.

    A line's set is its distinct words, lower-cased and split at white space; lines are split at newlines and ordered by
    (doc, tie, line_no). ``later`` says that an earlier line's set has ``100 * intersection >= percent * union`` with this one.
    Lines with one set are one class, which its first line stands for. Blank lines never match.
    """
    lowered = texts.select("doc", "tie", F.lower("text").alias("text"))
    levels, hot = rarity(lowered)
    bitmap = ", ".join(f"{c} long" for c in BITS)
    keyed = stage_table(lowered.mapInArrow(_keyed(levels, hot, percent), f"doc long, tie long, line_no int, n int, k long, {bitmap}, prefix array<long>"), "lines")
    firsts = stage_table(keyed.groupBy("k").agg(F.min(F.struct(*PLACE)).alias("place")), "firsts")

    # The last token of a prefix only serves as a second one.
    own = ["k", "n", *BITS, "prefix"]
    placed = keyed.select(*own, F.posexplode(F.slice("prefix", 1, F.greatest(F.size("prefix") - 1, F.lit(0)))).alias("at", "token"))
    is_hot = F.col("token") >= _HOT
    found = _meeting(placed.where(~is_hot).select(F.col("token").alias("key"), "k", _size_at(F.col("at")), *BITS), percent, 0, sizes, "found")
    split = placed.where(is_hot).select(*own, "at", "token")
    large = found.where("kind = 2").select("k", F.col("key").alias("token"), F.col("size_at").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))
    if not large.isEmpty():
        large = stage_table(large.distinct(), "large")
        lines = keyed.where(F.size("prefix") > 0).select(*own).join(large.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
        split = split.unionByName(large.join(lines, "k").select(split.columns))
    second = split.select(*own, "token", F.explode(F.sequence(F.col("at") + 1, F.size("prefix") - 1)).alias("next"))
    second = second.select(F.xxhash64("token", F.col("prefix")[F.col("next")]).alias("key"), "k", _size_at(F.col("next")), *BITS)
    again = _meeting(second, percent, 1, sizes, "again")

    groups = found.where("kind = 1").withColumn("known", F.lit(0)).unionByName(again.where("kind > 0").withColumn("known", F.lit(1))).drop("kind").dropDuplicates(["key", "k"])
    groups = stage_table(groups.join(firsts, "k"), "groups")
    centres = groups.groupBy("key").agg(F.min(F.struct("place", "k", "size_at", *BITS)).alias("c")).select("key", F.col("c.place").alias("before"), F.col("c.k").alias("earlier"), *_other("c", "c."))
    star = groups.join(centres, "key").where((F.col("k") != F.col("earlier")) & _possible("c", percent)).select(F.col("k").alias("later"), "earlier", "before")
    pairs = stage_table(found.where("kind = 0").select("k", "key").unionByName(again.where("kind = 0").select("k", "key")).distinct(), "pairs")
    where = stage_table(pairs.select(F.explode(F.array("k", "key")).alias("k")).distinct().join(firsts, "k"), "where")
    placed = pairs.join(where.select("k", F.col("place").alias("p")), "k").join(where.select(F.col("k").alias("key"), F.col("place").alias("q")), "key")
    turned = F.col("p") < F.col("q")
    ordered = placed.select(F.when(turned, F.col("key")).otherwise(F.col("k")).alias("later"), F.when(turned, F.col("k")).otherwise(F.col("key")).alias("earlier"), F.least("p", "q").alias("before"))
    ordered = stage_table(ordered.unionByName(star), "ordered")

    # A line's earliest candidate is most often a match; only lines of which it isn't meet their other candidates.
    best = stage_table(ordered.groupBy("later").agg(F.min(F.struct("before", "earlier")).alias("c")).select("later", "c.earlier"), "best")
    done = stage_table(_matching(best, lowered, firsts, levels, percent), "done")
    left = groups.join(done, groups["k"] == done["later"], "left_anti")
    others = groups.select("key", F.col("k").alias("earlier"), F.col("place").alias("before"), *_other("o"))
    met = left.join(others, "key").where((F.col("before") < F.col("place")) & _possible("o", percent)).select(F.col("k").alias("later"), "earlier")
    rest = ordered.join(done, "later", "left_anti").select("later", "earlier").unionByName(met).distinct()
    rest = stage_table(rest.join(best, ["later", "earlier"], "left_anti"), "rest")
    if not rest.isEmpty():
        done = stage_table(done.unionByName(_matching(rest, lowered, firsts, levels, percent)).distinct(), "later")
    classes = firsts.join(done.select(F.col("later").alias("k"), F.lit(True).alias("matched")), "k", "left")
    out = keyed.select(*PLACE, "n", "k").join(classes, "k")
    return out.select(*PLACE, F.col("n").alias("n_tokens"), (F.coalesce("matched", F.lit(False)) | (F.struct(*PLACE) != F.col("place"))).alias("later"))


def _other(name: str, of: str = "") -> list[Column]:
    """size_at and the bitmap of a join's other side, under names of their own."""
    return [F.col(f"{of}{c}").alias(f"{name}_{c}") for c in ("size_at", *BITS)]


def _possible(other: str, percent: int) -> Column:
    """The filters of ``candidates`` for the rows of a join."""
    nx, ny = (F.shiftright(c, 32) for c in ("size_at", f"{other}_size_at"))
    ax, ay = (F.col(c).bitwiseAND(0xFFFFFFFF) for c in ("size_at", f"{other}_size_at"))
    need = F.ceil((nx + ny) * percent / (100 + percent))
    words = [F.col(c).bitwiseXOR(F.col(f"{other}_{c}")) for c in BITS]
    folded = words[0].bitwiseXOR(words[1]).bitwiseXOR(words[2]).bitwiseXOR(words[3])
    wide = F.when((nx >= WIDE) & (ny >= WIDE), sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))).otherwise(0)
    apart = F.greatest(F.bit_count(folded), wide)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (F.least(nx - ax, ny - ay) + F.col("known") >= need) & (nx + ny - apart >= 2 * need)


def _matching(pairs: DataFrame, lowered: DataFrame, firsts: DataFrame, levels: bytes, percent: int) -> DataFrame:
    """The later classes of pairs whose sets reach the threshold; lines are cut out of their documents again.

    The wanted lines are staged, so Spark knows their size: while it is small they go to the documents, else the texts
    of their documents are shuffled.
    """
    wanted = pairs.select(F.explode(F.array("later", "earlier")).alias("k")).distinct().join(firsts, "k").select("k", "place.*")
    numbers = stage_table(wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("line_no", "k")).alias("x")).select("doc", "tie", F.col("x.line_no").alias("numbers"), F.col("x.k").alias("ks")), "wanted")
    cut = lowered.join(numbers, ["doc", "tie"]).select("doc", "tie", "text", "numbers", "ks")
    arrays = stage_table(cut.mapInArrow(_cut(levels), "k long, tokens array<long>"), "arrays")
    side = lambda s: arrays.select(F.col("k").alias(s), F.col("tokens").alias(f"t{s}"))
    shared = F.size(F.array_intersect("tlater", "tearlier"))
    near = pairs.join(side("later"), "later").join(side("earlier"), "earlier").where(100 * shared >= percent * (F.size("tlater") + F.size("tearlier") - shared))
    return near.select("later").distinct()


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed_lines (numbers from 0 of the lines to remove, in order).

    Null and empty texts are one blank line, which stays. Documents are ordered by doc_id, those without one last; where an id
    repeats or lacks, a hash of the text decides, and rows that repeat an id and a text count as one document, with the
    same result each. Other columns are ignored; an empty table gives an empty one.
    """
    out = _removed(docs, percent)
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def _removed(docs: DataFrame, percent: int) -> DataFrame:
    texts, once = _texts(docs)
    gone = matched_lines(once, percent).where("later").groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    return texts.join(gone, ["doc", "tie"], "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))


def without_repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, text): the texts without the lines that match an earlier one."""
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed_lines", i))
    return _removed(docs, percent).select("doc_id", F.array_join(lines, "\n").alias("text"))
