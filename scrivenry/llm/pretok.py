"""Vectorised pre-tokens of a byte-level BPE and a two-tier lookup of their encodings.

The pre-token limits of a whole batch are computed on code points with numpy, by the published pattern of the
tokenizer; each pre-token is looked up by two independent 64-bit fingerprints of its bytes. Unknown ones are encoded by the
library itself, once per worker, as a pre-token's encoding does not depend on its surroundings.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from . import textnum

OTHER, LETTER, NUMBER, BLANK, UNASSIGNED = range(5)
#: Code points that the pattern's white-space class holds.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the pattern splits off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Most pre-tokens in a worker's cache before it starts again.
CACHE = 1_000_000


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNASSIGNED if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[BLANKS] = BLANK
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, the offsets among them, and each one's byte place (None where all are ASCII)."""
    if not len(data) or data.max() < 0x80:
        return data, offsets, None
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.searchsorted(at, offsets), at


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens; none crosses an offset."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    # The last blank of a run before something else: a space joins what follows, another blank stands alone.
    ends_run = blank & np.append(change[1:], True)
    before_more = ends_run & ~first[1:]
    start = change
    start[before_more] = True
    joins = before_more & (points == 0x20)
    start[1:] &= ~joins[:-1]
    # An apostrophe that begins a pre-token splits off its ending, also when more letters follow.
    quotes = np.flatnonzero(start & (points == 0x27))
    if len(quotes):
        limit = offsets[np.searchsorted(offsets, quotes, "right")]
        taken = np.zeros(len(quotes), np.int64)
        padded = np.append(points, [0, 0])
        for e in ENDINGS:
            hit = (taken == 0) & (quotes + len(e) < limit)
            for i, c in enumerate(e):
                hit &= padded[quotes + 1 + i] == ord(c)
            taken[hit] = len(e)
        quotes, taken = quotes[taken > 0], taken[taken > 0]
        for i in (1, 2):
            start[quotes[taken >= i] + i] = False
        after = quotes + 1 + taken
        start[after[(after < n)]] |= True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens in bytes, each text's bounds among them, and texts with unassigned code points."""
    points, bounds, at = code_points(data, offsets)
    starts, ends = pre_tokens(points, bounds)
    odd = np.zeros(len(offsets) - 1, bool)
    within = np.searchsorted(starts, bounds)
    if at is not None:
        odd[np.searchsorted(bounds, np.flatnonzero(classes()[points] == UNASSIGNED), "right") - 1] = True
        starts, ends = at[starts], at[ends]
    return starts, ends, within, odd


class Table:
    """128-bit fingerprint to a number from 0 on: an open-addressing hash table in three numpy arrays."""

    def __init__(self, bits: int = 12):
        self.codes, self.checks = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.count = 0

    def find(self, codes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each fingerprint, -1 where it's unknown."""
        out = np.full(len(codes), -1, np.int32)
        mask = np.uint64(len(self.values) - 1)
        live, slots = np.arange(len(codes)), (codes & mask).astype(np.int64)
        while len(live):
            found = self.values[slots]
            hit = (self.codes[slots] == codes[live]) & (self.checks[slots] == checks[live]) & (found >= 0)
            out[live[hit]] = found[hit]
            more = ~hit & (found >= 0)
            live, slots = live[more], (slots[more] + 1) & int(mask)
        return out

    def put(self, codes: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        """Add distinct fingerprints that the table lacks; it stays half empty."""
        if 2 * (self.count + len(codes)) > len(self.values):
            old = np.flatnonzero(self.values >= 0)
            kept = self.codes[old], self.checks[old], self.values[old]
            self.__init__((2 * (self.count + len(codes)) - 1).bit_length())
            self.put(*kept)
        self.count += len(codes)
        mask = len(self.values) - 1
        live, slots = np.arange(len(codes)), (codes & np.uint64(mask)).astype(np.int64)
        while len(live):
            free = np.flatnonzero(self.values[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            own = live[free[first]]
            self.codes[taken], self.checks[taken], self.values[taken] = codes[own], checks[own], values[own]
            left = np.ones(len(live), bool)
            left[free[first]] = False
            live, slots = live[left], (slots[left] + 1) & mask


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each pre-token."""
    return textnum.slice_hashes(data, starts, ends), textnum.slice_hashes(data, starts, ends, 1)


class Encoder:
    """Encodings of pre-tokens: what ``first`` (a table of numbers of tokens) knows, then this worker's cache.

    The cache keeps the number of tokens of each pre-token or, with ``ids``, the ids themselves; the library fills it. When
    it holds ``cache`` pre-tokens it starts again, so its size is bounded for any number of texts.
    """

    def __init__(self, path: str, first: Table | None = None, ids: bool = False, cache: int = CACHE):
        # Spark runs a worker for each core; threads within the library would only get in their way.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.first, self.with_ids, self.cache = first or Table(1), ids, cache
        self.reset()

    def reset(self) -> None:
        self.table = Table()
        self.used = 0
        self.lengths, self.begins, self.ids = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text, taken a few thousand at a time."""
        out = []
        for at in range(0, len(texts), 4096):
            out += [x.ids for x in self.library.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, checks: np.ndarray) -> None:
        raw = data.tobytes()
        found = self.encoded([raw[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        if not self.with_ids:
            self.table.put(codes, checks, lengths)
            return
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))
        n, at = self.table.count, self.used
        self.lengths, self.begins, self.ids = _room(self.lengths, n + len(found)), _room(self.begins, n + len(found)), _room(self.ids, at + len(flat))
        self.lengths[n : n + len(found)] = lengths
        self.begins[n : n + len(found)] = at + np.cumsum(lengths) - lengths
        self.ids[at : at + len(flat)] = flat
        self.used += len(flat)
        self.table.put(codes, checks, np.arange(n, n + len(found), dtype=np.int32))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each pre-token's number of tokens or, with ``ids``, its entry; what no table knows is encoded first."""
        if self.table.count > self.cache:
            self.reset()
        codes, checks = fingerprints(data, starts, ends)
        out = self.first.find(codes, checks)
        miss = np.flatnonzero(out < 0)
        out[miss] = self.table.find(codes[miss], checks[miss])
        miss = miss[out[miss] < 0]
        if len(miss):
            pairs = np.stack([codes[miss], checks[miss]], axis=1)
            _, at = np.unique(pairs.view("V16").ravel(), return_index=True)
            own = miss[at]
            self._learn(data, starts[own], ends[own], codes[own], checks[own])
            out[miss] = self.table.find(codes[miss], checks[miss])
        return out

    def whole(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> dict[int, list[int]]:
        """Ids of texts that the library must encode whole: they hold an added token, or ``odd`` marks them."""
        raw, odd = data.tobytes(), odd.copy()
        for name in self.specials:
            at = raw.find(name)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(name, at + 1)
        which = np.flatnonzero(odd).tolist()
        return dict(zip(which, self.encoded([raw[offsets[i] : offsets[i + 1]].decode("utf-8") for i in which]), strict=True))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])
