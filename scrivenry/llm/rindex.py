"""A run-length index: the run-compressed Burrows-Wheeler transform of many texts, with suffixes sampled at the ends of runs.

Matching statistics of other texts are streamed through it from right to left, all texts in step; where the next byte isn't that of
the run, the nearest runs of that byte are tried and their sampled suffixes tell how much of the match holds.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one with a 0 after each text, and where the texts start; UTF-8 has no byte 255."""
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(sizes))
    out = np.zeros(len(data) + len(sizes), np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data + np.uint8(1)
    return out, starts


#: Suffixes that tie are sorted in blocks of whole groups of about so many.
_BLOCK = 1 << 18


def _first_bytes(n: int) -> int:
    """How many bytes of a suffix fit beside its place, one of ``n``, in 64 bits."""
    return (64 - n.bit_length()) // 8


def _sorted_first(codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes by their first bytes up to their text's end, then by place, and which differ from the one before."""
    n = len(codes)
    bits, width = n.bit_length(), _first_bytes(n)
    blocks = np.ndarray(n, ">u8", np.concatenate([codes, np.zeros(8, np.uint8)]), strides=(1,)).astype(U64)
    short = np.flatnonzero(room < width)
    blocks[short] &= ~U64(0) << (U64(64) - U64(8) * room[short].astype(U64))
    # A value with its place in the low bits sorts several times as fast as an array of places by values.
    blocks &= ~U64(0) << U64(64 - 8 * width)
    blocks |= np.arange(n, dtype=U64)
    blocks.sort()
    order = (blocks & U64((1 << bits) - 1)).astype(np.int32)
    blocks >>= U64(64 - 8 * width)
    fresh = np.ones(n, bool)
    np.not_equal(blocks[1:], blocks[:-1], out=fresh[1:])
    return order, fresh


def _sorted_in_groups(heads: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by value inside of each group (``heads`` marks where one begins), and which differ from the one before.

    Values go up to ``most``. Group, value and place share 64 bits, so blocks of whole groups are sorted, or one larger group.
    """
    n = len(values)
    starts = np.append(np.flatnonzero(heads), n)
    move, new = np.empty(n, np.int64), np.empty(n, bool)
    width = most.bit_length()
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK, "right")) - 1)
        low, high = int(starts[at]), int(starts[to])
        bits = (high - low).bit_length()
        packed = np.cumsum(heads[low:high], dtype=U64)
        packed -= U64(1)
        packed <<= U64(width)
        packed |= values[low:high].astype(U64)
        packed <<= U64(bits)
        packed |= np.arange(high - low, dtype=U64)
        packed.sort()
        move[low:high] = (packed & U64((1 << bits) - 1)).astype(np.int64)
        move[low:high] += low
        packed >>= U64(bits)
        new[low] = True
        np.not_equal(packed[1:], packed[:-1], out=new[low + 1 : high])
        at = to
    return move, new


def suffix_order(codes: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order (ends of texts by their number), and ranks that are equal where the first ``depth`` bytes are.

    ``room`` tells how many bytes a suffix has before its text ends. ``depth`` is :func:`_first_bytes` times a power of two. Prefixes
    double: what ties after h bytes is sorted by the rank of what follows them.
    """
    n = len(codes)
    h = _first_bytes(n)
    order, fresh = _sorted_first(codes, room)
    places = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, places, 0))
    kept = rank.copy() if depth == h else None
    last = np.ones(n, bool)
    while True:
        last[:-1] = fresh[1:]
        ties = np.flatnonzero(~(fresh & last))
        own = order[ties]
        heads = fresh[ties]
        more = room[own] > h
        if not more.any():
            # Equal up to their texts' ends: by place.
            order[ties] = own[_sorted_in_groups(heads, own, n)[0]]
            return order, kept if kept is not None else rank
        follow = np.where(more, rank[np.minimum(own + np.int32(h), n - 1)] + np.int32(1), 0)
        move, new = _sorted_in_groups(heads, follow, n)
        own = own[move]
        order[ties] = own
        fresh[ties] = new
        rank[own] = ties[np.maximum.accumulate(np.where(new, places[: len(ties)], 0))]
        h *= 2
        if h == depth:
            kept = rank.copy()


class RunLengthIndex:
    """The index of texts (bytes with offsets), each with an owner; ``depth`` bytes are what a long match has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, owners: np.ndarray, depth: int):
        codes, starts = _coded(data, offsets)
        n, sizes = len(codes), np.diff(offsets)
        room = (np.repeat(starts + sizes, sizes + 1) - np.arange(n)).astype(np.int32)
        half = _first_bytes(n)
        while half * 2 <= depth:
            half *= 2
        order, rank = suffix_order(codes, room, half)
        before = codes[order - 1]
        fresh = np.ones(n, bool)
        fresh[1:] = before[1:] != before[:-1]
        self.size = n
        #: Eight bytes from each place on, the first one lowest.
        self.blocks = np.ndarray(n, "<u8", np.concatenate([codes, np.zeros(8, np.uint8)]), strides=(1,))
        #: Of each run: where it starts, its byte, the suffixes at both ends, and where its first position leads.
        self.starts = np.flatnonzero(fresh)
        self.heads = before[self.starts]
        self.lengths = np.diff(np.append(self.starts, n))
        self.first, self.last = order[self.starts].astype(np.int64), order[self.starts + self.lengths - 1].astype(np.int64)
        by_byte = np.argsort(self.heads, kind="stable")
        done = np.cumsum(self.lengths[by_byte]) - self.lengths[by_byte]
        self.leads = np.empty(len(by_byte), np.int64)
        self.leads[by_byte] = done
        self.by_byte = by_byte
        #: The run of each position, while texts stream, and how far its positions move.
        self.run_of = np.repeat(np.arange(len(self.starts), dtype=np.int32), self.lengths)
        self.shifts = self.leads - self.starts
        self.byte_keys = self.heads[by_byte].astype(np.int64) * len(by_byte) + by_byte
        #: Ranges of suffixes that agree in ``depth`` bytes, and the least owner in each.
        deep = room[order] >= depth
        head, rest = rank[order], rank[np.minimum(order + np.int32(depth - half), n - 1)]
        apart = np.ones(n, bool)
        apart[1:] = ~(deep[1:] & deep[:-1]) | (head[1:] != head[:-1]) | (rest[1:] != rest[:-1])
        self.group_of = np.cumsum(apart, dtype=np.int32) - np.int32(1)
        self.least = np.minimum.reduceat(np.repeat(owners, sizes + 1)[order], np.flatnonzero(apart)) if n else owners
        self.depth = depth

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from a and from b on agree, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            # Behind the last text come zeros, which no byte of a match is.
            x, y = self.blocks[a[live] + out[live]], self.blocks[b[live] + out[live]]
            apart = x ^ y
            same = np.bitwise_count((apart & (~apart + U64(1))) - U64(1)).astype(np.int64) >> 3
            out[live] = np.minimum(out[live] + same, most[live])
            live = live[(same == 8) & (out[live] < most[live])]
        return out

    def _step(self, byte: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One byte further to the left: position in the transform, in the texts, and length of the match."""
        run = self.run_of[at]
        off = np.flatnonzero(self.heads[run] != byte)
        if len(off):
            at, place, size = at.copy(), place.copy(), size.copy()
            key = byte[off].astype(np.int64) * len(self.by_byte) + run[off]
            up = np.searchsorted(self.byte_keys, key)
            below, above = up - 1, np.minimum(up, len(self.byte_keys) - 1)
            other = [self.by_byte[np.maximum(below, 0)], self.by_byte[above]]
            is_there = [(below >= 0) & (self.heads[other[0]] == byte[off]), (up < len(self.byte_keys)) & (self.heads[other[1]] == byte[off])]
            suffix = [self.last[other[0]], self.first[other[1]]]
            long = [np.where(there, self._agree(place[off], s, np.where(there, size[off], 0)), -1) for s, there in zip(suffix, is_there, strict=True)]
            down = long[0] >= long[1]
            run[off] = np.where(down, *other)
            place[off] = np.where(down, *suffix)
            at[off] = np.where(down, self.starts[other[0]] + self.lengths[other[0]] - 1, self.starts[other[1]])
            size[off] = np.maximum(*long)
        lost = size < 0 if len(off) else None
        at, place, size = self.shifts[run] + at, place - 1, size + 1
        if lost is not None:
            at[lost], place[lost], size[lost] = 0, self.first[0], 0
        return at, place, size

    def statistics(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the texts: the longest match that starts there, and a place in the transform that has it."""
        sizes = np.diff(offsets)
        lengths, places = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        if not self.size:
            return lengths, places
        order = np.argsort(-sizes, kind="stable")
        ends, sorted_sizes = offsets[1:][order], -sizes[order]
        at, place, size = (np.full(len(order), x, np.int64) for x in (0, self.first[0], 0))
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(sorted_sizes, -step, "right"))
            where = ends[:live] - step
            at, place, size = self._step(data[where] + np.uint8(1), at[:live], place[:live], size[:live])
            lengths[where], places[where] = size, at
        return lengths, places

    def earliest(self, lengths: np.ndarray, places: np.ndarray, none: int) -> np.ndarray:
        """The least owner of the ``depth`` bytes at each position, ``none`` where they don't occur."""
        out = np.full(len(lengths), none, np.int64)
        has = lengths >= self.depth
        out[has] = self.least[self.group_of[places[has]]]
        return out
