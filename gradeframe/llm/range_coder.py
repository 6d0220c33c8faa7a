"""Adaptive range coding of ids in independent blocks, many blocks side by side.

A block starts with empty tables, so it can be decoded alone. All blocks of a segment advance
together, one id each per step, as lanes of numpy arrays; encoder and decoder share the model.

The probability of the next id is a mixture of three predictions:

* order 2: the id last seen after the same two ids (by hash),
* order 1: the id last seen after the same id (by hash),
* order 0: the id frequencies of the segment, stored with it.

The weights of the first two are learned in the block, apart for each pair of their confidences,
and what is left belongs to order 0. If both predict the same id, their weights add.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BLOCK_IDS = 2048
SLOT_BITS = 9
SLOTS = 1 << SLOT_BITS  # entries of a block's table of each order
UNIT = 16  # bits of the mixture's probabilities
ONE = 1 << UNIT
STEP = 4  # a weight moves by 1/16 of its distance
GAIN = 4000  # a little under ONE / 16, so that order 0 always keeps some weight
TOP = np.uint64(1 << 32)  # a range never stays below this
ID_MASK = np.uint32((1 << 24) - 1)
SURE = np.uint32(1 << 24)  # one level of confidence; an entry holds an id and 0 to 3 levels
SUREST = np.uint32(3 << 24)
_32, _WORD = np.uint64(32), np.uint64(0xFFFFFFFF)
_SLOT, _LEVEL, _HALF = np.uint32(32 - SLOT_BITS), np.uint32(24), np.uint32(16)
_LOW_HALF, _TWICE = np.uint32(0xFFFF), np.uint32(2 << 24)
_STEPS = np.uint32((0xFFFF >> STEP) * 0x10001)  # what a shift by STEP leaves of each half


@dataclass
class Segment:
    """Coded ids: the order-0 table, and per block its number of ids, crc32 and words."""

    ids: np.ndarray  # uint32, distinct, most frequent first
    freqs: np.ndarray  # uint32, their sum is 1 << bits
    bits: int
    n_ids: int
    checksums: np.ndarray  # uint32 per block
    n_words: np.ndarray  # uint32 per block
    words: np.ndarray  # uint32


def block_sizes(n_ids: int) -> np.ndarray:
    """Even blocks of at most ``BLOCK_IDS``; larger ones come first and differ by one id."""
    n = -(-n_ids // BLOCK_IDS)
    return np.full(n, n_ids // max(n, 1), np.int64) + (np.arange(n) < n_ids % max(n, 1))


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that add up to a power of two, near the counts (largest first)."""
    bits = max(16, int(len(counts)).bit_length() + 2)
    total = 1 << bits
    freqs = np.maximum(1, counts * (total - len(counts)) // counts.sum()).astype(np.int64)
    freqs[0] += total - freqs.sum()
    return freqs.astype(np.uint32), bits


class Model:
    """The predictions and weights of all lanes. Ids are ranks in the order-0 table.

    Arrays of a step have one type each, as numpy converts mixed ones in small pieces.
    """

    def __init__(self, lanes: int):
        base = np.arange(lanes, dtype=np.uint32)
        self.base, self.base16 = base * np.uint32(SLOTS), base * np.uint32(16)
        self.tables = [np.full(lanes * SLOTS, ID_MASK) for _ in range(2)]  # no id is as large as that
        two, one = self._start_weights()
        self.weights = np.tile(two << _HALF | one, lanes)  # of order 2 above that of order 1
        self.last = [np.zeros(lanes, np.uint32) for _ in range(2)]
        self.predict(lanes)

    @staticmethod
    def _start_weights() -> list[np.ndarray]:
        two, one = np.divmod(np.arange(16, dtype=np.uint32), np.uint32(4))
        return [np.uint32(6000) * two, np.uint32(3000) * one]

    def predict(self, n: int) -> None:
        """Predictions of the first ``n`` lanes, and the ends of their shares of the unit."""
        a, b = self.last[0][:n], self.last[1][:n]
        self.at1 = (((a * np.uint32(2654435761)) >> _SLOT) + self.base[:n]).astype(np.int64)
        self.at2 = (((a * np.uint32(2246822519) + b * np.uint32(3266489917)) >> _SLOT) + self.base[:n]).astype(np.int64)
        self.entry2, self.entry1 = self.tables[1].take(self.at2), self.tables[0].take(self.at1)
        self.id2, self.id1 = self.entry2 & ID_MASK, self.entry1 & ID_MASK
        level = (self.entry2 >> _LEVEL << np.uint32(2)) | (self.entry1 >> _LEVEL)
        self.at_w = (level + self.base16[:n]).astype(np.int64)
        self.weight = self.weights.take(self.at_w)
        two = self.weight >> _HALF
        end1 = two + (self.weight & _LOW_HALF)
        # Both weights go to one id if both orders predict it.
        self.end2 = np.where(self.id2 == self.id1, end1, two).astype(np.uint64)
        self.end1 = end1.astype(np.uint64)

    def narrow(self, low: np.ndarray, width: np.ndarray, ends: tuple[np.ndarray, np.ndarray, np.ndarray], hit2: np.ndarray, hit1: np.ndarray) -> np.ndarray:
        """Cut the ranges of the lanes to the share of the prediction that came true; the lanes where none did.

        ``ends`` are the ends of the shares of order 2, order 1 and order 0 as parts of the ranges.
        """
        end2, end1, end0 = ends
        hit = np.flatnonzero(hit2 | hit1)
        two, first, second, before = hit2.take(hit), end2.take(hit), end1.take(hit), low.take(hit)
        np.add(low, end1, out=low)
        np.subtract(end0, end1, out=width)
        low[hit] = np.where(two, before, before + first)
        width[hit] = np.where(two, first, second - first)
        return np.flatnonzero(~(hit2 | hit1))

    def ends(self, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the shares of order 2, order 1 and order 0 as parts of these ranges."""
        unit = width >> np.uint64(UNIT)
        return unit * self.end2, unit * self.end1, unit << np.uint64(UNIT)

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        n = len(ids)
        weight = self.weight - ((self.weight >> np.uint32(STEP)) & _STEPS)
        for hit, gain in ((hit2, GAIN << 16), (hit1, GAIN)):
            weight += hit.astype(np.uint32) * np.uint32(gain)
        self.weights[self.at_w] = weight
        fresh = ids | SURE
        for table, at, entry, same in (
            (self.tables[1], self.at2, self.entry2, hit2),
            (self.tables[0], self.at1, self.entry1, ids == self.id1),
        ):
            after = np.where(entry >= _TWICE, entry - SURE, fresh)
            sure = np.flatnonzero(same)
            known = entry.take(sure)
            after[sure] = np.minimum(known + SURE, known | SUREST)
            table[at] = after
        self.last[1][:n] = self.last[0][:n]
        self.last[0][:n] = ids


def _renewal(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes that move on by a word, and their words: those whose ranges have become smaller than a word.

    Where the ends of such a range differ in the first word, it is cut there.
    """
    go = np.flatnonzero(width < TOP)
    start, size = low.take(go), width.take(go)
    differ = (start ^ (start + size)) >= TOP
    if differ.any():
        size[differ] = (~start[differ] + np.uint64(1)) & (TOP - np.uint64(1))
    low[go] = start << _32
    width[go] = size << _32
    return go, start >> _32


def encode(ids: np.ndarray) -> Segment:
    """Code a non-empty array of ids."""
    largest = int(ids.max())
    if largest < 1 << 22:
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        counts = counts[distinct]
        where = None
    else:
        distinct, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    freqs, bits = quantised(counts[order])
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    if where is None:
        by_id = np.zeros(largest + 1, np.uint32)
        by_id[distinct] = rank
        ranks = by_id[ids]
    else:
        ranks = rank[where]
    cum = np.concatenate([[0], np.cumsum(freqs, dtype=np.uint64)]).astype(np.uint64)
    shares = cum[:-1] << _32 | freqs  # start and size of each id's share in order 0

    sizes = block_sizes(len(ids))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    lanes, steps = len(sizes), int(sizes[0])
    grid = np.zeros((lanes, steps), np.uint32)
    grid[np.arange(steps) < sizes[:, None]] = ranks
    grid = np.ascontiguousarray(grid.T)

    room = steps + 2
    out = np.zeros(lanes * room, np.uint32)
    at = np.arange(lanes, dtype=np.int64) * room
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    model = Model(lanes)
    for step in range(steps):
        n = lanes if step < sizes[-1] else int((sizes > step).sum())
        x = grid[step, :n]
        if step:
            model.predict(n)
        hit2 = x == model.id2
        hit1 = (x == model.id1) & ~hit2
        rest = model.narrow(low[:n], width[:n], model.ends(width[:n]), hit2, hit1)
        share = shares.take(x.take(rest))
        unit = width.take(rest) >> np.uint64(bits)
        low[rest] = low.take(rest) + unit * (share >> _32)
        width[rest] = unit * (share & _WORD)
        go, word = _renewal(low[:n], width[:n])
        ended = at.take(go)
        out[ended] = word
        at[go] = ended + 1
        model.learn(x, hit2, hit1)
    out[at], out[at + 1] = low >> _32, low & np.uint64(0xFFFFFFFF)
    n_words = at + 2 - np.arange(lanes) * room
    words = out.reshape(lanes, room)[np.arange(room) < n_words[:, None]]
    raw = memoryview(ids.astype("<u4").tobytes())
    sums = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)], np.uint32)
    return Segment(distinct[order].astype(np.uint32), freqs, bits, len(ids), sums, n_words.astype(np.uint32), words)


def decode(segment: Segment) -> np.ndarray:
    """The ids of a segment. Raises ValueError if a block does not match its checksum."""
    sizes = block_sizes(segment.n_ids)
    lanes, steps, bits = len(sizes), int(sizes[0]), np.uint64(segment.bits)
    cum = np.concatenate([[0], np.cumsum(segment.freqs, dtype=np.uint64)]).astype(np.uint64)
    shares = cum[:-1] << _32 | segment.freqs
    slot = np.repeat(np.arange(len(segment.freqs), dtype=np.uint32), segment.freqs)
    last_slot = np.uint64(len(slot) - 1)
    words = segment.words.astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(segment.n_words[:-1], dtype=np.int64)]).astype(np.int64)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    code = (words[at] << _32) | words[at + 1]
    at += 2
    grid = np.empty((steps, lanes), np.uint32)
    model = Model(lanes)

    for step in range(steps):
        n = lanes if step < sizes[-1] else int((sizes > step).sum())
        if step:
            model.predict(n)
        ends, place = model.ends(width[:n]), code[:n] - low[:n]
        hit2 = place < ends[0]
        hit1 = ~hit2 & (place < ends[1])
        x = np.where(hit2, model.id2, model.id1)
        rest = model.narrow(low[:n], width[:n], ends, hit2, hit1)
        unit = width.take(rest) >> bits
        low_rest = low.take(rest)
        named = slot.take(np.minimum((code.take(rest) - low_rest) // unit, last_slot).astype(np.int64))
        x[rest] = named
        share = shares.take(named)
        low[rest] = low_rest + unit * (share >> _32)
        width[rest] = unit * (share & _WORD)
        go, _ = _renewal(low[:n], width[:n])
        read = at.take(go)
        code[go] = (code.take(go) << _32) | words.take(read, mode="clip")
        at[go] = read + 1
        model.learn(x, hit2, hit1)
        grid[step, :n] = x
    ids = segment.ids[grid.T[np.arange(steps) < sizes[:, None]]]
    raw = ids.astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for n, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        if zlib.crc32(raw[4 * a : 4 * b]) != segment.checksums[n]:
            raise ValueError(f"block {n} does not match its checksum")
    return ids
