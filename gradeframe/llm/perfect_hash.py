"""A minimal perfect hash of 64-bit keys: levels of bit arrays in which each key finds a place of its own."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

ROOM = 2  # places per key in a level; about 6 of 10 keys find one of their own in each


def mix(keys: np.ndarray, level: int = 0) -> np.ndarray:
    """Well-mixed 64-bit values (splitmix64), others on each level; different keys stay different."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Index of each key among ``len(keys)``, without gaps.

    A key's place on a level is its mixed value modulo the level's size. Places that exactly one key
    has are marked; the other keys go on to the next level. The index is the number of marks before
    the key's own over all levels.
    """

    sizes: list[int]
    words: np.ndarray  # marks of all levels, each from a new 64-bit word on

    def __post_init__(self) -> None:
        self.starts = np.cumsum([0, *(-(-s // 64) for s in self.sizes)]).tolist()
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys; an empty array has no level."""
        sizes, words, level = [], [np.zeros(0, np.uint64)], 0
        while len(keys):
            size = max(64, ROOM * len(keys))
            place = (mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            padded = np.zeros(-(-size // 64) * 64, bool)
            padded[:size] = alone
            words.append(np.packbits(padded, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys, level = keys[~alone[place]], level + 1
        return cls(sizes, np.concatenate(words))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or that of another key for one that was not built in, so keys must be verified."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = mix(keys[rest], level) % np.uint64(size)
            at = self.starts[level] + (place >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (place & np.uint64(63))
            here = (self.words[at] & bit) != 0
            below = np.bitwise_count(self.words[at] & (bit - np.uint64(1)))
            out[rest[here]] = (self.before[at] + below)[here]
            rest = rest[~here]
            if not len(rest):
                break
        return out


def dump(hashed: PerfectHash, **columns: np.ndarray) -> bytes:
    """The hash and columns in index order as bytes."""
    out = io.BytesIO()
    np.savez(out, sizes=np.array(hashed.sizes, np.int64), words=hashed.words, **columns)
    return out.getvalue()


def load(data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    """The hash and the columns of ``dump``."""
    with np.load(io.BytesIO(data)) as found:
        columns = {name: found[name] for name in found.files}
    return PerfectHash(columns.pop("sizes").tolist(), columns.pop("words")), columns
