"""One-permutation MinHash fingerprints of few bits, with optimal densification."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.bpe import Remembered
from gradeframe.llm.shared import id_and_text, record_batch, text_slices, texts_of, worker_table
from gradeframe.session import materialise

WORDS = 5  # of a shingle
BINS = 512
BITS = 4  # kept of each bin
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(Remembered):
    """64-bit hash of each word, in a table of bounded size."""

    def __init__(self, limit: int = 150_000):
        super().__init__(xxhash.xxh3_64_intdigest, limit)


@worker_table(maxsize=1)
def word_hashes() -> WordHashes:
    """The table of a Python worker; one for all its tasks."""
    return WordHashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts in order, and how many each text has.

    Words are what blanks separate, in lower case. A text of one to four words is one shingle; a text
    of none has none.
    """
    table, hashes, counts = word_hashes(), [], []
    for text in texts:
        words = text.lower().split()
        counts.append(max(1, len(words) - WORDS + 1) if words else 0)
        if 0 < len(words) < WORDS:
            words += [""] * (WORDS - len(words))
        hashes.append(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)))
    table.turn()
    counts = np.array(counts, np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = len(flat) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64), counts
    rolled = flat[:n] * _ODD[0]
    for j in range(1, WORDS):
        rolled += flat[j : j + n] * _ODD[j]
    # The last four places of a text would run into the next one.
    inside = np.ones(len(flat), bool)
    ends = np.cumsum(np.where(counts > 0, counts + WORDS - 1, 0))
    for j in range(1, WORDS):
        inside[ends[counts > 0] - j] = False
    return mixed(rolled[inside[:n]]), counts


@functools.lru_cache(maxsize=None)
def _donor(attempt: int, bins: int) -> np.ndarray:
    """The bin that each empty bin looks at in this attempt."""
    return (mixed(np.arange(bins, dtype=np.uint64) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)


def fingerprints(texts: list[str], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints, one row of ``bins * BITS / 8`` bytes per text, and which texts have shingles.

    Each shingle is hashed once: its upper bits say the bin, the rest the value, and a bin keeps its
    smallest value. An empty bin takes the value of the first filled bin in a fixed random order of its
    own, so texts that share filled bins share what they lend. ``BITS`` bits of each value's hash stay.
    """
    hashes, counts = shingles(texts)
    shift = np.uint64(64 - (bins - 1).bit_length())
    row = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    table = np.full(len(texts) * bins, _EMPTY)
    np.minimum.at(table, row * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    has = counts > 0
    filled = table != _EMPTY
    empty = np.flatnonzero(~filled & np.repeat(has, bins))
    attempt = 1
    while len(empty):
        source = empty - empty % bins + _donor(attempt, bins)[empty % bins] if attempt < 4 * bins else _next_filled(filled, empty, bins)
        found = filled[source]
        table[empty[found]] = table[source[found]]
        empty = empty[~found]
        attempt += 1
    # Hashed with the number of the bin, as bins that took the same value must not agree by one chance.
    table = mixed(table.reshape(len(texts), -1) + np.arange(bins, dtype=np.uint64) * _ODD[1])
    low = (table & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[~has] = 0
    return low[:, ::2] << 4 | low[:, 1::2], has


def _next_filled(filled: np.ndarray, empty: np.ndarray, bins: int) -> np.ndarray:
    """For the very few bins that no attempt served: the next filled bin of the text, in a circle."""
    out = empty.copy()
    left = np.arange(len(empty))
    while len(left):
        out[left] = out[left] - out[left] % bins + (out[left] % bins + 1) % bins
        left = left[~filled[out[left]]]
    return out


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingles of texts, row by row.

    Unlike values still agree in their low bits once in 2**BITS; that share is taken off. A text
    without shingles is like another such text (1) and unlike all others (0).
    """
    x = a ^ b
    agree = ((x & 0x0F) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
    chance = 1 / (1 << BITS)
    estimate = np.clip((agree / (2 * x.shape[1]) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(has_a & has_b, estimate, (has_a == has_b).astype(float))


def shown(prints: np.ndarray, has: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text; empty for texts without shingles."""
    return [p.hex() for p in packed(prints, has)]


def packed(prints: np.ndarray, has: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes; none for texts without shingles."""
    return [p.tobytes() if h else b"" for p, h in zip(prints, has, strict=True)]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the next one, as long if that has so many letters."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROWS = pa.schema([
    ("part", pa.int64()), ("role", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
])
_DDL = "part long, role string, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _results(part: int, ids: list[int | None], texts: list[str], following: list[str], prints: tuple, next_prints: tuple) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, has = prints
    theirs, they_have = fingerprints(changed)
    n = len(ids)
    return record_batch(
        _ROWS, part=[part] * n, role=["done"] * n, doc_id=ids, n_chars=[len(t) for t in texts],
        edited_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in changed],
        fingerprint=packed(own, has), edited_fingerprint=packed(theirs, they_have),
        near_edited=likeness(own, has, theirs, they_have), near_next=likeness(own, has, *next_prints), text=[None] * n,
    )


def _edge(part: int, role: str, doc_id: int | None, text: str) -> pa.RecordBatch:
    empty = dict.fromkeys(RESULT, [None])
    return record_batch(_ROWS, **(empty | {"part": [part], "role": [role], "doc_id": [doc_id], "text": [text]}))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how near they and the next one are.

    The next document is the one with the next higher id; the last one's is the first. Rows with the
    same id follow each other by text, null ids come first, a null text is empty. Documents are dealt
    to ranges of ids and each task walks through a sorted range with one document of look-ahead. Only
    the first and the last document of a range are needed by another task, and are joined afterwards.
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for rows in text_slices(batches):
            ids, texts = rows.column("doc_id").to_pylist(), texts_of(rows)
            prints, has = fingerprints(texts)
            if held is None:
                yield _edge(part, "first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
                prints, has = np.vstack([held[2], prints]), np.concatenate([held[3], has])
            if len(ids) > 1:
                yield _results(part, ids[:-1], texts[:-1], texts[1:], (prints[:-1], has[:-1]), (prints[1:], has[1:]))
            held = (ids[-1], texts[-1], prints[-1:], has[-1:])
        if held is not None:
            yield _edge(part, "last", held[0], held[1])

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            texts, following = texts_of(rows), texts_of(rows, "following")
            yield _results(0, rows.column("doc_id").to_pylist(), texts, following, fingerprints(texts), fingerprints(following))

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = materialise(ordered.mapInArrow(walk, _DDL), "fingerprints")
    # One row per range: the order of the ranges is as small as their list.
    ranges = rows.filter(F.col("role") == "first").select("part")
    all_ranges = Window.orderBy("part")
    after = ranges.select("part", F.coalesce(F.lead("part").over(all_ranges), F.min("part").over(Window.partitionBy())).alias("next_part"))
    first = rows.filter(F.col("role") == "first").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    last = rows.filter(F.col("role") == "last").select("part", "doc_id", "text")
    closed = last.join(after, "part").join(first, "next_part").select("doc_id", "text", "following").mapInArrow(close, _DDL)
    both = rows.filter(F.col("role") == "done").select(RESULT).unionByName(closed.select(RESULT))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
