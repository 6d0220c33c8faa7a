"""Benchmark passages in training text: an FM-index per shard, searched for all windows of the benchmark."""

from __future__ import annotations

import io
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.fm_index import FmIndex
from gradeframe.llm.shared import create_file, id_and_text, lean, open_file, text_slices, texts_of, worker_table
from gradeframe.session import work_dir

WINDOW = 10
# Benchmark words that a task holds at once; a larger benchmark is searched block by block.
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 16 << 20  # text of an index; a task's rows are cut into shards of this size
ROWS_AT_ONCE = 1 << 20  # occurrences located at once

# Bytes of words stay, A-Z in lower case; all others are blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of letters a-z (A-Z lower-cased), digits and all signs beyond ASCII."""
    return text.encode().translate(_WORD_BYTES).split()


@dataclass
class Phrases:
    """Distinct windows of a block of the benchmark."""

    symbols: dict[bytes, int]  # of each word, from 2
    windows: dict[int, np.ndarray]  # by length, one window a row
    first: dict[int, int]  # number of the first window of each length
    items: list[str]
    of_window: np.ndarray  # items of all windows, one after the other
    ends: np.ndarray  # where those of each window end


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Write the items in blocks of bounded size to the shared folder; returns their addresses.

    A null id is the item "null"; repeated ids are one item. Texts without words are left out.
    """
    folder = work_dir(benchmark.sparkSession, "phrases")
    blocks, names, words, total = [], [], [], 0

    def write() -> None:
        file, uri = create_file(folder, ".npz")
        with file:
            buffer = io.BytesIO()
            lengths = [len(w) for w in words]
            flat = [x for w in words for x in w]
            np.savez(buffer, names=json.dumps(names).encode(), words=b" ".join(flat), lengths=lengths, window=window)
            file.write(buffer.getvalue())
        blocks.append(uri)

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    for row in rows.filter(F.col("text").isNotNull()).toLocalIterator():
        found = words_of(row.text)
        if found:
            names.append(row.id)
            words.append(found)
            total += len(found)
        if total >= BLOCK_WORDS:
            write()
            names, words, total = [], [], 0
    if names:
        write()
    return blocks


@worker_table(maxsize=2)
def load_phrases(uri: str) -> Phrases:
    """A block, as a task uses it."""
    with open_file(uri) as file:
        data = np.load(io.BytesIO(file.read()))
    window = int(data["window"])
    flat = data["words"].item().split(b" ")
    symbols: dict[bytes, int] = {}
    ids = np.array([symbols.setdefault(w, len(symbols) + 2) for w in flat], np.int64)
    names = json.loads(data["names"].item())
    items = sorted(set(names))
    number = {name: n for n, name in enumerate(items)}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    start = 0
    for name, length in zip(names, data["lengths"].tolist(), strict=True):
        size = min(window, length)
        for i in range(start, start + length - size + 1):
            found.setdefault(size, {}).setdefault(tuple(ids[i : i + size].tolist()), set()).add(number[name])
        start += length
    windows, first, owners = {}, {}, []
    for size, of in sorted(found.items()):
        first[size] = len(owners)
        windows[size] = np.array(list(of), np.int64)
        owners += [sorted(x) for x in of.values()]
    return Phrases(symbols, windows, first, items, np.concatenate(owners), np.cumsum([len(x) for x in owners]))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of consecutive ranges."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Words:
    """The words of a shard's documents, as numbers of its different words."""

    different: list[bytes]
    lengths: np.ndarray  # words of each document
    numbers: np.ndarray  # of all documents, one after the other

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        numbers = []
        for text in texts:
            words = words_of(text)
            numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        return cls(list(number), np.array([len(n) for n in numbers], np.int64), np.concatenate(numbers) if numbers else np.zeros(0, np.int32))

    def base(self) -> np.ndarray:
        """Where each document begins if one place after each stays empty."""
        return np.cumsum(self.lengths + 1) - self.lengths - 1


def _occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word, length and window number of every occurrence in a shard.

    A word that no item has cannot be part of an occurrence, so only unbroken runs of benchmark words
    that are long enough for a window are indexed, and equal runs once.
    """
    get = phrases.symbols.get
    shortest = min(phrases.windows)
    base = words.base()
    symbol = np.fromiter(map(get, words.different, repeat(0)), np.int64, len(words.different))
    symbols = np.zeros(int((words.lengths + 1).sum()), np.int64)
    symbols[_ranges(base, words.lengths)] = symbol[words.numbers]
    known = np.concatenate([[False], symbols > 0])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    segments: dict[bytes, list[int]] = {}
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        segments.setdefault(symbols[a:b].tobytes(), []).append(a)
    none = np.zeros(0, np.int64)
    if not segments:
        return none, none, none, none
    index = FmIndex([np.frombuffer(s, np.int64) for s in segments], len(phrases.symbols) + 2)
    copies = np.array([len(x) for x in segments.values()])
    places = np.concatenate([np.array(x) for x in segments.values()])
    first_copy = np.cumsum(copies) - copies
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size, windows in phrases.windows.items():
        low, high = index.search(windows)
        rows, owner = _ranges(low, high - low), np.repeat(np.arange(len(windows)), high - low) + phrases.first[size]
        for a in range(0, len(rows), ROWS_AT_ONCE):
            segment, offset = index.locate(rows[a : a + ROWS_AT_ONCE])
            n = copies[segment]
            place = places[_ranges(first_copy[segment], n)] + np.repeat(offset, n)
            out.append((place, np.full(len(place), size), np.repeat(owner[a : a + ROWS_AT_ONCE], n)))
    place, size, owner = (np.concatenate(x) if out else none for x in (zip(*out, strict=True) if out else ((), (), ())))
    doc = np.searchsorted(base, place, "right") - 1
    return doc, place - base[doc], size, owner


@dataclass
class Found:
    """Per document of a shard: its words, the merged spans of words that occurrences cover, and their items."""

    n_words: list[int]
    spans: list[list[tuple[int, int]]]
    items: list[list[str]]


def search(texts: list[str], blocks: list[str]) -> Found:
    """Occurrences of all windows of all blocks in a shard."""
    words = Words.of(texts)
    lengths, base = words.lengths, words.base()
    depth = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for uri in blocks:
        phrases = load_phrases(uri)
        doc, first, size, window = _occurrences(words, phrases)
        np.add.at(depth, base[doc] + first, 1)
        np.add.at(depth, base[doc] + first + size, -1)
        pairs = np.unique(doc * len(phrases.ends) + window)
        for d, w in zip(*(x.tolist() for x in np.divmod(pairs, len(phrases.ends))), strict=True):
            begin = int(phrases.ends[w - 1]) if w else 0
            items[d].update(phrases.items[i] for i in phrases.of_window[begin : int(phrases.ends[w])])
    covered = np.concatenate([[False], np.cumsum(depth) > 0])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(base, edges[::2], "right") - 1
    for d, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[d].append((a - int(base[d]), b - int(base[d])))
    return Found(lengths.tolist(), spans, [sorted(x) for x in items])


def letter_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points from the first to the last word of each span of words."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each whole text has in common with the benchmark.

    Returns doc_id, n_words, n_hit (words within an occurrence of a window), items (ids as sorted
    strings) and spans (first letter and end of each covered passage, merged). A window is ``window``
    consecutive words of an item, or all words of a shorter item. Every task cuts its rows into shards
    and builds an FM-index for each; nothing is shuffled. Null texts have no words; every row is
    answered for itself, so null and repeated ids do no harm. An empty benchmark hits nothing.
    """
    blocks = phrase_blocks(benchmark, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, SHARD_BYTES):
            texts = texts_of(rows)
            found = search(texts, blocks)
            spans = [letter_spans(t, s) for t, s in zip(texts, found.spans, strict=True)]
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"),
                "n_words": pa.array(found.n_words, pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in s) for s in found.spans], pa.int64()),
                "items": pa.array(found.items, pa.list_(pa.string())),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            })

    ddl = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: bigint, end: bigint>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run, load_phrases), ddl)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents with all covered passages cut out of their texts; other texts and columns stay as they are."""
    blocks = phrase_blocks(benchmark, window)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, SHARD_BYTES, text_col):
            texts = rows.column(text_col).to_pylist()
            found = search([t or "" for t in texts], blocks)
            for n, spans in enumerate(found.spans):
                if spans:
                    edges = [0, *(x for s in letter_spans(texts[n], spans) for x in s), len(texts[n])]
                    texts[n] = "".join(texts[n][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield rows.set_column(at, text_col, pa.array(texts, rows.schema.field(at).type))

    return docs.mapInArrow(lean(run, load_phrases), schema)
