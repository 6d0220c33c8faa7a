"""Alignment of two tokenizers over the same bytes, and how often their ids are linked in the whole corpus.

Pass 1 aligns documents and adds up links per id pair and task. The distinct pairs are dealt to shards
by hash and each shard gets a minimal perfect hash. Every part of a shard's counts becomes a dense
vector in hash order, and vectors are summed as a tree. Pass 2 aligns the documents again and looks the
counts up, verifying the key at each index.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm import perfect_hash
from gradeframe.llm.bpe import PLAIN, WORD, ByteBpe
from gradeframe.llm.piece_bpe import PairMerges, PieceBpe
from gradeframe.llm.shared import create_file, id_and_text, open_file, record_batch, text_slices, texts_of
from gradeframe.session import materialise, work_dir

# A unit is a word with the white space before it. Both tokenizers end a token at its end: the letter
# before a single space or line break is no white space to either, and no token goes on over one.
UNIT = re.compile(r"\n(?=\S)| ?\S+|\s+\S*")
SLICE = 5 << 20
KEPT_PAIRS = 1 << 20  # distinct pairs that a task of pass 1 holds before it puts them out
SHARD_KEYS = 1 << 14  # distinct pairs of a shard
VECTOR_ROWS = 1 << 16  # rows that are added into one dense vector
FAN_IN = 8  # vectors summed by one step of the tree
CACHE_BYTES = 384 << 20  # shards that a Python worker of pass 2 keeps; others are read again

_PARTIAL = pa.schema([("key", pa.int64()), ("mixed", pa.int64()), ("n", pa.int64()), ("block", pa.int64())])
_FILES = pa.schema([("shard", pa.int64()), ("uri", pa.string())])
_VECTOR = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])
_BEST = pa.schema([("b", pa.int64()), ("most", pa.int64())])
_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string()),
])
_STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Values that deal keys to shards: not negative, and not those that any level of the hash uses."""
    return (perfect_hash.mix(keys, -2) >> np.uint64(1)).astype(np.int64)


class ByteSide:
    """The byte-level tokenizer on units, by merge rounds. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        bpe = ByteBpe(path, limit=1)
        self.split_words = bpe.split_words
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        # printable bytes stand for themselves, the others for the letters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(hidden)}
        size = bpe.tokenizer.get_vocab_size(with_added_tokens=True)
        entries = [bpe.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        self.letter = np.zeros(256, np.int64)
        self.letter[list(byte.values())] = [vocabulary[c] for c in byte]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[x] * size + vocabulary[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        joined = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        self.merges = PairMerges(keys[order], order.astype(np.int64), joined[order], size)

    def _words(self, text: str) -> np.ndarray:
        """Numbers of letters of the words of a text, as the library cuts it."""
        if PLAIN.fullmatch(text):
            return np.fromiter(map(len, WORD.findall(text)), np.int64)
        spans = [end - start for _, (start, end) in self.split_words(text)]
        if sum(spans) != len(text):
            raise ValueError("the tokenizer leaves letters out")
        return np.array(spans, np.int64)

    def merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and the number of the unit of each.

        Units are cut into words together. One that begins with a letter gets a line break before it,
        as it has in its text, whose token is dropped. Units of white space alone, which are few, would
        grow together with their neighbours and are cut one by one.
        """
        blank = [u.isspace() for u in units]
        solid, rest = ([n for n, b in enumerate(blank) if b is which] for which in (False, True))
        bare = [not units[n][0].isspace() for n in solid]
        chunks = ["\n" + units[n] if b else units[n] for n, b in zip(solid, bare, strict=True)]
        lengths = [self._words("".join(chunks)), *(self._words(units[n]) for n in rest)]
        chunks += [units[n] for n in rest]
        letters = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        if not len(letters):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.concatenate(lengths)
        chunk_lengths = np.fromiter(map(len, chunks), np.int64)
        chunk_ends = np.cumsum(chunk_lengths)
        word_starts = np.cumsum(lengths) - lengths
        owner = np.searchsorted(chunk_ends, word_starts, "right")
        begins = word_starts == (chunk_ends - chunk_lengths)[owner]
        added = np.array(bare + [False] * len(rest), bool)
        unit = np.where(begins & added[owner], -1, np.array([*solid, *rest])[owner])
        bytes_of = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
        words = np.repeat(np.repeat(np.arange(len(lengths)), lengths), bytes_of)
        ids, words = self.merges.rounds(self.letter[np.frombuffer("".join(chunks).encode(), np.uint8)], words)
        unit = unit[words]
        order = np.argsort(unit[unit >= 0], kind="stable") if rest else slice(None)
        return ids[unit >= 0][order], unit[unit >= 0][order]


@dataclass
class Links:
    """Links of some units, in their order: id pair and unit of each link; tokens of both sides."""

    keys: np.ndarray
    unit: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_closes: np.ndarray  # tokens at whose end a token of the other side ends as well
    b_closes: np.ndarray
    n_a: np.ndarray  # per unit
    n_b: np.ndarray
    n_groups: np.ndarray


class Aligner:
    """Both tokenizers, on the different units of some texts at once."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteSide(byte_path), PieceBpe(piece_path)
        self.a_table, self.b_table = self._table(self.a.bytes), self._table(self.b.surfaces)
        self.a_size, self.b_size = self.a_table[0], self.b_table[0]
        self.width = len(self.b_size)
        self.cut = UNIT.findall if self.b.by_word else lambda t: [t]
        self.a_texts = [np.array([f"{i}{end}" for i in range(len(self.a_size))], object) for end in ",|"]
        self.b_texts = [np.array([f"{i}{end}" for i in range(self.width)], object) for end in ",;"]

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of bytes of each entry, where they begin, and all bytes."""
        size = np.array([len(x) for x in entries], np.int64)
        return size, np.cumsum(size) - size, np.frombuffer(b"".join(entries), np.uint8)

    @staticmethod
    def _same(data: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, ...], ids: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Whether the bytes of each unit's tokens are those of the unit; ``data`` holds the units, which end at ``ends``."""
        size, start, flat = table
        sizes = np.bincount(unit, size[ids], minlength=len(ends)).astype(np.int64)
        lengths = np.diff(np.append(0, ends))
        same = sizes == lengths
        ids = ids[same[unit]]
        n = size[ids]
        joined = flat[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        owner = np.repeat(np.arange(len(ends)), lengths)
        fits = same[owner]
        same[owner[fits][joined != data[fits]]] = False
        return same

    def links(self, units: list[str]) -> tuple[Links, np.ndarray]:
        """All links of different units, and which units have tokens: those whose bytes both sides give back."""
        data = np.frombuffer("".join(units).encode(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)))
        (a, a_unit), (b, b_unit) = self.a.merged(units), self.b.merged(units)
        good = self._same(data, ends, self.a_table, a, a_unit) & self._same(data, ends, self.b_table, b, b_unit)
        a, a_unit, b, b_unit = a[good[a_unit]], a_unit[good[a_unit]], b[good[b_unit]], b_unit[good[b_unit]]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.append(True, np.diff(ends) > 0)[: len(ends)]]
        # Between two neighbouring ends lies one token of each side, and any two that overlap share one such gap.
        at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        a_closes, b_closes = (_among(x, y) for x, y in ((a_end, b_end), (b_end, a_end)))
        n_a, n_b, n_groups = (np.bincount(u, minlength=len(units)) for u in (a_unit, b_unit, a_unit[a_closes]))
        return Links(a[at_a] * self.width + b[at_b], a_unit[at_a], a, b, a_closes, b_closes, n_a, n_b, n_groups), good

    def group_texts(self, links: Links) -> list[str]:
        """``a1,a2|b1;`` for the groups of each unit."""
        a_texts = np.where(links.a_closes, self.a_texts[1][links.a], self.a_texts[0][links.a])
        b_texts = np.where(links.b_closes, self.b_texts[1][links.b], self.b_texts[0][links.b])
        a_group, b_group = (np.cumsum(c) - c for c in (links.a_closes, links.b_closes))
        a_until, b_until = (np.append(0, np.flatnonzero(c) + 1) for c in (links.a_closes, links.b_closes))
        out = np.empty(len(links.a) + len(links.b), object)
        out[np.arange(len(links.a)) + b_until[a_group]] = a_texts
        out[np.arange(len(links.b)) + a_until[b_group + 1]] = b_texts
        bounds = np.append(0, np.cumsum(links.n_a + links.n_b)).tolist()
        flat = out.tolist()
        return ["".join(flat[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of some sorted values are among other sorted ones."""
    if not len(others):
        return np.zeros(len(values), bool)
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


@functools.lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """The tokenizers of a Python worker; one pair for all its tasks."""
    return Aligner(byte_path, piece_path)


@dataclass
class _Slice:
    """Texts as numbers of different units; ``stops`` are the ends of documents in ``flat``."""

    units: list[str]
    flat: np.ndarray
    stops: np.ndarray

    @classmethod
    def of(cls, aligner: Aligner, texts: list[str]) -> _Slice:
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__  # a new unit gets the next number
        numbers = []
        for text in texts:
            units = aligner.cut(" " + text) if text else []
            numbers.append(np.fromiter(map(number.__getitem__, units), np.int64, len(units)))
        return cls(list(number), np.concatenate(numbers), np.cumsum([len(n) for n in numbers]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the units' values over each document."""
        running = np.append(0, np.cumsum(values[self.flat]))
        return np.diff(running[np.append(0, self.stops)])


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, np.diff(keys) != 0)[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def link_counts(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 1: links per id pair (``key`` = A id x size of B + B id), added up within tasks and written.

    A task puts its sums out at its end, and before that whenever it holds ``KEPT_PAIRS`` different pairs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            return record_batch(_PARTIAL, key=keys, mixed=_mixed(keys), n=n, block=np.full(len(keys), block))

        for rows in text_slices(batches, SLICE):
            part = _Slice.of(aligner, texts_of(rows))
            links, good = aligner.links(part.units)
            whole = part.sums(~good) == 0
            lengths = np.diff(np.append(0, part.stops))
            times = np.bincount(part.flat[np.repeat(whole, lengths)], minlength=len(part.units))
            here = times[links.unit]
            keys, n = _added(np.concatenate([keys, links.keys[here > 0]]), np.concatenate([n, here[here > 0]]))
            if len(keys) >= KEPT_PAIRS:
                yield out()
                block += 1
                keys, n = keys[:0], n[:0]
        if len(keys):
            yield out()

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, "key long, mixed long, n long, block long")
    return materialise(found, "link-counts")


def _write(data: bytes, folder: str) -> str:
    file, uri = create_file(folder, ".npz")
    with file:
        file.write(data)
    return uri


def _read(uri: str) -> tuple[perfect_hash.PerfectHash, dict[str, np.ndarray]]:
    with open_file(uri) as file:
        return perfect_hash.load(file.read())


def _hash_files(partial: DataFrame, n_shards: int, folder: str) -> dict[int, str]:
    """A file with the perfect hash and the keys of each shard; their addresses, one per ``SHARD_KEYS`` pairs."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(np.asarray(table.column("key").combine_chunks()))
        hashed = perfect_hash.PerfectHash.build(keys)
        ordered = np.empty_like(keys)
        ordered[hashed.index(keys)] = keys
        return pa.table({"shard": [table.column("shard")[0].as_py()], "uri": [_write(perfect_hash.dump(hashed, keys=ordered), folder)]}, schema=_FILES)

    distinct = partial.select("key", (F.col("mixed") % n_shards).alias("shard")).distinct()
    rows = distinct.groupBy("shard").applyInArrow(build, "shard long, uri string").collect()
    return {r.shard: r.uri for r in rows}


def _summed(partial: DataFrame, files: dict[int, str], n_shards: int) -> DataFrame:
    """shard, counts: one dense vector of long integers per shard, in hash order, summed as a tree."""

    def vector(table: pa.Table) -> pa.Table:
        shard, part = (table.column(c)[0].as_py() for c in ("shard", "part"))
        hashed, columns = _read(files[shard])
        at = hashed.index(np.asarray(table.column("key").combine_chunks()))
        counts = np.zeros(len(columns["keys"]), np.int64)
        np.add.at(counts, at, np.asarray(table.column("n").combine_chunks()))
        return pa.table({"shard": [shard], "part": [part], "counts": [counts.tobytes()]}, schema=_VECTOR)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table(
            {"shard": [table.column("shard")[0].as_py()], "part": [table.column("part")[0].as_py()], "counts": [total.tobytes()]},
            schema=_VECTOR,
        )

    columns = "shard long, part long, counts binary"
    parts = math.ceil(partial.count() / (VECTOR_ROWS * n_shards))
    rows = partial.select("key", "n", (F.col("mixed") % n_shards).alias("shard"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"))
    vectors = rows.groupBy("shard", "part").applyInArrow(vector, columns)
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        step = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN))
        vectors = step.groupBy("shard", "part").applyInArrow(add, columns)
    return materialise(vectors.select("shard", "counts"), "link-vectors")


def _most_by_b(sums: DataFrame, files: dict[int, str], width: int) -> np.ndarray:
    """The highest count of each B id; a vector as long as B's vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(width, np.int64)
        for rows in batches:
            for shard, counts in zip(rows.column("shard").to_pylist(), rows.column("counts").to_pylist(), strict=True):
                np.maximum.at(most, _read(files[shard])[1]["keys"] % width, np.frombuffer(counts, np.int64))
        yield record_batch(_BEST, b=np.flatnonzero(most), most=most[most > 0])

    found = sums.mapInArrow(run, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).toArrow()
    out = np.zeros(width, np.int64)
    out[np.asarray(found.column("b").combine_chunks())] = np.asarray(found.column("most").combine_chunks())
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


@dataclass(frozen=True)
class CountTable:
    """Corpus-wide counts of all linked id pairs: a file per shard with hash, keys, counts and marks of the best."""

    n_shards: int
    files: dict[int, str]


def count_table(partial: DataFrame, piece_path: str) -> CountTable:
    """The table of all pairs of ``link_counts``. No pairs give a table without shards."""
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=piece_path).get_piece_size()
    n_shards = math.ceil(partial.select("key").distinct().count() / SHARD_KEYS)
    if not n_shards:
        return CountTable(0, {})
    folder = work_dir(partial.sparkSession, "link-table")
    hashes = _hash_files(partial, n_shards, folder)
    sums = _summed(partial, hashes, n_shards)
    most = _most_by_b(sums, hashes, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            shards, uris = rows.column("shard").to_pylist(), []
            for shard, counts in zip(shards, rows.column("counts").to_pylist(), strict=True):
                hashed, columns = _read(hashes[shard])
                counts = np.frombuffer(counts, np.int64)
                best = counts == most[columns["keys"] % width]
                uris.append(_write(perfect_hash.dump(hashed, keys=_narrow(columns["keys"]), counts=_narrow(counts), best=best), folder))
            yield record_batch(_FILES, shard=shards, uri=uris)

    return CountTable(n_shards, {r.shard: r.uri for r in sums.mapInArrow(run, "shard long, uri string").collect()})


class _Lookup:
    """Counts of id pairs from the shards; the latest used are kept up to ``CACHE_BYTES``."""

    def __init__(self, table: CountTable):
        self.table = table
        self.kept: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def shard(self, number: int) -> tuple[perfect_hash.PerfectHash, dict[str, np.ndarray]]:
        if number not in self.kept:
            found = _read(self.table.files[number])
            self.kept[number] = found
            self.bytes += self._size(found)
            while self.bytes > CACHE_BYTES and len(self.kept) > 1:
                self.bytes -= self._size(self.kept.popitem(last=False)[1])
        self.kept.move_to_end(number)
        return self.kept[number]

    @staticmethod
    def _size(found: tuple) -> int:
        return found[0].words.nbytes + found[0].before.nbytes + sum(c.nbytes for c in found[1].values())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and mark of each pair. A pair that the table lacks is an error: the corpus has changed."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not len(keys):
            return counts, best
        if not self.table.n_shards:
            raise ValueError("the table of counts has no pairs")
        shard = _mixed(keys) % self.table.n_shards
        order = np.argsort(shard, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
        for rows in np.split(order, starts[1:]):
            hashed, columns = self.shard(int(shard[rows[0]]))
            at = hashed.index(keys[rows])
            if (at < 0).any() or (columns["keys"][at] != keys[rows]).any():
                raise ValueError("an id pair is not in the table of counts")
            counts[rows], best[rows] = columns["counts"][at], columns["best"][at]
        return counts, best


def aligned(docs: DataFrame, table: CountTable, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 2: tokens, groups and links of every whole text with the corpus-wide counts of their id pairs.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id), count_sum
    and groups, ``a1,a2|b1;a3|b2,b3``. A text is null, empty or not reproduced byte for byte by either
    tokenizer: zeros and no groups. Each row gives a row, so repeated rows and null ids stay and count each
    time; other columns are not read. ``table`` must come from the same documents.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, lookup = _aligner(byte_path, piece_path), _Lookup(table)
        for rows in text_slices(batches, SLICE):
            part = _Slice.of(aligner, texts_of(rows))
            links, good = aligner.links(part.units)
            whole = part.sums(~good) == 0
            used = np.zeros(len(part.units), bool)
            used[part.flat[np.repeat(whole, np.diff(np.append(0, part.stops)))]] = True
            here = used[links.unit]
            keys, back = np.unique(links.keys[here], return_inverse=True)
            counts, best = lookup.find(keys)
            stats = {"n_a": links.n_a, "n_b": links.n_b, "n_groups": links.n_groups}
            bounds = np.searchsorted(links.unit[here], np.arange(len(part.units) + 1))
            for name, values in (("n_links", np.ones(len(back), np.int64)), ("n_best", best[back]), ("count_sum", counts[back])):
                stats[name] = np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[bounds])
            texts, bounds, flat = aligner.group_texts(links), [0, *part.stops.tolist()], part.flat.tolist()
            groups = [
                "".join(map(texts.__getitem__, flat[s:e]))[:-1] if w else ""
                for s, e, w in zip(bounds[:-1], bounds[1:], whole.tolist(), strict=True)
            ]
            yield record_batch(
                _ROWS, doc_id=rows.column("doc_id"), groups=groups,
                **{name: np.where(whole, part.sums(stats[name]), 0) for name in _STATS},
            )

    sums = ", ".join(f"{name} long" for name in _STATS)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {sums}, groups string")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both passes: see ``aligned``. An empty table gives an empty one."""
    table = count_table(link_counts(docs, byte_path, piece_path, id_col, text_col), piece_path)
    return aligned(docs, table, byte_path, piece_path, id_col, text_col)
