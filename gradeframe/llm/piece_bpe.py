"""Ids of a byte-fallback piece model by rounds of simultaneous merges over flat arrays, and texts from ids."""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import id_and_text, record_batch, text_slices, texts_of

SPACE = "▁"
CODES = 0x110000  # code points of Unicode
NO_PAIR = np.iinfo(np.int32).max
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what the library decodes an unknown id to

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])


def _one_replacement_a_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("gradeframe-byte", _one_replacement_a_byte)


class PairMerges:
    """Merge rounds over many words at once.

    ``keys`` are the pairs that can be joined, left id times ``stride`` plus right id, with the rank and the
    joined id of each. In a round, each word's least rank is found and all leftmost pairs of that rank that
    do not overlap are merged at once. That equals one merge after another unless a merge brings up a pair
    of the same or a lesser rank; such a word merges only its first pair in that round. Words without a
    pair leave the arrays, and only pairs beside a merge are looked up again.
    """

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, joined: np.ndarray, stride: int):
        self.stride = stride
        # a hash table with at most one place in four taken; a key that finds its place taken goes to the next
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks, self.joined = np.full(self.mask + 1, NO_PAIR, np.int32), np.zeros(self.mask + 1, np.int32)
        self.steps, at = 0, self._place(keys)
        while len(keys):
            self.steps += 1
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(keys), bool)
            mine[first] = True
            mine &= free
            self.keys[at[mine]], self.ranks[at[mine]], self.joined[at[mine]] = keys[mine], ranks[mine], joined[mine]
            keys, ranks, joined, at = keys[~mine], ranks[~mine], joined[~mine], (at[~mine] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined id of each pair; ``NO_PAIR`` where the two can't be joined."""
        key = left.astype(np.int64) * self.stride + right
        at = self._place(key)
        found = self.keys[at]
        again = np.flatnonzero((found != key) & (found != -1))
        for _ in range(1, self.steps):
            if not len(again):
                break
            at[again] = (at[again] + 1) & self.mask
            found[again] = self.keys[at[again]]
            again = again[(found[again] != key[again]) & (found[again] != -1)]
        return np.where(found == key, self.ranks[at], np.int32(NO_PAIR)), self.joined[at]

    def _set(self, symbols: np.ndarray, words: np.ndarray, rank: np.ndarray, joined: np.ndarray, at: np.ndarray) -> None:
        """Look up the pairs that begin at some places; the last symbol of a word begins none."""
        at = at[(at >= 0) & (at < len(symbols))]
        right = np.minimum(at + 1, len(symbols) - 1)
        inside = (at + 1 < len(symbols)) & (words[at] == words[right])
        rank[at] = NO_PAIR
        at, right = at[inside], right[inside]
        rank[at], joined[at] = self.pairs(symbols[at], symbols[right])

    def rounds(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words until no pair remains; ``words`` numbers each symbol's word in ascending order."""
        done = []
        symbols, words = symbols.astype(np.int32), words.astype(np.int32)
        rank, joined = self.pairs(symbols[:-1], symbols[1:])
        rank = np.append(np.where(words[:-1] == words[1:], rank, np.int32(NO_PAIR)), np.int32(NO_PAIR))[: len(symbols)]
        joined = np.append(joined, np.int32(0))[: len(symbols)]
        while len(symbols):
            starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            lengths = np.diff(np.append(starts, len(words)))
            least = np.minimum.reduceat(rank, starts)
            ended = least == NO_PAIR
            if 4 * int(ended.sum()) >= len(ended):  # words without a pair leave when they are many
                over = np.repeat(ended, lengths)
                done.append((symbols[over], words[over]))
                if ended.all():
                    break
                symbols, words, rank, joined = (x[~over] for x in (symbols, words, rank, joined))
                least, lengths = least[~ended], lengths[~ended]
            at = np.flatnonzero((rank == np.repeat(least, lengths)) & (rank != NO_PAIR))
            at = self._in_turn(symbols, words, rank, joined, self._leftmost(at))
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places once the right symbols of the merges before are gone
            symbols, words, rank, joined = (x[keep] for x in (symbols, words, rank, joined))
            self._set(symbols, words, rank, joined, np.concatenate([at - 1, at]))
        if not done:
            return symbols.astype(np.int64), words
        symbols, words = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return symbols[order].astype(np.int64), words[order]

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Every second pair of a run of overlapping ones, from its first."""
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), place, 0))
        return at[(place - first) % 2 == 0]

    def _in_turn(self, symbols: np.ndarray, words: np.ndarray, rank: np.ndarray, joined: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leave only the first merge of words where a merge brings up a pair that must go before the next."""
        again = np.append(False, words[at[1:]] == words[at[:-1]])
        if not again.any():
            return at
        size = len(symbols)
        new = joined[at]
        after = symbols.copy()
        after[at + 1] = new  # the symbol on the left of any later one, once all merges are made
        right, left = np.minimum(at + 2, size - 1), np.maximum(at - 1, 0)
        right_rank = np.where((at + 2 < size) & (words[right] == words[at]), self.pairs(new, symbols[right])[0], NO_PAIR)
        left_rank = np.where((at > 0) & (words[left] == words[at]), self.pairs(after[left], new)[0], NO_PAIR)
        early = words[at[np.minimum(right_rank, left_rank) <= rank[at]]]
        return at[~again | ~np.isin(words[at], early)] if len(early) else at


class PieceBpe:
    """Exactly the ids of the sentencepiece library for a byte-fallback BPE model, without sampling.

    The merge of a pair has the rank of the joined piece (see ``PairMerges``). A word ends wherever no piece holds the two letters side by side, so a merge can't pass there. Ids
    of words are remembered in a table of bounded size, as most words of a text are met again.
    """

    def __init__(self, path: str, limit: int = 2_500_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.byte_ids = np.zeros(256, np.uint32)
        found = {int(pieces[i][3:5], 16): i for i in special if sp.is_byte(i)}
        if len(found) != 256:
            raise ValueError("the model has no piece for each byte")
        self.byte_ids[list(found)] = list(found.values())
        self.control = np.array([sp.is_control(i) for i in range(self.size)])
        self.ordinary = np.array([i not in special for i in range(self.size)])
        self.surfaces = [
            b"" if self.control[i] else UNKNOWN_SURFACE.encode() if sp.is_unknown(i)
            else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self._prepare(ids, np.array([sp.get_score(i) for i in range(self.size)]))
        inner = {b for p in ids for b in p[1:]} | {p[0] for p in ids if len(p) > 1}
        # Spaces begin words and a line break stands alone, if the vocabulary allows.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in ids) and "\n" not in inner
        self.words_of = re.compile(r"\n| *[^ \n]+| +").findall if self.by_word else lambda t: [t] if t else []
        self.table: dict[str, bytes] = {}
        self.limit, self.held = limit, 0

    def _prepare(self, ids: dict[str, int], scores: np.ndarray) -> None:
        """Sorted pair keys with their ranks and joined ids, and the letter pairs that pieces hold."""
        order = np.unique(-scores, return_inverse=True)[1]
        self.letter = np.arange(CODES, dtype=np.int64) + self.size
        pairs, beside = {}, set()
        for piece, i in ids.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = i
            beside.update(ord(a) * CODES + ord(b) for a, b in zip(piece, piece[1:], strict=False))
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.size + CODES) + right] = i
        keys = np.array(sorted(pairs), np.int64)
        joined = np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.merges = PairMerges(keys, order[joined].astype(np.int64), joined, self.size + CODES)
        self.beside = np.array(sorted(beside), np.int64)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of the word of each."""
        letters = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4").astype(np.int64)
        if not len(letters):
            return letters, letters
        ends = np.cumsum([len(w) for w in words])
        pair = letters[:-1] * CODES + letters[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        cut = np.append(True, self.beside[at] != pair)
        cut[ends[:-1]] = True
        symbols, parts = self.merges.rounds(self.letter[letters], np.cumsum(cut))
        # A part lies in one word; its number is that of the word's parts.
        word_of_part = np.searchsorted(ends, np.flatnonzero(cut), "right")
        return self._with_bytes(symbols, word_of_part[parts - 1])

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        flat, word = self.merged(words)
        data = flat.astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters that are no piece become the pieces of their UTF-8 bytes."""
        code = symbols - self.size
        if (code < 0).all():
            return symbols, word
        n = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        out, places = np.repeat(symbols, n), np.cumsum(n) - n
        unknown = code >= 0
        text = np.frombuffer(code[unknown].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(places[unknown], n[unknown]) + _within(n[unknown])] = self.byte_ids[text]
        return out, np.repeat(word, n)

    def encode_words(self, words: Iterable[str]) -> None:
        """See to it that the table holds the ids of these words."""
        new = [w for w in dict.fromkeys(words) if w not in self.table]
        if new:
            self.table.update(zip(new, self._merge(new), strict=True))
            self.held += sum(map(len, new))

    def turn(self) -> None:
        """Empty the table when the words in it have grown beyond the limit."""
        if self.held > self.limit:
            self.table.clear()
            self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, without an end id; an empty text has none."""
        split = [self.words_of(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        self.encode_words(w for words in split for w in words)
        out = [b"".join(map(self.table.__getitem__, words)) for words in split]
        self.turn()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library decodes them: the space before the first word goes, bytes that
        are no letter become one U+FFFD each."""
        parts = np.split(ids, np.flatnonzero(self.control[ids])) if len(ids) else []
        texts = [b"".join(map(self.surfaces.__getitem__, part.tolist())) for part in parts]
        shown = ids[~self.control[ids]]
        text = "".join(t.decode("utf-8", "gradeframe-byte") for t in texts)  # control ids part the bytes of a letter
        return text[1:] if len(shown) and self.ordinary[shown[0]] and text.startswith(" ") else text


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of some consecutive groups."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@functools.lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    """The model of a Python worker; one for all its tasks."""
    return PieceBpe(path)


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(
    docs: DataFrame, model: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """doc_id and the ids of every whole text; ``end_id`` closes each text unless it is None.

    ``with_text`` adds ``text``, decoded again from the ids. A null text is empty and has the end id
    alone. Each row gives a row, so repeated rows and null ids stay; other columns are not read. An
    empty table gives an empty one.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model)
        for rows in text_slices(batches):
            encoded = [ids + end for ids in bpe.encode(texts_of(rows))]
            columns = {"doc_id": rows.column("doc_id"), "ids": id_lists(encoded)}
            if with_text:
                columns["text"] = [bpe.decode(np.frombuffer(ids, "<u4")) for ids in encoded]
            yield record_batch(_TEXTS if with_text else _IDS, **columns)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * with_text)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and their text; null or empty lists of ids have the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model)
        for rows in batches:
            lists = rows.column("ids")
            flat = np.asarray(lists.flatten())
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            texts = [bpe.decode(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
            yield record_batch(_TEXTS, doc_id=rows.column("doc_id"), ids=lists, text=texts)

    frame = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return frame.mapInArrow(run, "doc_id long, ids array<int>, text string")
