"""Token counts under a unigram vocabulary, by dynamic programming that carries only score and count."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeframe.llm.bpe import Remembered
from gradeframe.llm.shared import id_and_text, record_batch, text_slices, texts_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer: below the lowest score of the vocabulary
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that text is matched with, and their scores. Other letters fall back to a piece per byte."""

    pieces: tuple[tuple[str, float], ...]
    lowest: float


def vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a SentencePiece file; control, unknown and byte pieces never match text."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return Vocabulary(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in ids), min(sp.get_score(i) for i in range(sp.get_piece_size())))


class Counter:
    """Number of pieces of the best segmentation of a text.

    A path's score is the sum of its pieces' scores in double precision; a letter that is no piece
    costs the lowest score less ``UNKNOWN_PENALTY`` and counts one piece per UTF-8 byte. At each end
    the candidates are met from the longest piece to the shortest and a later one wins only if it is
    strictly better, which is the tie rule of the tokenizer.

    Spaces are written as ``▁``, one more stands before a text that is not empty. No piece of the
    vocabulary goes on after a word's end, so the best path of a text passes between its words and
    the text is counted word by word; counts of words are remembered in a table of bounded size. The
    same holds on both sides of a line break, which no piece contains.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.lowest - UNKNOWN_PENALTY
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p, _ in vocabulary.pieces)
        self.by_line = all("\n" not in p for p, _ in vocabulary.pieces)
        self.words = Remembered(self._word, limit)
        self.lines = Remembered(self.best, limit // 2)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.by_word:
            return self.best(SPACE + text.replace(" ", SPACE))
        # A word takes the spaces before it along. The table leaves its first space out.
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        n = sum(map(self.words.__getitem__, words))
        self.words.turn()
        self.lines.turn()
        return n

    def _word(self, word: str) -> int:
        shown = SPACE + word.replace(" ", SPACE)
        if "\n" not in shown or not self.by_line:
            return self.best(shown)
        lines = shown.split("\n")
        return sum(self.lines[line] for line in lines) + len(lines) - 1

    def best(self, shown: str) -> int:
        """Pieces of the best path through a text with written spaces."""
        if not shown:
            return 0
        size = len(shown)
        score: list[float | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        score[0] = 0.0
        end = 1
        for last, (length, own) in self.automaton.iter(shown):
            while end < last + 1:
                self._single(shown, score, count, end)
                end += 1
            start = last + 1 - length
            candidate = score[start] + own
            if score[end] is None or candidate > score[end]:
                score[end], count[end] = candidate, count[start] + 1
        while end <= size:
            self._single(shown, score, count, end)
            end += 1
        return count[size]

    def _single(self, shown: str, score: list[float | None], count: list[int], end: int) -> None:
        """After all pieces that end here: the last letter alone, if it is no piece."""
        letter = shown[end - 1]
        if letter not in self.single:
            candidate = score[end - 1] + self.unknown
            if score[end] is None or candidate > score[end]:
                score[end], count[end] = candidate, count[end - 1] + len(letter.encode())


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """The counter of a Python worker; one for all its tasks."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text, without making its tokens.

    ``model`` is a SentencePiece file whose pieces and scores are taken as a unigram vocabulary. A
    null or empty text has no tokens. Each row gives a row, so repeated rows and null ids stay.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for rows in text_slices(batches):
            yield record_batch(_COUNTS, doc_id=rows.column("doc_id"), n_tokens=[counter.count(t) for t in texts_of(rows)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
