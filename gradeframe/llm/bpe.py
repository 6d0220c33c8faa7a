"""Token ids under a byte-level BPE file of the ``tokenizers`` library, at the cost of one call per new word."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

from gradeframe.llm.shared import worker_table

# Texts of these letters only are cut into words by one pattern, which says for them what the
# library's pre-tokenizer says for all letters. Other texts go through the pre-tokenizer itself.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(f"[\t\n\r -~{_L}]*")
WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


class ByteBpe:
    """Exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian uint32 bytes.

    Merges never cross words, so each word goes through the library's model once and its ids are
    remembered in a table of bounded size that lives as long as the Python worker. A text with an
    added token goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split_words = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = self._byte_letters()
        self.plain = Remembered(lambda w: self._ids(self.shown(w)), limit)
        self.other = Remembered(self._ids, limit // 2)

    def _ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _byte_letters(self) -> dict[int, str]:
        """The library's letter for each byte of a plain text, under the Latin-1 letter of that byte."""
        found = {}
        for code in (9, 10, 13, *range(32, 127), *range(0xC0, 0x250)):
            shown = "".join(w for w, _ in self.split_words(chr(code)))
            found.update(zip(chr(code).encode(), shown, strict=True))
        return found

    def shown(self, word: str) -> str:
        """A plain word in the letters by which the library writes bytes."""
        if word.isascii() and word[1:].isalpha() and word[0] == " ":
            return self.letters[32] + word[1:]
        return word.encode().decode("latin-1").translate(self.letters)

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if PLAIN.fullmatch(text):
            return self.plain.joined(WORD.findall(text))
        return self.other.joined([w for w, _ in self.split_words(text)])


class Remembered(dict):
    """Values of a function by key. At ``limit`` keys the table becomes the older of two and a new one begins."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def joined(self, keys: list[str]) -> bytes:
        out = b"".join(map(self.__getitem__, keys))
        self.turn()
        return out

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


@worker_table(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a Python worker; one for all its tasks."""
    return ByteBpe(path)
