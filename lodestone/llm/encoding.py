"""Exact token ids of the tokenizers library, with each distinct word encoded once a worker.

Both vocabularies cut text so that no token reaches over white space into the next word: one drops white
space, the other lets at most one space or line end stand before a word. A text whose words are parted by
single spaces or line ends is therefore the join of its words' ids. Any other text goes to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Bytes of words kept by a worker for its vocabulary; others are encoded whenever they come.
KEPT = 80 << 20
#: What an entry takes besides its word and ids.
_ENTRY = 200
#: Places that tell, by hash, whether a word came before; one that comes once is not kept.
_SEEN = 1 << 20
SLICE = 1 << 20
_SPACE = re.compile(r"\s")
#: One run of letters that have a composed form and a plain lower case, and one of marks without apostrophes (these may
#: join letters). Both vocabularies cut between the two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class OddSpace(Exception):
    """The text has white space other than single spaces and line ends between words."""


@lru_cache(1)
def _byte_marks() -> dict[int, str]:
    """Byte-level vocabularies show a byte as itself where it prints, else as a letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids (little-endian unsigned 32-bit, joined) by word, up to ``most`` bytes; a word is kept from its second time on."""

    def __init__(self, encode, most: int = KEPT) -> None:
        super().__init__()
        self.encode, self.left, self.seen = encode, most, bytearray(_SEEN)

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if self.left > 0:
            at = hash(word) & (_SEEN - 1)
            if self.seen[at]:
                self[word] = ids
                self.left -= _ENTRY + len(word) + len(ids)
            else:
                self.seen[at] = 1
        return ids


# How the two known kinds of vocabulary normalise text and cut it before their merges.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_FORMS = [
    (None, _BYTES | {"use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]},
    ),
]


class Encoder:
    """spaced: a space before a word is part of its token; else white space is dropped and case folded."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        self.spaced = form["normalizer"] is None
        # any other way of cutting text than the two that this module knows encodes every text whole
        self.known = (form["normalizer"], form["pre_tokenizer"]) in _FORMS and form["model"]["type"] == "BPE"
        self.words = _Words(self._spaced_word if self.spaced else self._dropped_word)
        self.firsts = _Words(lambda w: self._word(w, ""), KEPT // 8)
        self.model, self.marks = self.tokenizer.model, _byte_marks()
        self.space, self.line = self.marks[0x20], None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, piece: str) -> bytes:
        """A run that the vocabulary doesn't cut before its merges, as the vocabulary shows it."""
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _shown(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.marks)

    def _word(self, word: str, before: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            if not word or _SPACE.search(word):
                raise OddSpace
            return self._whole(before + word)
        letters, marks = plain.groups()
        if not self.spaced:
            letters = letters.lower()
        if not letters.isascii():
            letters = self._shown(letters)
        if before == " ":
            ids = self._run(self.space + letters)
        else:
            ids = self._run(letters)
            if before == "\n":
                self.line = self.line or self._run(self._shown("\n"))
                ids = self.line + ids
        return ids + self._run(marks) if marks else ids

    def _spaced_word(self, word: str) -> bytes:
        return self._word(word[1:], "\n") if word[:1] == "\n" else self._word(word, " ")

    def _dropped_word(self, word: str) -> bytes:
        return self._word(word, "") if word else b""

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, as joined little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.known:
            return self._whole(text)
        try:
            return b"".join(self._slices(text))
        except OddSpace:
            return self._whole(text)

    def _slices(self, text: str):
        at = 0
        while at < len(text):
            end = text.find(" ", at + SLICE) if len(text) - at > SLICE else -1
            part = text[at : end if end >= 0 else len(text)]
            if not self.spaced:
                yield b"".join(map(self.words.__getitem__, part.replace("\n", " ").split(" ")))
            else:
                pieces = part.replace("\n", " \n").split(" ")
                if at == 0:
                    yield self.firsts[pieces[0]]
                    pieces = pieces[1:]
                yield b"".join(map(self.words.__getitem__, pieces))
            at = end + 1 if end >= 0 else len(text)
            if end >= 0 and at == len(text) and self.spaced:  # a space ends the text
                raise OddSpace


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; Python workers live over many tasks, and hold one vocabulary's words at a time."""
    return Encoder(path)
