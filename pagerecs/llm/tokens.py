"""Texts to token ids with the ``tokenizers`` library, at the rate of a cache.

Neither kind of vocabulary here lets a token reach over a space that stands
between two other characters, so a text is cut there and every distinct chunk
is encoded once per worker; the ids equal those of the whole text. A chunk of
plain Latin letters is one piece for the pre-tokenizer, so it goes straight
to the library's merge model; any other chunk takes the library's whole path.
A worker keeps its encoders while it encodes; a task of another operator drops
them (``common.give_back``).
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice
from typing import TYPE_CHECKING

from pagerecs.llm.common import on_give_back

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Chunks a worker remembers (some 160 MB); beyond that it forgets the half it has not met for longest.
CACHE_CHUNKS = 900_000
_ADJACENT = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters, then marks (no apostrophe: it may open a contraction), by line.
_PART = r"[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(rf"{_PART}(?:\n{_PART})*")
_PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)(.*)")
#: The same for one or two lines, in parts.
_LINES = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*))?")
_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: itself where
    it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Chunks(dict):
    """Ids of chunks that stand after a space; a missing one is encoded and
    remembered. Two generations of half of ``most`` each: what is found in
    the elder moves to the younger, the rest is forgotten with it."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        self.elder: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        parts = json.loads(tokenizer.to_str())
        before, normal = parts["pre_tokenizer"] or {}, json.dumps(parts["normalizer"])
        self.lower = '"Lowercase"' in normal
        bytes_and_spaces = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and normal == "null"
        bytes_and_words = self.lower and parts["model"].get("end_of_word_suffix") == "</w>"
        self.spaces = bytes_and_spaces
        self.direct = bytes_and_spaces or bytes_and_words

    def forget(self) -> None:
        """Makes room; a caller asks for it between batches."""
        if len(self) > self.most // 2:
            self.elder = dict(self)
            self.clear()
        if len(self.pieces) > self.most // 4:
            self.pieces.clear()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.elder.get(chunk)
        if ids is None:
            ids = self._encoded(chunk)
        self[chunk] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer, as it stands in the text."""
        if self.lower:
            piece = piece.lower()
        if not (piece.isascii() and piece.isalpha()):  # letters of ASCII stand for themselves
            piece = piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self._ids(piece)
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word of letters after a space: it is a chunk of its own too."""
        ids = self.get(word) or self.elder.get(word)
        if ids is None:
            ids = self[word] = self._letters(word)
        return ids

    def _letters(self, word: str) -> bytes:
        """Ids of letters after a space."""
        if not self.spaces:
            return self._ids(word)
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(_LETTERS[0x20] + letters)]).tobytes()

    def _encoded(self, chunk: str) -> bytes:
        if self.direct and (found := _LINES.fullmatch(chunk)):
            word, marks, second, more = found.groups()
            if second is None:
                return self._word(word) + self._piece(marks) if marks else self._letters(word)
            ids = self._word(word) + self._piece(marks) if marks else self._word(word)
            ids += self._piece("\n") + self._piece(second) if self.spaces else self._word(second)
            return ids + self._piece(more) if more else ids
        if not (self.direct and _PLAIN.fullmatch(chunk)):
            return array("I", self.tokenizer.encode_batch_fast([" " + chunk], add_special_tokens=False)[0].ids).tobytes()
        ids = b""
        for k, line in enumerate(chunk.split("\n")):
            word, marks = _PARTS.fullmatch(line).groups()
            ids += self._piece("\n") + self._piece(word) if k and self.spaces else self._word(word)
            if marks:
                ids += self._piece(marks)
        return ids


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, plain: bool = False, most: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.chunks = Chunks(self.tokenizer, most)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        self.chunks.forget()
        cut = [(_SAFE.split(t) if _ADJACENT.search(t) else t.split(" ")) if t else [] for t in texts]
        heads = iter(self.tokenizer.encode_batch_fast([p[0] for p in cut if p], add_special_tokens=False))
        ids = self.chunks.__getitem__
        return [
            array("I", next(heads).ids).tobytes() + b"".join(map(ids, islice(parts, 1, None))) if parts else b""
            for parts in cut
        ]


on_give_back(_ENCODERS.clear)


def encoder(path: str, plain: bool = False, most: int = CACHE_CHUNKS) -> Encoder:
    """The worker's encoder for a vocabulary file. ``plain``: the strings of
    the vocabulary's own marks are ordinary text where they stand in a text.
    ``most``: chunks it remembers; fewer take less memory and more time."""
    key = path, plain, most
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, plain, most)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
