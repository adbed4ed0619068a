"""Token ids of whole texts by a public tokenizer file, with a bounded cache of space-separated pieces."""

from __future__ import annotations

import codecs
import os
import re
from array import array

import numpy as np

#: Pieces in each of the two generations of a worker's cache.
CACHE = 450_000

#: A word and the signs after it. The letters are those below U+0130 that lower-case to one letter.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-į]+)([!-&(-/:-@\\[-`{-~]*)")

#: White space of more than one character.
WIDE = re.compile(r"\s\s")

_loaded: dict[tuple[str, bool], "Encoder"] = {}


class Pieces(dict):
    """Piece to ids as bytes; a piece that is missing comes from the older generation or is made."""

    def __init__(self, make, old: dict[str, bytes]):
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)  # get() makes nothing
        if ids is None:
            ids = self.make(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of Tokenizer.encode(text, add_special_tokens=False).

    Both vocabularies pre-tokenize so that no token spans the place before a space that a non-space
    follows. A text is therefore cut there and each distinct piece is encoded once and remembered;
    pieces that begin with white space stay with the one before them. A line end that no white space
    touches is a pre-token of its own.

    A piece that is a word of plain letters and then signs is two pre-tokens, the word and all its
    signs. Both expressions that find pre-tokens, and normalization, leave such a word whole (but for
    its case), so it goes to the library's model directly, and is remembered without its signs as
    well. All other pieces, and the signs, go through the whole tokenizer.

    keep_space: the piece keeps its space (byte-level vocabularies); else white space has no tokens.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        self.model = self.tokenizer.model
        self.known = Pieces(self._make, {})
        self.model._resize_cache(0)  # words that come here are new
        # The byte-level alphabet: printable bytes stand for themselves, the others follow U+0100 in order.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))

    def pieces(self, text: str) -> list[str]:
        if not self.keep_space:
            return text.replace("\n", " ").split(" ")
        if not WIDE.search(text) and "\0" not in text:
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of plain letters, which are one pre-token, and of the space before them."""
        raw = word if self.keep_space else word.lower()
        shown = codecs.charmap_decode(raw.encode(), "strict", self.alphabet)[0]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _make(self, piece: str) -> bytes:
        found = PLAIN.fullmatch(piece)
        if found:
            word, signs = found.groups()
            return self.known[word] + self.known[signs] if signs else self._word(word)
        if self.keep_space and "\n" in piece:
            lines = piece.split("\n")
            if all(x and not x[-1].isspace() and (k == 0 or not x[0].isspace()) for k, x in enumerate(lines)):
                return self.known["\n"].join([self.known[x] for x in lines])
        return self._whole(piece)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array of ids for each text."""
        out = []
        for text in texts:
            out.append(np.frombuffer(b"".join(map(self.known.__getitem__, self.pieces(text))), "<u4"))
            if len(self.known) > CACHE:
                self.known.old = {}
                self.known = Pieces(self._make, self.known if len(self.known) <= 2 * CACHE else {})
        return out


def encoder(path: str, keep_space: bool) -> Encoder:
    """One for each worker process."""
    if (path, keep_space) not in _loaded:
        _loaded[path, keep_space] = Encoder(path, keep_space)
    return _loaded[path, keep_space]
