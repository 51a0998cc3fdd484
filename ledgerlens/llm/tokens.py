"""Token ids of whole texts by the tokenizers library, with a word cache.

Byte-level BPE works on pre-tokens, and a pre-token always ends before a
single white-space character that follows a non-space one.  So a text
without adjacent white space splits at its spaces and newlines into pieces that
encode on their own, and a piece that was seen before is one dictionary lookup.
A new piece is a pre-token if it is all letters; a mark after one is
a pre-token of its own; other pieces are cut by the tokenizer's published pattern.
Pre-tokens are encoded by the library's own model.  Stretches with adjacent white space go through the
library whole.  The strings of added tokens are cut out of a text first, as the library does, and
become their ids.  The ids equal those of ``encode(text, add_special_tokens=False)`` on
the whole text (a test compares them).

The cache lives in the Python worker, in two generations of at most
``CACHE_PIECES`` pieces: a full one becomes the old one, from which pieces still in
use are taken over.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

CACHE_PIECES = 500_000
# Fixed value: marks that make a pre-token of their own after letters.
MARKS = frozenset(".,;:!?")
END_ID = 0                       # closes every document
ID_BYTES = 4                     # ids as little-endian unsigned 32-bit integers

_WIDE_SPACE = re.compile(r"\s\s")
_WIDE_PARTS = re.compile(r"(\s?\S*\s{2,}\S*)")


def default_tokenizer_path() -> str:
    """byte_bpe_50k.json of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """piece -> packed ids; a missing piece is taken from the old generation or encoded."""

    def __init__(self, encoder: "PieceEncoder", prefix: str):
        super().__init__()
        self.encoder, self.prefix, self.old = encoder, prefix, {}
        self.letter = prefix.translate(encoder.letters)

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self._encode(piece)
        self[piece] = got
        return got

    def _encode(self, piece: str) -> bytes:
        if piece.isalpha():
            # plain letters stand for themselves in the byte-level alphabet
            return self.encoder.ids(self.letter + piece) if piece.isascii() else self.encoder.token(self.prefix + piece)
        word, mark = piece[:-1], piece[-1:]
        if mark in MARKS and word.isalpha():
            return self[word] + self.encoder.small[mark]
        return b"".join(map(self.encoder.small.__getitem__, self.encoder.pattern.findall(self.prefix + piece)))

    def turn(self) -> None:
        """Begin a new generation when this one is full."""
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()


class _Tokens(dict):
    """Pre-token -> packed ids (marks, numbers and other short ones)."""

    def __init__(self, encoder: "PieceEncoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
        got = self[token] = self.encoder.token(token)
        return got


class PieceEncoder:
    """ids of texts as packed bytes (``ID_BYTES`` per id)."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # the longest first, should one begin another
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added_ids = {text: i.to_bytes(ID_BYTES, "little") for text, i in added.items()}
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(ID_BYTES, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.small = _Tokens(self)
        self.bare = _Pieces(self, "")           # at the start of a line
        self.spaced = _Pieces(self, " ")        # after a space
        self.newline = self.token("\n")

    def token(self, token: str) -> bytes:
        return self.ids(token.encode("utf-8").decode("latin-1").translate(self.letters))

    def ids(self, plain: str) -> bytes:
        """Packed ids of a pre-token in the byte-level alphabet."""
        found = self.model.tokenize(plain)
        if len(found) == 1:
            return self.packed[found[0].id]
        return b"".join([self.packed[t.id] for t in found])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        lines = [line.split(" ") for line in text.split("\n")]
        return self.newline.join([bare(line[0]) + b"".join(map(spaced, line[1:])) for line in lines])

    def encode(self, text: str) -> bytes:
        self.bare.turn()
        self.spaced.turn()
        if self.added is None or not self.added.search(text):
            return self._without_added(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self._without_added(text[at: m.start()]), self.added_ids[m.group()]]
            at = m.end()
        return b"".join([*out, self._without_added(text[at:])])

    def _without_added(self, text: str) -> bytes:
        if not text:
            return b""
        if not _WIDE_SPACE.search(text):
            return self._plain(text)
        parts = _WIDE_PARTS.split(text)
        return b"".join([(self._whole if i % 2 else self._plain)(p) for i, p in enumerate(parts) if p])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and tokenizer file."""
    return PieceEncoder(path)


def document_ids(text: str | None, path: str) -> bytes:
    """Packed ids of a document, closed by ``END_ID``; null counts as empty."""
    return encoder(path).encode(text or "") + END_ID.to_bytes(ID_BYTES, "little")
