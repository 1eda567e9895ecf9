"""Pre-tokens of two public vocabularies, with the library as the judge of all else.

Splitting a text by a compiled pattern and looking each piece up is much cheaper
than encoding it, and exact where the pattern's letter classes are beyond doubt.
A text with a character that ``UNUSUAL`` finds, or with the start of a special
token, goes to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

LETTERS = "a-zA-ZÀ-ÖØ-öø-įĲ-ňŊ-ſЀ-џぁ-ゖァ-ヺ一-龥"
#: Anything outside: letters, ASCII, and a few marks that are punctuation or symbols in every Unicode version.
UNUSUAL = re.compile(f"[^\t-\r -~{LETTERS}¡§©«®°·»¿‐-‧‰-⁞€]|<\\|")

# The splitting patterns of the two vocabulary files.
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")

#: Byte -> the character that byte-level vocabularies write for it: printable Latin-1 ones stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def piece_ids(path: str) -> Callable[[str], list[int]]:
    """Ids of one lower-case piece of a text without unusual characters: the merges alone,
    as normalising and splitting change nothing there."""
    model = tokenizer(path).model

    def ids(piece: str) -> list[int]:
        return [x.id for x in model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS))]

    return ids


class Cache(dict):
    """piece -> value, worked out once; emptied when ``limit`` new pieces came in."""

    def __init__(self, make: Callable[[str], object], start: dict | None = None, limit: int = 400_000):
        super().__init__(start or {})
        self.make, self.start, self.room = make, start or {}, limit
        self.limit = limit

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= 64:  # long pieces hardly come again
            if self.room <= 0:
                self.clear()
                self.update(self.start)
                self.room = self.limit
            self.room -= 1
            self[piece] = value
        return value


def vocabulary(name: str) -> str:
    """Where the installed tokenizer package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
