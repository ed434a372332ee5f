"""Token ids of whole texts, exactly as the tokenizers library gives them, with the words' ids kept in a bounded cache.

A text is cut where a byte-level BPE never merges: before a space that a non-space follows, around runs of white space,
and behind a word of letters, so that what follows it makes no new unit of it. The ids of a text are then the ids of its
units in order, so that a unit needs the library only when it is new.
Special tokens are cut out first, as the library does.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import regex

#: Unicode White_Space, and the pattern that byte-level BPE splits words by.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters, of which all versions of Unicode are sure; a run of them before another ASCII character or the end is one word piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNIT = re.compile(f" ?[{LETTERS}]+(?=[\t-\r -@[-`{{-~]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(f" ?[{LETTERS}]+").fullmatch
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Pieces(dict):
    """Packed ids by unit or word piece, in two generations: a full one becomes the old one, from which what is asked for again comes back.

    At most twice ``limit`` entries are kept, and none of a long piece.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.encode(piece)
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; ``encode_piece`` gives the ids of one word piece."""

    def __init__(self, encode_piece: Callable[[str], bytes], specials: dict[str, int]):
        split = PIECE.findall

        def encode(unit: str) -> bytes:
            parts = (unit,) if PLAIN(unit) else split(unit)
            return encode_piece(unit) if len(parts) == 1 else b"".join(map(self.units.__getitem__, parts))

        # a word piece is also a unit, as it splits into itself: both are kept once
        self.units = Pieces(encode, 600_000)
        self.specials = {k: np.array([v], "<u4").tobytes() for k, v in specials.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

    def ids(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        if self.cut is None or not any(s in text for s in self.specials):
            return b"".join(map(self.units.__getitem__, UNIT.findall(text)))
        return b"".join(self.specials.get(part) or b"".join(map(self.units.__getitem__, UNIT.findall(part))) for part in self.cut.split(text))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """An encoder whose word pieces are encoded by the tokenizers library; one for each worker process.

    A piece goes to the library's model in the letters that a byte-level pre-tokenizer would give it.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    tokenize, letters = library.model.tokenize, {b: ord(c) for c, b in byte_letters().items()}
    specials = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return Encoder(lambda piece: array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]).tobytes(), specials)


def default_path() -> str:
    """The tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
