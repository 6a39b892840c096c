"""Token ids of whole texts with a public tokenizer file, word by word.

The tokenizer splits at white space before anything else, so a text's ids are the ids of its space-separated pieces
in a row. Pieces repeat, so each Python worker keeps the ids of the pieces it has met. Pieces of ASCII and Latin-1
letters go to the library's model directly, all others through the library's full pipeline; ids are the same.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

CACHE = 1_300_000  # pieces kept per Python worker
# fixed values: how the tokenizer splits lower-case ASCII and Latin-1 text
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
END_ID = 1


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as_letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.special = [s.content for s in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = [packed([i]) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        of_id, tokenize, letters = self.bytes_of.__getitem__, self.model.tokenize, self.bytes_as_letters
        whole, split, plain = self.whole, UNIT.findall, PLAIN.match

        class Pieces(dict):
            """Ids of a piece; computed at its first sight, kept until the cache is full."""

            def __missing__(self, piece: str) -> bytes:
                if plain(piece):
                    units = split(piece.lower())
                    if len(units) == 1 and units[0] == piece:
                        spelled = piece if piece.isascii() else piece.translate(letters)
                        ids = b"".join([of_id(t.id) for t in tokenize(spelled)])
                    else:
                        ids = b"".join(map(self.__getitem__, units))
                else:
                    ids = whole(piece)
                if len(self) >= CACHE:
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.pieces = Pieces()

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):  # such a string may hold or touch anything: the library decides
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(file)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_bytes(file: str, end_id: int = END_ID) -> Callable:
    """Column function: ids of a text and the end id, as little-endian unsigned 32-bit bytes."""
    end = packed([end_id])

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        of = encoder(file)
        return pa.array([of.encode(t) + end for t in texts.to_pylist()], pa.binary())

    return ids
