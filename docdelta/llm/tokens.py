"""Token ids of a public byte-level BPE, fast for running text."""

from __future__ import annotations

import base64
import functools
import re
import sys
from array import array

#: A blank before other white space or at the end belongs to a longer run of white space.
LONG_SPACE = re.compile(r" (?:\s|\Z)")


@functools.cache
def encoder(name: str = "byte_bpe_50k"):
    """The encoding of ``<name>.tiktoken``; the ids are those of ``<name>.json`` where both files exist."""
    import public_tokenizers as vocabularies
    import tiktoken

    with open(vocabularies.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 16-bit numbers (all vocabularies here are below 2**16)."""
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceCache(dict):
    """Encodes texts piece by piece and remembers the pieces: a part behind a blank -> its ids.

    The pattern always starts a new pre-token at a blank that stands between two other characters of which
    the second is no white space, so a text can be cut there and the parts encoded one by one.
    """

    def __init__(self, name: str, most: int = 400_000):
        super().__init__()
        self.encode = encoder(name).encode_ordinary
        self.most = most

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = packed_ids(self.encode(" " + part))
        return ids

    def pieces(self, text: str) -> list[bytes]:
        """Parts of the id sequence, as ``packed_ids``."""
        if len(self) > self.most:
            self.clear()
        if LONG_SPACE.search(text):
            return [packed_ids(self.encode(text))]
        first, *rest = text.split(" ")
        return [packed_ids(self.encode(first)), *map(self.__getitem__, rest)]

    def packed(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text))) // 2


@functools.cache
def piece_cache(name: str) -> PieceCache:
    """One cache for a Python worker."""
    return PieceCache(name)
