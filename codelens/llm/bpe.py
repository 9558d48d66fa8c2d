"""Byte-pair encoding with a public rank file.

A text is split by the tokenizer's pattern; each piece starts as single bytes, and the adjacent pair of lowest rank
(the leftmost of equals) is merged until none has a rank. The pairs of a piece are the leaves of a segment tree over
byte positions whose nodes hold the leftmost minimum rank; a merge updates the leaves of the live neighbours only, in
logarithmic time, so that a piece of n bytes costs O(n log n), however long it is. Pieces recur, so each Python worker
keeps the result of those it has met.

Null and empty texts have no tokens. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache
from itertools import chain

DEFAULT_FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: White_Space of Unicode, as the character class body that all regex engines agree on.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the split pattern that comes with the rank files.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts of ASCII only, for the faster engine.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NO_RANK = 1 << 30
#: A worker forgets its pieces when it knows this many; only speed depends on it.
CACHE_PIECES = 400_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get = ranks.get
    size = 1
    while size < n:
        size *= 2
    # tree[size + i] is the rank of the pair that starts at byte i, tree[1] the least of all
    tree = [NO_RANK] * (2 * size)
    tree[size : size + n - 1] = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))  # where the token before starts

    def update(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (least := tree[1]) != NO_RANK:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = after[i]
        end = after[j]
        after[i] = end
        update(j, NO_RANK)
        update(i, get(piece[i : after[end]], NO_RANK) if end < n else NO_RANK)
        if end < n:
            before[end] = i
        p = before[i]
        if p >= 0:
            update(p, get(piece[p:end], NO_RANK))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """Piece (str) -> token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(merge(raw, self.ranks))
        if len(raw) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Counts(dict):
    """Piece (str) -> number of its tokens."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, piece: str) -> int:
        n = len(self.pieces[piece])
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


class Encoder:
    """Encodes texts by a rank file."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER):
        import re

        import regex

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.wide, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.pieces = Pieces(self.ranks)
        self.counts = Counts(self.pieces)

    def split(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.wide).findall(text)

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.split(text))) if text else 0


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> Encoder:
    """The encoder of this process."""
    return Encoder(name, folder)
