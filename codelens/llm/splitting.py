"""Problem 10: cutting texts over a token limit at natural boundaries.

Balanced targets: the least number of pieces that can hold the text gives equal-length targets; each target moves to the
strongest boundary nearby (blank line, line end, sentence end, white space, any token) and, among equals, the nearest.
When a piece, encoded by itself, exceeds the limit, the text is cut anew with one more piece.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.bpe import DEFAULT_FOLDER, Encoder, encoder
from codelens.sources.checkpoints import spread

#: Pieces of the tokenizer's pattern longer than this many characters (or an eighth of the limit) may be cut inside.
ATOM = 24


def strength(text: str, at: int) -> int:
    """How natural a cut at this character is: 4 after a blank line, 3 after a line, 2 after a sentence, 1 at white space."""
    tail, rest = text[max(0, at - 8) : at], text[at : at + 1]
    if tail.endswith("\n"):
        return 4 if rest not in "\r\n" and tail[len(tail.rstrip()) :].count("\n") > 1 else 3
    if rest.isspace():
        return 2 if tail[-1:] in ".!?;:。！？" else 1
    return 1 if tail[-1:].isspace() else 0


def atoms_of(enc: Encoder, text: str, limit: int) -> tuple[list[str], list[int]] | None:
    """The text in pieces of the tokenizer's pattern, long ones cut, and their tokens; None if it is within the limit."""
    pieces = enc.split(text)
    counts = list(map(enc.counts.__getitem__, pieces))
    if sum(counts) <= limit:
        return None
    most = max(1, min(ATOM, limit // 8))
    if max(map(len, pieces)) > most:
        pieces = [p[i : i + most] for p in pieces for i in range(0, len(p), most)]
        counts = list(map(enc.counts.__getitem__, pieces))
    return pieces, counts


class _Strength(dict):
    """The strength of the cut before each atom, looked at when needed."""

    def __init__(self, text: str, chars: list[int]):
        super().__init__()
        self.text, self.chars = text, chars

    def __missing__(self, j: int) -> int:
        s = self[j] = strength(self.text, self.chars[j])
        return s


def cut(enc: Encoder, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, characters repeated from the piece before, tokens) of each piece; nothing if the text is within the limit."""
    found = atoms_of(enc, text, limit)
    if found is None:
        return []
    chars, tokens = [0, *accumulate(map(len, found[0]))], [0, *accumulate(found[1])]
    m, total = len(found[0]), tokens[-1]
    power = _Strength(text, chars)
    k = max(2, -(-(total - overlap) // (limit - overlap)))
    while True:
        full = (total + (k - 1) * overlap) / k
        reach = max(8, min(limit // 8, int(full / 4)))
        cuts = [0]
        for i in range(1, k):
            t = full * i - overlap * (i - 1)
            lo, hi = max(cuts[-1] + 1, bisect_left(tokens, t - reach)), min(m - 1, bisect_right(tokens, t + reach) - 1)
            if lo > hi:
                lo = hi = min(m, max(cuts[-1] + 1, bisect_left(tokens, t)))
            if lo < m:
                cuts.append(max(range(lo, hi + 1), key=lambda j: (power[j], -abs(tokens[j] - t), -j)))
        cuts.append(m)
        out = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            s = a
            if a:
                s = max(cuts[i - 1] + 1, bisect_left(tokens, tokens[a] - overlap))
                best = next((j for j in range(s, a) if power[j] >= 1), s)
                s = best if tokens[a] - tokens[best] >= overlap // 2 else s
                while s < a and enc.count(text[chars[s] : chars[a]]) > overlap:
                    s += 1
                while k >= m and s < a and enc.count(text[chars[s] : chars[b]]) > limit:
                    s += 1  # no more pieces are possible: repeat less
            out.append((chars[s], chars[b], chars[a] - chars[s], enc.count(text[chars[s] : chars[b]])))
        if all(x[3] <= limit for x in out) or k >= m:
            return out
        k += 1


def pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, with_text: bool = True
) -> DataFrame:
    """One row for each piece of each text of more than `limit` tokens: key, piece, n_pieces, start, end, overlap_chars, n_tokens, piece_text.

    Texts within the limit (null and empty ones among them) give no row: they need no cut. A token has at least one byte, so
    texts of at most `limit` bytes never leave the JVM. Piece texts without their repeated beginnings add up to the text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer, folder)
        for b in batches:
            rows = [
                (k, i, len(cuts), s, e, o, n, t[s:e] if with_text else "")
                for k, t in zip(b.iloc[:, 0], b.iloc[:, 1])
                for cuts in [cut(enc, t, limit, overlap)]
                for i, (s, e, o, n) in enumerate(cuts)
            ]
            yield pd.DataFrame(rows, columns=[key, "piece", "n_pieces", "start", "end", "overlap_chars", "n_tokens", "piece_text"])

    return spread(df.select(key, text).where(F.octet_length(text) > limit)).mapInPandas(run, f"`{key}` {kind}, piece int, n_pieces int, start int, end int, overlap_chars int, n_tokens int, piece_text string")
