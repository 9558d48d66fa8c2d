"""Problem 5: long exact spans shared between records.

Level-wise doubling over windows of a quarter, half and the whole of the least length L. Windows of the first level
are chosen by content (winnowing), so that of any L bytes that two records share, both choose the same one. Only
windows whose hash occurs in at least two different contents go on; each is extended to the left and to the right to twice
its length (one of the two still lies inside the shared span), and those that recur are extended to all windows of L bytes
that choose them. Of a record, thus, only the parts that may be shared are looked at again.

Contents are compared by 64-bit polynomial hashes of random byte values; equal contents are one class, so copies cost
nothing and no pair within a class is formed before the result needs it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.filters import may_match
from codelens.sources.checkpoints import cut, spread

CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, and BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK)
        inverse = pow(BASE, -1, 1 << 64)
        for name, b in (("up", BASE), ("down", inverse)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        _powers["value"] = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
    return _powers["value"], _powers["up"], _powers["down"]


class Hashes:
    """Hashes of all windows of some bytes."""

    def __init__(self, data: np.ndarray):
        value, up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x)
    y = np.full(-(-n // w) * w, x.dtype.type(np.iinfo(x.dtype).max), x.dtype)
    y[:n] = x
    rows = y.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def choices(h: np.ndarray, w: int, inside: np.ndarray) -> np.ndarray:
    """For each window start that is `inside` its record, where its chosen (least, of equals leftmost) hash is."""
    key = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(key, w)
    return (least & np.uint64(0xFFFFF)).astype(np.int64)[inside[: len(least)]]


def parts(contents: list[bytes], length: int):
    """Contents gathered into, or cut with margins into, pieces of about CHUNK bytes: (bytes, [(row, from, to, offset in row)])."""
    data, spans, size = [], [], 0
    for row, c in enumerate(contents):
        if len(c) < length:
            continue
        step = CHUNK - 4 * length
        for a in range(0, max(1, len(c) - length + 1), step):
            piece = c if len(c) <= CHUNK else c[a : a + CHUNK]
            if size + len(piece) > CHUNK and data:
                yield np.frombuffer(b"".join(data), np.uint8), spans
                data, spans, size = [], [], 0
            data.append(piece)
            spans.append((row, size, size + len(piece), a))
            size += len(piece)
            if len(c) <= CHUNK or a + CHUNK >= len(c):
                break
    if data:
        yield np.frombuffer(b"".join(data), np.uint8), spans


def layout(spans, n: int, length: int):
    """Of each byte: its span's number; and which starts have `length` bytes of the same record."""
    ends = np.array([s[2] for s in spans])
    begins = np.array([s[1] for s in spans])
    of = np.repeat(np.arange(len(spans)), ends - begins)
    inside = np.arange(n) + length <= ends[of]
    return begins, ends, of, inside


def anchors(contents: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Chosen windows of length // 4: row, position, hash, and the hashes of their extensions to the left and the right (0: none)."""
    k, out = length // 4, []
    for data, spans in parts(contents, length):
        begins, ends, of, inside = layout(spans, len(data), length)
        hashes = Hashes(data)
        p = np.unique(choices(hashes.all(k), length - k + 1, inside))
        b, e = begins[of[p]], ends[of[p]]
        left, right = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
        fits = p - k >= b
        left[fits] = hashes.at(p[fits] - k, 2 * k)
        fits = p + 2 * k <= e
        right[fits] = hashes.at(p[fits], 2 * k)
        rows, shift = np.array([s[0] for s in spans]), np.array([s[3] - s[1] for s in spans])
        out.append((rows[of[p]], p + shift[of[p]], hashes.at(p, k).view(np.int64), left.view(np.int64), right.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def windows(contents: list[bytes], alive: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """Windows of the whole length whose chosen window is alive (its position is in `alive` of the row): row, start, hash."""
    k, out = length // 4, []
    for data, spans in parts(contents, length):
        begins, ends, of, inside = layout(spans, len(data), length)
        hashes = Hashes(data)
        start = np.flatnonzero(inside[: len(data) - length + 1])
        chosen = choices(hashes.all(k), length - k + 1, inside)
        live = np.zeros(len(data) + 1, bool)
        for row, a, z, off in spans:
            at = np.asarray(alive[row]) - off + a
            live[at[(at >= a) & (at < z)]] = True
        start = start[live[chosen]]
        rows, shift = np.array([s[0] for s in spans]), np.array([s[3] - s[1] for s in spans])
        out.append((rows[of[start]], start + shift[of[start]], hashes.at(start, length).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def recurring(rows: DataFrame, h: str) -> DataFrame:
    """The values of h that occur in at least two contents."""
    two = rows.groupBy(h).agg(F.min("c1").alias("a"), F.max("c1").alias("b"), F.min("c2").alias("c"), F.max("c2").alias("d"))
    return two.where("a <> b or c <> d").select(h)


class Spans:
    """Spans of at least `length` bytes that occur in more than one record of `df`.

    Null contents and those shorter than `length` share nothing; repeated rows of a key are one record. Columns of `df` other
    than key and content are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "file_id", content: str = "content", length: int = 400):
        if length < 8 or length % 4:
            raise ValueError("length must be a multiple of 4")
        self.length = length
        rows = df.select(F.col(key).alias("k"), F.col(content).cast("binary").alias("content")).where(F.octet_length(content) >= length)
        self.rows = rows.withColumns({"c1": F.xxhash64("content"), "c2": F.xxhash64(F.lit(7), F.col("content"))})
        self.members = self.rows.select("k", "c1", "c2", F.octet_length("content").alias("bytes")).distinct()

    def anchors(self) -> DataFrame:
        length = self.length

        def run(it):
            for b in it:
                row, pos, h, left, right = anchors(b["content"].tolist(), length)
                yield pd.DataFrame({"c1": b["c1"].to_numpy()[row], "c2": b["c2"].to_numpy()[row], "p": pos.astype(np.int32), "h": h, "l": left, "r": right})

        return spread(self.rows.select("c1", "c2", "content")).mapInPandas(run, "c1 bigint, c2 bigint, p int, h bigint, l bigint, r bigint")

    def windows(self) -> DataFrame:
        """(h, c1, c2, start): the windows of the whole length that occur in at least two contents."""
        length, first = self.length, self.anchors()
        again = recurring(first, "h")
        kept = cut(may_match(first, F.col("h"), again, F.col("h")).join(again, "h", "left_semi"))
        sides = kept.select("c1", "c2", "p", F.explode(F.array("l", "r")).alias("h2")).where("h2 <> 0")
        sides = sides.join(recurring(sides, "h2"), "h2", "left_semi").groupBy("c1", "c2").agg(F.collect_set("p").alias("at"))
        one = self.members.groupBy("c1", "c2").agg(F.min("k").alias("k"))
        todo = cut(sides.join(one, ["c1", "c2"]).select("k", "at"))

        def run(it):
            for b in it:
                row, start, h = windows(b["content"].tolist(), b["at"].tolist(), length)
                out = pd.DataFrame({"h": h, "c1": b["c1"].to_numpy()[row], "c2": b["c2"].to_numpy()[row], "start": start.astype(np.int32)})
                yield out.drop_duplicates(["h", "c1", "c2", "start"])

        few = may_match(self.rows, F.col("k"), todo, F.col("k"))
        found = cut(few.join(todo, "k").select("c1", "c2", "content", "at").mapInPandas(run, "h bigint, c1 bigint, c2 bigint, start int"))
        shared = recurring(found, "h")
        return may_match(found, F.col("h"), shared, F.col("h")).join(shared, "h", "left_semi")

    def levels(self) -> DataFrame:
        """(k, longest): of each record that shares a span the greatest length * 2**i that some span shared with another content reaches.

        Windows repeated at one length alone are extended to twice that length: two that follow each other make one, told apart by
        both hashes, and only those that recur go on, until none survives. Contents are not read again.
        """
        length = self.length
        alive = cut(self.windows().select("c1", "c2", "start", "h").distinct())
        reached = [alive.groupBy("c1", "c2").agg(F.lit(length).alias("longest"))]
        while True:
            after = alive.select("c1", "c2", (F.col("start") - length).alias("start"), F.col("h").alias("next"))
            twice = alive.join(after, ["c1", "c2", "start"]).select("c1", "c2", "start", F.xxhash64("h", "next").alias("h"))
            length *= 2
            alive = cut(twice.join(recurring(twice, "h"), "h", "left_semi"))
            if alive.isEmpty():
                break
            reached.append(alive.groupBy("c1", "c2").agg(F.lit(length).alias("longest")))
        all_ = reached[0]
        for r in reached[1:]:
            all_ = all_.unionByName(r)
        return self.members.join(all_.groupBy("c1", "c2").agg(F.max("longest").alias("longest")), ["c1", "c2"]).select("k", "longest")

    def class_pairs(self, windows: DataFrame) -> DataFrame:
        """(a1, a2, b1, b2): pairs of different contents with a common span.

        Windows that occur in the same set of contents say the same, so of each set one window is joined; sets are told apart by
        count and two exclusive-or sums.
        """
        each = windows.select("h", "c1", "c2").distinct()
        sets = each.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor("c1").alias("x"), F.bit_xor("c2").alias("y"), F.bit_xor(F.xxhash64("c1", "c2")).alias("z"))
        each = each.join(sets.groupBy("n", "x", "y", "z").agg(F.min("h").alias("h")).select("h"), "h", "left_semi")
        a, b = each.select("h", F.col("c1").alias("a1"), F.col("c2").alias("a2")), each.select("h", F.col("c1").alias("b1"), F.col("c2").alias("b2"))
        return a.join(b, "h").where("a1 < b1 or (a1 = b1 and a2 < b2)").select("a1", "a2", "b1", "b2").distinct()

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all pairs of records with a common span."""
        m = self.members
        side = lambda x: m.select(F.col("k").alias(x), F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"))
        across = self.class_pairs(self.windows()).join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
        across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        twins = m.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1")
        copies = m.join(twins, ["c1", "c2"]).select("k", "c1", "c2")
        x, y = copies.select("c1", "c2", F.col("k").alias("a")), copies.select("c1", "c2", F.col("k").alias("b"))
        return across.unionByName(x.join(y, ["c1", "c2"]).where("a < b").select("a", "b"))

    def shared(self) -> DataFrame:
        """(k, bytes, shared_bytes, share): how much of each record of at least `length` bytes occurs in others."""
        length = self.length
        m = self.members
        starts = self.windows().groupBy("c1", "c2").agg(F.array_sort(F.collect_set("start")).alias("s"))
        covered = F.expr(f"aggregate(s, struct(0 as n, -{length} as last), (x, t) -> struct(x.n + least({length}, t - x.last) as n, t as last), x -> x.n)")
        size = m.groupBy("c1", "c2").agg(F.count("*").alias("copies"))
        out = m.join(size, ["c1", "c2"]).join(starts.select("c1", "c2", covered.alias("n")), ["c1", "c2"], "left")
        n = F.when(F.col("copies") > 1, F.col("bytes")).otherwise(F.coalesce("n", F.lit(0)))
        return out.select("k", "bytes", n.alias("shared_bytes"), (n / F.col("bytes")).alias("share"))
