"""Clone detection: tokens, normalisation, shingles, MinHash with banding, groups and summaries.

The hash family is portable: h_i(x) = (a_i * x + b_i) mod (2**31 - 1) over the first seven hex digits of a shingle's md5, so any engine
can recompute signatures. Identical fragments are folded into one before any pairing.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import stats
from codelens.operators.graphs import connected_components
from codelens.sources.checkpoints import cut

TOKEN = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\d[\w.]*|[A-Za-z_][A-Za-z0-9_]*|===|!==|\*\*=|<<=|>>=|->|=>|::|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|\+=|-=|\*=|/=|:=|[^\sA-Za-z0-9_])"""
#: Words that normalisation keeps.
KEYWORDS = "if else for while do switch case default return break continue fn func def function class struct enum impl trait pub let mut const var static void int import from use package public private protected new try catch finally throw async await match in of end then elif with as yield lambda true false null None True False self this".split()
PRIME = 2147483647
HASHES, BANDS, ROWS = 200, 20, 10


def _seeds(n: int) -> list[tuple[int, int]]:
    r = random.Random(20240613)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


SEEDS = _seeds(HASHES)


def tokens(text: Column) -> Column:
    """TXT-14: strings, numbers, identifiers and operators in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def normalised(toks: Column) -> Column:
    """TXT-15: literals as LITERAL, identifiers as VAR_k by first appearance, keywords and operators kept."""
    word = lambda x: x.rlike("^[A-Za-z_]") & ~x.isin(KEYWORDS)
    kind = lambda names: lambda x: F.when(x.rlike("^[\"'0-9]"), F.lit("LITERAL")).when(word(x), F.concat(F.lit("VAR_"), F.array_position(names, x) - 1)).otherwise(x)
    both = F.struct(toks.alias("t"), F.array_distinct(F.filter(toks, word)).alias("n"))
    return stats.let(both, lambda b: F.transform(b["t"], kind(b["n"])))


def shingles(toks: Column, k: int = 5) -> Column:
    """TXT-17: the set of k adjacent tokens, joined; one for a shorter sequence, none for an empty one."""
    part = lambda t: lambda i: F.concat_ws("", F.slice(t, i, k))
    many = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), part(t)))
    return stats.let(toks, lambda t: F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(many(t)))


def base_hash(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint")


def signature(sh: Column) -> Column:
    """ML-1: the least of each hash over the shingles."""
    a, b = F.array(*[F.lit(s[0]).cast("bigint") for s in SEEDS]), F.array(*[F.lit(s[1]).cast("bigint") for s in SEEDS])
    least = lambda x: lambda p, q: F.array_min(F.transform(x, lambda v: (p * v + q) % PRIME))
    return stats.let(F.transform(sh, base_hash), lambda x: F.zip_with(a, b, least(x)))


def fragments(df: DataFrame, key: str, text: str, least_tokens: int = 50) -> DataFrame:
    """ML-2: (frag, fp, n_tokens, toks): fragments of enough tokens and the fingerprint of their normalised tokens."""
    t = df.where(F.col(text).isNotNull()).select(F.col(key).alias("frag"), tokens(F.col(text)).alias("raw")).where(F.size("raw") >= least_tokens)
    t = t.select("frag", normalised(F.col("raw")).alias("toks"))
    return t.select("frag", F.md5(F.concat_ws(" ", "toks")).alias("fp"), F.size("toks").alias("n_tokens"), "toks")


def signatures(frags: DataFrame) -> DataFrame:
    """(fp, sig): one signature for each distinct fragment."""
    one = frags.groupBy("fp").agg(F.first("toks").alias("toks"))
    return one.select("fp", signature(shingles(F.col("toks"))).alias("sig"))


def candidates(sigs: DataFrame) -> DataFrame:
    """JOI-12: distinct pairs (a < b) that share a band; the equi-join on (band, hash) is split by adaptive execution if skewed."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.concat_ws(",", F.slice("sig", i * ROWS + 1, ROWS))).alias("h")))
    b = sigs.select("fp", F.explode(bands).alias("x")).select("fp", "x.band", "x.h")
    busy = b.groupBy("band", "h").agg(F.min("fp").alias("l"), F.max("fp").alias("g")).where("l <> g").select("band", "h")
    b = b.join(busy, ["band", "h"], "left_semi")
    return b.select("band", "h", F.col("fp").alias("a")).join(b.select("band", "h", F.col("fp").alias("b")), ["band", "h"]).where("a < b").select("a", "b").distinct()


def similar(sigs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """JOI-13: candidate pairs of at least the threshold's share of equal slots."""
    c = candidates(sigs).join(sigs.select(F.col("fp").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("fp").alias("b"), F.col("sig").alias("sb")), "b")
    s = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / HASHES
    return c.select("a", "b", s.alias("similarity")).where(F.col("similarity") >= threshold)


def clone_type(s: Column) -> Column:
    return stats.ladder(s, [(0.95, "type1"), (0.85, "type2")], "type3")


def groups(frags: DataFrame, pairs: DataFrame) -> DataFrame:
    """GRA-5 and AGG-25: (frag, class, links): each fragment's clone class (its least fingerprint) and links of its fingerprint.

    Fragments of one fingerprint are one member; classes of a single fragment are left out.
    """
    ids = cut(frags.select("frag", "fp", "n_tokens"))
    e = pairs.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))
    nodes = ids.select(F.xxhash64("fp").alias("src"), F.xxhash64("fp").alias("dst")).distinct()
    comp = connected_components(e.union(nodes))
    links = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count("*").alias("links"))
    m = ids.join(comp, F.xxhash64("fp") == comp["node"]).join(links, "fp", "left").fillna(0, ["links"])
    size = m.groupBy("component").agg(F.count("*").alias("members"), F.min("fp").alias("class")).where("members > 1")
    return m.join(size, "component").select("frag", "fp", "class", "members", "links", "n_tokens")
