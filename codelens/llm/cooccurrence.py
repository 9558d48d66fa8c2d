"""Problem 7: items that appear together, and how much more often than chance.

Items are made distinct per basket, ordered pairs are emitted per basket and counted with map-side combine; lift and
pointwise mutual information come from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.filters import may_match

#: Words of hash slots by which a basket's distinct items are bounded from below before any basket is gathered; more for larger limits.
SLOT_WORDS = 4


def pair_counts(
    df: DataFrame, basket: str, item: str, known: DataFrame | None = None, most_items: int = 100, least_pairs: int = 1, least_ratio: float = 0.0
) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n, lift, pmi) of the pairs in at least `least_pairs` baskets.

    Null baskets and items are left out, repeated rows count once; `known` restricts the baskets to those it has (any number
    of times). Baskets of more than `most_items` distinct items are left out altogether. item_a < item_b.
    `least_ratio` keeps pairs with n_ab / max(n_a, n_b) of at least so much. Both limits are exact and are used early: an item
    of fewer than `least_pairs` baskets, and a pair whose marginals alone exceed the ratio, need no counting.
    An oversized basket is recognised by a bitmap of item hashes, combined on the map side, so it is never gathered.
    """
    rows = df.select(F.col(basket).alias("b"), F.col(item).alias("i")).where(F.col("b").isNotNull() & F.col("i").isNotNull())
    # of the slots, twice as many as items at least, more than most_items are taken: surely too many items, whatever their number
    words = max(SLOT_WORDS, -(-most_items // 32))
    busy = rows.groupBy(F.xxhash64("b").alias("hb")).agg(F.count("*").alias("k")).where(F.col("k") > most_items).select("hb")
    slot, bit = F.pmod(F.xxhash64("i"), F.lit(64 * words)), F.expr("shiftleft(1L, cast(pmod(xxhash64(i), 64) as int))")
    bits = [F.bit_or(F.when(F.floor(slot / 64) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(words)]
    taken = sum((F.bit_count(f"w{w}") for w in range(words)), F.lit(0))
    huge = may_match(rows, F.xxhash64("b"), busy, F.col("hb")).groupBy("b").agg(*bits).where(taken > most_items).select("b")
    rows = rows.join(huge, "b", "left_anti")
    if known is not None:
        rows = rows.join(known.select(F.col(basket).alias("b")).distinct(), "b", "left_semi")
    baskets = rows.groupBy("b").agg(F.collect_set("i").alias("items")).where(F.size("items") <= most_items)
    n = baskets.agg(F.count("*")).scalar()
    short = lambda c: F.unhex(F.md5(F.col(c).cast("string")))  # noqa: E731  16 bytes stand for a basket or an item between shuffles
    single = baskets.select(short("b").alias("b"), F.explode("items").alias("i"))
    marginal = single.groupBy("i").agg(F.count("*").alias("k")).where(F.col("k") >= least_pairs)
    kept = single.join(marginal, "i").groupBy("b").agg(F.array_sort(F.collect_list(F.struct(short("i").alias("i"), F.col("k")))).alias("items")).where(F.size("items") > 1)
    pairs = F.expr(
        "flatten(transform(items, (x, p) -> transform(filter(slice(items, p + 2, size(items)), y -> "
        f"least(x.k, y.k) >= {least_ratio!r}D * greatest(x.k, y.k)), y -> struct(x.i as i, y.i as j, x.k as k, y.k as l))))"
    )
    counts = kept.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j", "p.k", "p.l").agg(F.count("*").alias("n_ab"))
    counts = counts.where((F.col("n_ab") >= least_pairs) & (F.col("n_ab") / F.greatest("k", "l") >= least_ratio))
    names = marginal.select(short("i").alias("h"), F.col("i").alias("name"))
    counts = counts.join(names.toDF("i", "x"), "i").join(names.toDF("j", "y"), "j")
    counts = counts.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), *[F.when(F.col("x") < F.col("y"), u).otherwise(v).alias(n) for u, v, n in ((F.col("k"), F.col("l"), "n_a"), (F.col("l"), F.col("k"), "n_b"))], "n_ab").withColumn("n", n)
    lift = F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b"))
    return counts.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
