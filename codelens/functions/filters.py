"""Bounded prefilters for joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 20


def may_match(df: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """Rows of `df` whose key may be among the keys: a bitmap of 2**20 hash bits, 200 KB whatever the input, is broadcast.

    Rows that match are never lost; the exact join follows, on what is left. With more keys than bits it keeps nearly all.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    one = keys.select(bit(other).alias("bit"))
    words = one.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")).alias("__bits"))
    named = df.withColumn("__bit", bit(key)).withColumn("__word", F.floor(F.col("__bit") / 64).cast("int"))
    hit = named.join(F.broadcast(words), "__word").where(F.expr("getbit(__bits, cast(pmod(__bit, 64) as int)) = 1"))
    return hit.drop("__word", "__bits", "__bit")
