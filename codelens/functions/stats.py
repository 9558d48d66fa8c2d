"""Statistics with the reference semantics, written so that no group of rows is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges into which an order is cut for running sums; balance depends on it, never the result.
RANGES = 128


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], nulls: bool = True) -> DataFrame:
    """`df` with, for each name of `sums`, the sum of its column over all rows of the same keys up to and including this one in
    the given order, which must be total within the keys, and with `<name>_all`, the sum over all rows of the keys.

    No group is gathered in one task, however large: the order is cut into ranges at the values with the least hashes (a uniform
    sample that is the same however often the plan is run), sums of ranges are combined on the map side, and rows are sorted
    within (keys, range) only. A group has at most RANGES + 1 sums, so the window over them is bounded. Null keys are a group;
    without `nulls` there are none, and rows stay where they were sorted.
    """
    at = F.struct(*order)
    few = df.select(at.alias("__at")).orderBy(F.xxhash64(*[F.col(f"__at.{c}") for c in order]), "__at").limit(RANGES)
    ends = few.agg(F.array_sort(F.collect_set("__at")).alias("__ends"))  # RANGES rows at most
    x = df.join(F.broadcast(ends)).withColumn("__range", F.size(F.filter("__ends", lambda e: e < at))).drop("__ends")
    x = x.select("*", *[v.alias(f"__{n}") for n, v in sums.items()])
    by = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = by.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    t = x.groupBy(*keys, "__range").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    t = t.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__range").alias("__at_range"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums], *[F.sum(f"__{n}").over(by).alias(f"{n}_all") for n in sums])
    local = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    y = x.select("*", *[F.sum(f"__{n}").over(local).alias(n) for n in sums])
    on = F.col("__range") == F.col("__at_range")
    for k in keys:
        same = F.col(k).eqNullSafe if nulls else F.col(k).__eq__
        on = on & same(F.col(f"__key_{k}"))
    j = y.join(t if keys else F.broadcast(t), on)
    return j.select(*df.columns, *[(F.col(n) + F.col(f"__before_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    h = df.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    return running(h, keys, ["v"], {"upto": F.col("c")}).withColumnRenamed("upto_all", "n")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(v, c, upto, n): each distinct value but null, its count, the count of values up to it, and of all.

    Rows are counted per value with map-side combine first; distinct values are ranked within ranges (`running`).
    """
    return _counted(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), [])


def percentiles(df: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row: the element at index round(p * (n - 1)) of the sorted values for each wanted p; 0 where there are none (AGG-7)."""
    h = histogram(df, value)
    at = lambda p: F.round(F.lit(p) * (F.col("n") - 1)) + 1
    return h.agg(*[F.coalesce(F.min(F.when(F.col("upto") >= at(p), F.col("v"))), F.lit(0)).alias(name) for name, p in wanted.items()])


def percentile_of_each(df: DataFrame, values: dict[str, Column], p: float) -> DataFrame:
    """One row: for each named value what `percentiles` gives, all counted and ranked in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in values.items()])).alias("x")).select("x.*")
    h = _counted(long.where("v is not null"), ["k"])
    hit = F.col("upto") >= F.round(F.lit(p) * (F.col("n") - 1)) + 1
    return h.agg(*[F.coalesce(F.min(F.when((F.col("k") == k) & hit, F.col("v"))), F.lit(0.0)).alias(k) for k in values])


def mid_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """`df` with 100 * (below + 0.5 * equal) / n of the value among all rows that have one (WIN-1); others are left out."""
    h = histogram(df, value).select(F.col("v").alias(value), (100 * (F.col("upto") - F.col("c") + 0.5 * F.col("c")) / F.col("n")).alias(name))
    return df.join(h, value)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: inside lambdas a column is computed for each element otherwise."""
    return F.transform(F.array(value), body)[0]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_normalize(v: Column, most: Column) -> Column:
    """0 if the maximum isn't positive, 1 from the maximum on, else the quotient."""
    return F.when(most <= 0, 0.0).when(v >= most, 1.0).otherwise(v / most)


def ladder(x: Column, steps: list[tuple[float, object]], last: object, strict: bool = False) -> Column:
    """The label of the first step that x reaches (exceeds, if strict)."""
    out = None
    for least, label in steps:
        hit = x > least if strict else x >= least
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def interpolate(x: Column, table: list[tuple[float, float]]) -> Column:
    """Piecewise-linear interpolation, constant beyond both ends (AGG-16)."""
    out = F.when(x <= table[0][0], float(table[0][1]))
    for (x0, y0), (x1, y1) in zip(table, table[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * (y1 - y0) / (x1 - x0))
    return out.otherwise(float(table[-1][1]))


#: Lower bounds of grades.
GRADES = [(97.0, "A+"), (93.0, "A"), (90.0, "A-"), (87.0, "B+"), (83.0, "B"), (80.0, "B-"), (77.0, "C+"), (73.0, "C"), (70.0, "C-"), (60.0, "D")]
LETTERS = [(90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D")]


def grade(x: Column) -> Column:
    return ladder(x, GRADES, "F")


def letter(x: Column) -> Column:
    return ladder(x, LETTERS, "F")
