"""Problem 9: mixing sources to target shares of all tokens.

Documents are aggregated by membership pattern (the set of listed sources they belong to; a document may belong to
several). A min-cost flow over patterns and sources, a graph whose size depends on the number of sources only, decides how
many tokens of each pattern go to each source: the r-th use of a pattern's tokens costs r - 1, so that repetition is
spread as thinly as possible (convex costs), and no source takes a pattern more than its max_repeats times. The total is
the given one or the largest at which all sources that have documents meet their quotas. Documents of a pattern, in a
seeded order, lie on a circle of the pattern's tokens; each source takes an arc, and a document is used once for
each time it lies on the arc. What is left open at an arc's end is filled with documents that fit and have uses left, the largest
first, at last one that exceeds it by less than is open: a source misses its quota by at most half of the smallest of them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.sources.checkpoints import cut

#: Documents of one bucket are ordered in one task.
DOCS_PER_BUCKET = 50_000
#: The flow is solved on the driver; the number of patterns is bounded by the sets of sources, and checked.
MAX_PATTERNS = 20_000


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> tuple[int, list[int]]:
    """Largest flow of least cost; arcs are (from, to, capacity, cost >= 0). Successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        graph[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    high, total = [0] * n, 0
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                v, nd = to[e], d + cost[e] + high[u] - high[to[e]]
                if cap[e] > 0 and nd < dist[v]:
                    dist[v], via[v] = nd, e
                    heapq.heappush(heap, (nd, v))
        if via[t] < 0:
            return total, [cap[2 * i + 1] for i in range(len(arcs))]
        high = [h + (d if d < float("inf") else 0) for h, d in zip(high, dist)]
        push, v = 1 << 62, t
        while v != s:
            push, v = min(push, cap[via[v]]), to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern for each source. patterns: tokens by membership; targets: share and max_repeats by source."""
    have = [p for p, tokens in patterns.items() if tokens > 0 and any(s in targets for s in p)]
    sources = sorted({s for p in have for s in p if s in targets and targets[s][0] > 0 and targets[s][1] > 0})
    if not sources:
        return {}

    def solve(whole: int):
        quota = {s: int(targets[s][0] * whole) for s in sources}
        at = {p: 2 + i for i, p in enumerate(have)} | {s: 2 + len(have) + i for i, s in enumerate(sources)}
        arcs, routed = [], []
        for p in have:
            uses = max((targets[s][1] for s in p if s in targets), default=0)
            arcs += [(0, at[p], patterns[p], r) for r in range(uses)]
            for s in p:
                if s in quota:
                    routed.append((len(arcs), p, s))
                    arcs.append((at[p], at[s], patterns[p] * targets[s][1], 0))
        arcs += [(at[s], 1, quota[s], 0) for s in sources]
        got, flow = min_cost_flow(2 + len(have) + len(sources), arcs, 0, 1)
        return got == sum(quota.values()), {(p, s): flow[i] for i, p, s in routed if flow[i]}

    if total is not None:
        return solve(total)[1]
    low, high = 0, int(min(sum(patterns[p] for p in have if s in p) * targets[s][1] / targets[s][0] for s in sources)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if solve(mid)[0] else (low, mid)
    return solve(low)[1]


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", sources: str = "source", size: str = "n_tokens", total: int | None = None, seed: int = 1) -> DataFrame:
    """(key, source, copies, n_tokens): which documents each source contributes and how often.

    `docs` has a size in tokens and a source, or an array of sources, per document; `targets` has source, target_share and
    max_repeats. Documents of no listed source, of null source, or without tokens stay out; repeated keys are separate
    documents; a listed source without documents contributes nothing, so the shares of the others grow in proportion.
    Equal sizes and hashes are ordered by the key.
    """
    spark = docs.sparkSession
    want = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None}
    listed = F.array(*[F.lit(s) for s in sorted(want)]) if want else F.array().cast("array<string>")
    has = F.col(sources) if docs.schema[sources].dataType.typeName() == "array" else F.array(sources)
    base = docs.select(F.col(key).alias("__k"), F.col(size).cast("bigint").alias("__n"), F.array_join(F.array_sort(F.array_intersect(F.array_compact(has), listed)), "\x1f").alias("__p")).where((F.col("__p") != "") & (F.col("__n") > 0))
    base = cut(base.withColumn("__h", F.xxhash64("__k", F.lit(seed))))
    sums = base.groupBy("__p").agg(F.sum("__n").alias("n"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    flow = route({tuple(r["__p"].split("\x1f")): r["n"] for r in sums}, want, total)
    arcs, start = [], {}
    for (p, s), f in sorted(flow.items()):
        a = start.get(p, 0)
        arcs.append(("\x1f".join(p), s, a, a + f))
        start[p] = a + f
    shape = [(r["__p"], r["n"], max(1, -(-r["docs"] // DOCS_PER_BUCKET))) for r in sums]
    out = f"`{key}` {docs.schema[key].dataType.simpleString()}, source string, copies int, n_tokens bigint"
    if not arcs:
        return spark.createDataFrame([], out)
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731  at most MAX_PATTERNS rows
    b = base.join(small(shape, "__p string, __len bigint, __b int"), "__p").withColumn("__bucket", F.pmod(F.shiftright("__h", 20), F.col("__b")).cast("int"))
    before = b.groupBy("__p", "__bucket").agg(F.sum("__n").alias("__sum"))
    before = before.withColumn("__base", F.sum("__sum").over(Window.partitionBy("__p").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__sum")
    w = Window.partitionBy("__p", "__bucket").orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("__in", F.coalesce(F.sum("__n").over(w), F.lit(0))).join(before, ["__p", "__bucket"]).withColumn("__at", F.coalesce("__base", F.lit(0)) + F.col("__in"))
    # uses of a document: multiples k with from <= at + k * len and at + k * len + n <= to
    b = b.join(small(arcs, "__p string, source string, __from bigint, __to bigint"), "__p")
    b = b.withColumn("copies", F.greatest(F.floor((F.col("__to") - F.col("__n") - F.col("__at")) / F.col("__len")) - F.ceil((F.col("__from") - F.col("__at")) / F.col("__len")) + 1, F.lit(0)).cast("int"))
    b = cut(b.select("__p", "__k", "__h", "__n", "__at", "__len", "source", "copies"))
    used = {(r["__p"], r["source"]): r["n"] for r in b.groupBy("__p", "source").agg(F.sum(F.col("__n") * F.col("copies")).alias("n")).collect()}
    gaps = [(p, s, z - a - used.get((p, s), 0), max(want[x][1] for x in p.split("\x1f")), want[s][1]) for p, s, a, z in arcs]
    extra = _fill(b, small(gaps, "__p string, source string, __gap bigint, __uses int, __most int"), {(p, s): g for p, s, g, _, _ in gaps})
    if extra:
        more = small(extra, f"__p string, source string, __at bigint, __k {docs.schema[key].dataType.simpleString()}, __one int")
        b = b.join(more, ["__p", "source", "__at", "__k"], "left").withColumn("copies", F.col("copies") + F.coalesce("__one", F.lit(0)))
    return b.where("copies > 0").select(F.col("__k").alias(key), "source", "copies", F.col("__n").alias("n_tokens"))


#: Of the documents that may fill an arc's end so many of each power of two of tokens come to the driver, by hash.
FILLERS = 16


def _fill(b: DataFrame, gaps: DataFrame, left: dict[tuple[str, str], int]) -> list[tuple]:
    """(pattern, source, place, key, 1) of the documents that fill what is left of each arc: those with uses left in
    this source and in all. Their number is bounded by arcs, powers of two and FILLERS."""
    total = F.sum("copies").over(Window.partitionBy("__p", "__at", "__k"))
    c = b.join(gaps, ["__p", "source"]).withColumn("__total", total).where((F.col("__n") < 2 * F.col("__gap")) & (F.col("__total") < F.col("__uses")) & (F.col("copies") < F.col("__most")))
    w = Window.partitionBy("__p", "source", F.floor(F.log2("__n"))).orderBy("__h", "__k", "__at")
    rows = c.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= FILLERS).select("__p", "source", "__at", "__k", "__n").collect()
    left, taken, out = dict(left), set(), []
    order = sorted(rows, key=lambda r: (-r["__n"], r["__at"]))
    for r, over in [(r, False) for r in order] + [(r, True) for r in order[::-1]]:  # at last one that misses by less on the other side
        at, place = (r["__p"], r["source"]), (r["__p"], r["__at"], r["__k"])
        if (r["__n"] < 2 * left[at] if over else r["__n"] <= left[at]) and place not in taken:
            left[at] -= r["__n"]
            taken.add(place)
            out.append((r["__p"], r["source"], r["__at"], r["__k"], 1))
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each listed source: target_share, documents, tokens and actual_share of the mixture, and its most used document's uses."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_uses"))
    got = targets.join(F.broadcast(got), "source", "left").fillna(0, ["documents", "tokens", "most_uses"])  # one row per source
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return got.select("source", "target_share", "max_repeats", "documents", "tokens", "most_uses", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"))
