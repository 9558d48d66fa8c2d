"""Scores of quality: defect probability, debt gradient, component scores, composite and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import stats

#: Cumulative distributions and weights of the defect model.
CDF = {
    "churn": [(0, 0), (0.1, 0.05), (0.2, 0.15), (0.3, 0.30), (0.4, 0.50), (0.5, 0.70), (0.6, 0.85), (0.7, 0.93), (0.8, 0.97), (1, 1)],
    "complexity": [(1, 0.1), (2, 0.2), (3, 0.3), (5, 0.5), (7, 0.7), (10, 0.8), (15, 0.9), (20, 0.95), (30, 0.98), (50, 1)],
    "coupling": [(0, 0.1), (1, 0.3), (2, 0.5), (3, 0.7), (5, 0.8), (8, 0.9), (12, 0.95), (20, 1)],
    "ownership": [(1, 0.1), (2, 0.3), (3, 0.5), (5, 0.7), (8, 0.85), (12, 0.95), (20, 1)],
}
DEFECT_WEIGHTS = {"churn": 0.30, "duplication": 0.25, "complexity": 0.20, "coupling": 0.10, "ownership": 0.15}


def defect_inputs(files: DataFrame, git: DataFrame, complexity: DataFrame, duplication: DataFrame, coupling: DataFrame) -> DataFrame:
    """JOI-2: each file with what is known of it; missing complexity is estimated from its lines as min(loc / 30, 50)."""
    j = files.select("path", "loc").join(git.select("path", "churn", "contributors"), "path", "left").join(complexity.select("path", "complexity"), "path", "left")
    j = j.join(duplication.select("path", "duplication"), "path", "left").join(coupling.select("path", "coupling"), "path", "left")
    return j.select(
        "path", "loc", F.coalesce("churn", F.lit(0.0)).alias("churn"), F.coalesce("contributors", F.lit(1)).alias("contributors"), F.col("complexity").isNull().alias("estimated"),
        F.coalesce(F.col("complexity").cast("double"), F.least(F.col("loc") / 30, F.lit(50.0))).alias("complexity"), F.coalesce("duplication", F.lit(0.0)).alias("duplication"), F.coalesce("coupling", F.lit(0)).alias("coupling"))


def defect_probability(inputs: DataFrame) -> DataFrame:
    """AGG-15 to AGG-17: sigmoid of the weighted distribution values, confidence, risk band (0.7 and 0.3)."""
    w = DEFECT_WEIGHTS
    x = (
        w["churn"] * stats.interpolate(F.col("churn"), CDF["churn"]) + w["duplication"] * stats.clamp(F.col("duplication")) + w["complexity"] * stats.interpolate(F.col("complexity"), CDF["complexity"])
        + w["coupling"] * stats.interpolate(F.col("coupling"), CDF["coupling"]) + w["ownership"] * stats.interpolate(F.col("contributors"), CDF["ownership"])
    )
    p = 1 / (1 + F.exp(-10 * (x - 0.5)))
    c = F.when(F.col("loc") < 10, 0.5).when(F.col("loc") < 50, 0.8).otherwise(1.0) * F.when(F.col("churn") == 0, 0.85).otherwise(1.0) * F.when(F.col("estimated"), 0.85).otherwise(1.0)
    return inputs.select("path", x.alias("raw"), p.alias("probability"), c.alias("confidence"), stats.ladder(p, [(0.7, "high"), (0.3, "medium")], "low").alias("risk"))


def coupling_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-19: afferent and efferent edges of each node."""
    ca, ce = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("afferent")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("efferent"))
    return nodes.select("node").join(ca, "node", "left").join(ce, "node", "left").fillna(0)


#: Greatest points of the parts of the debt gradient.
TDG_MAX = {"structural": 20, "semantic": 15, "duplication": 15, "coupling": 15, "documentation": 5, "consistency": 10, "hotspot": 10, "temporal": 10}


def tdg_parts(m: DataFrame) -> DataFrame:
    """Points of each part from a file's lexical measures (cyclomatic, nesting, dup_ratio, imports, doc_coverage, indent_share,
    and hotspot, cochanges, both null where unknown: full points, JOI-3)."""
    cyc, nest = F.col("cyclomatic"), F.col("nesting")
    structural = 20 - F.when(cyc > 30, F.least(cyc - 30, F.lit(15)) * 0.5).otherwise(0.0)
    semantic = 15 - F.when(nest > 4, F.least(nest - 4, F.lit(10)) * 1.0).otherwise(0.0)
    duplication = 15 - F.when(F.col("dup_ratio") > 0.1, F.least(20 * F.col("dup_ratio"), F.lit(20.0))).otherwise(0.0)
    coupling = 15 - F.when(F.col("imports") > 20, F.least((F.col("imports") - 20) * 0.2, F.lit(10.0))).otherwise(0.0)
    most = m.agg(F.max("cochanges").alias("most"))
    return m.join(F.broadcast(most)).select(
        "path", "language", "critical", structural.alias("structural"), semantic.alias("semantic"), duplication.alias("duplication"), coupling.alias("coupling"), (F.col("doc_coverage") * 5).alias("documentation"),
        (F.col("indent_share") * 10).alias("consistency"), F.coalesce(10 * (1 - F.col("hotspot")), F.lit(10.0)).alias("hotspot"),
        F.coalesce(10 * (1 - F.col("cochanges") / F.when(F.col("most") > 0, F.col("most"))), F.lit(10.0)).alias("temporal"))


def tdg_total(parts: DataFrame) -> DataFrame:
    """AGG-32 and AGG-33: clamped parts added up, scaled by 110 where above 100; a critical defect scores 0."""
    raw = sum((stats.clamp(F.col(k), 0.0, float(v)) for k, v in TDG_MAX.items()), F.lit(0.0))
    total = F.when(F.col("critical") > 0, 0.0).otherwise(F.when(raw > 100, raw / 110 * 100).otherwise(raw))
    return parts.withColumn("total", total).withColumn("grade", F.when(F.col("critical") > 0, "F").otherwise(stats.grade(total)))


def tdg_project(scored: DataFrame) -> DataFrame:
    """AGG-34: mean score, files and grade of each language."""
    p = scored.groupBy("language").agg(F.count("*").alias("files"), F.avg("total").alias("mean"))
    return p.withColumn("grade", stats.grade(F.col("mean")))


def _pieces(x: Column, steps: list[tuple[float, Column]], last: Column) -> Column:
    out = None
    for most, value in steps:
        out = F.when(x <= most, value) if out is None else out.when(x <= most, value)
    return F.greatest(out.otherwise(last), F.lit(0.0))


def component_score(component: str, x: Column, y: Column | None = None) -> Column:
    """AGG-35: the score of one component from its measure."""
    if component == "complexity":
        return _pieces(x, [(10, 100 - x), (20, 70 + 2 * (20 - x)), (40, 50 + (40 - x))], 50 - (x - 40))
    if component == "deadcode":
        return _pieces(x, [(0, F.lit(100.0)), (5, 90 - 2 * x), (20, 80 - 2 * (x - 5))], 50 - (x - 20))
    if component == "churn":
        return _pieces(x, [(0.1, F.lit(100.0)), (0.3, 80 + 100 * (0.3 - x)), (0.5, 60 + 100 * (0.5 - x)), (0.8, 40 + 66.67 * (0.8 - x))], 40 - 50 * (x - 0.8))
    if component == "duplication":
        return _pieces(x, [(0, F.lit(100.0)), (0.05, 90 + 200 * (0.05 - x)), (0.1, 70 + 400 * (0.1 - x)), (0.2, 50 + 200 * (0.2 - x))], 50 - 100 * (x - 0.2))
    if component == "cohesion":
        return _pieces(x, [(1, F.lit(100.0)), (2, 80 + 20 * (2 - x)), (5, 50 + 10 * (5 - x))], 50 - 5 * (x - 5))
    if component == "ownership":  # x: bus factor, y: share of silos
        bus = F.when(x <= 1, 20.0).when(x <= 3, 35.0).when(x <= 5, 45.0).otherwise(50.0)
        return F.greatest(bus + _pieces(y, [(0.1, F.lit(50.0)), (0.3, 30 + 100 * (0.3 - y)), (0.5, 10 + 100 * (0.5 - y))], 10 - 20 * (y - 0.5)), F.lit(0.0))
    if component == "defect":
        return _pieces(x, [(0.1, F.lit(100.0)), (0.3, 80 + 100 * (0.3 - x)), (0.5, 60 + 100 * (0.5 - x)), (0.7, 40 + 100 * (0.7 - x))], 40 - 100 * (x - 0.7))
    if component == "satd":
        return _pieces(x, [(0, F.lit(100.0)), (0.1, 90 + 100 * (0.1 - x)), (0.5, 70 + 50 * (0.5 - x)), (1, 50 + 40 * (1 - x))], 50 - 10 * (x - 1))
    if component == "smells":  # x: weighted density
        return 100 * F.exp(-2.5 * x)
    if component == "tdg":
        return stats.clamp(x, 0.0, 100.0)
    raise ValueError(component)


def coupling_score(cycles: Column, mean_degree: Column, max_degree: Column, share_high: Column) -> Column:
    """AGG-35 for coupling: cycles, mean and greatest degree, share of nodes of degree above 10."""
    degree = F.when(mean_degree <= 2, 35.0).when(mean_degree <= 5, 20 + 5 * (5 - mean_degree)).when(mean_degree <= 10, 5 + 3 * (10 - mean_degree)).otherwise(5 - (mean_degree - 10))
    d = max_degree
    penalty = F.least(F.when(d <= 10, 0.0).when(d <= 30, 0.3 * (d - 10)).when(d <= 80, 6 + 0.2 * (d - 30)).otherwise(16 + 0.1 * (d - 80)), F.lit(20.0))
    hubs = 30 - penalty - F.least(100 * share_high, F.lit(10.0))
    return F.greatest(F.greatest(35 - 5 * cycles, F.lit(0.0)) + F.greatest(degree, F.lit(0.0)) + F.greatest(hubs, F.lit(0.0)), F.lit(0.0))


#: Weights of the composite.
SCORE_WEIGHTS = {"complexity": 1.0, "duplication": 0.8, "cohesion": 0.6, "tdg": 0.6, "satd": 0.4, "coupling": 0.4, "smells": 0.2, "deadcode": 0.0, "churn": 0.0, "defect": 0.0, "ownership": 0.0}


def composite(components: DataFrame, groups: list[str]) -> DataFrame:
    """AGG-36: weighted mean of the available components (component, score; null: skipped), 100 if none; critical below 50."""
    w = F.lit(0.0)
    for k, v in SCORE_WEIGHTS.items():
        w = F.when(F.col("component") == k, v).otherwise(w)
    c = components.withColumn("w", F.when(F.col("score").isNotNull(), w).otherwise(0.0))
    a = c.groupBy(*groups).agg(F.sum(F.col("score") * F.col("w")).alias("sw"), F.sum("w").alias("w"), F.count_if(F.col("score") < 50).alias("critical"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("score").isNull(), F.col("component")))), ",").alias("skipped"))
    s = F.when(F.col("w") > 0, F.col("sw") / F.col("w")).otherwise(100.0)
    return a.select(*groups, s.alias("score"), stats.letter(s).alias("grade"), "critical", "skipped")


def regression(points: DataFrame, y: str, groups: list[str], order: list[str]) -> DataFrame:
    """AGG-37, AGG-38 and WIN-10: line through the values at positions 0, 1, ... in order; r2 of a flat series is 0.

    Points are samples of a trend, a few per group.
    """
    w = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    x = points.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    a = x.groupBy(*groups).agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col("x")).alias("slope"), F.regr_intercept(F.col(y), F.col("x")).alias("intercept"), F.when(F.var_pop(y) == 0, 0.0).otherwise(F.regr_r2(F.col(y), F.col("x"))).alias("r2"))
    return a.withColumn("correlation", F.sqrt("r2"))


def sample_grid(commits: DataFrame, samples: int) -> DataFrame:
    """WIN-8 and WIN-7: `samples` times evenly over the commits' time, whole seconds, with the one before (0 for the first)."""
    b = commits.agg(F.unix_timestamp(F.min("ts")).alias("a"), F.unix_timestamp(F.max("ts")).alias("z"))
    g = b.select("a", "z", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    g = g.select("i", (F.col("a") + F.floor((F.col("z") - F.col("a")) * F.col("i") / (samples - 1))).alias("t"))
    return g.withColumn("before", F.lag("t", 1, 0).over(Window.orderBy("i")))


def as_of(grid: DataFrame, commits: DataFrame) -> DataFrame:
    """JOI-8: the latest commit (by time and sha) up to each sample; samples of the same commit keep the first.

    Commits are assigned to the first sample that sees them, reduced to one per sample with map-side combine, and carried on.
    """
    seen = _bucket(grid, commits).groupBy("i").agg(F.max(F.struct("ts", "sha")).alias("last"))
    w = Window.orderBy("i")
    g = grid.join(F.broadcast(seen), "i", "left").withColumn("last", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))  # one row per sample
    g = g.where("last is not null").select("i", "t", F.col("last.sha").alias("sha")).withColumn("p", F.lag("sha").over(w))
    return g.where("p is null or p <> sha").drop("p")


def _bucket(grid: DataFrame, commits: DataFrame) -> DataFrame:
    """Each commit with the sample whose window (before, t] holds it; the grid is a row per sample, so it fits one array."""
    ends = grid.agg(F.array_sort(F.collect_list(F.struct("t", "i"))).alias("ends"))
    c = commits.select("sha", "ts", "message").join(F.broadcast(ends))
    hit = F.expr("filter(ends, e -> e.t >= unix_timestamp(ts))")
    return c.withColumn("h", hit).where(F.size("h") > 0).select("sha", "ts", "message", F.col("h")[0]["i"].alias("i"))


def window_messages(grid: DataFrame, commits: DataFrame, k: int = 5) -> DataFrame:
    """JOI-9: the k latest messages of each sample's window."""
    w = Window.partitionBy("i").orderBy(F.desc("ts"), F.desc("sha"))
    return _bucket(grid, commits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "rank", "sha", "message")
