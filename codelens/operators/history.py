"""Change-history operators: churn, co-change, ownership, just-in-time risk, hotspots, flags.

Inputs are tables of commits (sha, author, ts, ...), file changes (sha, path, additions, deletions) and line authorship (path,
author, lines). Nulls in keys are left out by the joins; repeated rows count as often as they occur unless stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import stats
from codelens.sources.checkpoints import cut


def file_churn(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """AGG-1: commits, authors, added and deleted lines, first and last time of each path."""
    j = changes.join(commits.select("sha", "author", "ts"), "sha")
    return j.groupBy("path").agg(
        F.count("*").alias("commits"), F.count_distinct("author").alias("authors"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def churn_scores(churn: DataFrame) -> DataFrame:
    """AGG-2: 0.6 * commits / most commits + 0.4 * changed lines / most, over the global maxima (one row, broadcast)."""
    lines = F.col("additions") + F.col("deletions")
    top = churn.agg(F.max("commits").alias("mc"), F.max(lines).alias("ml"))
    s = F.when(F.col("mc") > 0, 0.6 * F.least(F.col("commits") / F.col("mc"), F.lit(1.0))).otherwise(0.0) + F.when(F.col("ml") > 0, 0.4 * F.least(lines / F.col("ml"), F.lit(1.0))).otherwise(0.0)
    return churn.join(F.broadcast(top)).withColumn("churn_score", s).drop("mc", "ml")


def relative_churn(churn: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-3: churn per line of code and per active day (whole periods of 24 hours, one at least)."""
    days = F.greatest(F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / 86400), F.lit(1))
    j = churn.join(files.select("path", "loc"), "path").withColumn("days_active", days).withColumn("relative_churn", F.try_divide(F.col("additions") + F.col("deletions"), "loc"))
    return j.withColumn("churn_rate", F.col("relative_churn") / F.col("days_active")).withColumn("change_frequency", F.col("commits") / F.col("days_active"))


def churn_statistics(scored: DataFrame) -> DataFrame:
    """AGG-4: mean, population variance and deviation, p50 and p95 of the score (rounded to 6 digits before ranking)."""
    s = scored.select(F.round("churn_score", 6).alias("s"))
    return s.agg(F.avg("s").alias("mean"), F.var_pop("s").alias("variance"), F.stddev_pop("s").alias("stddev")).join(F.broadcast(stats.percentiles(s, "s", {"p50": 0.5, "p95": 0.95})))


def author_contributions(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """AGG-5: touches of files by each author."""
    return changes.join(commits.select("sha", "author"), "sha").groupBy("author").agg(F.count("*").alias("touches"), F.count_distinct("path").alias("files"))


def cochange(changes: DataFrame, least: int = 3, most_files: int = 100) -> DataFrame:
    """JOI-4 and AGG-21: pairs of paths in the same commits; strength = min(1, together / max of both commits).

    Commits of more than `most_files` paths make no pairs but count in each path's commits. Paths are distinct per commit, so
    a commit's array is bounded; pairs are counted with map-side combine.
    """
    one = changes.select("sha", "path").distinct()
    alone = one.groupBy("path").agg(F.count("*").alias("n"))
    small = one.groupBy("sha").agg(F.count("*").alias("k")).where(F.col("k").between(2, most_files)).select("sha")
    baskets = one.join(small, "sha").groupBy("sha").agg(F.array_sort(F.collect_list("path")).alias("p"))
    pairs = baskets.select(F.explode(F.expr("flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> struct(x as path_a, y as path_b))))")).alias("q"))
    counts = pairs.groupBy("q.path_a", "q.path_b").agg(F.count("*").alias("cochanges")).where(F.col("cochanges") >= least)
    counts = counts.join(alone.select(F.col("path").alias("path_a"), F.col("n").alias("commits_a")), "path_a").join(alone.select(F.col("path").alias("path_b"), F.col("n").alias("commits_b")), "path_b")
    return counts.withColumn("strength", F.least(F.lit(1.0), F.col("cochanges") / F.greatest("commits_a", "commits_b")))


def cochange_summary(pairs: DataFrame, changes: DataFrame, strong: float = 0.5) -> DataFrame:
    """AGG-21: couplings, strong ones, mean and greatest strength, and all files seen."""
    p = pairs.agg(F.count("*").alias("couplings"), F.count_if(F.col("strength") >= strong).alias("strong"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("mean_strength"), F.coalesce(F.max("strength"), F.lit(0.0)).alias("max_strength"))
    return p.join(F.broadcast(changes.agg(F.count_distinct("path").alias("total_files"))))


def blame_shares(blame: DataFrame) -> DataFrame:
    """SRC-12: lines, share in percent, first and last time of each author of a file."""
    total = blame.groupBy("path").agg(F.sum("lines").alias("total"))
    return blame.join(total, "path").withColumn("percentage", F.when(F.col("total") > 0, 100 * F.col("lines") / F.col("total")).otherwise(0.0))


def blame_helpers(blame: DataFrame) -> DataFrame:
    """SRC-13: contributors above 5 percent, primary owner (ties by name), ownership ratio."""
    b = blame_shares(blame)
    return b.groupBy("path").agg(
        F.count_if(F.col("percentage") > 5).alias("significant"), F.min_by("author", F.struct(-F.col("lines"), F.col("author"))).alias("owner"), (F.max("percentage") / 100).alias("ratio"))


def ownership(blame: DataFrame) -> DataFrame:
    """AGG-22: primary owner, concentration (1 for a single author), silo, risk."""
    o = blame_shares(blame).groupBy("path").agg(
        F.min_by("author", F.struct(-F.col("lines"), F.col("author"))).alias("owner"), F.max("percentage").alias("top"), F.count("*").alias("contributors"), F.sum("lines").alias("total_lines"))
    conc = F.when(F.col("contributors") == 1, 1.0).otherwise(F.col("top") / 100)
    risk = F.when((F.col("contributors") == 1) | (conc >= 0.8), "high").when((conc >= 0.6) | (F.col("contributors") <= 2), "medium").otherwise("low")
    return o.select("path", "owner", conc.alias("concentration"), "contributors", "total_lines", (F.col("contributors") == 1).alias("silo"), risk.alias("risk"))


def bus_factor(blame: DataFrame) -> DataFrame:
    """AGG-23 and WIN-6: the least number of authors, by lines and name, whose lines reach half (rounded down) of all.

    Authors' totals are aggregated first; the running sum sees one row per author.
    """
    r = cumulative_lines(blame)
    return r.agg(F.coalesce(F.min(F.when(F.col("cum") >= F.floor(F.col("cum_all") / 2), F.col("rank"))), F.lit(0)).cast("bigint").alias("bus_factor"))


def cumulative_lines(blame: DataFrame) -> DataFrame:
    """WIN-6: (author, lines, rank, cum, cum_all, ...): authors' lines added up from the greatest on, equals by name."""
    a = blame.groupBy("author").agg(F.sum("lines").alias("lines")).withColumn("less", -F.col("lines"))
    return stats.running(a, [], ["less", "author"], {"rank": F.lit(1), "cum": F.col("lines")})


def top_owners(owned: DataFrame, k: int = 5) -> DataFrame:
    """AGG-24: owners of most files."""
    return owned.groupBy("owner").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "owner").limit(k)


def ownership_summary(owned: DataFrame) -> DataFrame:
    """AGG-24: files, silos, files by risk, mean contributors and concentration."""
    return owned.agg(
        F.count("*").alias("files"), F.count_if("silo").alias("silos"), *[F.count_if(F.col("risk") == r).alias(f"{r}_risk") for r in ("high", "medium", "low")],
        F.avg("contributors").alias("mean_contributors"), F.avg("concentration").alias("mean_concentration"))


def hotspots(commits: DataFrame, changes: DataFrame, files: DataFrame, least: float = 50.0) -> DataFrame:
    """JOI-1: files that change often and are complex: both percentiles, of each whole population, at least `least`.

    churn is the sum of 1 + changed lines / 100; percentiles are mid-ranks; severity by the product of both (of 1).
    """
    c = changes.groupBy("path").agg(F.sum(1 + (F.col("additions") + F.col("deletions")) / 100).alias("churn"), F.count("*").alias("commits"))
    c = stats.mid_rank(c.withColumn("churn", F.round("churn", 6)), "churn", "churn_pct")
    x = stats.mid_rank(files.select("path", "complexity"), "complexity", "complexity_pct")
    j = c.join(x, "path").where((F.col("churn_pct") >= least) & (F.col("complexity_pct") >= least))
    score = F.col("churn_pct") / 100 * F.col("complexity_pct") / 100
    return j.withColumn("score", score).withColumn("severity", stats.ladder(score, [(0.81, "critical"), (0.64, "high"), (0.36, "moderate")], "low"))


#: Weights of the risk of a change.
RISK_WEIGHTS = {"lines_added": 0.16, "entropy": 0.14, "fix": 0.12, "lines_deleted": 0.08, "num_files": 0.08, "unique_changes": 0.07, "num_developers": 0.05, "experience": 0.05, "file_churn": 0.10, "file_complexity": 0.08, "ownership_diffusion": 0.07}
#: Messages of fixes and of automated commits.
FIX = r"(?i)(\bfix(es|ed|ing)?\b|\bbug\b|\bbugfix\b|\bpatch(es|ed|ing)?\b|\bresolve[sd]?\b|\bclose[sd]?\s+#\d+|\bfixes?\s+#\d+|\bdefect\b|\bissue\b|\berror\b|\bcrash(es|ed|ing)?\b)"
AUTOMATED = r"(?i)(^\s*chore:\s*updated?\s+(image\s+)?tag|\[skip ci\]|^\s*Merge\s+(pull\s+request|branch)|^\s*chore\(deps\):|^\s*chore:\s*bump\s+version|^\s*ci:|^\s*docs?:|^\s*style:)"


def entropy(changes: DataFrame) -> DataFrame:
    """AGG-8: Shannon entropy (base 2) of a commit's changed lines over its files; 0 without changed lines."""
    c = changes.select("sha", (F.col("additions") + F.col("deletions")).alias("n")).where("n > 0")
    t = c.groupBy("sha").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return c.join(t, "sha").groupBy("sha").agg(F.sum(-p * F.log2(p)).alias("entropy"))


#: A path of more authors is hot: no commit lists its earlier authors. Costs depend on it, never the result.
HOT = 500
#: Commits, and authors, of one group in Python at most, about.
GROUP, CHUNK = 20_000, 65_536


def prior_state(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """WIN-2 to WIN-5: author experience, earlier touches and earlier authors of the touched files, in order of (ts, sha).

    Commits and authors get numbers. Running counts (`stats.running`, so neither a busy path nor a busy author is one task's work) give
    earlier touches and earlier authors of each path; a commit of one path needs no more. Of several, each path of at most HOT
    authors adds the list of its earlier ones. Commits of the same hot paths share one list of the first times of those paths'
    authors: the hot paths' earlier authors are counted in it, and of the commit's listed authors those that aren't among them.
    """
    c = commits.select("sha", "author", "ts").orderBy("ts", "sha").select("sha", "author", F.monotonically_increasing_id().alias("no"))
    who = stats.running(commits.select(F.col("author").alias("name")).distinct(), [], ["name"], {"who": F.lit(1)}).select("name", F.col("who").cast("int").alias("who"))
    c = cut(c.join(who, F.col("author").eqNullSafe(F.col("name"))).select("sha", "no", "who"))
    exp = stats.running(c, ["who"], ["no"], {"experience": F.lit(1)}, nulls=False).select("sha", "no", (F.col("experience") - 1).alias("experience"))
    t = changes.select("sha", "path").distinct().join(c, "sha").select("path", "no", "who")
    paths = stats.running(t.select("path").distinct(), [], ["path"], {"p": F.lit(1)}).select("path", "p")
    t = t.join(paths, "path").select("p", "no", "who").withColumn("fresh", F.when(F.row_number().over(Window.partitionBy("p", "who").orderBy("no")) == 1, 1).otherwise(0))
    first = t.where("fresh = 1").select("p", "who", F.col("no").alias("first"))
    t = stats.running(t.select("p", "no", "fresh"), ["p"], ["no"], {"touches": F.lit(1), "authors": F.col("fresh")}, nulls=False)
    first = first.join(first.groupBy("p").agg(F.count("*").alias("n")), "p")
    listed = first.where(F.col("n") <= HOT).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("first", "who"))).alias("x")).select("p", F.col("x.who").alias("listed"))
    before = F.col("authors") - F.col("fresh")
    t = t.join(listed, "p", "left").select("no", "touches", before.alias("before"), F.when(before > 0, F.slice("listed", F.lit(1), before.cast("int"))).alias("listed"), F.when((before > 0) & F.col("listed").isNull(), F.col("p")).alias("hot"))
    by = t.groupBy("no").agg(F.sum(F.col("touches") - 1).alias("unique_changes"), F.max("before").alias("most"), F.count_if(F.col("before") > 0).alias("paths"), F.collect_list("listed").alias("listed"), F.collect_list("hot").alias("hot"))
    one = F.col("paths") <= 1
    by = cut(by.select("no", "unique_changes", F.when(one, F.col("most")).when(F.size("hot") == 0, F.size(F.array_distinct(F.flatten("listed")))).alias("n"), F.when(~one & (F.size("hot") > 0), F.array_sort("hot")).alias("hot"), F.when(~one & (F.size("hot") > 0), F.array_distinct(F.flatten("listed"))).alias("listed")))
    many = by.where("hot is not null").select("no", "hot", "listed")
    sets = many.groupBy("hot").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    many = many.join(sets, "hot").select("hot", F.pmod(F.hash("no"), "parts").alias("part"), "no", "listed")
    firsts = first.where(F.col("n") > HOT).groupBy("p", F.floor(F.col("who") / CHUNK)).agg(F.collect_list("who").alias("who"), F.collect_list("first").alias("first"))
    firsts = sets.select("hot", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.explode("hot").alias("p")).join(firsts.select("p", "who", "first"), "p").select(F.col("hot").alias("set"), F.col("part").alias("set_part"), "who", "first")
    more = many.groupBy("hot", "part").cogroup(firsts.groupBy("set", "set_part")).applyInArrow(_earlier_authors, "no bigint, more bigint")
    own = by.select("no", "unique_changes", "n").join(more, "no", "left").select("no", "unique_changes", F.coalesce("n", "more").alias("num_developers"))
    return exp.join(own, "no", "left").select("sha", "experience", "unique_changes", "num_developers").fillna(0, ["unique_changes", "num_developers"])


def _earlier_authors(commits, firsts):
    """(no, more): of commits of the same hot paths, given the first times of each author in each of these, the distinct earlier
    authors in them and in the commit's own list."""
    import numpy as np
    import pyarrow as pa

    flat = lambda table, name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    who, first = flat(firsts, "who"), flat(firsts, "first")
    order = np.lexsort((first, who))
    who, first = who[order], first[order]
    least = np.concatenate(([True], who[1:] != who[:-1]))
    who, first = who[least], first[least]
    no = commits.column("no").to_numpy()
    listed, size = flat(commits, "listed"), commits.column("listed").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(no)), size)
    at = np.minimum(np.searchsorted(who, listed), len(who) - 1)
    new = (who[at] != listed) | (first[at] >= no[row])
    return pa.table({"no": no, "more": np.searchsorted(np.sort(first), no) + np.bincount(row[new], minlength=len(no))})


def commit_features(commits: DataFrame, changes: DataFrame, files: DataFrame, owned: DataFrame) -> DataFrame:
    """AGG-12: sizes, entropy, prior state and the worst file signals of each commit that has changes."""
    size = changes.groupBy("sha").agg(F.sum("additions").alias("lines_added"), F.sum("deletions").alias("lines_deleted"), F.count_distinct("path").alias("num_files"))
    touches = changes.groupBy("path").agg(F.count_distinct("sha").alias("touches"))
    most = touches.agg(F.max("touches").alias("most"))
    churn = touches.join(F.broadcast(most)).select("path", (F.col("touches") / F.col("most")).alias("churn"))
    risk = changes.select("sha", "path").join(churn, "path").join(files.select("path", "complexity"), "path", "left").join(owned.select(F.col("path"), (1 - F.col("concentration")).alias("diffusion")), "path", "left")
    risk = risk.groupBy("sha").agg(F.max("churn").alias("file_churn"), F.coalesce(F.max("complexity"), F.lit(0)).cast("double").alias("file_complexity"), F.coalesce(F.max("diffusion"), F.lit(0.0)).alias("ownership_diffusion"))
    base = commits.join(size, "sha").join(entropy(changes), "sha", "left").join(prior_state(commits, changes), "sha").join(risk, "sha")
    return base.fillna(0.0, ["entropy"]).withColumn("is_fix", F.coalesce(F.col("message").rlike(FIX), F.lit(False))).withColumn("is_automated", F.coalesce(F.col("message").rlike(AUTOMATED), F.lit(False)))


P95 = ["lines_added", "lines_deleted", "num_files", "unique_changes", "num_developers", "experience", "entropy"]


def normalizers(features: DataFrame) -> DataFrame:
    """AGG-9: p95 of each feature, one at least; whole numbers are cut to whole numbers by being such."""
    each = {c: F.round(F.col(c).cast("double"), 6) for c in [*P95, "file_complexity"]}
    p = stats.percentile_of_each(features, each, 0.95)
    return p.select(*[F.greatest(F.col(c), F.lit(1.0)).alias(f"max_{c}") for c in each], F.lit(1.0).alias("max_file_churn"))


def _normal(name: str):
    return stats.safe_normalize(F.col(name).cast("double"), F.col(f"max_{name}"))


def factors() -> dict:
    """AGG-13: what each feature adds to the risk."""
    w = RISK_WEIGHTS
    out = {k: _normal(k) * w[k] for k in ("lines_added", "entropy", "lines_deleted", "num_files", "unique_changes", "num_developers", "file_churn", "file_complexity")}
    return out | {"fix": F.when(F.col("is_fix"), w["fix"]).otherwise(0.0), "experience": (1 - _normal("experience")) * w["experience"], "ownership_diffusion": F.col("ownership_diffusion") * w["ownership_diffusion"]}


def commit_risk(features: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """AGG-10 and AGG-11: weighted risk of each commit in [0, 1], 0.05 for automated ones, and its level by p95 and p80."""
    features = cut(features)  # ranked by nine measures
    norms = normalizers(features) if norms is None else norms
    total = sum(factors().values(), F.lit(0.0))
    r = features.join(F.broadcast(norms)).withColumn("risk", F.round(F.when(F.col("is_automated"), 0.05).otherwise(stats.clamp(total)), 6))
    t = stats.percentiles(r.select("risk"), "risk", {"p95": 0.95, "p80": 0.80})
    return r.join(F.broadcast(t)).withColumn("level", F.when(F.col("risk") >= F.col("p95"), "high").when(F.col("risk") >= F.col("p80"), "medium").otherwise("low"))


def recommendations(risked: DataFrame) -> DataFrame:
    """AGG-13: factors that add most, and the rules that a commit's risk triggers, by name."""
    f = factors()
    rule = lambda cond, name: F.when(cond, F.lit(name))
    rules = F.array_compact(F.array(
        rule(F.col("is_fix"), "fix"), rule(f["entropy"] > 0.15, "entropy"), rule(f["lines_added"] > 0.15, "large"), rule(f["num_files"] > 0.08, "many_files"), rule(f["experience"] > 0.04, "inexperienced"),
        rule(F.col("file_complexity") > 10, "complex"), rule(F.col("file_churn") > 0.7, "volatile"), rule(F.col("ownership_diffusion") > 0.7, "diffuse"), rule(F.col("risk") >= 0.7, "high_risk"), rule((F.col("risk") >= 0.5) & (F.col("risk") < 0.7), "elevated")))
    names = F.when(F.size(rules) == 0, F.array(F.lit("low_risk"))).otherwise(rules)
    top = F.array_max(F.array(*[F.struct(F.round(v, 6).alias("v"), F.lit(k).alias("k")) for k, v in sorted(f.items())]))
    return risked.select("sha", "risk", "level", F.array_join(names, ",").alias("recommendations"), top.getField("k").alias("top_factor"), top.getField("v").alias("top_value"))


#: Normalisers of the risk of a difference between two states.
DIFF_NORMS = {"lines_added": 400.0, "lines_deleted": 200.0, "num_files": 15.0, "commits": 10.0, "entropy": 3.0}


def diff_risk(commits: DataFrame, changes: DataFrame, branch: str) -> DataFrame:
    """AGG-14: risk of all changes of one branch, with fixed normalisers in place of the window's percentiles."""
    j = changes.join(commits.select("sha", F.col(branch).alias("branch")), "sha")
    per = j.groupBy("branch", "path").agg(F.sum(F.col("additions") + F.col("deletions")).alias("n"), F.sum("additions").alias("a"), F.sum("deletions").alias("d"))
    total = per.groupBy("branch").agg(F.sum("a").alias("lines_added"), F.sum("d").alias("lines_deleted"), F.count("*").alias("num_files"), F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    e = per.where("n > 0").join(total.select("branch", "t"), "branch").groupBy("branch").agg(F.sum(-p * F.log2(p)).alias("entropy"))
    c = j.groupBy("branch").agg(F.count_distinct("sha").alias("commits"))
    d = total.drop("t").join(e, "branch", "left").join(c, "branch").fillna(0.0, ["entropy"])
    norm = lambda k: stats.safe_normalize(F.col(k).cast("double"), F.lit(DIFF_NORMS[k]))
    score = 0.3 * norm("lines_added") + 0.15 * norm("lines_deleted") + 0.2 * norm("num_files") + 0.1 * norm("commits") + 0.25 * norm("entropy")
    return d.withColumn("score", stats.clamp(score)).withColumn("level", stats.ladder(F.col("score"), [(0.6, "high"), (0.3, "medium")], "low"))


def flag_rollup(refs: DataFrame, as_of: str, ttl_days: int) -> DataFrame:
    """AGG-41: of each flag: files, references, first and last time, age in whole days at `as_of`, whether it outlived its time."""
    r = refs.groupBy("flag").agg(F.count_distinct("file").alias("files"), F.count("*").alias("references"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("first_seen")) / 86400)
    return r.withColumn("age_days", age).withColumn("stale", age > ttl_days)


def flag_priority(refs: DataFrame, complexity: DataFrame, rolled: DataFrame) -> DataFrame:
    """JOI-18 and SRT-2: priority by the greatest complexity of referring files; order: priority, stale first, age."""
    m = refs.select("flag", "file").distinct().join(complexity, "file").groupBy("flag").agg(F.max("complexity").alias("max_complexity"))
    p = rolled.join(m, "flag", "left").fillna(0, ["max_complexity"])
    return p.withColumn("priority", stats.ladder(F.col("max_complexity"), [(50, "critical"), (20, "high"), (10, "medium")], "low"))
