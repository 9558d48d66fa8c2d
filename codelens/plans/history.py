"""Queries of the history operators on the mapped tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import history as h
from codelens.sources import tables as t
from codelens.sources.checkpoints import cut

CTE = """
with cm as (select sha, coalesce(nullif(trim(x.author, ' '), ''), '(none)') as author, x.ts as ts, x.message as message, length(coalesce(x.message, ''))::double as size, case when starts_with(x.message, 'Merge') then 'merge' when starts_with(x.message, 'fix') then 'fix' else 'other' end as status
  from (select sha, arg_min({'author': author, 'ts': ts, 'message': message}, ingested_at) as x from commits group by sha)),
fc as (select sha, path, sum(coalesce(additions, 0))::bigint as additions, sum(coalesce(deletions, 0))::bigint as deletions from (select distinct * from file_changes where path is not null) group by all),
fi as (select file_path as path, sum(c)::bigint as complexity, max(e)::bigint as loc, string_split(file_path, '.')[-1] as language, split_part(file_path, '/', 1) as component from (select file_path, symbol_name, max(cyclomatic_complexity) as c, max(end_line) as e from symbols group by all) group by file_path),
bl as (select path, author, sum(additions)::bigint as lines, min(ts) as first_ts, max(ts) as last_ts from fc join cm using (sha) group by all),
ch as (select path, count(*) as commits, count(distinct author) as authors, sum(additions)::bigint as additions, sum(deletions)::bigint as deletions, min(ts) as first_ts, max(ts) as last_ts from fc join cm using (sha) group by path),
cs as (select *, 0.6 * least(commits / (max(commits) over ())::double, 1) + 0.4 * least((additions + deletions) / (max(additions + deletions) over ())::double, 1) as churn_score from ch),
bt as (select path, sum(lines) as total from bl group by path),
bs as (select bl.*, total, coalesce(100 * lines / nullif(total, 0)::double, 0) as percentage from bl join bt using (path)),
ow0 as (select path, first(author order by lines desc, author) as owner, max(percentage) as top, count(*) as contributors, sum(lines)::bigint as total_lines from bs group by path),
ow1 as (select path, owner, case when contributors = 1 then 1.0::double else top / 100 end as concentration, contributors, total_lines from ow0),
ow as (select *, contributors = 1 as silo, case when contributors = 1 or concentration >= 0.8 then 'high' when concentration >= 0.6 or contributors <= 2 then 'medium' else 'low' end as risk from ow1)
"""
SIX = lambda *names: [F.round(n, 6).alias(n) for n in names]


def agg_1_file_churn(s, d):
    return h.file_churn(t.commits(s, d), t.file_changes(s, d))


def agg_2_churn_score(s, d):
    return h.churn_scores(agg_1_file_churn(s, d)).select("path", *SIX("churn_score"))


def agg_3_relative_churn(s, d):
    return h.relative_churn(agg_1_file_churn(s, d), t.files(s, d)).select("path", "days_active", *SIX("relative_churn", "churn_rate", "change_frequency"))


def agg_4_churn_statistics(s, d):
    return h.churn_statistics(h.churn_scores(agg_1_file_churn(s, d))).select(*SIX("mean", "variance", "stddev", "p50", "p95"))


def agg_5_author_contributions(s, d):
    return h.author_contributions(t.commits(s, d), t.file_changes(s, d))


def srt_3_hot_and_stable(s, d):
    """SRT-3: of the ten highest scores those above 0.5, of the ten lowest those below 0.1."""
    c = h.churn_scores(agg_1_file_churn(s, d)).select("path", F.round("churn_score", 6).alias("churn_score"))
    hot = c.orderBy(F.desc("churn_score"), "path").limit(10).where("churn_score > 0.5").withColumn("list", F.lit("hot"))
    return hot.unionByName(c.orderBy("churn_score", F.desc("path")).limit(10).where("churn_score < 0.1").withColumn("list", F.lit("stable")))


def joi_4_cochange(s, d):
    return h.cochange(t.file_changes(s, d), 3).select("path_a", "path_b", "cochanges", *SIX("strength"))


def joi_4_cochange_small_commits(s, d):
    """The guard against sweeping commits, at a cut-off that this data reaches."""
    return h.cochange(t.file_changes(s, d), 2, 5).select("path_a", "path_b", "cochanges", *SIX("strength"))


def agg_21_cochange_summary(s, d):
    f = t.file_changes(s, d)
    return h.cochange_summary(h.cochange(f, 2), f, 0.05).select("couplings", "strong", "total_files", *SIX("mean_strength", "max_strength"))


def src_12_blame_shares(s, d):
    return h.blame_shares(t.blame(s, d)).select("path", "author", "lines", "first_ts", "last_ts", *SIX("percentage"))


def src_13_blame_helpers(s, d):
    return h.blame_helpers(t.blame(s, d)).select("path", "significant", "owner", *SIX("ratio"))


def agg_22_ownership(s, d):
    return h.ownership(t.blame(s, d)).select("path", "owner", "contributors", "total_lines", "silo", "risk", *SIX("concentration"))


def agg_23_bus_factor(s, d):
    return h.bus_factor(t.blame(s, d))


def win_6_cumulative_lines(s, d):
    """WIN-6: lines of authors in order, added up."""
    return h.cumulative_lines(t.blame(s, d)).select("author", "lines", F.col("cum").alias("running"))


def agg_24_top_owners(s, d):
    return h.top_owners(h.ownership(t.blame(s, d)))


def agg_24_ownership_summary(s, d):
    return h.ownership_summary(h.ownership(t.blame(s, d))).select("files", "silos", "high_risk", "medium_risk", "low_risk", *SIX("mean_contributors", "mean_concentration"))


def joi_1_hotspot(s, d):
    return h.hotspots(t.commits(s, d), t.file_changes(s, d), t.files(s, d)).select("path", "commits", "complexity", "severity", *SIX("churn", "churn_pct", "complexity_pct", "score"))


def hotspot_join(s, d):
    """The flagship: hotspots in order of score."""
    return joi_1_hotspot(s, d).orderBy(F.desc("score"), "path")


def win_1_mid_rank(s, d):
    """WIN-1: mid-rank percentile of complexity."""
    from codelens.functions import stats

    return stats.mid_rank(t.files(s, d).select("path", "complexity"), "complexity", "pct").select("path", "complexity", *SIX("pct"))


def agg_7_percentiles(s, d):
    """AGG-7: nearest-rank percentiles of complexity and of line counts."""
    from codelens.functions import stats

    return stats.percentiles(t.files(s, d), "complexity", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def agg_8_entropy(s, d):
    return h.entropy(t.file_changes(s, d)).select("sha", *SIX("entropy"))


def win_2_prior_state(s, d):
    return h.prior_state(t.commits(s, d), t.file_changes(s, d))


def _features(s, d):
    return h.commit_features(t.commits(s, d), t.file_changes(s, d), t.files(s, d), h.ownership(t.blame(s, d)))


def agg_12_commit_features(s, d):
    return _features(s, d).select("sha", "lines_added", "lines_deleted", "num_files", "unique_changes", "num_developers", F.col("experience").cast("bigint").alias("experience"), *SIX("entropy", "file_churn", "file_complexity", "ownership_diffusion"))


def agg_9_normalizers(s, d):
    n = h.normalizers(cut(_features(s, d)))
    return n.select(*SIX(*sorted(n.columns)))


def agg_10_commit_risk(s, d):
    return h.commit_risk(_features(s, d)).select("sha", "risk", "level")


def agg_11_risk_levels(s, d):
    return h.commit_risk(_features(s, d)).groupBy("level").agg(F.count("*").alias("commits"))


def agg_13_recommendations(s, d):
    return h.recommendations(h.commit_risk(_features(s, d)))


def agg_14_diff_risk(s, d):
    c = t.commits(s, d).withColumn("branch", F.date_format("ts", "yyyy-MM"))
    return h.diff_risk(c, t.file_changes(s, d), "branch").select("branch", "lines_added", "lines_deleted", "num_files", "commits", "level", *SIX("entropy", "score"))


def _refs(s, d):
    return t.table(s, d, "events").select(F.col("event_type").alias("flag"), F.col("user_id").alias("file"), "ts")


def agg_41_flag_rollup(s, d):
    return h.flag_rollup(_refs(s, d), "2024-02-15 00:00:00", 14)


def joi_18_flag_priority(s, d):
    r = _refs(s, d)
    c = t.table(s, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("complexity"))
    return h.flag_priority(r, c, h.flag_rollup(r, "2024-02-15 00:00:00", 14)).orderBy(F.expr("array_position(array('critical','high','medium','low'), priority)"), F.desc("stale"), F.desc("age_days"), "flag")


def agg_20_commits_contributors(s, d):
    """AGG-20: commits and distinct contributors of each file; churn = min(commits / 20, 1)."""
    c = agg_1_file_churn(s, d)
    return c.select("path", "commits", F.col("authors").alias("contributors"), F.round(F.least(F.col("commits") / 20, F.lit(1.0)), 6).alias("churn"))


def fil_3_time_window(s, d):
    """FIL-3 and INC-3: commits of the last days before a date, the latest first, cut to a number (months have 30 days)."""
    c = t.commits(s, d).where(F.col("ts") >= F.date_sub(F.lit("2025-06-01").cast("date"), 180).cast("timestamp"))
    return c.orderBy(F.desc("ts"), F.desc("sha")).limit(500).select("sha", "author", "ts")


def joi_5_analysed_files(s, d):
    """JOI-5 and SET-4: churn of files that are in the analysed set."""
    return agg_1_file_churn(s, d).join(t.files(s, d).where("complexity > 25").select("path"), "path", "left_semi").select("path", "commits")


def src_11_path_history(s, d):
    """SRC-11: commits and authors of chosen paths only."""
    chosen = t.files(s, d).where("language = 'rs'").select("path")
    j = t.file_changes(s, d).join(chosen, "path", "left_semi").join(t.commits(s, d).select("sha", "author"), "sha")
    return j.groupBy("path").agg(F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"))


def src_15_commit_stats(s, d):
    """SRC-15: files, added and deleted lines of each commit; commits without changes have none."""
    c = t.file_changes(s, d).groupBy("sha").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return t.commits(s, d).select("sha").join(c, "sha", "left").fillna(0, ["files", "additions", "deletions"])


def fil_7_bug_fix_commits(s, d):
    """FIL-7: commits of the change log whose message tells of a fix; one row per sha."""
    return t.table(s, d, "commits").where(F.col("message").rlike(h.FIX)).select("sha").distinct()


def fil_8_automated_commits(s, d):
    """FIL-8: automated commits of the change log."""
    return t.table(s, d, "commits").where(F.col("message").rlike(h.AUTOMATED)).select("sha").distinct()


def txt_13_short_messages(s, d):
    """TXT-13: the first line of a message; over 80 bytes its first 77 characters and three dots."""
    line = F.substring_index(F.coalesce("message", F.lit("")), "\n", 1)
    return t.table(s, d, "commits").select("sha", F.when(F.octet_length(line) > 80, F.concat(F.left(line, F.lit(77)), F.lit("..."))).otherwise(F.trim(line)).alias("short")).distinct()


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "joi", "win", "srt", "src", "fil", "txt", "hotspot") and callable(v)}

_HOT = """, hc as (select path, round(sum(1 + (additions + deletions) / 100.0::double), 6) as churn, count(*) as commits from fc group by path),
hp as (select *, 100 * (rank() over (order by churn) - 1 + 0.5 * count(*) over (partition by churn)) / (count(*) over ())::double as churn_pct from hc),
xp as (select path, complexity, 100 * (rank() over (order by complexity) - 1 + 0.5 * count(*) over (partition by complexity)) / (count(*) over ())::double as complexity_pct from fi where complexity is not null),
hs as (select path, commits, complexity, churn, churn_pct, complexity_pct, churn_pct / 100 * complexity_pct / 100 as score from hp join xp using (path) where churn_pct >= 50 and complexity_pct >= 50),
hot as (select path, commits, complexity, case when score >= 0.81 then 'critical' when score >= 0.64 then 'high' when score >= 0.36 then 'moderate' else 'low' end as severity,
  round(churn, 6) as churn, round(churn_pct, 6) as churn_pct, round(complexity_pct, 6) as complexity_pct, round(score, 6) as score from hs)"""
_PAIRS = """, one as (select distinct sha, path from fc), alone as (select path, count(*) as n from one group by path),
small as (select sha from one group by sha having count(*) between 2 and {most}),
pr as (select a.path as path_a, b.path as path_b, count(*) as cochanges from one a join one b on a.sha = b.sha and a.path < b.path where a.sha in (select sha from small) group by all having count(*) >= {least}),
co as (select path_a, path_b, cochanges, least(1.0, cochanges / greatest(x.n, y.n)::double) as strength from pr join alone x on x.path = path_a join alone y on y.path = path_b)"""
_FEATURES = """, sz as (select sha, sum(additions)::bigint as lines_added, sum(deletions)::bigint as lines_deleted, count(distinct path) as num_files from fc group by sha),
en0 as (select sha, additions + deletions as n from fc where additions + deletions > 0), en1 as (select sha, n, sum(n) over (partition by sha) as t from en0),
en as (select sha, sum(-(n / t::double) * log2(n / t::double)) as entropy from en1 group by sha),
ex as (select sha, row_number() over (partition by author order by ts, sha) - 1 as experience from cm),
tc as (select fc.sha, path, author, ts, row_number() over (partition by path order by ts, fc.sha) - 1 as before from fc join cm using (sha)),
nu as (select sha, sum(before)::bigint as unique_changes from tc group by sha),
ft as (select path, author, min(row(ts, sha)) as first from tc group by all),
nd as (select tc.sha, count(distinct ft.author) as num_developers from tc join ft on ft.path = tc.path and ft.first < row(tc.ts, tc.sha) group by tc.sha),
tm as (select path, count(distinct sha) as touches from fc group by path), tn as (select path, touches / (max(touches) over ())::double as churn from tm),
po as (select path, case when count(*) = 1 then 0 else 1 - coalesce(max(lines) / nullif(sum(lines), 0)::double, 0) end as diffusion from bl group by path),
fr as (select fc.sha, max(churn) as file_churn, coalesce(max(complexity), 0)::double as file_complexity, coalesce(max(diffusion), 0) as ownership_diffusion from fc join tn using (path) left join fi using (path) left join po using (path) group by fc.sha),
fe as (select cm.sha, coalesce(regexp_matches(message, '{fix}'), false) as is_fix, coalesce(regexp_matches(message, '{auto}'), false) as is_automated, lines_added, lines_deleted, num_files, coalesce(unique_changes, 0) as unique_changes, coalesce(num_developers, 0) as num_developers, experience, coalesce(entropy, 0) as entropy, file_churn, file_complexity, ownership_diffusion
  from cm join sz using (sha) left join en using (sha) join ex using (sha) left join nu using (sha) left join nd using (sha) join fr using (sha))""".replace("{fix}", h.FIX.replace("'", "''")).replace("{auto}", h.AUTOMATED.replace("'", "''"))
_P = lambda c, name: f"greatest((list(round({c}::double, 6) order by {c}))[(round(0.95 * (count(*) - 1)) + 1)::int], 1.0) as {name}"
_NORM = ", nm as (select " + ", ".join(_P(c, f"max_{c}") for c in [*h.P95, "file_complexity"]) + ", 1.0::double as max_file_churn from fe)"
_N = lambda c: f"case when max_{c} <= 0 then 0 when {c} >= max_{c} then 1 else {c} / max_{c}::double end"
_W = h.RISK_WEIGHTS
_FACTORS = {k: f"({_N(k)}) * {_W[k]}::double" for k in ("lines_added", "entropy", "lines_deleted", "num_files", "unique_changes", "num_developers", "file_churn", "file_complexity")} | {"fix": "case when is_fix then 0.12 else 0.0::double end", "experience": f"(1 - ({_N('experience')})) * 0.05::double", "ownership_diffusion": "ownership_diffusion * 0.07::double"}
_RISK = ", rk0 as (select *, round(case when is_automated then 0.05 else greatest(0, least(1, " + " + ".join(_FACTORS.values()) + ")) end, 6) as risk from fe cross join nm), th as (select (list(risk order by risk))[(round(0.95 * (count(*) - 1)) + 1)::int] as p95, (list(risk order by risk))[(round(0.8 * (count(*) - 1)) + 1)::int] as p80 from rk0), rk as (select rk0.*, case when risk >= p95 then 'high' when risk >= p80 then 'medium' else 'low' end as level from rk0 cross join th)"
_RE = lambda p: p.replace("'", "''")
_FLAGS = "with rf as (select event_type as flag, user_id as file, ts from events), ro as (select flag, count(distinct file) as files, count(*) as \"references\", min(ts) as first_seen, max(ts) as last_seen, floor((epoch(timestamp '2024-02-15') - floor(epoch(min(ts)))) / 86400)::bigint as age_days from rf group by flag), rs as (select *, age_days > 14 as stale from ro)"

SQL = {
    "agg_1_file_churn": CTE + "select * from ch",
    "agg_2_churn_score": CTE + "select path, round(churn_score, 6) as churn_score from cs",
    "agg_3_relative_churn": CTE + ", x as (select path, commits, additions + deletions as n, loc, greatest(floor((epoch(last_ts) - epoch(first_ts)) / 86400), 1)::bigint as days_active from ch join fi using (path)) select path, days_active, round(n / loc::double, 6) as relative_churn, round(n / loc::double / days_active, 6) as churn_rate, round(commits / days_active::double, 6) as change_frequency from x",
    "agg_4_churn_statistics": CTE + ", x as (select round(churn_score, 6) as s from cs) select round(avg(s), 6) as mean, round(var_pop(s), 6) as variance, round(stddev_pop(s), 6) as stddev, (list(s order by s))[(round(0.5 * (count(*) - 1)) + 1)::int] as p50, (list(s order by s))[(round(0.95 * (count(*) - 1)) + 1)::int] as p95 from x",
    "agg_5_author_contributions": CTE + "select author, count(*) as touches, count(distinct path) as files from fc join cm using (sha) group by author",
    "srt_3_hot_and_stable": CTE + ", x as (select path, round(churn_score, 6) as churn_score from cs) select *, 'hot' as list from (select * from x order by churn_score desc, path limit 10) where churn_score > 0.5 union all select *, 'stable' from (select * from x order by churn_score, path desc limit 10) where churn_score < 0.1",
    "joi_4_cochange": CTE + _PAIRS.format(most=100, least=3) + "select path_a, path_b, cochanges, round(strength, 6) as strength from co",
    "joi_4_cochange_small_commits": CTE + _PAIRS.format(most=5, least=2) + "select path_a, path_b, cochanges, round(strength, 6) as strength from co",
    "agg_21_cochange_summary": CTE + _PAIRS.format(most=100, least=2) + "select count(*) as couplings, count(*) filter (strength >= 0.05) as strong, (select count(distinct path) from fc) as total_files, round(avg(strength), 6) as mean_strength, round(max(strength), 6) as max_strength from co",
    "src_12_blame_shares": CTE + "select path, author, lines, first_ts, last_ts, round(percentage, 6) as percentage from bs",
    "src_13_blame_helpers": CTE + "select path, count(*) filter (percentage > 5) as significant, first(author order by lines desc, author) as owner, round(max(percentage) / 100, 6) as ratio from bs group by path",
    "agg_22_ownership": CTE + "select path, owner, contributors, total_lines, silo, risk, round(concentration, 6) as concentration from ow",
    "agg_23_bus_factor": CTE + ", a as (select author, sum(lines) as lines from bl group by author), r as (select row_number() over (order by lines desc, author) as rank, sum(lines) over (order by lines desc, author rows unbounded preceding) as cum, sum(lines) over () as total from a) select min(rank) as bus_factor from r where cum >= floor(total / 2)",
    "win_6_cumulative_lines": CTE + ", a as (select author, sum(lines)::bigint as lines from bl group by author) select author, lines, sum(lines) over (order by lines desc, author rows unbounded preceding)::bigint as running from a",
    "agg_24_top_owners": CTE + "select owner, count(*) as files from ow group by owner order by files desc, owner limit 5",
    "agg_24_ownership_summary": CTE + "select count(*) as files, count(*) filter (silo) as silos, count(*) filter (risk = 'high') as high_risk, count(*) filter (risk = 'medium') as medium_risk, count(*) filter (risk = 'low') as low_risk, round(avg(contributors), 6) as mean_contributors, round(avg(concentration), 6) as mean_concentration from ow",
    "joi_1_hotspot": CTE + _HOT + "select * from hot",
    "hotspot_join": CTE + _HOT + "select * from hot order by score desc, path",
    "win_1_mid_rank": CTE + "select path, complexity, round(100 * (rank() over (order by complexity) - 1 + 0.5 * count(*) over (partition by complexity)) / (count(*) over ())::double, 6) as pct from fi where complexity is not null",
    "agg_7_percentiles": CTE + "select " + ", ".join(f"(list(complexity order by complexity))[(round({p} * (count(*) - 1)) + 1)::int] as {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " from fi where complexity is not null",
    "agg_8_entropy": CTE + _FEATURES + "select sha, round(entropy, 6) as entropy from en",
    "win_2_prior_state": CTE + _FEATURES + "select ex.sha, experience, coalesce(unique_changes, 0) as unique_changes, coalesce(num_developers, 0) as num_developers from ex left join nu using (sha) left join nd using (sha)",
    "agg_12_commit_features": CTE + _FEATURES + "select sha, lines_added, lines_deleted, num_files, unique_changes, num_developers, experience, round(entropy, 6) as entropy, round(file_churn, 6) as file_churn, round(file_complexity, 6) as file_complexity, round(ownership_diffusion, 6) as ownership_diffusion from fe",
    "agg_9_normalizers": CTE + _FEATURES + _NORM + "select * from nm",
    "agg_10_commit_risk": CTE + _FEATURES + _NORM + _RISK + "select sha, risk, level from rk",
    "agg_11_risk_levels": CTE + _FEATURES + _NORM + _RISK + "select level, count(*) as commits from rk group by level",
    "agg_14_diff_risk": CTE + ", j as (select strftime(ts, '%Y-%m') as branch, path, sum(additions + deletions) as n, sum(additions) as a, sum(deletions) as d from fc join cm using (sha) group by all), x as (select branch, sum(a)::bigint as lines_added, sum(d)::bigint as lines_deleted, count(*) as num_files, sum(n) as t from j group by branch), e as (select branch, sum(-(n / t::double) * log2(n / t::double)) as entropy from j join x using (branch) where n > 0 group by branch), c as (select strftime(ts, '%Y-%m') as branch, count(distinct fc.sha) as commits from fc join cm using (sha) group by all), y as (select x.*, coalesce(entropy, 0) as entropy, commits, greatest(0, least(1, 0.3 * least(lines_added / 400.0::double, 1) + 0.15 * least(lines_deleted / 200.0::double, 1) + 0.2 * least(num_files / 15.0::double, 1) + 0.1 * least(commits / 10.0::double, 1) + 0.25 * least(coalesce(entropy, 0) / 3.0::double, 1))) as score from x left join e using (branch) join c using (branch)) select branch, lines_added, lines_deleted, num_files, commits, case when score >= 0.6 then 'high' when score >= 0.3 then 'medium' else 'low' end as level, round(entropy, 6) as entropy, round(score, 6) as score from y",
    "agg_41_flag_rollup": _FLAGS + " select * from rs",
    "joi_18_flag_priority": _FLAGS + ", m as (select flag, max(p_size) as max_complexity from (select distinct flag, file from rf) join part on p_partkey = file group by flag) select rs.*, coalesce(max_complexity, 0) as max_complexity, case when coalesce(max_complexity, 0) >= 50 then 'critical' when max_complexity >= 20 then 'high' when max_complexity >= 10 then 'medium' else 'low' end as priority from rs left join m using (flag)",
    "agg_20_commits_contributors": CTE + "select path, commits, authors as contributors, round(least(commits / 20.0::double, 1), 6) as churn from ch",
    "fil_3_time_window": CTE + "select sha, author, ts from cm where ts >= date '2025-06-01' - 180 order by ts desc, sha desc limit 500",
    "joi_5_analysed_files": CTE + "select path, commits from ch where path in (select path from fi where complexity > 25)",
    "src_11_path_history": CTE + "select path, count(distinct sha) as commits, count(distinct author) as authors from fc join cm using (sha) where path in (select path from fi where language = 'rs') group by path",
    "src_15_commit_stats": CTE + "select cm.sha, count(path) as files, coalesce(sum(additions), 0)::bigint as additions, coalesce(sum(deletions), 0)::bigint as deletions from cm left join fc using (sha) group by cm.sha",
    "fil_7_bug_fix_commits": f"select distinct sha from commits where regexp_matches(message, '{_RE(h.FIX)}')",
    "fil_8_automated_commits": f"select distinct sha from commits where regexp_matches(message, '{_RE(h.AUTOMATED)}')",
    "txt_13_short_messages": "select distinct sha, case when strlen(l) > 80 then l[:77] || '...' else trim(l, ' ') end as short from (select sha, split_part(coalesce(message, ''), chr(10), 1) as l from commits)",
}
SQL["agg_13_recommendations"] = (
    CTE + _FEATURES + _NORM + _RISK + f""", fx as (select *, {", ".join(f"round({v}, 6) as f_{k}" for k, v in sorted(_FACTORS.items()))} from rk)
select sha, risk, level, coalesce(nullif(array_to_string(list_filter([case when is_fix then 'fix' end, case when f_entropy > 0.15 then 'entropy' end, case when f_lines_added > 0.15 then 'large' end, case when f_num_files > 0.08 then 'many_files' end, case when f_experience > 0.04 then 'inexperienced' end,
 case when file_complexity > 10 then 'complex' end, case when file_churn > 0.7 then 'volatile' end, case when ownership_diffusion > 0.7 then 'diffuse' end, case when risk >= 0.7 then 'high_risk' end, case when risk >= 0.5 and risk < 0.7 then 'elevated' end], lambda x: x is not null), ','), ''), 'low_risk') as recommendations,
 (list_max([{", ".join(f"{{'v': f_{k}, 'k': '{k}'}}" for k in sorted(_FACTORS))}])).k as top_factor, (list_max([{", ".join(f"{{'v': f_{k}, 'k': '{k}'}}" for k in sorted(_FACTORS))}])).v as top_value from fx"""
)
