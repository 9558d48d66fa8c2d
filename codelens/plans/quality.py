"""Queries of quality scores on the mapped tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import stats
from codelens.operators import history as h
from codelens.operators import quality as q
from codelens.plans import history as hp
from codelens.plans import text as xp
from codelens.plans.history import CTE, SIX
from codelens.sources import tables as t


def _defect(s, d):
    files = t.files(s, d)
    git = hp.agg_20_commits_contributors(s, d)
    coupling = _partners(s, d).select("path", F.col("cochanges").alias("coupling"))
    return q.defect_inputs(files, git, files.select("path", "complexity"), _duplication(s, d), coupling)


def _duplication(s, d):
    """Share of a file's chunks whose content another chunk of the file has too."""
    y = t.table(s, d, "symbols").where("content_hash is not null").select(F.col("file_path").alias("path"), "symbol_name", "chunk_index", "content_hash").distinct()
    return y.groupBy("path").agg((1 - F.count_distinct("content_hash") / F.count("*")).alias("duplication"))


def _partners(s, d):
    """Files that changed together with each file twice or more."""
    co = h.cochange(t.file_changes(s, d), 2)
    return co.select(F.col("path_a").alias("path")).union(co.select("path_b")).groupBy("path").agg(F.count("*").alias("cochanges"))


def joi_2_defect_inputs(s, d):
    return _defect(s, d).select("path", "loc", "contributors", "estimated", "coupling", *SIX("churn", "complexity", "duplication"))


def agg_15_defect_probability(s, d):
    return q.defect_probability(_defect(s, d)).select("path", "risk", *SIX("probability", "confidence"))


def agg_16_cdf_interpolation(s, d):
    x = (F.col("p_size") / 2).alias("x")
    f = t.table(s, d, "part").select("p_partkey", x)
    return f.select("p_partkey", *[F.round(stats.interpolate(F.col("x") / (25 if k == "churn" else 1), v), 6).alias(k) for k, v in q.CDF.items()])


def agg_17_defect_summary(s, d):
    return q.defect_probability(_defect(s, d)).groupBy("risk").agg(F.count("*").alias("files"), F.round(F.avg("probability"), 6).alias("mean"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _measures(s, d):
    """The worst lexical measures of each file's symbols, with the file's hotspot score and co-changes where known."""
    y = xp.txt_21_lexical(s, d).join(xp.txt_21_duplicate_lines(s, d).select("id", "dup_ratio"), "id", "left").join(xp.txt_22_critical_patterns(s, d), "id", "left")
    paths = t.table(s, d, "symbols").select("id", F.col("file_path").alias("path")).distinct()
    m = y.join(paths, "id").groupBy("path").agg(
        F.sum("cyclomatic").alias("cyclomatic"), F.max("nesting").alias("nesting"), F.coalesce(F.max("dup_ratio"), F.lit(0.0)).alias("dup_ratio"), F.sum("imports").alias("imports"), F.max("doc_coverage").alias("doc_coverage"),
        F.min("indent_share").alias("indent_share"), F.coalesce(F.max("hits"), F.lit(0)).alias("critical"))
    hot = hp.joi_1_hotspot(s, d).select("path", F.col("score").alias("hotspot"))
    return m.withColumn("language", F.substring_index("path", ".", -1)).join(hot, "path", "left").join(_partners(s, d), "path", "left")


def joi_3_tdg_parts(s, d):
    return q.tdg_parts(_measures(s, d)).select("path", "critical", *SIX(*q.TDG_MAX))


def agg_32_tdg_total(s, d):
    return q.tdg_total(q.tdg_parts(_measures(s, d))).select("path", "grade", *SIX("total"))


def agg_33_grades(s, d):
    f = t.table(s, d, "part").select("p_partkey", (F.col("p_size") * 2.0 + 0.5).alias("x"))
    return f.select("p_partkey", stats.grade(F.col("x")).alias("grade"), stats.letter(F.col("x")).alias("letter"))


def agg_34_tdg_project(s, d):
    return q.tdg_project(q.tdg_total(q.tdg_parts(_measures(s, d)))).select("language", "files", "grade", *SIX("mean"))


def _components(s, d):
    """Eleven components of each brand from its parts; brands without a measure lack the component."""
    p = t.table(s, d, "part").withColumn("k", F.col("p_partkey") % 11)
    g = p.groupBy(F.col("p_brand").alias("area"), "k").agg(F.avg("p_size").alias("m"), F.count("*").alias("n"))
    m = F.col("m")
    by = {0: ("complexity", m), 1: ("deadcode", F.floor(m)), 2: ("churn", m / 50), 3: ("duplication", m / 200), 4: ("cohesion", m / 8), 6: ("defect", m / 50), 7: ("tdg", m * 2), 9: ("smells", m / 100), 10: ("satd", m / 40)}
    name, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, (c, x) in by.items():
        name, score = F.when(F.col("k") == k, c).otherwise(name), F.when(F.col("k") == k, q.component_score(c, x)).otherwise(score)
    name = F.when(F.col("k") == 5, "ownership").when(F.col("k") == 8, "coupling").otherwise(name)
    score = F.when(F.col("k") == 5, q.component_score("ownership", F.floor(m / 7), m / 50)).otherwise(score)
    score = F.when((F.col("k") == 8) & (F.col("n") > 7), q.coupling_score(F.floor(m) % 4, m / 5, m * 2, m / 500)).otherwise(score)
    return g.select("area", name.alias("component"), score.alias("score"))


def agg_35_component_scores(s, d):
    return _components(s, d).select("area", "component", *SIX("score"))


def agg_36_composite(s, d):
    return q.composite(_components(s, d), ["area"]).select("area", "grade", "critical", "skipped", *SIX("score"))


def _monthly(s, d):
    c = t.commits(s, d)
    return c.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.max("size").alias("score"))


def agg_37_regression(s, d):
    return q.regression(_monthly(s, d), "score", [], ["month"]).select("n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2", "correlation")])


def agg_38_component_trends(s, d):
    c = t.commits(s, d)
    m = c.groupBy("status", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.max("size").alias("score"))
    flat = c.groupBy(F.lit("flat").alias("status"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.lit(7.0).alias("score"))
    return q.regression(m.unionByName(flat), "score", ["status"], ["month"]).select("status", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2", "correlation")])


def win_10_regression_index(s, d):
    from pyspark.sql import Window

    return _monthly(s, d).withColumn("x", F.row_number().over(Window.orderBy("month")) - 1)


def win_8_sample_grid(s, d):
    return q.sample_grid(t.commits(s, d), 24)


def joi_8_as_of(s, d):
    c = t.commits(s, d)
    return q.as_of(q.sample_grid(c, 24), c)


def joi_9_window_messages(s, d):
    c = t.commits(s, d)
    return q.window_messages(q.sample_grid(c, 24), c)


def joi_6_debt(s, d):
    """JOI-6: debt markers whose place is no stub line, per area."""
    li = t.table(s, d, "lineitem")
    marks = li.where("l_discount > 0.08").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("area"))
    stubs = li.where("l_tax > 0.06").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    left = marks.join(stubs, ["file", "line"], "left_anti").groupBy("area").agg(F.count("*").alias("marks"), F.count_distinct("file").alias("files"))
    return left.withColumn("score", F.round(q.component_score("satd", F.col("marks") / F.col("files") / 3), 6))


def joi_7_reported_elsewhere(s, d):
    """JOI-7: candidates without those another tool reports at the same place."""
    li = t.table(s, d, "lineitem")
    tool = li.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber").distinct()
    return li.where("l_quantity > 48").select("l_orderkey", "l_linenumber", "l_partkey").join(tool, ["l_orderkey", "l_linenumber"], "left_anti")


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "joi", "win") and callable(v)}


def _cdf(x: str, table) -> str:
    out = f"case when {x} <= {table[0][0]} then {table[0][1]}::double"
    for (x0, y0), (x1, y1) in zip(table, table[1:]):
        out += f" when {x} <= {x1} then {y0}::double + ({x} - {x0}::double) * {y1 - y0!r}::double / {x1 - x0!r}::double"
    return out + f" else {table[-1][1]}::double end"


_DEFECT = CTE + hp._PAIRS.format(most=100, least=2) + """, cc as (select path, count(*) as cochanges from (select path_a as path from co union all select path_b from co) group by path), gi as (select path, least(commits / 20.0::double, 1) as churn, authors as contributors from ch),
du as (select path, 1 - count(distinct content_hash) / count(*)::double as duplication from (select distinct file_path as path, symbol_name, chunk_index, content_hash from symbols where content_hash is not null) group by path),
di as (select fi.path, loc, coalesce(round(churn, 6), 0) as churn, coalesce(contributors, 1) as contributors, complexity is null as estimated, coalesce(complexity::double, least(loc / 30.0::double, 50)) as complexity, coalesce(duplication, 0) as duplication, coalesce(cochanges, 0) as coupling
  from fi left join gi using (path) left join du using (path) left join cc using (path)),
dp as (select path, 1 / (1 + exp(-10 * (""" + f"0.30::double * ({_cdf('churn', q.CDF['churn'])}) + 0.25::double * least(greatest(duplication, 0), 1) + 0.20::double * ({_cdf('complexity', q.CDF['complexity'])}) + 0.10::double * ({_cdf('coupling', q.CDF['coupling'])}) + 0.15::double * ({_cdf('contributors', q.CDF['ownership'])})" + """ - 0.5::double))) as probability,
  case when loc < 10 then 0.5 when loc < 50 then 0.8 else 1.0::double end * case when churn = 0 then 0.85 else 1.0::double end * case when estimated then 0.85 else 1.0::double end as confidence from di),
dr as (select *, case when probability >= 0.7 then 'high' when probability >= 0.3 then 'medium' else 'low' end as risk from dp) """
_G = "case " + " ".join(f"when {{x}} >= {a} then '{b}'" for a, b in stats.GRADES) + " else 'F' end"
_L = "case " + " ".join(f"when {{x}} >= {a} then '{b}'" for a, b in stats.LETTERS) + " else 'F' end"
_TDG = CTE + hp._HOT + hp._PAIRS.format(most=100, least=2).replace(", one as", ", one as", 1) + """, cc as (select path, count(*) as cochanges from (select path_a as path from co union all select path_b from co) group by path),
lx as (""" + xp.SQL["txt_21_lexical"] + """), dl as (""" + xp.SQL["txt_21_duplicate_lines"] + """), cr as (""" + xp.SQL["txt_22_critical_patterns"] + """), pa as (select distinct id, file_path as path from symbols),
me as (select path, sum(cyclomatic)::bigint as cyclomatic, max(nesting) as nesting, coalesce(max(dup_ratio), 0) as dup_ratio, sum(imports)::bigint as imports, max(doc_coverage) as doc_coverage, min(indent_share) as indent_share, coalesce(max(hits), 0) as critical from lx join pa using (id) left join dl using (id) left join cr using (id) group by path),
ms as (select me.*, string_split(path, '.')[-1] as language, hot.score as hotspot, cochanges from me left join hot using (path) left join cc using (path)),
tp as (select path, language, critical, 20 - case when cyclomatic > 30 then least(cyclomatic - 30, 15) * 0.5::double else 0 end as structural, 15 - case when nesting > 4 then least(nesting - 4, 10)::double else 0 end as semantic,
  15 - case when dup_ratio > 0.1 then least(20 * dup_ratio, 20) else 0 end as duplication, 15 - case when imports > 20 then least((imports - 20) * 0.2::double, 10) else 0 end as coupling, doc_coverage * 5 as documentation, indent_share * 10 as consistency,
  coalesce(10 * (1 - hotspot), 10) as hotspot, coalesce(10 * (1 - cochanges / (max(cochanges) over ())::double), 10) as temporal from ms),
tr as (select *, """ + " + ".join(f"least(greatest({k}, 0), {v})" for k, v in q.TDG_MAX.items()) + """ as raw from tp),
tt as (select path, language, critical, case when critical > 0 then 0 when raw > 100 then raw / 110 * 100 else raw end as total from tr) """
_COMP = """with g as (select p_brand as area, p_partkey % 11 as k, avg(p_size) as m, count(*) as n from part group by all),
v as (select *, case k when 1 then floor(m) when 2 then m / 50 when 3 then m / 200 when 4 then m / 8 when 6 then m / 50 when 7 then m * 2 when 9 then m / 100 when 10 then m / 40 else m end as x, m / 50 as y, m / 5 as md, m * 2 as mx from g),
c as (select area, case k when 0 then 'complexity' when 1 then 'deadcode' when 2 then 'churn' when 3 then 'duplication' when 4 then 'cohesion' when 5 then 'ownership' when 6 then 'defect' when 7 then 'tdg' when 8 then 'coupling' when 9 then 'smells' else 'satd' end as component,
 case k when 0 then greatest(0, case when x <= 10 then 100 - x when x <= 20 then 70 + 2 * (20 - x) when x <= 40 then 50 + (40 - x) else 50 - (x - 40) end)
 when 1 then greatest(0, case when x <= 0 then 100 when x <= 5 then 90 - 2 * x when x <= 20 then 80 - 2 * (x - 5) else 50 - (x - 20) end)
 when 2 then greatest(0, case when x <= 0.1 then 100 when x <= 0.3 then 80 + 100 * (0.3 - x) when x <= 0.5 then 60 + 100 * (0.5 - x) when x <= 0.8 then 40 + 66.67 * (0.8 - x) else 40 - 50 * (x - 0.8) end)
 when 3 then greatest(0, case when x <= 0 then 100 when x <= 0.05 then 90 + 200 * (0.05 - x) when x <= 0.1 then 70 + 400 * (0.1 - x) when x <= 0.2 then 50 + 200 * (0.2 - x) else 50 - 100 * (x - 0.2) end)
 when 4 then greatest(0, case when x <= 1 then 100 when x <= 2 then 80 + 20 * (2 - x) when x <= 5 then 50 + 10 * (5 - x) else 50 - 5 * (x - 5) end)
 when 5 then case when floor(m / 7) <= 1 then 20 when floor(m / 7) <= 3 then 35 when floor(m / 7) <= 5 then 45 else 50 end + greatest(0, case when y <= 0.1 then 50 when y <= 0.3 then 30 + 100 * (0.3 - y) when y <= 0.5 then 10 + 100 * (0.5 - y) else 10 - 20 * (y - 0.5) end)
 when 6 then greatest(0, case when x <= 0.1 then 100 when x <= 0.3 then 80 + 100 * (0.3 - x) when x <= 0.5 then 60 + 100 * (0.5 - x) when x <= 0.7 then 40 + 100 * (0.7 - x) else 40 - 100 * (x - 0.7) end)
 when 7 then least(greatest(x, 0), 100)
 when 8 then case when n > 7 then greatest(35 - 5 * (floor(m)::int % 4), 0) + greatest(case when md <= 2 then 35 when md <= 5 then 20 + 5 * (5 - md) when md <= 10 then 5 + 3 * (10 - md) else 5 - (md - 10) end, 0)
   + greatest(30 - least(case when mx <= 10 then 0 when mx <= 30 then 0.3 * (mx - 10) when mx <= 80 then 6 + 0.2 * (mx - 30) else 16 + 0.1 * (mx - 80) end, 20) - least(100 * m / 500, 10), 0) end
 when 9 then 100 * exp(-2.5 * x)
 else greatest(0, case when x <= 0 then 100 when x <= 0.1 then 90 + 100 * (0.1 - x) when x <= 0.5 then 70 + 50 * (0.5 - x) when x <= 1 then 50 + 40 * (1 - x) else 50 - 10 * (x - 1) end) end::double as score from v) """
_WCASE = "case component " + " ".join(f"when '{k}' then {v}" for k, v in q.SCORE_WEIGHTS.items()) + " end::double"
_GRID = CTE + ", b as (select epoch(min(ts))::bigint as a, epoch(max(ts))::bigint as z from cm), gr as (select i::int as i, (a + floor((z - a) * i / 23.0::double))::bigint as t from b, range(24) r(i)), gw as (select i, t, lag(t, 1, 0) over (order by i) as before from gr) "
_REGR = "count(*) as n, round(regr_slope(score, x), 4) as slope, round(regr_intercept(score, x), 4) as intercept, round(case when var_pop(score) = 0 then 0 else regr_r2(score, x) end, 4) as r2, round(sqrt(case when var_pop(score) = 0 then 0 else regr_r2(score, x) end), 4) as correlation"

SQL = {
    "joi_2_defect_inputs": _DEFECT + "select path, loc, contributors, estimated, coupling, round(churn, 6) as churn, round(complexity, 6) as complexity, round(duplication, 6) as duplication from di",
    "agg_15_defect_probability": _DEFECT + "select path, risk, round(probability, 6) as probability, round(confidence, 6) as confidence from dr",
    "agg_16_cdf_interpolation": "with f as (select p_partkey, p_size / 2.0::double as x, p_size / 2.0::double / 25 as c from part) select p_partkey, " + ", ".join(f"round({_cdf('c' if k == 'churn' else 'x', v)}, 6) as {k}" for k, v in q.CDF.items()) + " from f",
    "agg_17_defect_summary": _DEFECT + "select risk, count(*) as files, round(avg(probability), 6) as mean, round(avg(confidence), 6) as confidence from dr group by risk",
    "joi_3_tdg_parts": _TDG + "select path, critical, " + ", ".join(f"round({k}, 6) as {k}" for k in q.TDG_MAX) + " from tp",
    "agg_32_tdg_total": _TDG + f"select path, case when critical > 0 then 'F' else {_G.format(x='total')} end as grade, round(total, 6) as total from tt",
    "agg_33_grades": f"with f as (select p_partkey, p_size * 2.0 + 0.5 as x from part) select p_partkey, {_G.format(x='x')} as grade, {_L.format(x='x')} as letter from f",
    "agg_34_tdg_project": _TDG + f", p as (select language, count(*) as files, avg(total) as mean from tt group by language) select language, files, {_G.format(x='mean')} as grade, round(mean, 6) as mean from p",
    "agg_35_component_scores": _COMP + "select area, component, round(score, 6) as score from c",
    "agg_36_composite": _COMP + f", w as (select *, case when score is null then 0 else {_WCASE} end as w from c), a as (select area, coalesce(sum(score * w) / nullif(sum(w), 0), 100) as score, count(*) filter (score < 50) as critical, coalesce(string_agg(case when score is null then component end, ',' order by component), '') as skipped from w group by area) select area, {_L.format(x='score')} as grade, critical, skipped, round(score, 6) as score from a",
    "agg_37_regression": CTE + f", m as (select strftime(ts, '%Y-%m') as month, max(size) as score from cm group by 1), r as (select *, row_number() over (order by month) - 1 as x from m) select {_REGR} from r",
    "agg_38_component_trends": CTE + f", m as (select status, strftime(ts, '%Y-%m') as month, max(size) as score from cm group by all union all select distinct 'flat', strftime(ts, '%Y-%m'), 7.0::double from cm), r as (select *, row_number() over (partition by status order by month) - 1 as x from m) select status, {_REGR} from r group by status",
    "win_10_regression_index": CTE + ", m as (select strftime(ts, '%Y-%m') as month, max(size) as score from cm group by 1) select month, score, row_number() over (order by month) - 1 as x from m",
    "win_8_sample_grid": _GRID + "select * from gw",
    "joi_8_as_of": _GRID + ", x as (select i, t, (select c.sha from cm c where epoch(c.ts) <= t order by c.ts desc, c.sha desc limit 1) as sha from gw), y as (select *, lag(sha) over (order by i) as p from x) select i, t, sha from y where sha is not null and (p is null or p <> sha)",
    "joi_9_window_messages": _GRID + ", x as (select i, cm.sha, message, row_number() over (partition by i order by ts desc, cm.sha desc) as rank from cm join gw on epoch(ts) > before and epoch(ts) <= t) select i, rank, sha, message from x where rank <= 5",
    "joi_6_debt": "with st as (select distinct l_orderkey, l_linenumber from lineitem where l_tax > 0.06), mk as (select l_orderkey as file, l_returnflag as area from lineitem li where l_discount > 0.08 and not exists (select 1 from st where st.l_orderkey = li.l_orderkey and st.l_linenumber = li.l_linenumber)), a as (select area, count(*) as marks, count(distinct file) as files from mk group by area), b as (select *, marks / files::double / 3 as x from a) select area, marks, files, round(greatest(0, case when x <= 0 then 100 when x <= 0.1 then 90 + 100 * (0.1 - x) when x <= 0.5 then 70 + 50 * (0.5 - x) when x <= 1 then 50 + 40 * (1 - x) else 50 - 10 * (x - 1) end)::double, 6) as score from b",
    "joi_7_reported_elsewhere": "with o as (select distinct l_orderkey, l_linenumber from lineitem where l_linestatus = 'O') select l_orderkey, l_linenumber, l_partkey from lineitem li where l_quantity > 48 and not exists (select 1 from o where o.l_orderkey = li.l_orderkey and o.l_linenumber = li.l_linenumber)",
}
