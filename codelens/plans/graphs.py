"""Queries of graph operators: dependencies between nations, calls between parts and symbols; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelens.functions import stats
from codelens.operators import clones
from codelens.operators import graphs as g
from codelens.operators import quality as q
from codelens.plans.history import SIX
from codelens.sources import tables as t
from codelens.sources.checkpoints import cut


def gra_1_dependencies(s, d):
    """GRA-1: the three suppliers' nations that each customers' nation buys most from, self edges dropped."""
    li, o, c, su = t.table(s, d, "lineitem"), t.table(s, d, "orders"), t.table(s, d, "customer"), t.table(s, d, "supplier")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(su, li["l_suppkey"] == su["s_suppkey"])
    v = j.groupBy(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).agg(F.sum("l_quantity").alias("v"))
    r = v.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("v"), "dst"))).where("r <= 3")
    return g.clean_edges(r)


def _calls(s, d):
    """The next part within an order calls the one before."""
    li = t.table(s, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    return g.clean_edges(e)


def gra_1_calls(s, d):
    return _calls(s, d)


def gra_2_pagerank(s, d):
    e = gra_1_dependencies(s, d)
    return g.pagerank(e, g.nodes_of(e), 20).select("node", F.round("rank", 4).alias("rank"))


def gra_2_call_rank(s, d):
    e = _calls(s, d)
    return g.pagerank(e, cut(g.nodes_of(e)), 100, tolerance=1e-6).select("node", F.round(F.col("rank") * 1000, 4).alias("rank"))


def gra_3_betweenness(s, d):
    e = gra_1_dependencies(s, d)
    return g.betweenness(e, g.nodes_of(e)).select("node", *SIX("betweenness"))


def gra_4_cycles(s, d):
    return g.strong_components(gra_1_dependencies(s, d))


def gra_5_components(s, d):
    """GRA-5: connected components of calls."""
    return g.connected_components(_calls(s, d))


def gra_6_callers(s, d):
    """GRA-6: what the parts whose id is divisible by 50 reach in three calls."""
    e = _calls(s, d)
    return g.bfs(e, g.nodes_of(e).where("node % 50 = 0"), 3)


def gra_6_callees(s, d):
    """The same in two calls against their direction."""
    e = _calls(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.bfs(e, g.nodes_of(e).where("node % 50 = 0"), 2)


def gra_7_reachability(s, d):
    """GRA-7: parts reached from entry points."""
    e = _calls(s, d)
    return g.reachable(e, g.nodes_of(e).where("node % 50 = 0"))


def gra_8_inheritance(s, d):
    return g.depth_of_inheritance(t.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 7)).alias("parent")))


def _degrees(s, d):
    e = _calls(s, d)
    return g.degrees(e, g.nodes_of(e)), e


def agg_19_coupling(s, d):
    e = _calls(s, d)
    return q.coupling_counts(e, g.nodes_of(e))


def gra_9_smells(s, d):
    deg, e = _degrees(s, d)
    return g.smells(deg, e)


def joi_14_unstable(s, d):
    return gra_9_smells(s, d).where("kind = 'unstable_dependency'").select("node", "other")


def agg_28_smell_rollup(s, d):
    deg, e = _degrees(s, d)
    k = g.smells(deg, e).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"))
    return k.join(F.broadcast(deg.agg(F.round(F.avg("instability"), 6).alias("mean_instability"))))


def agg_43_graph_summary(s, d):
    deg, e = _degrees(s, d)
    n = deg.agg(F.count("*").alias("nodes"), F.max(F.col("in_degree") + F.col("out_degree")).alias("max_degree"), F.avg("instability").alias("instability"))
    return n.join(F.broadcast(e.agg(F.count("*").alias("edges")))).select("nodes", "edges", "max_degree", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("mean_degree"), *SIX("instability"))


def _symbols(s, d):
    return t.table(s, d, "symbols").select("id", F.col("file_path").alias("file"), F.col("symbol_name").alias("name"), "enriched_text").distinct()


def _symbol_calls(s, d):
    y = _symbols(s, d)
    c = y.select(F.concat_ws(":", "file", "name").alias("caller"), "file", "name", F.explode(F.array_distinct(F.regexp_extract_all("enriched_text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("callee"))
    return c.where("callee <> name").select("caller", "file", "callee").distinct()


def gra_12_symbol_calls(s, d):
    """GRA-12: names that each symbol calls."""
    return _symbol_calls(s, d)


def joi_15_resolved_calls(s, d):
    return g.resolve_calls(_symbol_calls(s, d), _symbols(s, d)).where("target is not null").distinct()


def joi_16_call_edges(s, d):
    return g.resolve_calls_all(_symbol_calls(s, d), _symbols(s, d)).distinct()


def joi_17_imports(s, d):
    """JOI-17: every indexed file imports the stem that comes before its own, whichever files have it."""
    f = t.table(s, d, "parsed_files").select(F.col("rel_path").alias("path")).distinct()
    stem = F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)
    i = f.select(F.col("path").alias("src"), F.lag(stem).over(Window.partitionBy(F.substring_index("path", "/", 1)).orderBy("path")).alias("import")).where("import is not null")
    return g.resolve_imports(i, f)


def agg_46_repomap_summary(s, d):
    e = joi_15_resolved_calls(s, d)
    return _symbols(s, d).agg(F.count_distinct("file").alias("files"), F.count_distinct("file", "name").alias("symbols")).join(F.broadcast(e.agg(F.count("*").alias("calls"), F.count_distinct("target").alias("called"))))


def srt_5_top_symbols(s, d):
    """SRT-5: symbols by callers, cut to clamp(tokens / 250, 5, 100) for a budget of 4000 tokens."""
    return joi_15_resolved_calls(s, d).groupBy("target").agg(F.count_distinct("caller").alias("callers")).orderBy(F.desc("callers"), "target").limit(max(5, min(100, 4000 // 250)))


def gra_10_symbol_report(s, d):
    """GRA-10: definitions, direct callers and callees of the most called symbol's name."""
    e = joi_15_resolved_calls(s, d)
    top = e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(1).select("target")
    callers = e.join(F.broadcast(top), "target").select(F.lit("caller").alias("role"), F.col("caller").alias("symbol"))  # one row
    callees = e.join(F.broadcast(top.select(F.col("target").alias("caller"))), "caller").select(F.lit("callee").alias("role"), F.col("target").alias("symbol"))
    return top.select(F.lit("symbol").alias("role"), F.col("target").alias("symbol")).union(callers).union(callees).distinct()


def agg_30_lcom(s, d):
    """AGG-30: connected components of an order's lines that share suppliers; AGG-29 beside it: methods and fields."""
    li = t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("f")).distinct()
    return lcom(li)


def lcom(uses):
    """uses: class c, method m, field f. Components of the methods of all classes at once."""
    first = uses.groupBy("c", "f").agg(F.min("m").alias("one"))
    node = lambda m: F.xxhash64("c", m)
    # methods that share a field are joined to the first of them: few edges, most of which are a method's own
    e = uses.join(first, ["c", "f"]).select(node("m").alias("src"), node("one").alias("dst"))
    comp = g.connected_components(e)
    m = uses.select("c", "m", "f", node("m").alias("node")).join(comp, "node")
    return m.groupBy("c").agg(F.count_distinct("component").alias("lcom"), F.count_distinct("m").alias("methods"), F.count_distinct("f").alias("fields"))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "joi", "gra", "srt") and callable(v)}

_DEP = """with {rec} v as (select c_nationkey::bigint as src, s_nationkey::bigint as dst, sum(l_quantity) as v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all),
r as (select *, row_number() over (partition by src order by v desc, dst) as r from v), e as (select distinct src, dst from r where r <= 3 and src <> dst), nd as (select src as node from e union select dst from e)"""
_CALL = """with {rec} l as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem), e as (select distinct src, dst from l where dst is not null and src <> dst), nd as (select src as node from e union select dst from e)"""
_DEG = ", dg as (select node, count(*) filter (d = 1) as in_degree, count(*) filter (d = 0) as out_degree from (select src as node, 0 as d from e union all select dst, 1 from e) group by node), di as (select *, coalesce(out_degree / nullif(in_degree + out_degree, 0)::double, 0) as instability from dg), sm as (select 'central_connector' as kind, 'high' as severity, node, null::bigint as other from di where in_degree > 10 and out_degree > 10 union all select 'hub', 'high', node, null from di where not (in_degree > 10 and out_degree > 10) and in_degree + out_degree > 20 and in_degree >= 3 union all select 'unstable_dependency', 'medium', src, dst from e join di a on a.node = src join di b on b.node = dst where a.instability < 0.3 and b.instability > 0.7 and b.instability - a.instability > 0.4)"


def _ranks(rounds: int) -> str:
    out = ", od as (select src, count(*) as deg from e group by src), n as (select count(*) as n from nd), p0 as materialized (select node, 1.0::double / n as rank from nd, n)"
    for i in range(rounds):
        out += f", p{i + 1} as materialized (select nd.node, 0.15::double / any_value(n) + 0.85::double * coalesce(sum(rank / deg), 0) as rank from nd cross join n left join e on e.dst = nd.node left join p{i} on p{i}.node = e.src left join od on od.src = e.src group by nd.node)"
    return out


_Y = r"""with y as (select distinct id, file_path as file, symbol_name as name, enriched_text from symbols), c0 as (select file || ':' || name as caller, file, name, unnest(regexp_extract_all(enriched_text, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) as callee from y), c as (select distinct caller, file, callee from c0 where callee <> name),
qy as (select distinct file || ':' || name as q, name from y), ay as (select name, min(q) as q from qy group by name), rc as (select distinct caller, callee, coalesce(t1.q, t2.q, t3.q) as target, case when t1.q is not null then 1 when t2.q is not null then 2 else 3 end as tier from c left join qy t1 on t1.q = callee left join qy t2 on t2.q = file || ':' || callee left join ay t3 on t3.name = callee where coalesce(t1.q, t2.q, t3.q) is not null) """
_BFS = ", b(root, node, level) as (select node, node, 0 from nd where node % 50 = 0 union select root, e.dst, level + 1 from b join e on e.src = b.node where level < {k}) select root, node, min(level) as level from b group by root, node having min(level) > 0"

SQL = {
    "gra_1_dependencies": _DEP.format(rec="") + "select src, dst from e",
    "gra_1_calls": _CALL.format(rec="") + "select src, dst from e",
    "gra_2_pagerank": _DEP.format(rec="") + _ranks(20) + "select node, round(rank, 4) as rank from p20",
    "gra_4_cycles": _DEP.format(rec="recursive") + ", rc(a, b) as (select src, dst from e union select rc.a, e.dst from rc join e on e.src = rc.b), m as (select x.a, x.b from rc x join rc y on x.a = y.b and x.b = y.a) select a as node, max(b) as component from m group by a having count(*) > 1",
    "gra_6_callers": _CALL.format(rec="recursive") + _BFS.format(k=3),
    "gra_6_callees": _CALL.format(rec="recursive").replace("e as (select distinct src, dst from l", "e as (select distinct dst as src, src as dst from l") + _BFS.format(k=2),
    "gra_7_reachability": _CALL.format(rec="recursive") + ", b(node) as (select node from nd where node % 50 = 0 union select e.dst from b join e on e.src = b.node) select node from b",
    "gra_8_inheritance": "with recursive p as (select p_partkey as node, p_partkey // 7 as parent from part), b(node, depth) as (select node, 0 from p where node = 0 union select p.node, depth + 1 from b join p on p.parent = b.node and p.node > 0) select b.node, min(depth) as depth, (select count(*) from p where parent = b.node and p.node > 0) as children from b group by b.node",
    "agg_19_coupling": _CALL.format(rec="") + "select node, (select count(*) from e where dst = node) as afferent, (select count(*) from e where src = node) as efferent from nd",
    "gra_9_smells": _CALL.format(rec="") + _DEG + "select * from sm",
    "joi_14_unstable": _CALL.format(rec="") + _DEG + "select node, other from sm where kind = 'unstable_dependency'",
    "agg_28_smell_rollup": _CALL.format(rec="") + _DEG + "select kind, count(*) as n, count(*) filter (severity = 'high') as high, (select round(avg(instability), 6) from di) as mean_instability from sm group by kind",
    "agg_43_graph_summary": _CALL.format(rec="") + _DEG + "select count(*) as nodes, (select count(*) from e) as edges, max(in_degree + out_degree) as max_degree, round(2 * (select count(*) from e) / count(*)::double, 6) as mean_degree, round(avg(instability), 6) as instability from di",
    "gra_12_symbol_calls": _Y + "select * from c",
    "joi_15_resolved_calls": _Y + "select * from rc",
    "joi_16_call_edges": _Y + ", d as (select distinct file, name from y) select distinct caller, callee, coalesce(h.file, o.file) || ':' || callee as target from c left join d h on h.file = c.file and h.name = callee left join d o on h.file is null and o.name = callee where coalesce(h.file, o.file) is not null",
    "joi_17_imports": r"with f as (select distinct rel_path as path from parsed_files), x as (select path, coalesce(regexp_extract(path, '^(.*/)?[^/]*$', 1), '') as dir, regexp_extract(path, '([^/.]*)[^/]*$', 1) as stem from f), i as (select path as src, dir as here, lag(stem) over (partition by split_part(path, '/', 1) order by path) as imp from x), c as (select src, imp, case when dir = here then 1 else 2 end as tier, x.path as target, row_number() over (partition by src, imp order by case when dir = here then 1 else 2 end, length(x.path), x.path) as r from i join x on x.stem = imp and x.path <> src) select src, imp as import, tier, target from c where r = 1",
    "agg_46_repomap_summary": _Y + "select (select count(distinct file) from y) as files, (select count(*) from (select distinct file, name from y)) as symbols, (select count(*) from rc) as calls, (select count(distinct target) from rc) as called",
    "srt_5_top_symbols": _Y + "select target, count(distinct caller) as callers from rc group by target order by callers desc, target limit 16",
    "gra_10_symbol_report": _Y + ", tp as (select target from rc group by target order by count(*) desc, target limit 1) select 'symbol' as role, target as symbol from tp union select 'caller', caller from rc where target in (select target from tp) union select 'callee', target from rc where caller in (select target from tp)",
    "agg_30_lcom": "with recursive u as (select distinct l_orderkey as c, l_linenumber as m, l_suppkey as f from lineitem), p as (select distinct a.c, a.m as a, b.m as b from u a join u b on a.c = b.c and a.f = b.f), cc(c, m, low) as (select distinct c, m, m from u union select p.c, p.b, cc.low from cc join p on p.c = cc.c and p.a = cc.m), lo as (select c, m, min(low) as low from cc group by c, m), n as (select c, count(distinct low) as lcom, count(*) as methods from lo group by c) select n.c, lcom, methods, fields from n join (select c, count(distinct f) as fields from u group by c) using (c)",
}
