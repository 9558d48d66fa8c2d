"""Queries of clone detection over indexed symbols (a fragment each), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import clones as c
from codelens.sources import tables as t
from codelens.sources.checkpoints import cut


def _rows(s, d):
    return t.table(s, d, "symbols").select("id", "file_path", "enriched_text").distinct()


def _frags(s, d):
    return c.fragments(_rows(s, d), "id", "enriched_text")


def txt_14_tokens(s, d):
    """TXT-14: how often each token occurs."""
    return _rows(s, d).select(F.explode(c.tokens(F.col("enriched_text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def txt_15_normalised(s, d):
    return _rows(s, d).select("id", F.md5(F.concat_ws(" ", c.normalised(c.tokens(F.col("enriched_text"))))).alias("fp"))


def txt_17_shingles(s, d):
    return _rows(s, d).select("id", F.size(c.shingles(c.normalised(c.tokens(F.col("enriched_text"))))).alias("shingles"))


def ml_1_minhash(s, d):
    sg = c.signatures(_frags(s, d))
    return sg.select("fp", F.col("sig")[0].alias("h1"), F.col("sig")[99].alias("h100"), F.col("sig")[199].alias("h200"), F.aggregate("sig", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def ml_2_fingerprints(s, d):
    return _frags(s, d).groupBy("fp").agg(F.count("*").alias("fragments"), F.max("n_tokens").alias("n_tokens"))


def _pairs(s, d):
    return c.similar(cut(c.signatures(_frags(s, d))), 0.9)


def joi_13_similar(s, d):
    """JOI-12 and JOI-13: similar pairs between representatives of equal fragments."""
    return _pairs(s, d).select("a", "b", F.round("similarity", 6).alias("similarity"), c.clone_type(F.col("similarity")).alias("kind"))


def agg_25_clone_groups(s, d):
    """AGG-25: each fragment of a clone class, the class, its members and the fragment's links."""
    p = cut(_pairs(s, d))
    return c.groups(_frags(s, d), p).select("frag", "class", "members", "links")


def agg_26_clone_summary(s, d):
    p = cut(_pairs(s, d))
    g = c.groups(_frags(s, d), p)
    n = _frags(s, d).agg(F.count("*").alias("fragments"))
    return g.agg(F.count_distinct("class").alias("classes"), F.count("*").alias("cloned"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).join(F.broadcast(n))


def agg_27_duplication_hotspots(s, d):
    """AGG-27: files by ln(tokens + 1) * sqrt(classes), the ten first."""
    g = c.groups(_frags(s, d), cut(_pairs(s, d))).join(_rows(s, d).select(F.col("id").alias("frag"), "file_path"), "frag")
    f = g.groupBy("file_path").agg(F.sum("n_tokens").alias("n"), F.count_distinct("class").alias("classes"))
    return f.select("file_path", "classes", F.round(F.log1p("n") * F.sqrt("classes"), 6).alias("severity")).orderBy(F.desc("severity"), "file_path").limit(10)


def agg_18_duplication_ratio(s, d):
    """AGG-18: share of each file's tokens in clones, 1 at most."""
    ids = _frags(s, d).select("frag", "n_tokens").join(_rows(s, d).select(F.col("id").alias("frag"), "file_path"), "frag").groupBy("file_path").agg(F.sum("n_tokens").alias("total"))
    g = c.groups(_frags(s, d), cut(_pairs(s, d))).join(_rows(s, d).select(F.col("id").alias("frag"), "file_path"), "frag").groupBy("file_path").agg(F.sum("n_tokens").alias("n"))
    return ids.join(g, "file_path", "left").select("file_path", F.round(F.least(F.coalesce(F.col("n"), F.lit(0)) / F.col("total"), F.lit(1.0)), 6).alias("ratio"))


def joi_10_interval_overlap(s, d):
    """JOI-10: pairs of symbols of one run and file whose line ranges overlap, which clone pairs must not."""
    r = t.table(s, d, "symbols").select("id", "run_id", "file_path", "start_line", "end_line").distinct()
    a, b = r.toDF("a", "run_id", "file_path", "s1", "e1"), r.toDF("b", "run_id", "file_path", "s2", "e2")
    return a.join(b, ["run_id", "file_path"]).where("a < b and s1 <= e2 and s2 <= e1").select("a", "b")


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "joi", "txt", "ml") and callable(v)}

_TOK = c.TOKEN.replace("'", "''")
_KW = ", ".join(f"'{k}'" for k in c.KEYWORDS)
_S = f"""with sy as (select distinct id, file_path, enriched_text from symbols), tk as (select id, file_path, regexp_extract_all(enriched_text, '{_TOK}', 1) as toks from sy where enriched_text is not null),
nm as (select *, list_filter(toks, lambda x: regexp_matches(x, '^[A-Za-z_]') and x not in ({_KW})) as nm0 from tk),
nn as (select id, file_path, toks, list_distinct(nm0) as dn, nm0 from nm),
ord as (select id, file_path, toks, list_filter(nm0, lambda x, i: list_position(nm0, x) = i) as names from nn),
no as (select id, file_path, list_transform(toks, lambda x: case when regexp_matches(x, '^["''0-9]') then 'LITERAL' when regexp_matches(x, '^[A-Za-z_]') and x not in ({_KW}) then 'VAR_' || (list_position(names, x) - 1) else x end) as toks from ord),
fr as (select id as frag, file_path, md5(array_to_string(toks, ' ')) as fp, len(toks) as n_tokens, toks from no where len(toks) >= 50),
sh as (select fp, any_value(list_distinct(list_transform(range(1, greatest(len(toks) - 3, 2)), lambda i: array_to_string(toks[i:i + 4], '')))) as sh from fr group by fp),
sx as (select fp, unnest(list_transform(sh, lambda x: ('0x' || md5(x)[:7])::bigint)) as v from sh),
sd as (select * from (values {", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(c.SEEDS))}) t(i, a, b)),
sg as (select fp, i, min((a * v + b) % {c.PRIME}) as h from sx, sd group by all),
bd as (select fp, (i - 1) // 10 as band, string_agg(h::varchar, ',' order by i) as h from sg group by all),
cd as (select distinct a.fp as a, b.fp as b from bd a join bd b on a.band = b.band and a.h = b.h and a.fp < b.fp),
si as (select cd.a, cd.b, count(*) filter (x.h = y.h) / 200.0::double as similarity from cd join sg x on x.fp = cd.a join sg y on y.fp = cd.b and y.i = x.i group by all having similarity >= 0.9)"""
_REC = _S.replace("with sy", "with recursive sy", 1) + """, ed as (select a, b from si union select b, a from si), cc(fp, low) as (select distinct fp, fp from fr union select ed.b, cc.low from cc join ed on ed.a = cc.fp),
cl as (select fp, min(low) as class from cc group by fp), ln as (select fp, count(*) as links from (select a as fp from si union all select b from si) group by fp),
m as (select frag, file_path, fr.fp, class, coalesce(links, 0) as links, n_tokens from fr join cl using (fp) left join ln using (fp)), mz as (select class, count(*) as members from m group by class having count(*) > 1), g as (select m.*, members from m join mz using (class)) """
SQL = {
    "txt_14_tokens": _S + "select token, count(*) as n from (select unnest(toks) as token from tk) group by token",
    "txt_15_normalised": _S + "select id, md5(array_to_string(toks, ' ')) as fp from no",
    "txt_17_shingles": _S + "select id, case when len(toks) = 0 then 0 else len(list_distinct(list_transform(range(1, greatest(len(toks) - 3, 2)), lambda i: array_to_string(toks[i:i + 4], '')))) end as shingles from no",
    "ml_1_minhash": _S + "select fp, min(h) filter (i = 1) as h1, min(h) filter (i = 100) as h100, min(h) filter (i = 200) as h200, sum(h)::bigint as total from sg group by fp",
    "ml_2_fingerprints": _S + "select fp, count(*) as fragments, max(n_tokens) as n_tokens from fr group by fp",
    "joi_13_similar": _S + "select a, b, round(similarity, 6) as similarity, case when similarity >= 0.95 then 'type1' when similarity >= 0.85 then 'type2' else 'type3' end as kind from si",
    "agg_25_clone_groups": _REC + "select frag, class, members, links from g",
    "agg_26_clone_summary": _REC + "select count(distinct class) as classes, count(*) as cloned, coalesce(sum(n_tokens), 0)::bigint as tokens, (select count(*) from fr) as fragments from g",
    "agg_27_duplication_hotspots": _REC + "select file_path, count(distinct class) as classes, round(ln(sum(n_tokens) + 1) * sqrt(count(distinct class)), 6) as severity from g group by file_path order by severity desc, file_path limit 10",
    "agg_18_duplication_ratio": _REC + ", tt as (select file_path, sum(n_tokens) as total from fr group by 1), gg as (select file_path, sum(n_tokens) as n from g group by 1) select file_path, round(least(coalesce(n, 0) / total::double, 1), 6) as ratio from tt left join gg using (file_path)",
    "joi_10_interval_overlap": "with r as (select distinct id, run_id, file_path, start_line, end_line from symbols) select a.id as a, b.id as b from r a join r b on a.run_id = b.run_id and a.file_path = b.file_path and a.id < b.id and a.start_line <= b.end_line and b.start_line <= a.end_line",
}
