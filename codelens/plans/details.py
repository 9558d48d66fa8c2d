"""Queries of single inventory entries that others contain, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelens.operators import clones as c
from codelens.operators import history as h
from codelens.operators import mutation as m
from codelens.operators import quality as q
from codelens.operators import text as x
from codelens.plans import clones as cp
from codelens.plans import code, graphs, text
from codelens.plans import history as hp
from codelens.plans import mutation as mp
from codelens.plans import quality as qp
from codelens.sources import extract
from codelens.sources import tables as t


def win_3_unique_changes(s, d):
    """WIN-3: earlier touches of the files of a commit."""
    return h.prior_state(t.commits(s, d), t.file_changes(s, d)).where("unique_changes > 0").select("sha", "unique_changes")


def win_4_prior_developers(s, d):
    """WIN-4: distinct earlier authors of the files of a commit."""
    return h.prior_state(t.commits(s, d), t.file_changes(s, d)).where("num_developers > 0").select("sha", "num_developers")


def win_5_log_order(s, d):
    """WIN-5: an author's commits in order of time and sha, ties included."""
    w = Window.partitionBy("author").orderBy("ts", "sha")
    return t.commits(s, d).select("sha", "author", F.row_number().over(w).alias("seq"))


def win_7_sample_windows(s, d):
    """WIN-7: commits within each sample's window."""
    k = t.commits(s, d)
    return q._bucket(q.sample_grid(k, 24), k).groupBy("i").agg(F.count("*").alias("commits"))


def win_9_best_chunk(s, d):
    """WIN-9: of each symbol the chunk of greatest complexity, the first of equals."""
    y = t.table(s, d, "symbols").select("id", "file_path", "symbol_name", F.coalesce("cyclomatic_complexity", F.lit(0)).alias("score")).distinct()
    return y.groupBy("file_path", "symbol_name").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").cast("int").alias("score"))


def joi_12_candidates(s, d):
    """JOI-12: pairs of fragments that share a band."""
    return c.candidates(cp.cut(c.signatures(cp._frags(s, d))))


def set_1_union(s, d):
    """SET-1: results of several tables under one schema."""
    a = t.table(s, d, "source_files").select("path", F.lit("source").alias("origin"))
    b = t.table(s, d, "parsed_files").select(F.col("rel_path").alias("path"), F.lit("index").alias("origin"))
    return a.unionByName(b).groupBy("path", "origin").agg(F.count("*").alias("n"))


def set_2_distinct_changes(s, d):
    """SET-2: distinct (path, kind of change), spellings folded."""
    k = F.lower(F.trim("change_type"))
    kind = F.when(k.isin("m", "modified"), "modified").when(k.isin("a", "added"), "added").when(k.isin("d", "deleted"), "deleted").when(k.isin("r", "renamed"), "renamed").otherwise(k)
    return t.table(s, d, "file_changes").where("path is not null").select("path", kind.alias("kind")).distinct()


def set_4_churn_of_file_set(s, d):
    """SET-4: churned paths that are in the file set."""
    churned = t.table(s, d, "file_changes").where("path is not null").groupBy("path").agg(F.count("*").alias("changes"))
    return churned.join(t.table(s, d, "source_files").select("path"), "path", "left_semi")


def txt_4_ignore_directive(s, d):
    """TXT-4: markers with and without the request to ignore them."""
    rows = s.createDataFrame([(1, "// TODO: a"), (2, "// TODO: b satd:ignore"), (3, "# FIXME SATD:IGNORE"), (4, "# FIXME")], "line_no int, line string")
    return x.satd(rows).select("line_no", "category")


def txt_7_custom_markers(s, d):
    """TXT-7: own markers come last."""
    return x.satd(text._lines(s, d), ["gantry", "orchard"]).where("category = 'custom'").groupBy("marker").agg(F.count("*").alias("items"))


def txt_9_elision(s, d):
    """TXT-9: phrases of unfinished work on literal lines."""
    rows = ["rest of the implementation", "... existing code", "for brevity", "a placeholder root", "TODO: implement later", "not yet implemented", "Stubs are fine", "stubbed out", "your code here", "nothing"]
    r = s.createDataFrame(list(enumerate(rows)), "n int, line string")
    return r.select("n", F.col("line").rlike(x.ELISION).alias("strong"), F.col("line").rlike(x.WEAK_ELISION).alias("weak"), F.col("line").rlike(x.NOT_IMPLEMENTED).alias("message"))


def txt_10_stub_findings(s, d):
    """TXT-10: findings after merging, by function."""
    return code.txt_8_stubs(s, d).groupBy("path", "function").agg(F.min("line").alias("line"), F.min("kind").alias("kind"))


def txt_16_fragments(s, d):
    """TXT-16: fragments of files: their functions, the whole file where there are none."""
    k = code._code(s, d).select("path", "lines", F.explode_outer("functions").alias("f"))
    return k.select("path", F.coalesce("f.start_line", F.lit(1)).alias("first"), F.coalesce("f.end_line", "lines").alias("last"))


def par_5_node_tables(s, d):
    """PAR-5: the words that branch and that nest, by language."""
    rows = [(la, "decision", w) for la, v in extract.DECISIONS.items() for w in v.split()] + [(la, "nesting", w) for la, v in extract.NESTING.items() for w in v]
    return s.createDataFrame(rows, "language string, role string, word string")


def par_7_cognitive(s, d):
    """PAR-7 and PAR-8: functions by cognitive complexity and nesting."""
    return code._measured(s, d).groupBy("language", "nesting").agg(F.count("*").alias("functions"), F.max("cognitive").alias("max_cognitive"))


def par_12_test_ranges(s, d):
    """PAR-12: functions outside test ranges; a range spans from #[cfg(test)] to the end of its module."""
    f = t.table(s, d, "source_files").where("path like '%.rs'").select("path", F.col("content").cast("string").alias("t")).dropDuplicates(["path"])
    l = x.lines(f, "path", "t")
    r = l.where(r"line rlike '^\\s*#\\[cfg\\(test\\)\\]'").groupBy("path").agg(F.min("line_no").alias("a"))
    fn = code._functions(s, d).where("language = 'rust'").select("path", "name", "start_line")
    return fn.join(r, "path", "left").where("a is null or start_line < a").drop("a")


def fil_5_gate(s, d):
    """FIL-5: whether any finding reaches the gate."""
    y = t.table(s, d, "symbols").where("cyclomatic_complexity >= 4").select("id").limit(1)
    return y.agg((F.count("*") > 0).alias("failed"))


def fil_9_score_filters(s, d):
    """FIL-9: hits of at least a score whose complexity is small or unknown."""
    return text._hits(s, d, least=0.3).where("score >= 0.3 and (complexity is null or complexity <= 4)").select("query", "doc", "score")


def srt_1_by_metric(s, d):
    """SRT-1: files by commits, ties by path."""
    return hp.agg_1_file_churn(s, d).select("path", "commits").orderBy(F.desc("commits"), "path").limit(50)


def srt_2_flag_order(s, d):
    """SRT-2: place of each flag by priority, staleness and age."""
    p = hp.joi_18_flag_priority(s, d).drop("files")
    w = Window.orderBy(F.expr("array_position(array('critical','high','medium','low'), priority)"), F.desc("stale"), F.desc("age_days"), "flag")
    return p.select("flag", F.row_number().over(w).alias("place"))


def inc_3_history_windows(s, d):
    """INC-3: commits and authors in windows of 30 days."""
    k = t.commits(s, d).groupBy(F.floor(F.unix_timestamp("ts") / (30 * 86400)).alias("window"))
    return k.agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"))


def src_19_cached_symbols(s, d):
    """SRC-19: distinct rows of the symbol cache, chunks complete."""
    y = t.table(s, d, "symbols").select("id", "file_path", "symbol_name", "chunk_index", "total_chunks").distinct()
    return y.where("chunk_index < total_chunks").groupBy("file_path").agg(F.count_distinct("symbol_name").alias("symbols"), F.count("*").alias("chunks"))


def ml_8_language_mutants(s, d):
    """ML-8: mutants of operators of one language."""
    dim = m.dimension(s)
    own = dim.where("language <> ''").select("operator").distinct()
    return m.mutants(mp._tokens(s, d), dim).join(F.broadcast(own), "operator").groupBy("operator").agg(F.count("*").alias("n"))  # a fixed table


def ml_10_incremental(s, d):
    """ML-10: status of mutants on changed lines."""
    return mp.joi_11_changed_lines(s, d).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("win", "joi", "set", "txt", "par", "fil", "srt", "inc", "src", "ml") and callable(v)}

_L9 = "(values (0, 'rest of the implementation'), (1, '... existing code'), (2, 'for brevity'), (3, 'a placeholder root'), (4, 'TODO: implement later'), (5, 'not yet implemented'), (6, 'Stubs are fine'), (7, 'stubbed out'), (8, 'your code here'), (9, 'nothing')) t(n, line)"
SQL = {
    "win_3_unique_changes": hp.CTE + hp._FEATURES + "select sha, unique_changes from nu where unique_changes > 0",
    "win_4_prior_developers": hp.CTE + hp._FEATURES + "select sha, num_developers from nd",
    "win_5_log_order": hp.CTE + "select sha, author, row_number() over (partition by author order by ts, sha) as seq from cm",
    "win_7_sample_windows": qp._GRID + "select i, count(*) as commits from cm join gw on epoch(ts) > before and epoch(ts) <= t group by i",
    "win_9_best_chunk": "with y as (select distinct id, file_path, symbol_name, coalesce(cyclomatic_complexity, 0)::int as score from symbols), r as (select *, row_number() over (partition by file_path, symbol_name order by score desc, id) as r from y) select file_path, symbol_name, id, score from r where r = 1",
    "joi_12_candidates": cp._S + "select a, b from cd",
    "set_1_union": "select path, 'source' as origin, count(*) as n from source_files group by 1 union all select rel_path, 'index', count(*) from parsed_files group by 1",
    "set_2_distinct_changes": "select distinct path, case when k in ('m', 'modified') then 'modified' when k in ('a', 'added') then 'added' when k in ('d', 'deleted') then 'deleted' when k in ('r', 'renamed') then 'renamed' else k end as kind from (select path, lower(trim(change_type)) as k from file_changes where path is not null)",
    "set_4_churn_of_file_set": "select path, count(*) as changes from file_changes where path in (select path from source_files) group by path",
    "txt_4_ignore_directive": "select * from (values (1, 'requirement'), (4, 'defect')) t(line_no, category)",
    "txt_7_custom_markers": text._S + ", " + text._satd_sql("li", "id, line_no", ["gantry", "orchard"]) + "select marker, count(*) as items from sd where category = 'custom' group by marker",
    "txt_9_elision": f"select n, regexp_matches(line, '{x.ELISION}') as strong, regexp_matches(line, '{x.WEAK_ELISION}') as weak, regexp_matches(line, '{x.NOT_IMPLEMENTED}') as message from {_L9}",
    "fil_5_gate": "select count(*) > 0 as failed from symbols where cyclomatic_complexity >= 4",
    "fil_9_score_filters": text._SEARCH + "select query, doc, score from ht where score >= 0.3 and (complexity is null or complexity <= 4)",
    "srt_1_by_metric": hp.CTE + "select path, commits from ch order by commits desc, path limit 50",
    "srt_2_flag_order": hp._FLAGS + ", mx as (select flag, max(p_size) as mc from (select distinct flag, file from rf) join part on p_partkey = file group by flag), p as (select rs.*, case when coalesce(mc, 0) >= 50 then 1 when mc >= 20 then 2 when mc >= 10 then 3 else 4 end as pr from rs left join mx using (flag)) select flag, row_number() over (order by pr, stale desc, age_days desc, flag) as place from p",
    "inc_3_history_windows": hp.CTE + "select floor(epoch(ts) / (30 * 86400))::bigint as window, count(*) as commits, count(distinct author) as authors from cm group by 1",
    "src_19_cached_symbols": "with y as (select distinct id, file_path, symbol_name, chunk_index, total_chunks from symbols) select file_path, count(distinct symbol_name) as symbols, count(*) as chunks from y where chunk_index < total_chunks group by file_path",
    "ml_8_language_mutants": mp._M + "select operator, count(*) as n from mu where operator in (select operator from dm where only_ <> '') group by operator",
    "ml_10_incremental": mp._R + ", g as (select o_orderkey as file, o_custkey % 3 + 1 as first, o_custkey % 3 + 2 as last from orders where o_orderstatus = 'F'), z as (select distinct r.* from r join g on g.file = r.file and line between first and last) select status, count(*) as n from z group by status",
}
