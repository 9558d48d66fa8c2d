"""Queries of incremental processing (problem 6; INC-1) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.operators import changed as op
from codelens.sources.checkpoints import ensure_folder
from codelens.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Files and chunks that are new or changed since the last successful run.

    The upper limit is the greatest run at the start. A fresh pipeline first commits the state at the last successful run (an
    engine that runs on keeps it from one run to the next and skips this), then the changes of the runs after it, read with
    the limits in the scan, together with the new watermark; the committed changes are the result.
    """
    ensure_folder(spark)
    progress = op.Progress(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/changed-{uuid.uuid4().hex}")
    since = op.last_success(table(spark, d, "sync_runs"))
    units = {"files": ("parsed_files", ["rel_path"], "file_hash", "parsed_at"), "chunks": ("symbols", ["file_path", "symbol_name", "chunk_index"], "content_hash", "created_at")}
    limits = [table(spark, d, name).agg(F.max("run_id").alias("m")) for name, *_ in units.values()]
    upto = limits[0].union(limits[1]).agg(F.max("m")).first()[0]
    upto = max(x for x in (since, upto, 0) if x is not None)
    progress.run(since, lambda _, at: {f"state_{u}": op.state_of(table(spark, d, name), keys, digest, time, at) for u, (name, keys, digest, time) in units.items()})
    kept = {u: progress.read(f"state_{u}") for u in units}

    def step(before: int | None, at: int) -> dict[str, DataFrame]:
        moved = {u: op.increment(table(spark, d, name), kept[u], keys, digest, time, before, at) for u, (name, keys, digest, time) in units.items()}
        files = op.differing(moved["files"], "file_hash").select(F.lit("file").alias("unit"), F.col("rel_path").alias("file_path"), F.lit("").alias("symbol_name"), F.lit(-1).alias("chunk_index"))
        chunks = op.differing(moved["chunks"], "content_hash").select(F.lit("symbol").alias("unit"), "file_path", "symbol_name", "chunk_index")
        return {"changes": files.unionByName(chunks)}

    if progress.run(upto, step) is None:  # nothing came after the last successful run
        return spark.createDataFrame([], "unit string, file_path string, symbol_name string, chunk_index int")
    return progress.read("changes")


_P6 = """
with a as (select run_id, arg_max(status, attempt) as s from sync_runs group by run_id),
w as (select max(run_id) as w from a where s = 'success'),
r as (select 'file' as unit, rel_path as file_path, '' as symbol_name, -1 as chunk_index, run_id, file_hash as h, parsed_at as t from parsed_files where file_hash is not null
  union all select 'symbol', file_path, symbol_name, chunk_index, run_id, content_hash, created_at from symbols where content_hash is not null),
n as (select *, row_number() over (partition by unit, file_path, symbol_name, chunk_index order by t desc, run_id desc, h desc) as k from r),
o as (select r.*, row_number() over (partition by unit, file_path, symbol_name, chunk_index order by t desc, run_id desc, h desc) as k from r, w where run_id <= w.w)
select n.unit, n.file_path, n.symbol_name, n.chunk_index from n left join o on o.k = 1 and o.unit = n.unit and o.file_path is not distinct from n.file_path
  and o.symbol_name is not distinct from n.symbol_name and o.chunk_index is not distinct from n.chunk_index
where n.k = 1 and (o.h is null or o.h <> n.h)
"""


def inc_1_index_diff(spark: SparkSession, d: str) -> DataFrame:
    """INC-1: files that are new, changed, deleted or kept since the index of the last successful run."""
    since = op.last_success(table(spark, d, "sync_runs"))
    f = table(spark, d, "source_files").select("path").distinct().withColumn("there", F.lit(True))
    r = table(spark, d, "parsed_files").where("file_hash is not null")
    order = F.struct("parsed_at", "run_id", "file_hash")
    h = r.groupBy(F.col("rel_path").alias("path")).agg(F.max(order).alias("now"), F.max(F.when(F.col("run_id") <= since, order)).alias("was"))
    was, now = F.col("was.file_hash"), F.col("now.file_hash")
    state = F.when(was.isNull(), "new").when(F.col("there").isNull(), "deleted").when(was != now, "changed").otherwise("kept")
    return f.join(h, "path", "full_outer").select("path", state.alias("state"))


def inc_2_upserted_symbols(spark: SparkSession, d: str) -> DataFrame:
    """INC-2 and SRC-19: the symbol cache after all runs: of each (file, symbol, chunk) the last row, without files that are gone."""
    y = table(spark, d, "symbols").where("content_hash is not null")
    last = y.groupBy("file_path", "symbol_name", "chunk_index").agg(F.max_by("id", F.struct("created_at", "run_id", "id")).alias("id"))
    files = table(spark, d, "source_files").select(F.col("path").alias("file_path")).distinct()
    return last.join(files, "file_path", "left_semi")


def set_3_removed_files(spark: SparkSession, d: str) -> DataFrame:
    """SET-3: touched paths that no indexed file has."""
    return table(spark, d, "file_changes").select("path").where("path is not null").distinct().join(table(spark, d, "parsed_files").select(F.col("rel_path").alias("path")), "path", "left_anti")


def src_8_commit_log(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8, SRC-14: distinct commits since a time, the latest first, cut to a number."""
    c = table(spark, d, "commits").groupBy("sha").agg(F.min("ts").alias("ts"), F.max_by("author", F.struct("ingested_at", "author")).alias("author"))
    return c.where("ts >= timestamp'2020-03-01 00:00:00'").orderBy(F.desc("ts"), "sha").limit(300)


def snk_1_sarif(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1: findings as rows of a SARIF log: complex symbols."""
    y = table(spark, d, "symbols").where("cyclomatic_complexity >= 4").select("id", "file_path", "start_line", "symbol_name", "cyclomatic_complexity").distinct()
    level = F.when(F.col("cyclomatic_complexity") >= 8, "error").when(F.col("cyclomatic_complexity") >= 6, "warning").otherwise("note")
    text = F.concat(F.col("symbol_name"), F.lit(" has cyclomatic complexity "), F.col("cyclomatic_complexity").cast("int"))
    return y.select("id", F.lit("complexity").alias("rule_id"), level.alias("level"), F.col("file_path").alias("uri"), F.col("start_line").alias("line"), text.alias("message"))


def _log(spark: SparkSession) -> DataFrame:
    from codelens.sources.paths import parse_log

    text = "a1b2c3d4|Ann|ann@x.example|1700000000|fix: a | b\n\n3\t0\tsrc/a.rs\n-\t-\tlogo.png\n0\t2\tsrc/b.rs\n\ne5f60718|Bo|bo@x.example|1700003600|more\n4\t4\tsrc/a.rs"
    return parse_log(spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, value string"))


def src_9_numstat_log(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9, SRC-10: a log of two commits, parsed."""
    return _log(spark)


def src_17_coverage(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17: covered lines of four small reports, one of each format."""
    from codelens.sources.paths import covered_lines

    docs = [
        '{"data": [{"files": [{"filename": "a.rs", "segments": [[1, 1, 3, true, true, false], [2, 1, 0, true, true, false], [4, 1, 5, false, false, false]]}]}]}',
        '{"b.js": {"path": "b.js", "statementMap": {"0": {"start": {"line": 3, "column": 0}, "end": {"line": 3, "column": 9}}, "1": {"start": {"line": 5, "column": 0}, "end": {"line": 5, "column": 9}}}, "s": {"0": 2, "1": 0}}}',
        '{"files": {"c.py": {"executed_lines": [1, 2, 2], "missing_lines": [3]}}}',
        '{"Packages": [{"Name": "p", "Coverage": 0.5, "Files": [{"Name": "d.go", "Lines": [{"StartLine": 7, "StartCol": 1, "EndLine": 8, "EndCol": 2, "Count": 1}, {"StartLine": 9, "StartCol": 1, "EndLine": 9, "EndCol": 2, "Count": 0}]}]}]}',
    ]
    out = covered_lines(spark, docs[0])
    for x in docs[1:]:
        out = out.union(covered_lines(spark, x))
    return out.distinct()


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("p6", "inc", "set", "src", "snk") and callable(v)}
SQL = {
    "p6_found": _P6,
    "inc_1_index_diff": "with a as (select run_id, arg_max(status, attempt) as s from sync_runs group by run_id), w as (select max(run_id) as w from a where s = 'success'), f as (select distinct path from source_files), r as (select rel_path as path, run_id, file_hash, row(parsed_at, run_id, file_hash) as o from parsed_files where file_hash is not null), h as (select path, arg_max(file_hash, o) as now, arg_max(file_hash, o) filter (run_id <= w) as was from r, w group by path) select coalesce(f.path, h.path) as path, case when was is null then 'new' when f.path is null then 'deleted' when was <> now then 'changed' else 'kept' end as state from f full join h on f.path = h.path",
    "inc_2_upserted_symbols": "select file_path, symbol_name, chunk_index, arg_max(id, row(created_at, run_id, id)) as id from symbols where content_hash is not null and file_path in (select path from source_files) group by all",
    "set_3_removed_files": "select distinct path from file_changes where path is not null and path not in (select rel_path from parsed_files)",
    "src_8_commit_log": "select sha, min(ts) as ts, arg_max(author, row(ingested_at, author)) as author from commits group by sha having min(ts) >= timestamp '2020-03-01' order by ts desc, sha limit 300",
    "snk_1_sarif": "select distinct id, 'complexity' as rule_id, case when cyclomatic_complexity >= 8 then 'error' when cyclomatic_complexity >= 6 then 'warning' else 'note' end as level, file_path as uri, start_line as line, symbol_name || ' has cyclomatic complexity ' || cyclomatic_complexity::int as message from symbols where cyclomatic_complexity >= 4",
    "src_9_numstat_log": "select * from (values ('a1b2c3d4', 'Ann', 'ann@x.example', timestamp '2023-11-14 22:13:20', 'fix: a | b', 'src/a.rs', 3::bigint, 0::bigint, 'added'), ('a1b2c3d4', 'Ann', 'ann@x.example', timestamp '2023-11-14 22:13:20', 'fix: a | b', 'src/b.rs', 0, 2, 'deleted'), ('e5f60718', 'Bo', 'bo@x.example', timestamp '2023-11-14 23:13:20', 'more', 'src/a.rs', 4, 4, 'modified')) t(sha, author, email, ts, message, path, additions, deletions, change_type)",
    "src_17_coverage": "select * from (values ('a.rs', 1), ('b.js', 3), ('c.py', 1), ('c.py', 2), ('d.go', 7), ('d.go', 8)) t(path, line)",
}
