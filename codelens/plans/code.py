"""Queries over source files: paths, extraction, complexity, cohesion, dead code, outline; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import stats
from codelens.operators import graphs as g
from codelens.sources import extract as x
from codelens.sources import paths as p
from codelens.sources import tables as t
from codelens.sources.checkpoints import cut


def _files(s, d):
    return t.table(s, d, "source_files").select("repo", "path", "content").dropDuplicates(["path"])


def _code(s, d, most_bytes=5 * 1024 * 1024):
    return x.extract(t.table(s, d, "source_files").select("path", "content"), most_bytes)


def _measured(s, d):
    """Functions of the files that complexity is measured in: 1 MB at most (SRC-7)."""
    return _functions(s, d, 1_000_000)


def _functions(s, d, most_bytes=5 * 1024 * 1024):
    return _code(s, d, most_bytes).select("path", "language", F.explode("functions").alias("f")).select("path", "language", "f.*")


def src_2_built_assets(s, d):
    return t.table(s, d, "source_files").select("path").distinct().where(p.built_asset(F.col("path")))


def src_3_ignored(s, d):
    return t.table(s, d, "source_files").select("path").distinct().where(p.ignored(F.col("path")))


def src_4_languages(s, d):
    return t.table(s, d, "file_changes").select("path").where("path is not null").distinct().select("path", x.language_column(F.col("path")).alias("language"))


def src_7_size_guard(s, d):
    """SRC-7: files within the size limits."""
    return t.table(s, d, "source_files").select("file_id", F.octet_length("content").alias("bytes")).distinct().where("bytes <= 4096")


def src_1_file_set(s, d):
    """SRC-1: known languages, no built assets, no skipped folders, no excluded globs, in order."""
    f = t.table(s, d, "source_files").select("path").distinct()
    keep = x.language_column(F.col("path")).isNotNull() & ~p.built_asset(F.col("path")) & ~p.ignored(F.col("path")) & ~F.col("path").rlike(p.glob("**/scripts/**"))
    return f.where(keep).orderBy("path")


def fil_1_globs(s, d):
    """FIL-1: files kept by one glob and not dropped by another."""
    f = t.table(s, d, "source_files").select("path").distinct()
    return f.where(F.col("path").rlike(p.glob("*/packages/**/*.{js,ts}")) & ~F.col("path").rlike(p.glob("**/lib/**")))


def fil_2_changed_files(s, d):
    """FIL-2: indexed files that a change of the last run's days touched."""
    changed = t.table(s, d, "file_changes").where(F.lower("change_type").isin("added", "modified", "renamed", "m", "a", "r")).select("path").distinct()
    return t.table(s, d, "parsed_files").select(F.col("rel_path").alias("path")).distinct().join(changed, "path", "left_semi")


def fil_6_generated(s, d):
    return t.table(s, d, "source_files").select("path").distinct().where(p.generated(F.col("path")))


def fil_11_by_language(s, d):
    """FIL-11: files of each language."""
    return src_4_languages(s, d).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def par_11_test_files(s, d):
    return t.table(s, d, "file_changes").select("path").where("path is not null").distinct().where(p.test_file(F.col("path")))


def agg_44_directory_tree(s, d):
    """AGG-44: files of each folder of at most three levels."""
    f = t.table(s, d, "file_changes").select("path").where("path is not null").distinct()
    parts = F.split("path", "/")
    return f.select(F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(3))), "/").alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def par_2_functions(s, d):
    return _functions(s, d).drop("calls")


def par_3_classes(s, d):
    return _code(s, d).select("path", F.explode("classes").alias("c")).select("path", "c.name", "c.start_line", "c.end_line", F.size("c.methods").alias("methods"), F.size("c.fields").alias("fields"))


def par_4_imports(s, d):
    return _code(s, d).select("path", F.explode("imports").alias("i")).select("path", "i.name", "i.line")


def par_6_cyclomatic(s, d):
    """PAR-6, PAR-7, PAR-8: measures of each function."""
    return _measured(s, d).select("path", "name", "start_line", "cyclomatic", "cognitive", "nesting")


def par_10_outline(s, d):
    """PAR-10: one outline per file: imports, then classes, then signatures."""
    c = _code(s, d)
    line = F.concat_ws("\n", F.transform("imports", lambda i: F.concat(F.lit("- import "), i["name"])), F.transform("classes", lambda k: F.concat(F.lit("- class "), k["name"])), F.transform("functions", lambda f: F.concat(F.lit("- "), f["signature"], F.lit(" L"), f["start_line"])))
    return c.select("path", F.concat(F.lit("## "), F.col("path"), F.lit("\n"), line).alias("outline"))


def agg_6_complexity_rollup(s, d):
    """AGG-6: totals and means per file, percentiles over all functions."""
    f = _measured(s, d)
    per = f.groupBy("path").agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("cyclomatic"), F.round(F.avg("cognitive"), 6).alias("mean_cognitive"), F.max("cyclomatic").alias("max_cyclomatic"))
    return per.join(F.broadcast(stats.percentiles(f, "cyclomatic", {"p90": 0.9, "p95": 0.95})))


def fil_4_violations(s, d):
    """FIL-4 and FIL-5: functions over a limit, with their severity."""
    f = _measured(s, d).where("cyclomatic > 5 or cognitive > 8")
    return f.select("path", "name", "start_line", "cyclomatic", "cognitive", F.when((F.col("cyclomatic") > 10) | (F.col("cognitive") > 15), "error").otherwise("warn").alias("gate"))


def agg_29_class_metrics(s, d):
    """AGG-29: WMC, RFC, NOM, NOF of each class, and whether WMC exceeds 24."""
    c = _code(s, d).select("path", F.explode("classes").alias("c"))
    return c.select("path", "c.name", "c.wmc", (F.size("c.methods") + F.size(F.array_except("c.calls", "c.methods"))).alias("rfc"), F.size("c.methods").alias("nom"), F.size("c.fields").alias("nof"), (F.col("c.wmc") > 24).alias("too_complex"))


def agg_31_dead_code(s, d):
    """AGG-31, GRA-7, JOI-16: functions that nothing reaches from entry points (exported, main, tests, called at top level)."""
    f = cut(_functions(s, d).select("path", "name", "start_line", "exported", "calls"))  # parsed once, used five times
    f = f.withColumn("test", p.test_file(F.col("path")))
    calls = f.select(F.concat_ws(":", "path", "name").alias("caller"), F.col("path").alias("file"), F.explode("calls").alias("callee"))
    e = g.resolve_calls_all(calls, f.select(F.col("path").alias("file"), "name")).select(F.xxhash64("caller").alias("src"), F.xxhash64("target").alias("dst"))
    entry = f.where(F.col("exported") | F.col("test") | F.lower("name").rlike("^(main|init|test|setup|teardown|handle)")).select(F.xxhash64(F.concat_ws(":", "path", "name")).alias("node"))
    live = g.reachable(e, entry)
    used = e.where("src <> dst").select(F.col("dst").alias("node")).distinct().withColumn("used", F.lit(True))
    dead = f.withColumn("node", F.xxhash64(F.concat_ws(":", "path", "name"))).join(live, "node", "left_anti").join(used, "node", "left")
    confidence = stats.clamp(F.lit(0.9) + F.when(F.col("used").isNull(), 0.05).otherwise(0.0) - F.when(F.col("exported"), 0.25).otherwise(0.0) + F.when(~F.col("exported"), 0.05).otherwise(0.0) - F.when(F.col("test"), 0.15).otherwise(0.0))
    return dead.select("path", "name", "start_line", F.round(confidence, 6).alias("confidence")).where("confidence >= 0.8")


def txt_8_stubs(s, d):
    """TXT-8 to TXT-10: findings of unfinished functions."""
    return _code(s, d).select("path", F.explode("stubs").alias("x")).select("path", "x.*")


def txt_11_stub_rollup(s, d):
    c = _code(s, d)
    n = c.select(F.explode_outer("stubs").alias("x"), "path").groupBy("x.kind", "x.severity").agg(F.count("*").alias("n"))
    return n.select(F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("severity", F.lit("none")).alias("severity"), "n")


def agg_45_risk_digest(s, d):
    """AGG-45: complex functions (cognitive 15 or cyclomatic 10 at least), the worst first, 25 at most."""
    f = _measured(s, d).where("cognitive >= 15 or cyclomatic >= 10")
    return f.select("path", "name", "cyclomatic", "cognitive", F.when((F.col("cognitive") >= 30) | (F.col("cyclomatic") >= 20), "high").otherwise("medium").alias("severity")).orderBy(F.desc("cognitive"), F.desc("cyclomatic"), "path", "name").limit(25)


def srt_4_top_and_omitted(s, d):
    """SRT-4: an offset and a limit over a result, with the number left out."""
    f = t.table(s, d, "source_files").select("path", F.octet_length("content").alias("bytes")).distinct()
    n = f.agg((F.count("*") - 20).alias("omitted"))
    return f.orderBy(F.desc("bytes"), "path").offset(5).limit(20).join(F.broadcast(n))


def set_5_labelled_union(s, d):
    """SET-5: files of several repositories under a label each; a label that occurs again gets a number."""
    f = t.table(s, d, "source_files").select("repo", "path").distinct()
    a = f.where("repo < 'm'").select("path", F.lit("left").alias("label"))
    b = f.where("repo >= 'm'").select("path", F.lit("left").alias("label"))
    from pyspark.sql import Window

    labels = a.select("label").distinct().withColumn("part", F.lit(0)).union(b.select("label").distinct().withColumn("part", F.lit(1)))
    labels = labels.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("part"))).select("label", "part", F.when(F.col("i") > 1, F.concat_ws("-", "label", "i")).otherwise(F.col("label")).alias("name"))
    u = a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))
    return u.join(F.broadcast(labels), ["label", "part"]).select(F.concat_ws("/", "name", "path").alias("path"))  # one row per repository


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "src", "fil", "par", "txt", "srt", "set") and callable(v)}

_F = "with f as (select distinct path from source_files), c as (select distinct path from file_changes where path is not null) "
_LANG = "case regexp_extract(lower(path), '\\.([^./]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in x.EXTENSIONS.items()) + " end"
_ANY = lambda names: "list_has_any(string_split(path, '/'), [" + ", ".join(f"'{n}'" for n in names) + "])"
SQL = {
    "src_1_file_set": _F + f"select path from f where {_LANG} is not null and not regexp_matches(path, '{p.BUILT}') and not {_ANY(p.IGNORED)} and not contains(path, '/scripts/') and not starts_with(path, 'scripts/') order by path",
    "src_2_built_assets": _F + f"select path from f where regexp_matches(path, '{p.BUILT}')",
    "src_3_ignored": _F + f"select path from f where {_ANY(p.IGNORED)}",
    "src_4_languages": _F + f"select path, {_LANG} as language from c",
    "src_7_size_guard": "select distinct file_id, octet_length(content)::int as bytes from source_files where octet_length(content) <= 4096",
    "fil_1_globs": _F + r"select path from f where regexp_matches(path, '^[^/]*/packages/(.*/)?[^/]*\.(js|ts)$') and not regexp_matches(path, '(^|/)lib/')",
    "fil_2_changed_files": "select distinct rel_path as path from parsed_files where rel_path in (select path from file_changes where lower(change_type) in ('added', 'modified', 'renamed', 'm', 'a', 'r'))",
    "fil_6_generated": _F + f"select path from f where regexp_matches(lower(path), '{p.GENERATED}')",
    "fil_11_by_language": _F + f"select {_LANG} as language, count(*) as files from c where {_LANG} is not null group by 1",
    "par_11_test_files": _F + ", t as (select path, lower(path) as l, string_split(lower(path), '/')[-1] as n from c) select path from t where list_has_any(string_split(l, '/'), [" + ", ".join(f"'{n}'" for n in p.TEST_FOLDERS) + "]) or starts_with(n, 'test_') or contains(n, '_test.') or contains(n, '_spec.') or (length(n) - length(replace(n, '.', '')) >= 2 and string_split(n, '.')[-2] in ('test', 'spec'))",
    "agg_44_directory_tree": _F + "select array_to_string(string_split(path, '/')[1:least(len(string_split(path, '/')) - 1, 3)], '/') as folder, count(*) as files from c group by 1",
    "srt_4_top_and_omitted": "with f as (select distinct path, octet_length(content)::int as bytes from source_files) select *, (select count(*) - 20 from f) as omitted from f order by bytes desc, path limit 20 offset 5",
    "set_5_labelled_union": "select distinct case when repo < 'm' then 'left/' else 'left-2/' end || path as path from source_files",
}
