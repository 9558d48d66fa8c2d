"""Predicates and readers over file paths, folders and version-control logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that scans skip.
IGNORED = ["node_modules", "target", ".next", "dist", "build", "coverage", ".coverage", ".turbo", ".cache", "vendor"]
#: Folders of tests.
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__", "__mocks__", "test_helpers", "testdata", "fixtures"]
BUILT = r"(\.min|\.bundle|\.chunk)\.(js|mjs|cjs|jsx|ts|tsx|mts|cts)$"
GENERATED = r"(\.pb\.go|\.pb\.cc|\.pb\.h|\.pb2\.py|_pb2\.py|_pb2_grpc\.py|\.gen\.go|\.generated\.go|\.generated\.ts|\.generated\.js|_gen\.go|_generated\.go)$|(^|/)bindata\.go$|(^|/)mock_[^/]*\.go$|(^|/)zz_generated\.[^/]*$"
TEST_FILE = r"(^|/)test_[^/]*$|_test\.[^/]*$|_spec\.[^/]*$|\.(test|spec)\.[^./]*$"


def built_asset(path: Column) -> Column:
    """SRC-2."""
    return path.rlike(BUILT)


def ignored(path: Column) -> Column:
    """SRC-3: a component is one of the skipped folders."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED]))


def generated(path: Column) -> Column:
    """FIL-6."""
    return F.lower(path).rlike(GENERATED)


def test_file(path: Column) -> Column:
    """PAR-11."""
    p = F.lower(F.translate(path, "\\", "/"))
    name = F.element_at(F.split(p, "/"), -1)
    dotted = (F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) >= 2) & F.get(F.reverse(F.split(name, r"\.")), F.lit(1)).isin("test", "spec")
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in TEST_FOLDERS])) | name.startswith("test_") | name.contains("_test.") | name.contains("_spec.") | dotted


def glob(pattern: str) -> str:
    """FIL-1: a glob as a regular expression: ** any folders, * and ? within one, [..] and {a,b}."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            j = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, most_bytes: int = 5 << 20) -> DataFrame:
    """SRC-1 and SRC-7: (path, content) of the files under a folder of known languages, without hidden, skipped, built and excluded ones."""
    from codelens.sources.extract import language_column

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = re.escape(root.rstrip("/").removeprefix("file:"))
    f = f.where(F.col("length") <= most_bytes).select(F.regexp_replace("path", rf"^(?:file:)?/*?{prefix}/", "").alias("path"), "content")
    keep = language_column(F.col("path")).isNotNull() & ~ignored(F.col("path")) & ~built_asset(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.[^/]")
    for g in exclude or []:
        keep &= ~F.col("path").rlike(glob(g))
    return f.where(keep).orderBy("path")


def parse_log(lines: DataFrame, text: str = "value", order: str = "n") -> DataFrame:
    """SRC-9: (sha, author, email, ts, message, path, additions, deletions, change_type) from a log of header lines
    `sha|author|email|unix time|subject` and `added TAB deleted TAB path` lines; binary files (-) are dropped.

    The change type follows from the counts. Lines come in order within a file of the log.
    """
    from pyspark.sql import Window

    h = F.regexp_extract(text, r"^([0-9a-fA-F]{7,64})\|([^|]*)\|([^|]*)\|(\d+)\|(.*)$", 0)
    d = lines.withColumn("head", F.when(h != "", h))
    d = d.withColumn("head", F.last("head", ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    p = r"^(\d+)\t(\d+)\t(.+)$"
    d = d.where(F.col(text).rlike(p) & F.col("head").isNotNull())
    s = F.split("head", r"\|", 5)
    a, b = F.regexp_extract(text, p, 1).cast("bigint"), F.regexp_extract(text, p, 2).cast("bigint")
    kind = F.when((a > 0) & (b == 0), "added").when((a == 0) & (b > 0), "deleted").otherwise("modified")
    return d.select(s[0].alias("sha"), s[1].alias("author"), s[2].alias("email"), F.timestamp_seconds(s[3].cast("bigint")).alias("ts"), s[4].alias("message"), F.regexp_extract(text, p, 3).alias("path"), a.alias("additions"), b.alias("deletions"), kind.alias("change_type"))


def covered_lines(spark: SparkSession, text: str) -> DataFrame:
    """SRC-17: distinct (path, line) covered according to a coverage report: llvm-cov, istanbul, coverage.py or go-cover, told by its keys."""
    import json

    doc, rows = json.loads(text), set()
    if isinstance(doc.get("data"), list):
        rows = {(f["filename"], s[0]) for d in doc["data"] for f in d.get("files", []) for s in f.get("segments", []) if s[3] and s[2] > 0}
    elif isinstance(doc.get("files"), dict):
        rows = {(p, n) for p, f in doc["files"].items() for n in f.get("executed_lines", [])}
    elif isinstance(doc.get("Packages"), list):
        rows = {(f["Name"], n) for p in doc["Packages"] for f in p.get("Files", []) for x in f.get("Lines", []) if x["Count"] > 0 for n in range(x["StartLine"], x["EndLine"] + 1)}
    elif doc and all(isinstance(v, dict) and "statementMap" in v for v in doc.values()):
        rows = {(v.get("path", p), v["statementMap"][k]["start"]["line"]) for p, v in doc.items() for k, n in v.get("s", {}).items() if n > 0 and k in v["statementMap"]}
    elif doc:
        raise ValueError("unknown coverage format")
    return spark.createDataFrame(sorted(rows), "path string, line int")
