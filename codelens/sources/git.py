"""Loaders from version control (SRC-5, SRC-6, SRC-8, SRC-9, SRC-12, SRC-15): git writes text, Spark parses it.

Remote repositories need a network and are left to a hook: clone elsewhere and pass the folder (SRC-16).
"""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.sources.paths import parse_log

REMOTE = re.compile(r"^(?:https?://[^/]+/)?([\w.-]+/[\w.-]+?)(?:\.git)?(?:@([\w./-]+))?$")


def run(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def log(spark: SparkSession, folder: str, since: str | None = None, out: str | None = None) -> DataFrame:
    """SRC-9: the numstat log as file changes with their commits; `out`: a shared file for the text, else it goes through the driver."""
    args = ["log", "--format=%H|%an|%ae|%at|%s", "--numstat", *([f"--since={since}"] if since else [])]
    text = run(folder, *args).split("\n")
    if out:
        with open(out, "w") as f:
            f.write("\n".join(text))
        lines = spark.read.text(out).withColumn("n", F.monotonically_increasing_id())
    else:
        lines = spark.createDataFrame(list(enumerate(text)), "n bigint, value string")
    return parse_log(lines)


def tree(spark: SparkSession, folder: str, shas: DataFrame) -> DataFrame:
    """SRC-5, SRC-6: (sha, path, content) of the files of each commit (column sha), read by the workers from a shared clone."""

    def load(batches):
        for b in batches:
            rows = []
            for sha in b["sha"]:
                for path in run(folder, "ls-tree", "-r", "--name-only", sha).splitlines():
                    blob = subprocess.run(["git", "-C", folder, "cat-file", "blob", f"{sha}:{path}"], capture_output=True).stdout
                    rows.append((sha, path, blob))
            yield pd.DataFrame(rows, columns=["sha", "path", "content"])

    return shas.select("sha").distinct().mapInPandas(load, "sha string, path string, content binary")


def changed_since(folder: str, ref: str) -> list[str]:
    """FIL-2: paths that differ from a reference."""
    return run(folder, "diff", "--name-only", "--diff-filter=ACMR", ref).splitlines()


def merge_base(folder: str, a: str, b: str) -> str:
    return run(folder, "merge-base", a, b).strip()


def rev_count(folder: str, span: str) -> int:
    return int(run(folder, "rev-list", "--count", span))


def remote_of(name: str) -> tuple[str, str | None] | None:
    """SRC-16: owner/repo and reference of a remote's short name."""
    m = REMOTE.match(name)
    return (m.group(1), m.group(2)) if m else None
