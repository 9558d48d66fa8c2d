"""Writing results: JSON folders and their reload, SARIF, Markdown, top and offset, digests within a token budget."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, folder: str) -> None:
    """SNK-1: one JSON object a line, in parts, replaced as a whole."""
    df.write.mode("overwrite").json(folder)


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-18: results written before, without guessing their schema."""
    return spark.read.schema(schema).json(folder)


def top(df: DataFrame, k: int, offset: int = 0) -> tuple[DataFrame, int]:
    """SRT-4: a page of an ordered result and how many rows it leaves out."""
    return df.offset(offset).limit(k), max(df.count() - k, 0)


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """SNK-1: (result) SARIF result objects of findings rule_id, level, uri, line, message, a JSON text a row."""
    place = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """SNK-1: a table of the first rows, for people to read."""
    rows = df.limit(most).collect()
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def trim(digest: dict[str, list], tokens: int, least: int = 5, order: tuple[str, ...] = ("tree", "risks", "symbols", "entry_points", "hints")) -> dict[str, list]:
    """SRT-6: lists shortened, in this order and to `least` entries each, until the digest has at most four bytes a token."""
    out = {k: list(v) for k, v in digest.items()}
    for k in order:
        while len(out.get(k, [])) > least and len(json.dumps(out).encode()) > 4 * tokens:
            out[k].pop()
    return out


def context_markdown(digest: dict[str, list]) -> str:
    """SNK-4: a digest as text."""
    return "\n\n".join("\n".join([f"## {k.replace('_', ' ').capitalize()}", *(f"- {x}" for x in v)]) for k, v in digest.items() if v)
