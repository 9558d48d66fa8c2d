"""Problem 2: source files that do not parse.

Each file is parsed by the generalised LL recogniser of its language (by the language column where it names a supported one,
else by extension), all dialects together; one that no dialect derives is rejected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.parsing.checker import language_of, valid
from codelens.sources.checkpoints import spread


def check(df: DataFrame, key: str = "file_id", repo: str = "repo", path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """(key, repo, language, rejected), one row per key; rejected is null for files of unsupported languages.

    Repeated rows of a key are copies. Null and empty contents and those with nothing but comments are valid. Texts that are
    no UTF-8 are rejected in languages that demand it. One pass without shuffle; only the small result is made distinct.
    """
    kind, where = df.schema[key].dataType.simpleString(), df.schema[repo].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = [b.iloc[:, i] for i in range(5)]
            out = {"key": cols[0], "repo": cols[1], "language": [language_of(p, la) for p, la in zip(cols[2], cols[3])]}
            yield pd.DataFrame(out | {"rejected": pd.array([None if (v := valid(c, p, la)) is None else not v for p, la, c in zip(cols[2], cols[3], cols[4])], "boolean")})

    checked = spread(df.select(key, repo, path, language, F.col(content).cast("binary").alias("__content"))).mapInPandas(run, f"key {kind}, repo {where}, language string, rejected boolean")
    return checked.groupBy("key").agg(F.first("repo").alias("repo"), F.first("language").alias("language"), F.max("rejected").alias("rejected")).withColumnRenamed("key", key)


def rates(checked: DataFrame) -> DataFrame:
    """Files, rejected files and their share for each repository and language; files of unsupported languages don't count."""
    by = checked.where(F.col("rejected").isNotNull()).groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if("rejected").alias("rejected"))
    return by.withColumn("rate", F.round(F.col("rejected") / F.col("files"), 6))
