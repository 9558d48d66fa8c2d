"""Mutation analytics: the operators' replacement table, mutants, scores, a ridge predictor and equivalence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.functions import stats

#: Replacement sets of the operators; language '' means all.
SETS = {"ROR": "< <= > >= == !=", "AOR": "+ - * / %"}
PAIRS = [
    ("COR", "", "&&", "||"), ("COR", "", "&&", "true"), ("COR", "", "||", "&&"), ("COR", "", "||", "false"), ("COR", "", "and", "or"), ("COR", "", "and", "True"), ("COR", "", "or", "and"), ("COR", "", "or", "False"),
    ("BOR", "", "&", "|"), ("BOR", "", "|", "&"), ("BOR", "", "^", "&"), ("BOR", "", "<<", ">>"), ("BOR", "", ">>", "<<"), ("ASR", "", "+=", "-="), ("ASR", "", "-=", "+="), ("ASR", "", "*=", "/="), ("ASR", "", "/=", "*="), ("ASR", "", "&=", "|="), ("ASR", "", "|=", "&="),
    ("UOR", "", "!", ""), ("UOR", "", "~", ""), ("RVR", "", "true", "false"), ("RVR", "", "false", "true"), ("RVR", "python", "True", "False"), ("RVR", "python", "False", "True"),
    ("TypeScriptEquality", "typescript", "===", "=="), ("TypeScriptEquality", "typescript", "!==", "!="), ("TypeScriptEquality", "typescript", "==", "==="), ("PythonIdentity", "python", "is", "=="), ("RubyNil", "ruby", "nil", "false"), ("GoNil", "go", "nil", "0"),
    ("RustOption", "rust", "Some", "None"), ("RustResult", "rust", "Ok", "Err"), ("RustBorrow", "rust", "mut", ""),
]
BOUNDARY = [("BVO", "", "<", "<="), ("BVO", "", "<=", "<"), ("BVO", "", ">", ">="), ("BVO", "", ">=", ">")]


def dimension(spark: SparkSession) -> DataFrame:
    """ML-7, ML-8 and UDF-4: (operator, language, token, replacement); about a hundred rows."""
    rows = [(op, "", a, b) for op, s in SETS.items() for a in s.split() for b in s.split() if a != b] + PAIRS + BOUNDARY
    return spark.createDataFrame(rows, "operator string, language string, token string, replacement string")


def mutants(tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """ML-7: one row per replacement of each token (id, pos, token, language): table look-up, and integers by rule (CRR)."""
    d = tokens.join(F.broadcast(dim.withColumnRenamed("language", "only")), "token").where("only = '' or only = language")  # a fixed table
    ints = tokens.where(F.col("token").rlike(r"^\d{1,9}$")).withColumn("n", F.expr("try_cast(token as bigint)"))
    by_rule = F.when(F.col("n") == 0, F.array(F.lit(1), F.lit(-1)).cast("array<bigint>")).when(F.col("n") == 1, F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).otherwise(F.array(F.col("n") + 1, F.col("n") - 1, F.lit(0).cast("bigint")))
    crr = ints.select("id", "pos", "token", F.lit("CRR").alias("operator"), F.explode(F.transform(by_rule, lambda v: v.cast("string"))).alias("replacement"))
    return d.select("id", "pos", "token", "operator", "replacement").unionByName(crr)


def replacements_of_literal(text: str) -> list[str]:
    """CRR for one literal, floats included."""
    try:
        n = int(text)
        return {0: ["1", "-1"], 1: ["0", "2"], -1: ["0", "-2"]}.get(n, [str(n + 1), str(n - 1), "0"])
    except ValueError:
        pass
    try:
        f = float(text)
    except ValueError:
        return []
    return ["1.0", "-1.0"] if f == 0 else ["0.0", "2.0"] if f == 1 else ["0.0", f"{-f:g}"]


def apply_mutant(source: bytes, start: int, end: int, replacement: str) -> bytes:
    """ML-9: the source with one span of bytes replaced. Running tests on it is not this engine's business."""
    return source[:start] + replacement.encode() + source[end:]


def scores(results: DataFrame, groups: list[str]) -> DataFrame:
    """AGG-42: killed / (killed + survived) of each group; 0 where nothing was scored."""
    a = results.groupBy(*groups).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("killed", "survived", "skipped")], F.count("*").alias("mutants"))
    return a.withColumn("score", F.coalesce(F.try_divide("killed", F.col("killed") + F.col("survived")), F.lit(0.0)))


def covered_scores(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """JOI-19: mutants on covered and other lines, and the score over covered ones."""
    c = coverage.select("file", "line").distinct().withColumn("covered", F.lit(True))
    j = results.join(c, ["file", "line"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return scores(j, ["covered"])


def in_ranges(mutants_: DataFrame, ranges: DataFrame) -> DataFrame:
    """JOI-11 and ML-10: mutants on changed lines (ranges: file, first, last), once each."""
    return mutants_.join(ranges, "file").where("line between first and last").select(*mutants_.columns).distinct()


def gram(df: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Sums of products of the features (with a constant) and target: one aggregation, a matrix of the features' number squared."""
    cols = [F.col(c).cast("double") for c in features]
    m = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    mean, sd = np.array([m[f"m{i}"] or 0.0 for i in range(len(cols))]), np.array([m[f"s{i}"] or 0.0 for i in range(len(cols))])
    sd[sd == 0] = 1.0
    z = [F.lit(1.0)] + [(c - float(a)) / float(b) for c, a, b in zip(cols, mean, sd)]
    y = F.col(target).cast("double")
    r = df.agg(*[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(len(z)) for j in range(i, len(z))], *[F.sum(x * y).alias(f"b{i}") for i, x in enumerate(z)]).first()
    k = len(z)
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return g, np.array([r[f"b{i}"] for i in range(k)]), mean, sd, m["n"]


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 0.01) -> Column:
    """ML-3: the fitted probability as a column: least squares on z-scores with a penalty on all weights, the constant's too; in [0, 1]."""
    g, b, mean, sd, _ = gram(df, features, target)
    w = np.linalg.solve(g + penalty * np.eye(len(b)), b)
    return stats.clamp(sum(((F.col(c).cast("double") - float(a)) / float(s) * float(v) for c, a, s, v in zip(features, mean, sd, w[1:])), F.lit(float(w[0]))))


def confidence(p: Column, n: Column) -> Column:
    """ML-4: 0.7 * min(n / 100, 1) + 0.3 * 2 * |p - 0.5|; 0.3 untrained."""
    return F.when(n == 0, 0.3).otherwise(0.7 * F.least(n / 100, F.lit(1.0)) + 0.6 * F.abs(p - 0.5))


def equivalence(logging: Column, dead: Column, depth: Column, returns: Column, delta: Column) -> Column:
    """ML-5: how likely a mutant changes nothing: 0.95 in logging, 0.99 in dead code, 0.02 a level up to 0.2 more, 0.3 less at returns, 0.1 less per complexity step."""
    s = F.greatest(F.when(logging, 0.95).otherwise(0.0), F.when(dead, 0.99).otherwise(0.0)) + F.least(depth * 0.02, F.lit(0.2))
    return stats.clamp(s - F.when(returns, 0.3).otherwise(0.0) - 0.1 * F.abs(delta))


def heuristics(context: Column, token: Column, replacement: Column) -> Column:
    """ML-6: why a mutant is equivalent, null if it isn't known to be."""
    return (
        F.when(context.rlike(r"(?i)\b(?:log|logger|console|print(?:ln)?!?|fmt\.Print\w*|echo|puts)\b[.(! ]"), "logging")
        .when(context.rlike(r"[+-]\s*0\b|\*\s*1\b") & token.isin("+", "-", "*"), "identity")
        .when(context.rlike(r"!!|not\s+not\b"), "double_negation").when(token == replacement, "same").when(context.rlike(r"(?i)\b(?:toString|__repr__|Debug|Display)\b"), "boilerplate")
    )
