"""Queries of the training-data operators over the tables of a folder, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm import cooccurrence, encoding, mixing, names, origins, spans, splitting, syntax, terms
from codelens.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.contributors(table(spark, d, "author_identities")))


def p1_contributors(spark: SparkSession, d: str) -> DataFrame:
    return names.contributors(table(spark, d, "author_identities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check(table(spark, d, "source_files")).where("rejected").select("file_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.check(table(spark, d, "source_files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.shared_rare(terms.collection_counts(table(spark, d, "symbols")))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    s = terms.scores(table(spark, d, "symbols"))
    return s.select("id", "term", "tf", "df", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return origins.classify(table(spark, d, "source_files")).select("file_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return origins.classify(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.Spans(table(spark, d, "source_files")).pairs().select(F.col("a").alias("file_a"), F.col("b").alias("file_b"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    shared = spans.Spans(f).shared()
    paths = f.select(F.col("file_id").alias("k"), "path", F.coalesce(F.octet_length("content"), F.lit(0)).alias("all_bytes")).distinct()
    out = paths.join(shared, "k", "left").select(F.col("k").alias("file_id"), "path", F.col("all_bytes").alias("bytes"), F.coalesce("shared_bytes", F.lit(0)).alias("shared_bytes"))
    return out.withColumn("share", F.when(F.col("bytes") > 0, F.round(F.col("shared_bytes") / F.col("bytes"), 6)).otherwise(0.0))


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    """Of each file that shares a span with a different content, how long a span (400 bytes, doubled) it shares."""
    return spans.Spans(table(spark, d, "source_files")).levels().select(F.col("k").alias("file_id"), "longest")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(table(spark, d, "file_changes"), "sha", "path", table(spark, d, "commits"), 100, 4, 0.3)
    return pairs.where("n_ab * n >= 3 * n_a * n_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    listed = [r["source"] for r in table(spark, d, "mix_targets").select("source").distinct().collect() if r["source"] is not None]  # a fixed table
    return encoding.token_counts(table(spark, d, "documents").where(F.col("source").isin(listed)), ["doc_id", "source"])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_counted(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), with_text=False).where("piece = 0").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_P7_SQL = """
with c as (select distinct f.sha, f.path from file_changes f where f.path is not null and f.sha in (select sha from commits)),
g as (select sha from c group by sha having count(*) <= 100),
e as (select c.* from c join g using (sha)),
n as (select path, count(*) as k from e group by path),
t as (select count(distinct sha) as n from e),
p as (select a.path as path_a, b.path as path_b, count(*) as n_ab from e a join e b on a.sha = b.sha and a.path < b.path group by all having count(*) >= 4),
r as (select path_a, path_b, x.k as n_a, y.k as n_b, n_ab, t.n as n from p join n x on x.path = path_a join n y on y.path = path_b cross join t)
"""
_P7_WHERE = "from r where n_ab::double / greatest(n_a, n_b) >= 0.3 and n_ab * n >= 3 * n_a * n_b"

_P3_SQL = r"""
with d as (select id, any_value(enriched_text) as t from symbols group by id),
k as (select count(*) as n, avg(strlen(t)) as mean from d),
w as (select id, strlen(t) as length, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) as term from d where t is not null),
f as (select id, length, term, count(*) as tf from w group by all),
s as (select term, count(*) as df, sum(tf)::double as cf from f group by term),
x as (select id, term, tf, df, cf / k.n as fr, tf * log2(1 + k.mean / length) as tfn from f join s using (term) cross join k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3_SQL + "select id, term from x where tf >= 3 and df between 2 and 6",
        "p3_scores": _P3_SQL + "select id, term, tf, df, round((log2(1 + fr) + tfn * log2((1 + fr) / fr)) / (tfn + 1), 6) as score from x",
        "p7_found": _P7_SQL + "select path_a, path_b " + _P7_WHERE,
        "p7_pairs": _P7_SQL + "select path_a, path_b, n_a, n_b, n_ab, n, round(n_ab * n / (n_a * n_b)::double, 6) as lift, round(log2(n_ab * n / (n_a * n_b)::double), 6) as pmi " + _P7_WHERE,
    }
