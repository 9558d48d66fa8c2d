"""Queries of mutation analytics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import clones
from codelens.operators import mutation as m
from codelens.operators import text as x
from codelens.plans.history import SIX
from codelens.sources import tables as t
from codelens.sources.extract import EXTENSIONS, language_column


def _tokens(s, d):
    y = t.table(s, d, "symbols").select("id", "file_path", "enriched_text").distinct()
    return y.select("id", language_column(F.col("file_path")).alias("language"), F.posexplode(clones.tokens(F.col("enriched_text"))).alias("pos", "token"))


def _results(s, d):
    st = F.when(F.col("l_returnflag") == "R", "killed").when(F.col("l_returnflag") == "A", "survived").otherwise("skipped")
    return t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("operator"), st.alias("status"))


def ml_7_mutants(s, d):
    return m.mutants(_tokens(s, d), m.dimension(s)).groupBy("operator", "token", "replacement").agg(F.count("*").alias("n"))


def ml_7_mutants_per_symbol(s, d):
    return m.mutants(_tokens(s, d), m.dimension(s)).groupBy("id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def agg_42_mutation_scores(s, d):
    return m.scores(_results(s, d), ["operator"]).select("operator", "killed", "survived", "skipped", "mutants", *SIX("score"))


def agg_42_scores_per_file(s, d):
    return m.scores(_results(s, d), ["file"]).select("file", "mutants", *SIX("score"))


def joi_19_covered_scores(s, d):
    c = t.table(s, d, "lineitem").where("l_tax > 0.04").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return m.covered_scores(_results(s, d), c).select("covered", "killed", "survived", "mutants", *SIX("score"))


def joi_11_changed_lines(s, d):
    """JOI-11: mutants within changed line ranges of their file."""
    r = t.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 3 + 1).alias("first"), (F.col("o_custkey") % 3 + 2).alias("last"))
    return m.in_ranges(_results(s, d), r)


def set_6_coverage_merge(s, d):
    """SET-6: the union of two coverage reports."""
    li = t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "l_tax", "l_discount")
    u = li.where("l_tax > 0.06").select("file", "line").union(li.where("l_discount > 0.07").select("file", "line")).distinct()
    return u.groupBy("file").agg(F.count("*").alias("lines"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _trained(s, d):
    li = t.table(s, d, "lineitem").where("l_returnflag <> 'N'").withColumn("killed", (F.col("l_returnflag") == "R").cast("int"))
    return li.withColumn("p", m.ridge(li, FEATURES, "killed"))


def ml_3_ridge(s, d):
    """ML-3: predicted chance to be killed, by operator and line."""
    return _trained(s, d).groupBy("l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("p", "killed")])


def ml_4_confidence(s, d):
    n = t.table(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("p"), (F.col("p_partkey") % 140).alias("n"))
    return n.select("p_partkey", F.round(m.confidence(F.col("p"), F.col("n")), 6).alias("confidence"))


def ml_5_equivalence(s, d):
    k = F.col("p_partkey")
    e = m.equivalence(k % 3 == 0, k % 7 == 0, F.col("p_size"), k % 5 == 0, k % 4 - 1)
    return t.table(s, d, "part").select("p_partkey", F.round(e, 6).alias("score")).where("score >= 0.5")


def ml_6_heuristics(s, d):
    y = t.table(s, d, "symbols").select("id", "enriched_text").distinct()
    l = x.lines(y, "id", "enriched_text").withColumn("why", m.heuristics(F.col("line"), F.lit("+"), F.lit("-")))
    return l.where("why is not null").groupBy("why").agg(F.count("*").alias("lines"))


def txt_24_mutant_features(s, d):
    """TXT-24: words, distinct words and tests in the five lines around each function head."""
    y = t.table(s, d, "symbols").select("id", "enriched_text").distinct()
    l = x.lines(y, "id", "enriched_text")
    at = l.where("line rlike '(func|fn|def|function) '").select("id", F.col("line_no").alias("head"))
    c = at.join(l, "id").where("line_no between head - 5 and head + 5").select("id", "head", F.explode(x.words(F.col("line"))).alias("w"))
    return c.groupBy("id", "head").agg(F.count("*").alias("words"), F.count_distinct("w").alias("distinct_words"), F.max(F.col("w").contains("test")).alias("tests"))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "joi", "ml", "set", "txt") and callable(v)}

_TOK = clones.TOKEN.replace("'", "''")
_DIM = ", ".join("('" + "', '".join(r) + "')" for r in [(op, "", a, b) for op, v in m.SETS.items() for a in v.split() for b in v.split() if a != b] + m.PAIRS + m.BOUNDARY)
_LANG = "case regexp_extract(lower(file_path), '\\.([^./]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in EXTENSIONS.items()) + " end"
_M = f"""with y as (select distinct id, file_path, enriched_text from symbols), k as (select id, {_LANG} as language, regexp_extract_all(enriched_text, '{_TOK}', 1) as t from y), tk as (select id, language, unnest(range(len(t)))::int as pos, unnest(t) as token from k),
dm(operator, only_, token, replacement) as (values {_DIM}), n as (select *, token::bigint as n from tk where regexp_matches(token, '^\\d{{1,9}}$')),
mu as (select id, pos, tk.token, operator, replacement from tk join dm using (token) where only_ = '' or only_ = language union all
select id, pos, token, 'CRR', unnest(case when n = 0 then [1, -1] when n = 1 then [0, 2] else [n + 1, n - 1, 0] end)::varchar from n) """
_R = "with r as (select l_orderkey as file, l_linenumber as line, l_linestatus as operator, case l_returnflag when 'R' then 'killed' when 'A' then 'survived' else 'skipped' end as status from lineitem) "
_SC = "count(*) filter (status = 'killed') as killed, count(*) filter (status = 'survived') as survived, count(*) filter (status = 'skipped') as skipped, count(*) as mutants, round(coalesce(count(*) filter (status = 'killed') / nullif(count(*) filter (status <> 'skipped'), 0)::double, 0), 6) as score"
_LI = r"with sy as (select distinct id, enriched_text from symbols), ls as (select id, string_split(regexp_replace(enriched_text, '\n\z', ''), chr(10)) as l from sy where enriched_text <> ''), li as (select id, unnest(range(1, len(l) + 1))::int as line_no, regexp_replace(unnest(l), '\r\z', '') as line from ls)"
SQL = {
    "ml_7_mutants": _M + "select operator, token, replacement, count(*) as n from mu group by all",
    "ml_7_mutants_per_symbol": _M + "select id, count(*) as n, max(pos) as last from mu group by id",
    "agg_42_mutation_scores": _R + f"select operator, {_SC} from r group by operator",
    "agg_42_scores_per_file": _R + f", a as (select file, {_SC} from r group by file) select file, mutants, score from a",
    "joi_19_covered_scores": _R + f", c as (select distinct l_orderkey as file, l_linenumber as line from lineitem where l_tax > 0.04), j as (select r.*, c.file is not null as covered from r left join c using (file, line)), a as (select covered, {_SC} from j group by covered) select covered, killed, survived, mutants, score from a",
    "joi_11_changed_lines": _R + ", g as (select o_orderkey as file, o_custkey % 3 + 1 as first, o_custkey % 3 + 2 as last from orders where o_orderstatus = 'F') select distinct r.* from r join g on g.file = r.file and line between first and last",
    "set_6_coverage_merge": "with u as (select l_orderkey as file, l_linenumber as line from lineitem where l_tax > 0.06 union select l_orderkey, l_linenumber from lineitem where l_discount > 0.07) select file, count(*) as lines from u group by file",
    "ml_4_confidence": "with n as (select p_partkey, p_size / 50.0::double as p, p_partkey % 140 as n from part) select p_partkey, round(case when n = 0 then 0.3 else 0.7::double * least(n / 100.0::double, 1) + 0.6::double * abs(p - 0.5::double) end, 6) as confidence from n",
    "ml_5_equivalence": "with e as (select p_partkey, round(greatest(0, least(1, greatest(case when p_partkey % 3 = 0 then 0.95 else 0 end, case when p_partkey % 7 = 0 then 0.99 else 0 end)::double + least(p_size * 0.02::double, 0.2) - case when p_partkey % 5 = 0 then 0.3 else 0 end - 0.1::double * abs(p_partkey % 4 - 1))), 6) as score from part) select * from e where score >= 0.5",
    "ml_6_heuristics": _LI + r", w as (select case when regexp_matches(line, '(?i)\b(?:log|logger|console|print(?:ln)?!?|fmt\.Print\w*|echo|puts)\b[.(! ]') then 'logging' when regexp_matches(line, '[+-]\s*0\b|\*\s*1\b') then 'identity' when regexp_matches(line, '!!|not\s+not\b') then 'double_negation' when regexp_matches(line, '(?i)\b(?:toString|__repr__|Debug|Display)\b') then 'boilerplate' end as why from li) select why, count(*) as lines from w where why is not null group by why",
    "txt_24_mutant_features": _LI + r", h as (select id, line_no as head from li where regexp_matches(line, '(func|fn|def|function) ')), c as (select h.id, head, unnest(regexp_extract_all(lower(line), '[\p{L}\p{M}\p{N}_]+')) as w from h join li on li.id = h.id and line_no between head - 5 and head + 5) select id, head, count(*) as words, count(distinct w) as distinct_words, bool_or(contains(w, 'test')) as tests from c group by all",
}
