"""Queries of text operators over indexed symbols (chunks of code), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import text as x
from codelens.plans.history import SIX
from codelens.sources import tables as t

MARKERS = ["probe", "lantern", "vault-9", "HACK"]
FLAG = {"log": r"""log\.(?:Print|info)\("(\w+)"""}


def _symbols(s, d):
    """Each row once, by id: rows of one id are in one partition."""
    return t.table(s, d, "symbols").select("id", "file_path", "symbol_name", "enriched_text", "cyclomatic_complexity").repartition("id").distinct()


def _lines(s, d):
    return x.lines(_symbols(s, d), "id", "enriched_text")


def txt_1_satd(s, d):
    return x.satd(_lines(s, d), MARKERS)


def txt_2_comment_lines(s, d):
    return _lines(s, d).where(F.col("line").rlike(x.COMMENT_LINE)).groupBy("id").agg(F.count("*").alias("comments"))


def txt_3_ambiguous_markers(s, d):
    """TXT-3, TXT-4: marker rules on literal lines."""
    rows = [(1, "// TODO: later"), (2, "# error handling"), (3, "# ERROR: broken"), (4, "// need - more, HACK"), (5, "-- slow and bug"), (6, "/* doc */"), (7, "x = 1 // TODO"), (8, "// TODO satd:ignore"), (9, "; skip: unsafe fixme"), (10, "* ignore this, undocumented")]
    return x.satd(s.createDataFrame(rows, "line_no int, line string"))


def txt_5_severity_counts(s, d):
    return txt_1_satd(s, d).groupBy("category", "severity").agg(F.count("*").alias("items"))


def txt_6_satd_rollup(s, d):
    return x.satd_rollup(txt_1_satd(s, d), x.code_lines(_symbols(s, d), "id", "enriched_text"), "id").select("id", "items", *SIX("weight", "density"))


def par_9_code_lines(s, d):
    return x.code_lines(_symbols(s, d), "id", "enriched_text")


def txt_12_flag_references(s, d):
    return x.flag_references(_lines(s, d), list(x.FLAG_PROVIDERS), FLAG)


def txt_18_search_tokens(s, d):
    """TXT-18: frequencies of words and pairs of symbol names and signatures."""
    return t.table(s, d, "symbols").select("id", "signature").distinct().select(F.explode(x.search_tokens(F.col("signature"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def txt_19_enriched(s, d):
    return t.table(s, d, "symbols").select("id", x.enriched(F.col("file_path"), F.col("symbol_name"), F.coalesce("signature", F.lit(""))).alias("text")).distinct()


def txt_20_chunks(s, d):
    return x.chunks(_symbols(s, d), "id", "enriched_text", 200).select("id", "chunk", F.md5("body").alias("body"))


def txt_21_lexical(s, d):
    return x.lexical(_symbols(s, d), "id", "enriched_text").select("id", "lines", "cyclomatic", "nesting", "imports", *SIX("doc_coverage", "indent_share"))


def txt_21_duplicate_lines(s, d):
    return x.duplicate_lines(_symbols(s, d), "id", "enriched_text").select("id", "lines", *SIX("dup_ratio"))


def txt_22_critical_patterns(s, d):
    """TXT-22: calls that abort or run text, per symbol."""
    p = r"\.unwrap\(\)|panic!?\(|\beval\(|\bexec\(|\bsystem\(|System\.exit\(|console\.log\(|println!\("
    return _symbols(s, d).select("id", F.size(F.regexp_extract_all("enriched_text", F.lit(p), F.lit(0))).alias("hits")).where("hits > 0")


def txt_23_names_and_paths(s, d):
    n = t.table(s, d, "symbols").select("symbol_name", "file_path").distinct()
    return n.select("symbol_name", "file_path", x.snake_case(F.col("symbol_name")).alias("snake"), x.normal_path(F.concat(F.col("file_path"), F.lit("/../.././x"))).alias("path"), x.normal_path(F.concat(F.lit("a/../../"), F.col("file_path"))).isNull().alias("outside"))


def _index(s, d):
    return x.index(_symbols(s, d), "id", "enriched_text")


def agg_39_vocabulary(s, d):
    return _index(s, d)[1].select("term", "df", *SIX("idf"))


def agg_40_weights(s, d):
    w = _index(s, d)[0]
    return w.groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 5).alias("sum_w"), F.round(F.max("w"), 5).alias("max_w"))


def _search(s, d, which=None, only=None):
    sy = _symbols(s, d)
    q = sy.where(which or "true").select("id", F.concat_ws(" ", "symbol_name", F.regexp_replace("file_path", "[/._-]", " ")).alias("q"))
    return x.search(sy, "id", "enriched_text", q, "q", only)


def _hits(s, d, k=None, least=0.0, only=None):
    """Hits of the queries of every symbol whose id is divisible by 50, with the symbols' columns."""
    sy = _symbols(s, d).select(F.col("id").alias("key"), F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol"), F.col("cyclomatic_complexity").alias("complexity"))
    return x.hits(_search(s, d, "id % 50 = 0", only), k, least).join(sy, F.col("doc").eqNullSafe(F.col("key"))).drop("key")  # else the table is shuffled again, without null ids


def joi_20_search_scores(s, d):
    """JOI-20: every symbol asks for all that share a term with it."""
    t = x.totals(_search(s, d))
    return t.select("query", "docs", (F.expr("(millionths + 50) div 100") / 1e4).alias("total"), "best")


def srt_7_search(s, d):
    """SRT-7, WIN-9, FIL-9: every symbol whose id is divisible by 50 asks for the ten best symbols."""
    return x.best_chunks(_hits(s, d, 30), 10, 0.05, 8).select("query", "rank", "doc", "score")


def fil_10_search_in_files(s, d):
    """FIL-10: the search restricted to files; frequencies still come from all."""
    h = _hits(s, d, 15, only=F.col("file_path").endswith(".go")).where(F.col("file").endswith(".go"))
    return x.best_chunks(h, 5).select("query", "rank", "doc", "score")


def srt_8_suggestions(s, d):
    return x.suggestions(t.table(s, d, "symbols"), "symbol_name", "Load")


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("agg", "joi", "srt", "fil", "txt", "par") and callable(v)}

_S = r"with sy as (select distinct id, file_path, symbol_name, enriched_text, cyclomatic_complexity from symbols), ls as (select id, string_split(regexp_replace(enriched_text, '\n\z', ''), chr(10)) as l from sy where enriched_text <> ''), li as (select id, unnest(range(1, len(l) + 1))::int as line_no, regexp_replace(unnest(l), '\r\z', '') as line from ls)"
_CL = x.COMMENT_LINE.replace("'", "''")


def _satd_sql(source: str, keys: str, custom: list[str]) -> str:
    groups = [(c, w, m.split()) for c, w, m in x.SATD] + ([("custom", 1.0, [x._escape(m) for m in custom])] if custom else [])
    amb = ", ".join(f"'{a}'" for a in x.AMBIGUOUS)
    cases = {"category": "", "weight": "", "marker": ""}
    for c, w, m in groups:
        p = rf"(?i)\b({'|'.join(m)})\b(.?)"
        mk = f"upper(regexp_extract(line, '{p}', 1))"
        cond = f"when {mk} <> '' and ({mk} not in ({amb}) or regexp_extract(line, '{p}', 2) in (':', '-')) then "
        cases["category"] += cond + f"'{c}' "
        cases["weight"] += cond + f"{w}::double "
        cases["marker"] += cond + mk + " "
    cols = ", ".join(f"case {v} end as {k}" for k, v in cases.items())
    return f"sd0 as (select {keys}, line, {cols} from {source} where regexp_matches(line, '{_CL}') and not contains(lower(line), 'satd:ignore')), sd as (select {keys}, category, weight, marker, case when weight >= 4 then 'critical' when weight >= 2 then 'high' when weight >= 1 then 'medium' else 'low' end as severity, left(trim(line, ' '), 200) as text from sd0 where category is not null)"


_SATD = _S + ", " + _satd_sql("li", "id, line_no", MARKERS)
_LOC = f", lc as (select id, count(*) as lines, count(*) filter (trim(line, ' ') <> '' and not regexp_matches(line, '{_CL}')) as loc from li group by id)"
_TR = r", tl as (select id, line_no, line, trim(translate(line, chr(9), ' '), ' ') as t from li)"
_KW = " + ".join(f"(starts_with(t, '{w} ') or contains(t, ' {w} '))::int" for w in ("if", "for", "while", "match", "switch", "select"))
_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_TOKENS = _TOK + " || list_transform(range(1, len(" + _TOK + ")), lambda i: " + _TOK + "[i] || ' ' || " + _TOK + "[i + 1])"
_IDX = _S + ", tk as (select id as doc, unnest(" + _TOKENS.format(x="enriched_text") + ") as term from sy where enriched_text is not null), tf as (select doc, term, count(*) as tf from tk group by all), nd as (select count(*) as n from sy), vo as (select term, count(*) as df from tf group by term order by df desc, term limit 10000), idf as (select term, df, ln(1 + n / (1 + df)::double) + 1 as idf from vo, nd), w0 as (select doc, term, (1 + ln(tf)) * idf as w from tf join idf using (term)), wn as (select doc, sqrt(sum(w * w)) as norm from w0 group by doc), ww as (select doc, term, w / norm as w from w0 join wn using (doc)) "
_SEARCH = _IDX + ", q0 as (select id as query, symbol_name || ' ' || regexp_replace(file_path, '[/._-]', ' ', 'g') as q from sy where id % 50 = 0), q1 as (select query, unnest(" + _TOKENS.format(x="q") + ") as term from q0), q2 as (select query, term, (1 + ln(count(*))) * any_value(idf) as qw from q1 join idf using (term) group by all), q3 as (select query, sqrt(sum(qw * qw)) as norm from q2 group by query), q4 as (select query, term, qw / norm as qw from q2 join q3 using (query)), hi as (select query, doc, round(sum(w * qw), 6) as score from ww join q4 using (term) group by all), ht as (select hi.*, file_path as file, symbol_name as symbol, cyclomatic_complexity as complexity from hi join sy on sy.id = doc)"
_BEST = ", b1 as (select *, row_number() over (partition by query order by score desc, doc) as r from {src}), b2 as (select *, row_number() over (partition by query, file, symbol order by score desc, doc) as r2 from b1 where r <= {k3}), b3 as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from b2 where r2 = 1 and {cond}) select query, rank, doc, score from b3 where rank <= {k}"
_ROWS3 = "(values (1, '// TODO: later'), (2, '# error handling'), (3, '# ERROR: broken'), (4, '// need - more, HACK'), (5, '-- slow and bug'), (6, '/* doc */'), (7, 'x = 1 // TODO'), (8, '// TODO satd:ignore'), (9, '; skip: unsafe fixme'), (10, '* ignore this, undocumented')) v(line_no, line)"

SQL = {
    "txt_1_satd": _SATD + "select * from sd",
    "txt_2_comment_lines": _S + f"select id, count(*) as comments from li where regexp_matches(line, '{_CL}') group by id",
    "txt_3_ambiguous_markers": "with " + _satd_sql(_ROWS3, "line_no", []) + "select * from sd",
    "txt_5_severity_counts": _SATD + "select category, severity, count(*) as items from sd group by all",
    "txt_6_satd_rollup": _SATD + _LOC + ", r as (select lc.id, count(sd.id) as items, coalesce(sum(weight), 0) as weight, any_value(loc) as loc from lc left join sd using (id) group by lc.id) select id, items, round(weight, 6) as weight, round(coalesce(weight / nullif(loc / 1000.0::double, 0), 0), 6) as density from r",
    "par_9_code_lines": _S + _LOC + "select * from lc",
    "txt_12_flag_references": _S + ", f as (" + " union all ".join(f"select id, line_no, '{n}' as provider, unnest(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}', 1)) as flag from li" for n, p in (x.FLAG_PROVIDERS | FLAG).items()) + ") select * from f",
    "txt_18_search_tokens": "with y as (select distinct id, signature from symbols where signature is not null), z as (select unnest(" + _TOKENS.format(x="signature") + ") as token from y) select token, count(*) as n from z group by token",
    "txt_19_enriched": "select distinct id, '[' || file_path || '] ' || symbol_name || chr(10) || coalesce(list_aggregate(list_filter(list_transform(range(1, length(coalesce(signature, '')) + 1), lambda i: left(coalesce(signature, ''), i)), lambda y: strlen(y) <= 1500), 'last'), '') as text from symbols",
    "txt_21_lexical": _S + _TR + f", z as (select id, line_no, line, t, {_KW} + starts_with(t, 'case ')::int + len(regexp_extract_all(t, ' && ')) + len(regexp_extract_all(t, ' \\|\\| ')) as c, len(regexp_extract_all(t, '\\{{')) as o, len(regexp_extract_all(t, '\\}}')) as e from tl), s1 as (select *, sum(o - e) over (partition by id order by line_no) as sm from z), s2 as (select *, sm - least(0, min(sm) over (partition by id order by line_no)) as depth from s1), s3 as (select *, coalesce(lag(depth) over (partition by id order by line_no), 0) + o as d from s2) select id, count(*) as lines, (1 + sum(c))::bigint as cyclomatic, max(d)::bigint as nesting, count(*) filter (starts_with(t, 'use ') or starts_with(t, 'import ') or starts_with(t, 'from ') or starts_with(t, '#include ')) as imports, round(count(*) filter (starts_with(t, '//') or starts_with(t, '/*')) / count(*)::double, 6) as doc_coverage, round(coalesce(greatest(count(*) filter (starts_with(line, chr(9))), count(*) filter (starts_with(line, '  '))) / nullif(count(*) filter (starts_with(line, chr(9)) or starts_with(line, '  ')), 0)::double, 1), 6) as indent_share from s3 group by id",
    "txt_21_duplicate_lines": _S + _TR + ", k as (select id, t, count(*) as n from tl where t <> '' and not starts_with(t, '//') and not starts_with(t, '/*') group by all) select id, sum(n)::bigint as lines, round(case when sum(n) < 3 then 0 else coalesce(sum(n - 1) filter (strlen(t) > 10 and n > 1), 0) / sum(n)::double end, 6) as dup_ratio from k group by id",
    "txt_22_critical_patterns": _S + r"select id, len(regexp_extract_all(enriched_text, '\.unwrap\(\)|panic!?\(|\beval\(|\bexec\(|\bsystem\(|System\.exit\(|console\.log\(|println!\(')) as hits from sy where hits > 0",
    "txt_23_names_and_paths": r"select distinct symbol_name, file_path, lower(regexp_replace(regexp_replace(symbol_name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) as snake, array_to_string(string_split(file_path, '/')[:-3], '/') || case when len(string_split(file_path, '/')) > 2 then '/' else '' end || 'x' as path, true as outside from symbols",
    "agg_39_vocabulary": _IDX + "select term, df, round(idf, 6) as idf from idf",
    "agg_40_weights": _IDX + "select doc, count(*) as terms, round(sum(w), 5) as sum_w, round(max(w), 5) as max_w from ww group by doc",
    "joi_20_search_scores": _SEARCH.replace(" from sy where id % 50 = 0)", " from sy)") + "select query, count(*) as docs, round(sum(score::decimal(18, 6)), 4)::double as total, max(score) as best from ht group by query",
    "srt_7_search": _SEARCH + _BEST.format(src="ht", k3=30, k=10, cond="score >= 0.05 and (complexity is null or complexity <= 8)"),
    "fil_10_search_in_files": _SEARCH + _BEST.format(src="(select * from ht where file like '%.go')", k3=15, k=5, cond="score >= 0"),
    "srt_8_suggestions": "select distinct symbol_name from symbols where contains(lower(symbol_name), 'load') or contains('load', lower(symbol_name)) order by symbol_name limit 10",
}
