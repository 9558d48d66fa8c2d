"""Queries do the whole job: on small tables of their own they equal brute force."""

import random
from collections import defaultdict

import pytest

from codelens.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """(folder, edges): orders whose lines call parts far from each other, a chain from part 950 among them."""
    rng, d, rows = random.Random(3), tmp_path_factory.mktemp("calls"), []
    for o in range(400):
        parts = [rng.choice((rng.randint(1, 12), rng.randint(1, 900))) for _ in range(rng.randint(1, 4))]
        rows += [(o, n, p) for n, p in enumerate(parts)]
    rows += [(500 + i, n, 950 + i + n) for i in range(12) for n in (0, 1)]
    hub = [(2001 + i, 2000) for i in range(4)] + [(2000, 2010)] + [(2010, 2011 + i) for i in range(4)] + [(2030 + i, 2020) for i in range(25)]
    rows += [(600 + i, n, p) for i, ab in enumerate(hub) for n, p in enumerate(ab)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{d}/lineitem.parquet")
    edges = {(a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[2] != b[2]}
    return str(d), edges


def reach(edges, root, depth):
    out, level, front = defaultdict(set), {root: 0}, [root]
    for a, b in edges:
        out[a].add(b)
    while front and (depth is None or level[front[0]] < depth):
        new = {y for x in front for y in out[x]} - set(level)
        level |= dict.fromkeys(new, level[front[0]] + 1)
        front = list(new)
    return level


def rows(spark, name, d):
    return sorted(map(tuple, Q[name](spark, d).collect()), key=str)


def test_calls_keep_every_edge(spark, calls):
    assert set(rows(spark, "gra_1_calls", calls[0])) == calls[1]


def test_components_of_all_calls(spark, calls):
    d, e = calls
    both, want = e | {(b, a) for a, b in e}, {}
    for n in sorted({x for p in e for x in p}):
        want |= {} if n in want else dict.fromkeys(reach(both, n, None), n)
    assert dict(rows(spark, "gra_5_components", d)) == want


@pytest.mark.parametrize("name, depth, turned", [("gra_6_callers", 3, False), ("gra_6_callees", 2, True)])
def test_levels_from_all_roots(spark, calls, name, depth, turned):
    d, e = calls
    e = {(b, a) for a, b in e} if turned else e
    roots = sorted({x for p in e for x in p if x % 50 == 0})
    want = {(r, n, k) for r in roots for n, k in reach(e, r, depth).items() if k}
    assert max(roots) > 900 and set(rows(spark, name, d)) == want


def test_reachability_over_all_calls(spark, calls):
    d, e = calls
    roots = {x for p in e for x in p if x % 50 == 0}
    assert {n for (n,) in rows(spark, "gra_7_reachability", d)} == set().union(*(reach(e, r, None) for r in roots))


def test_smells_and_degrees_over_all_calls(spark, calls):
    d, e = calls
    i, o = defaultdict(int), defaultdict(int)
    for a, b in e:
        o[a] += 1
        i[b] += 1
    nodes = {x for p in e for x in p}
    unstable = {n: o[n] / (i[n] + o[n]) for n in nodes}
    want = {("central_connector", "high", n, None) for n in nodes if i[n] > 10 and o[n] > 10}
    want |= {("hub", "high", n, None) for n in nodes if not (i[n] > 10 and o[n] > 10) and i[n] + o[n] > 20 and i[n] >= 3}
    pairs = {(a, b) for a, b in e if unstable[a] < 0.3 and unstable[b] > 0.7 and unstable[b] - unstable[a] > 0.4}
    want |= {("unstable_dependency", "medium", a, b) for a, b in pairs}
    assert {k for k, *_ in want} == {"central_connector", "hub", "unstable_dependency"}
    assert set(rows(spark, "gra_9_smells", d)) == want and set(rows(spark, "joi_14_unstable", d)) == pairs
    assert set(rows(spark, "agg_19_coupling", d)) == {(n, i[n], o[n]) for n in nodes}
    mean = round(sum(unstable.values()) / len(nodes), 6)
    assert {(r.kind, r.n, r.high, r.mean_instability) for r in Q["agg_28_smell_rollup"](spark, d).collect()} == {
        (k, sum(w[0] == k for w in want), sum(w[0] == k and w[1] == "high" for w in want), mean) for k in {w[0] for w in want}
    }
    (r,) = Q["agg_43_graph_summary"](spark, d).collect()
    assert (r.nodes, r.edges, r.max_degree, r.instability) == (len(nodes), len(e), max(i[n] + o[n] for n in nodes), mean)


def test_call_rank_settles(spark, calls):
    d, e = calls
    nodes, deg = {x for p in e for x in p}, defaultdict(int)
    for a, _ in e:
        deg[a] += 1
    rank, moved, rounds = dict.fromkeys(nodes, 1 / len(nodes)), 1, 0
    while moved >= 1e-6 and rounds < 100:
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in e:
            new[b] += 0.85 * rank[a] / deg[a]
        rank, moved, rounds = new, sum(abs(new[n] - rank[n]) for n in nodes), rounds + 1
    assert rounds > 20
    got = dict(rows(spark, "gra_2_call_rank", d))
    assert set(got) == nodes and all(abs(got[n] - rank[n] * 1000) < 1e-4 for n in nodes)


def test_enriched_keeps_1500_bytes(spark, tmp_path):
    texts = ["", "def f(a_rather_long_name, another):", "x" * 1500, "x" * 1501, "x" * 1498 + "é€", "x" * 1499 + "€", "x" * 1497 + "€", "x" * 1498 + "😀", "é" * 900]
    spark.createDataFrame(list(enumerate(texts)), "id int, signature string").selectExpr("id", "'a.py' as file_path", "'f' as symbol_name", "signature").write.parquet(f"{tmp_path}/symbols.parquet")
    want = {i: "[a.py] f\n" + t.encode()[:1500].decode("utf-8", "ignore") for i, t in enumerate(texts)}
    assert dict(rows(spark, "txt_19_enriched", str(tmp_path))) == want


def test_files_over_a_megabyte_are_extracted(spark, tmp_path):
    code = lambda size: ("import os\n\ndef f(a):\n    if a:\n        return os\n" + "#" * size)[:size].encode()
    files = [("a.py", code(1_000_000)), ("b.py", code(1_000_001)), ("c.py", code(5 * 1024 * 1024)), ("d.py", code(5 * 1024 * 1024 + 1))]
    spark.createDataFrame(files, "path string, content binary").write.parquet(f"{tmp_path}/source_files.parquet")
    paths = lambda name: [r.path for r in Q[name](spark, str(tmp_path)).orderBy("path").collect()]
    assert paths("par_2_functions") == paths("par_4_imports") == ["a.py", "b.py", "c.py"]
    assert paths("par_6_cyclomatic") == paths("agg_6_complexity_rollup") == ["a.py"]


def test_defect_inputs_keep_measured_complexity(spark):
    from codelens.operators import quality
    from tests.parity import DATA

    assert Q["joi_2_defect_inputs"](spark, DATA).where("estimated").count() == 0
    one = lambda k: spark.createDataFrame([], f"path int, {k}")
    files = spark.createDataFrame([(1, 90), (2, 9000), (3, 90)], "path int, loc int")
    known = spark.createDataFrame([(3, 7)], "path int, complexity int")
    got = quality.defect_inputs(files, one("churn double, contributors int"), known, one("duplication double"), one("coupling int"))
    assert {(r.path, r.estimated, r.complexity) for r in got.collect()} == {(1, True, 3.0), (2, True, 50.0), (3, False, 7.0)}


def test_prior_state_of_hot_paths(spark, monkeypatch):
    """Commits of one, several and no hot paths; authors without a name count as one; groups are cut into parts."""
    from codelens.operators import history as h

    rng, commits, changes = random.Random(5), [], []
    for i in range(600):
        commits.append((f"s{i * 7919 % 600:03}", rng.choice((None, f"a{rng.randint(0, 90)}", f"a{rng.randint(0, 9)}")), i // 3))
        paths = {p for p, often in (("x", 0.6), ("y", 0.4), ("z", 0.2)) if rng.random() < often} | {f"p{rng.randint(0, 40)}" for _ in range(rng.randint(0, 4))}
        changes += [(commits[-1][0], p) for p in paths for _ in range(rng.randint(1, 2))]
    order, seen, want = sorted(commits, key=lambda c: (c[2], c[0])), defaultdict(list), {}
    for k, (sha, author, _) in enumerate(order):
        own = {p for s, p in changes if s == sha}
        want[sha] = (sum(c[1] == author for c in order[:k]), sum(len(seen[p]) for p in own), len({a for p in own for a in seen[p]}))
        for p in own:
            seen[p].append(author)
    assert max(len({*v}) for v in seen.values()) > 60
    c, f = spark.createDataFrame(commits, "sha string, author string, ts int"), spark.createDataFrame(changes, "sha string, path string")
    for hot, group in ((500, 20_000), (20, 20), (0, 7)):
        monkeypatch.setattr(h, "HOT", hot)
        monkeypatch.setattr(h, "GROUP", group)
        assert {r[0]: tuple(r)[1:] for r in h.prior_state(c, f).collect()} == want
    assert "FlatMapCoGroupsInArrow" in h.prior_state(c, f)._jdf.queryExecution().analyzed().toString()  # no join of a hot path's touches and authors


def test_search_of_all_symbols(spark, tmp_path, monkeypatch):
    """Every symbol asks, repeated ids and equal questions included, whatever the blocks; no pair of query and document is shuffled."""
    from codelens.operators import text
    from tests.parity import connect

    rng, words = random.Random(7), ["load", "store", "run", "x1", "Ünit", "go"]
    names = [(i % 90, f"{rng.choice(words)}/{rng.choice(words)}.{rng.choice(('go', 'py'))}", rng.choice(words), " ".join(rng.choices(words + [f"w{i}"], k=rng.randint(0, 9))) or None, rng.randint(1, 9)) for i in range(130)]
    spark.createDataFrame(names, "id bigint, file_path string, symbol_name string, enriched_text string, cyclomatic_complexity int").coalesce(1).write.parquet(f"{tmp_path}/symbols.parquet")
    con = connect()
    con.execute(f"create or replace view symbols as select * from '{tmp_path}/symbols.parquet/*.parquet'")
    for block in (25_000, 13):
        monkeypatch.setattr(text, "BLOCK", block)
        for name in ("joi_20_search_scores", "srt_7_search", "fil_10_search_in_files", "fil_9_score_filters"):
            df = Q[name](spark, str(tmp_path))
            want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
            assert sorted(map(tuple, df.collect())) == sorted(want), name
            assert name != "joi_20_search_scores" or len(want) == 90
            assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().analyzed().toString()
