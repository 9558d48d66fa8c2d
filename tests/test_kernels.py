"""Kernels on literal cases, and properties."""

import json
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelens import config, sinks
from codelens.functions import filters, stats
from codelens.operators import changed, clones, graphs, history, mutation, quality, text
from codelens.sources import extract, git, paths


def values(spark, xs, kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"v {kind}")


def test_percentiles(spark):
    one_to_ten = values(spark, range(1, 11), "int")
    assert tuple(stats.percentiles(one_to_ten, "v", {"a": 0.9, "b": 0.5, "c": 0.95}).first()) == (9, 6, 10)
    assert stats.percentiles(one_to_ten.limit(0), "v", {"a": 0.5}).first()["a"] == 0
    xs = [random.Random(1).randrange(40) for _ in range(301)]
    got = stats.percentiles(values(spark, xs, "int"), "v", {f"p{p}": p / 100 for p in (1, 25, 50, 80, 99)}).first()
    assert list(got) == [sorted(xs)[math.floor(p / 100 * 300 + 0.5)] for p in (1, 25, 50, 80, 99)]


def test_mid_rank(spark):
    got = {r.v: r.p for r in stats.mid_rank(values(spark, [1, 2, 2, 3], "int"), "v", "p").collect()}
    assert got == {1: 12.5, 2: 50.0, 3: 87.5}


def test_ladders_and_interpolation(spark):
    d = values(spark, [97.0, 96.9, 60.0, 59.9, 0.0])
    assert [r[0] for r in d.select(stats.grade(F.col("v"))).collect()] == ["A+", "A", "D", "F", "F"]
    d = values(spark, [-1.0, 0.0, 0.05, 0.1, 0.15, 2.0])
    got = [round(r[0], 9) for r in d.select(stats.interpolate(F.col("v"), quality.CDF["churn"])).collect()]
    assert got == [0, 0, 0.025, 0.05, 0.1, 1]
    d = spark.createDataFrame([(50.0, 100.0), (150.0, 100.0), (50.0, 0.0)], "v double, m double")
    assert [r[0] for r in d.select(stats.safe_normalize(F.col("v"), F.col("m"))).collect()] == [0.5, 1, 0]


def test_entropy(spark):
    rows = [("a", "x", 100, 0), ("b", "x", 50, 0), ("b", "y", 25, 25), ("c", "x", 0, 0)]
    got = {r.sha: r.entropy for r in history.entropy(spark.createDataFrame(rows, "sha string, path string, additions int, deletions int")).collect()}
    assert got == {"a": 0.0, "b": 1.0}


def test_messages(spark):
    m = {"Patch security vulnerability": (True, False), "Add new feature": (False, False), "Merge pull request #3": (False, True), "docs: fix typo": (True, True), "prefix": (False, False)}
    d = spark.createDataFrame([(k,) for k in m], "m string").select("m", F.col("m").rlike(history.FIX).alias("f"), F.col("m").rlike(history.AUTOMATED).alias("a"))
    assert {r.m: (r.f, r.a) for r in d.collect()} == m


def test_risk_of_automated_commits(spark):
    row = dict(sha=1, message="ci: x", is_fix=False, is_automated=True, lines_added=900, lines_deleted=1, num_files=9, unique_changes=3, num_developers=2, experience=0, entropy=2.0, file_churn=0.5, file_complexity=3.0, ownership_diffusion=0.1)
    rows = [row, {**row, "sha": 2, "is_automated": False, "is_fix": True}]
    got = {r.sha: r.risk for r in history.commit_risk(spark.createDataFrame(rows)).collect()}
    assert got[1] == 0.05 and 0 <= got[2] <= 1 and got[2] > 0.5


def test_regression_of_flat_series(spark):
    d = spark.createDataFrame([(i, 7.0) for i in range(5)], "i int, y double")
    r = quality.regression(d, "y", [], ["i"]).first()
    assert (r.slope, r.intercept, r.r2) == (0, 7, 0)
    r = quality.regression(spark.createDataFrame([(i, 2.0 * i + 1) for i in range(5)], "i int, y double"), "y", [], ["i"]).first()
    assert abs(r.slope - 2) < 1e-9 and abs(r.r2 - 1) < 1e-9


def test_component_scores_stay_in_range(spark):
    d = values(spark, [x / 7 for x in range(0, 700)])
    for c in ("complexity", "deadcode", "churn", "duplication", "cohesion", "defect", "satd", "smells", "tdg"):
        lo, hi = d.select(F.min(quality.component_score(c, F.col("v"))), F.max(quality.component_score(c, F.col("v")))).first()
        assert 0 <= lo <= hi <= 100


def test_clone_kernels(spark):
    d = values(spark, [0.99, 0.95, 0.90, 0.85, 0.70])
    assert [r[0] for r in d.select(clones.clone_type(F.col("v"))).collect()] == ["type1", "type1", "type2", "type2", "type3"]
    toks = spark.createDataFrame([(["my", "+", "other", "my", "if", "'s'", "3", "my"],)], "t array<string>")
    assert toks.select(clones.normalised(F.col("t"))).first()[0] == ["VAR_0", "+", "VAR_1", "VAR_0", "if", "LITERAL", "LITERAL", "VAR_0"]
    d = spark.createDataFrame([(list("abcde"),), (list("ab"),), ([],)], "t array<string>")
    assert [r[0] for r in d.select(F.size(clones.shingles(F.col("t"), 3))).collect()] == [3, 1, 0]
    same = spark.createDataFrame([([f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)])], "a array<string>, b array<string>")
    r = same.select(clones.signature(clones.shingles(F.col("a"))).alias("a"), clones.signature(clones.shingles(F.col("b"))).alias("b")).first()
    assert len(r.a) == 200 and sum(x == y for x, y in zip(r.a, r.b)) / 200 < 0.1


@pytest.mark.parametrize("path,want", [("src/contest_runner.rs", False), ("test.rs", False), ("src/test_utils.rs", True), ("spec/models/user_spec.rb", True), ("a/b.test.js", True), ("a/testdata/x.go", True), ("a/latest.js", False), ("A\\Tests\\x.cs", True)])
def test_test_files(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.test_file(F.col("p"))).first()[0] is want


def test_paths(spark):
    d = spark.createDataFrame([("a/x.min.js",), ("a/x.js",), ("a/min.js",), ("target/a.rs",), ("my_target/a.rs",), ("a/foo_pb2.py",), ("a/mock_x.go",)], "p string")
    got = d.select(paths.built_asset(F.col("p")), paths.ignored(F.col("p")), paths.generated(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, False), (False, False, False), (False, True, False), (False, False, False), (False, False, True), (False, False, True)]
    import re

    assert re.match(paths.glob("**/*.rs"), "a/b/c.rs") and re.match(paths.glob("**/*.rs"), "c.rs") and not re.match(paths.glob("*.rs"), "a/c.rs") and re.match(paths.glob("a/?.{js,ts}"), "a/x.ts")


def test_text(spark):
    d = spark.createDataFrame([(1, "a\n  b\r\n\n"), (2, ""), (3, None), (4, "x")], "k int, t string")
    assert [(r.k, r.line_no, r.line) for r in text.lines(d, "k", "t").orderBy("k", "line_no").collect()] == [(1, 1, "a"), (1, 2, "  b"), (1, 3, ""), (4, 1, "x")]
    d = spark.createDataFrame([("HTTPServerName2X",), ("aB",)], "s string")
    assert [r[0] for r in d.select(text.snake_case(F.col("s"))).collect()] == ["http_server_name2_x", "a_b"]
    d = spark.createDataFrame([("a/../b/./c",), ("../a",), ("a/..",)], "s string")
    assert [r[0] for r in d.select(text.normal_path(F.col("s"))).collect()] == ["b/c", None, ""]
    d = spark.createDataFrame([(1, 'if client.boolVariation("new-ui", false) && ENV["FEATURE_X"] { Flipper.enabled?(:beta) }')], "n int, line string")
    assert {(r.provider, r.flag) for r in text.flag_references(d, list(text.FLAG_PROVIDERS)).collect()} == {("launchdarkly", "new-ui"), ("env", "FEATURE_X"), ("flipper", "beta")}
    assert text.flag_references(d, []).collect() == []
    body = "def f():\n" + "".join(f"    line_{i} = {i}\nother_{i}\n" for i in range(60))
    got = text.chunks(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t", 100).orderBy("chunk").collect()
    assert len(got) > 3 and "\n".join(r.body for r in got) == body.rstrip("\n") and all(not r.body.startswith(" ") for r in got)


edges_of = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25)


def brute_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_connected_components(spark):
    rng = random.Random(3)
    for pairs in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]):
        got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame([(*p, 0) for p in pairs], "src bigint, dst bigint, node int")).collect()}
        assert got == brute_components(pairs)


def brute_reach(pairs, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, d in pairs:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_strong_components_and_betweenness(spark):
    rng = random.Random(5)
    for n in (6, 12):
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)})
        nodes = sorted({x for p in pairs for x in p})
        df = spark.createDataFrame(pairs, "src bigint, dst bigint")
        reach = {x: brute_reach([p for p in pairs if p[0] != p[1]], x) for x in nodes}
        want = {x: max(y for y in nodes if y == x or y in reach[x] and x in reach[y]) for x in nodes}
        size = Counter(want.values())
        assert {r.node: r.component for r in graphs.strong_components(df).collect()} == {x: c for x, c in want.items() if size[c] > 1}
        clean = {p for p in pairs if p[0] != p[1]}
        total = defaultdict(float)
        for s in nodes:  # shortest paths by brute force
            level, paths_ = {s: 0}, {s: [[s]]}
            front = [s]
            while front:
                nxt = defaultdict(list)
                for x in front:
                    for a, b in clean:
                        if a == x and b not in level:
                            nxt[b] += [p + [b] for p in paths_[x]]
                for b, ps in nxt.items():
                    level[b], paths_[b] = 1, ps
                front = list(nxt)
            for t, ps in paths_.items():
                for p in ps:
                    for v in p[1:-1]:
                        total[v] += 1 / len(ps)
        k = len(nodes)
        got = {r.node: r.betweenness for r in graphs.betweenness(df, graphs.nodes_of(df)).collect()}
        assert all(abs(got[v] - total[v] / ((k - 1) * (k - 2))) < 1e-9 for v in nodes)
    assert graphs.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")).collect() == []


def test_drawings(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    assert graphs.mermaid(e).splitlines()[0] == "graph TD" and '"1" -> "2"' in graphs.dot(e)


def test_changed(spark):
    rows = [("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 3, "y", 3), ("b", 1, "x", 1), ("b", 3, "z", 3), ("c", 3, "n", 3), ("d", 1, None, 1), ("d", 3, None, 4), ("e", 3, "k", 0), ("e", 1, "k", 5), (None, 3, "q", 1), ("b", 3, "z", 3)]
    df = spark.createDataFrame([(k, r, h, t) for k, r, h, t in rows], "k string, run_id int, h string, t int").withColumn("t", F.timestamp_seconds("t"))
    got = lambda **kw: {r.k for r in changed.changed(df, ["k"], "h", "t", **kw).collect()}
    assert got(since=2) == {"b", "c", None}
    assert got(since=None) == {"a", "b", "c", "e", None}
    assert got(since=1, upto=2) == {"a"}
    runs = spark.createDataFrame([(1, 1, "success"), (2, 1, "success"), (2, 2, "failed"), (3, 1, "running")], "run_id int, attempt int, status string")
    assert changed.last_success(runs) == 1 and changed.last_success(runs.where("run_id = 3")) is None
    assert changed.changed(df.limit(0), ["k"], "h", "t", 1).collect() == []


def test_progress_survives_failures(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i % 5 + 1) for i in range(50)], "k string, run_id int")
    p = changed.Progress(spark, str(tmp_path))
    make = lambda since, upto: {"new": df.where((F.col("run_id") > (since or 0)) & (F.col("run_id") <= upto))}

    def broken(since, upto):
        raise RuntimeError("lost")

    p.run(2, make)
    with pytest.raises(RuntimeError):
        p.run(4, broken)
    assert p.watermark() == 2

    class Dies:  # the outputs are written, the commit is not
        def rename(self, *a):
            raise RuntimeError("lost between write and commit")

    alive, p._files = p._files, Dies()
    with pytest.raises(RuntimeError):
        p.run(4, make)
    p._files = alive
    assert p.watermark() == 2 and len(list((tmp_path / "data").iterdir())) == 1
    # another writer takes the next commit meanwhile
    other = changed.Progress(spark, str(tmp_path))

    def slow(since, upto):
        other.run(3, make)
        return make(since, upto)

    with pytest.raises(Exception):
        p.run(4, slow)
    assert p.watermark() == 3
    p.run(4, make)
    assert p.run(4, make) is None
    p.run(5, make)
    got = Counter(r.k for c in p.commits() for r in spark.read.parquet(f"{c['data']}/new").collect())
    assert set(got.values()) == {1} and len(got) == 50


def test_increments_add_up_to_the_whole(spark, tmp_path):
    """Runs over increments and a kept state give what one comparison of the whole history gives."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "d"]), r, rng.choice(["x", "y", None]), r * 10 + rng.randrange(-15, 15)) for r in range(1, 7) for _ in range(6)]
    df = spark.createDataFrame(rows, "k string, run_id int, h string, t int").selectExpr("k", "run_id", "h", "timestamp_seconds(t + 100) as at")
    p, before = changed.Progress(spark, str(tmp_path)), None
    for upto in (1, 3, 4, 6):

        def make(since, at):
            state = p.read("state")
            state = changed.state_of(df, ["k"], "h", "at", None) if state is None else state
            moved = changed.increment(df, state, ["k"], "h", "at", since, at)
            return {"changes": changed.differing(moved, "h"), "state": moved.select("k", "__last")}

        p.run(upto, make)
        got = sorted((r.k for r in p.read("changes").collect()), key=str)
        want = sorted((r.k for r in changed.changed(df, ["k"], "h", "at", before, upto=upto).collect()), key=str)
        assert got == want and len(set(got)) == len(got)
        before = upto


def test_may_match_loses_nothing(spark):
    df, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7)
    kept = {r.k for r in filters.may_match(df, F.col("k"), keys, F.col("id")).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 1000


def test_cochange_by_brute_force(spark):
    rng = random.Random(8)
    rows = sorted({(rng.randrange(40), rng.randrange(12)) for _ in range(160)}) + [(99, i) for i in range(12)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "sha int, path int, additions int, deletions int")
    by = defaultdict(set)
    for s, p in rows:
        by[s].add(p)
    n = Counter(p for x in by.values() for p in x)
    pairs = Counter(q for s, x in by.items() if len(x) <= 8 for q in combinations(sorted(x), 2))
    want = {(a, b): (c, min(1, c / max(n[a], n[b]))) for (a, b), c in pairs.items() if c >= 2}
    assert {(r.path_a, r.path_b): (r.cochanges, r.strength) for r in history.cochange(df, 2, 8).collect()} == want


def test_extraction():
    src = "import os\nfrom a.b import c\nclass A(B):\n    def f(self, x):\n        if x and g(x):\n            for i in x:\n                self.y = h(i)\n        return 1\n"
    f = extract.functions(src, "python")[0]
    assert (f["name"], f["start_line"], f["end_line"], f["cyclomatic"], f["nesting"], f["calls"]) == ("f", 4, 8, 3, 2, ["g", "h"])
    assert extract.classes(src, "python")[0]["methods"] == ["f"] and extract.classes(src, "python")[0]["fields"] == ["y"]
    assert extract.imports(src, "python") == [("os", 1), ("a.b", 2)]
    go = 'package a\n\nimport "log"\n\nfunc (t *T) Load(a int) int {\n\tif a > 1 && b {\n\t\tfor {\n\t\t}\n\t}\n\treturn get(a)\n}\n'
    f = extract.functions(go, "go")[0]
    assert (f["name"], f["exported"], f["cyclomatic"], f["nesting"], f["start_line"], f["end_line"], f["calls"]) == ("Load", True, 4, 2, 5, 11, ["get"])
    assert extract.functions("function f(a) { return '}' + g(a); }\n", "javascript")[0]["end_line"] == 1
    for path, code, kind in (("x.rs", "fn f() -> i32 { todo!() }", "not_implemented"), ("x.ts", "function f() { throw new Error('not implemented'); }", "not_implemented"), ("x.go", "func f() { // ... rest of the implementation\n}", "empty_body"), ("x.rs", "fn f() {\n a();\n // rest of the code\n}", "elision")):
        assert [s[0] for s in extract.stubs(code, extract.EXTENSIONS[path.rsplit(".")[-1]])] == [kind], code
    assert extract.stubs("fn f() {\n a(); // a stub of b\n}", "rust") == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.sampled_from(sorted(extract.HEADS)))
def test_extraction_of_any_text(source, language):
    for f in extract.functions(source, language):
        assert f["cyclomatic"] >= 1 and f["cognitive"] >= 0 and f["end_line"] >= f["start_line"]
    extract.classes(source, language), extract.imports(source, language), extract.stubs(source, language)


def test_deeper_nesting_is_never_simpler():
    flat = "fn f() { if a { } if b { } }"
    deep = "fn f() { if a { if b { } } }"
    assert extract.functions(deep, "rust")[0]["cognitive"] > extract.functions(flat, "rust")[0]["cognitive"]


def test_extract_rows(spark):
    df = spark.createDataFrame([("a.py", b"def f(): pass", 1), ("a.py", b"def f(): pass", 1), ("b.unknown", b"x", 1), ("c.go", None, 1), ("d.rs", b"\xff\xfe", 1)], "path string, content binary, language int")
    got = {r.path: len(r.functions) for r in extract.extract(df).collect()}
    assert got == {"a.py": 1, "c.go": 0, "d.rs": 0}


def test_mutation(spark):
    assert [mutation.replacements_of_literal(x) for x in ("0", "1", "-1", "7", "0.0", "1.0", "2.5", "x")] == [["1", "-1"], ["0", "2"], ["0", "-2"], ["8", "6", "0"], ["1.0", "-1.0"], ["0.0", "2.0"], ["0.0", "-2.5"], []]
    assert mutation.apply_mutant(b"a < b", 2, 3, ">=") == b"a >= b"
    rng = random.Random(2)
    rows = [(x := rng.random(), rng.random(), int(x > 0.5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    p = df.select("y", mutation.ridge(df, ["a", "b"], "y").alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in p) and sum((r.p > 0.5) == r.y for r in p) > 380


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("exclude = ['a']\n[churn]\ntop = 3\n")
    c = config.load(str(f), {"CODELENS_CHURN__TOP": "5", "CODELENS_FLAGS__PROVIDERS": '["env"]'})
    assert c.exclude == ["a"] and c.churn.top == 5 and c.flags.providers == ["env"]
    f.write_text("[churn]\nnope = 3\n")
    with pytest.raises(ValueError):
        config.load(str(f), {})
    assert [config.days_of(x) for x in ("30 days", "6m", "1y", "2w", "all")] == [30, 180, 365, 14, None]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("r", "error", "a.rs", 3, "m|x")], "rule_id string, level string, uri string, line int, message string")
    sinks.write_json(d, str(tmp_path / "j"))
    assert sinks.read_json(spark, str(tmp_path / "j"), "rule_id string, line int").first()["line"] == 3
    r = json.loads(sinks.sarif(d, "t").first()["result"])
    assert r["ruleId"] == "r" and r["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert "m\\|x" in sinks.markdown(d)
    small = sinks.trim({"tree": list(range(500)), "risks": list(range(20))}, 50)
    assert len(small["tree"]) < 500 and len(small["tree"]) >= 5 and small["risks"]
    assert sinks.context_markdown({"tree": ["a"], "risks": []}) == "## Tree\n- a"
    page, left = sinks.top(spark.range(10).orderBy("id"), 3, 2)
    assert [r.id for r in page.collect()] == [2, 3, 4] and left == 7


def test_git(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    run("add", "."), run("commit", "-qm", "first | one")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("commit", "-qam", "second")
    got = {(r.message, r.path, r.additions, r.deletions, r.change_type) for r in git.log(spark, str(tmp_path)).collect()}
    assert got == {("first | one", "a.py", 2, 0, "added"), ("second", "a.py", 0, 1, "deleted")}
    shas = spark.createDataFrame([(s,) for s in git.run(str(tmp_path), "rev-list", "HEAD").split()], "sha string")
    assert sorted(bytes(r.content) for r in git.tree(spark, str(tmp_path), shas).collect()) == [b"x = 1\n", b"x = 1\ny = 2\n"]
    assert git.remote_of("o/r@v1") == ("o/r", "v1") and git.remote_of("https://x.example/o/r.git") == ("o/r", None) and git.remote_of("no") is None
    assert git.rev_count(str(tmp_path), "HEAD") == 2


def test_scan(spark, tmp_path):
    for p in ("a/x.py", "a/.hidden.py", "node_modules/y.js", "b/z.min.js", "c/t.txt", "d/k.go"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert [r.path for r in paths.scan(spark, str(tmp_path), ["d/**"]).collect()] == ["a/x.py"]


def test_streaming_churn(spark, tmp_path):
    from codelens.streaming.churn import start, windowed_churn

    rows = [(f"p{i % 3}", 1, 2, f"2024-01-{1 + i // 4:02d} 10:00:00") for i in range(80)]
    d = spark.createDataFrame(rows, "path string, additions int, deletions int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert done and done <= {tuple(r) for r in windowed_churn(d).collect()}
