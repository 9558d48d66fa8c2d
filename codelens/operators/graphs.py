"""Graph operators over edge tables: components (GRA-5), cleaning (GRA-1), PageRank (GRA-2), reachability and others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.sources.checkpoints import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph: component is the least node of each connected part (GRA-5).

    Alternates large-star and small-star contractions, which need O(log^2 n) rounds; each round's edges are cut from their
    lineage in the shared checkpoint folder. Edges with a null end are left out, self loops make a node known. A hub's
    neighbours are aggregated on the map side and never gathered.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = e.select("a").union(e.select("b")).distinct().withColumnRenamed("a", "node")
    e = cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = cut(small)
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.coalesce(F.sum(F.hash("a", "b").cast("bigint")), F.lit(0)).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """GRA-1: no self edges, parallel ones collapsed."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """GRA-2: (node, rank) after so many rounds; what nodes without out-edges hold is dropped, ranks don't add up to 1.

    Each round is one join and one aggregation on the node; lineage is cut every five rounds. With a tolerance the ranks settle
    when a round moves them by less in sum; lineage is cut every round then.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    e = cut(edges.join(out, "src").select("src", "dst", "deg"))
    n = nodes.count()
    base = nodes.select("node")
    r = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        old = r
        got = e.join(r, e["src"] == r["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        r = base.join(got, base["node"] == got["dst"], "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if tolerance is not None:
            new = cut(r)
            moved = new.join(old.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            r = new
            if moved is None or moved < tolerance:
                break
        elif i % 5 == 4:
            r = cut(r)
    return r


def bfs(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """GRA-6 and GRA-7: (root, node, level) of all nodes that each root reaches in at most `depth` steps (None: any), roots left out.

    One join and one anti join a level; every level is cut from its lineage.
    """
    e = edges.select("src", "dst").distinct()
    seen = cut(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("level", F.lit(0)))
    front, k = seen, 0
    while depth is None or k < depth:
        k += 1
        step = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen.where("level > 0")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GRA-7: nodes reached from any root, roots included."""
    e = edges.select("src", "dst").distinct()
    seen = front = cut(roots.select("node").distinct())
    while True:
        front = cut(front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def strong_components(edges: DataFrame) -> DataFrame:
    """GRA-4: (node, component) of strongly connected components of more than one node; the component is its greatest node.

    Nodes without in- or out-edges are trimmed; each round every node takes the greatest node that reaches it, and those that reach
    that node back within its colour are a component and leave.
    """
    e, found = cut(clean_edges(edges)), None
    while True:
        while True:  # trim
            keep = e.select(F.col("src").alias("v")).distinct().join(e.select(F.col("dst").alias("v")).distinct(), "v", "left_semi")
            t = cut(e.join(keep.withColumnRenamed("v", "src"), "src", "left_semi").join(keep.withColumnRenamed("v", "dst"), "dst", "left_semi"))
            if t.count() == e.count():
                break
            e = t
        if e.isEmpty():
            break
        color = nodes_of(e).select("node", F.col("node").alias("c"))
        while True:
            got = e.join(color, e["src"] == color["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("d"))
            new = cut(color.join(got, "node", "left").select("node", F.greatest("c", F.coalesce("d", "c")).alias("c"), (F.coalesce("d", "c") > F.col("c")).alias("moved")))
            color = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        a, b = color.toDF("src", "cs"), color.toDF("dst", "cd")
        inside = cut(e.join(a, "src").join(b, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c")))
        seen = front = cut(color.where("node = c"))
        while True:
            front = cut(front.join(inside.withColumnRenamed("src", "node"), ["node", "c"]).select(F.col("dst").alias("node"), "c").distinct().join(seen, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        found = seen if found is None else cut(found.unionByName(seen))
        e = cut(e.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if found is None:
        return nodes_of(edges).select("node", F.col("node").alias("component")).limit(0)
    big = found.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(big, "c").select("node", F.col("c").alias("component"))


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA-3: (node, betweenness) of a directed unweighted graph, divided by (n - 1)(n - 2); 0 if n <= 2.

    All sources at once: levels and path counts are joined forward, dependencies summed backward, a join a level. Nothing is
    collected; rows are sources times nodes, as the measure demands.
    """
    e = cut(clean_edges(edges))
    n = nodes.count()
    seen = front = cut(nodes.select(F.col("node").alias("s"), "node").withColumn("level", F.lit(0)).withColumn("paths", F.lit(1.0)))
    k = 0
    while not front.isEmpty():
        k += 1
        step = front.join(e, front["node"] == e["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(k).alias("level"), "paths"))
        seen = cut(seen.unionByName(front))
    delta = None
    for level in range(k - 1, 0, -1):
        down = seen.where(F.col("level") == level).select("s", F.col("node").alias("v"), F.col("paths").alias("pv"))
        up = seen.where(F.col("level") == level + 1).select("s", F.col("node").alias("w"), F.col("paths").alias("pw"))
        if delta is not None:
            up = up.join(delta.select("s", F.col("v").alias("w"), "d"), ["s", "w"], "left")
        else:
            up = up.withColumn("d", F.lit(0.0))
        got = down.join(e.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v").join(up, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("pv") / F.col("pw") * (1 + F.coalesce("d", F.lit(0.0)))).alias("d"))
        now = cut(got)
        delta = now if delta is None else cut(delta.unionByName(now))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    base = nodes.select("node")
    if delta is None:
        return base.withColumn("betweenness", F.lit(0.0))
    total = delta.groupBy(F.col("v").alias("node")).agg(F.sum("d").alias("d"))
    return base.join(total, "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, instability): instability = out / (in + out), 0 without edges (AGG-43)."""
    i, o = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    d = nodes.select("node").join(i, "node", "left").join(o, "node", "left").fillna(0)
    return d.withColumn("instability", F.coalesce(F.try_divide("out_degree", F.col("in_degree") + F.col("out_degree")), F.lit(0.0)))


def smells(deg: DataFrame, edges: DataFrame, hub: int = 20, hub_in: int = 3, central: int = 10) -> DataFrame:
    """GRA-9 and JOI-14: (kind, severity, node, other): hubs, central connectors (no hubs then), and edges from stable to unstable."""
    is_central = (F.col("in_degree") > central) & (F.col("out_degree") > central)
    c = deg.where(is_central).select(F.lit("central_connector").alias("kind"), F.lit("high").alias("severity"), "node", F.lit(None).cast("bigint").alias("other"))
    h = deg.where(~is_central & (F.col("in_degree") + F.col("out_degree") > hub) & (F.col("in_degree") >= hub_in)).select(F.lit("hub").alias("kind"), F.lit("high").alias("severity"), "node", F.lit(None).cast("bigint").alias("other"))
    a, b = deg.select(F.col("node").alias("src"), F.col("instability").alias("i")), deg.select(F.col("node").alias("dst"), F.col("instability").alias("j"))
    u = edges.join(a, "src").join(b, "dst").where("i < 0.3 and j > 0.7 and j - i > 0.4").select(F.lit("unstable_dependency").alias("kind"), F.lit("medium").alias("severity"), F.col("src").alias("node"), F.col("dst").alias("other"))
    return c.unionByName(h).unionByName(u)


def depth_of_inheritance(parents: DataFrame) -> DataFrame:
    """GRA-8: (node, depth, children) from (node, parent); cycles without a root have no depth."""
    e = parents.where("parent is not null and parent <> node").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    roots = parents.select("node").union(parents.where("parent is not null").select("parent")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    seen = front = cut(roots.withColumn("depth", F.lit(0)))
    k = 0
    while not front.isEmpty():
        k += 1
        front = cut(front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        seen = cut(seen.unionByName(front))
    return seen.join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children")), "node", "left").fillna(0, ["children"])


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """JOI-15: (caller, callee, target): the callee qualified, else in the caller's file, else the first of that name.

    calls: caller, file, callee; symbols: file, name. The third tier is reduced to one row per name before the join.
    """
    q = symbols.select(F.concat_ws(":", "file", "name").alias("q"), "name").distinct()
    exact = q.select(F.col("q").alias("callee"), F.col("q").alias("t1"))
    same = q.select(F.col("q").alias("t2"))
    any_ = q.groupBy(F.col("name").alias("callee")).agg(F.min("q").alias("t3"))
    j = calls.join(exact, "callee", "left").join(same, F.concat_ws(":", "file", "callee") == F.col("t2"), "left").join(any_, "callee", "left")
    return j.select("caller", "callee", F.coalesce("t1", "t2", "t3").alias("target"), F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3).alias("tier"))


def resolve_calls_all(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """JOI-16: edges to the definition in the caller's file, else to all definitions of that name."""
    d = symbols.select("file", F.col("name").alias("callee")).distinct()
    here = calls.join(d, ["file", "callee"]).select("caller", "callee", F.concat_ws(":", "file", "callee").alias("target"))
    rest = calls.join(d, ["file", "callee"], "left_anti").join(d.withColumnRenamed("file", "other"), "callee").select("caller", "callee", F.concat_ws(":", "other", "callee").alias("target"))
    return here.unionByName(rest)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """JOI-17: (src, import, target): of the files that an import may mean, by tier (same folder, then any with that stem), then
    the shortest and first path."""
    f = files.select(F.col("path").alias("target"), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/.]*)[^/]*$", 1).alias("import"))
    i = imports.select("src", "import", F.regexp_extract("src", r"^(.*/)?[^/]*$", 1).alias("here")).distinct()
    c = i.join(f, "import").where("src <> target")
    order = F.struct(F.when(F.col("dir") == F.col("here"), 1).otherwise(2).alias("tier"), F.length("target").alias("len"), F.col("target").alias("target"))
    return c.groupBy("src", "import").agg(F.min(order).alias("b")).select("src", "import", "b.tier", "b.target")


def mermaid(edges: DataFrame) -> str:
    """GRA-11: a Mermaid drawing; drawings are for small graphs, so more than 500 edges are refused."""
    rows = edges.orderBy("src", "dst").limit(501).collect()
    if len(rows) > 500:
        raise ValueError("too many edges to draw")
    return "\n".join(["graph TD", *(f"    n{r['src']}[{r['src']}] --> n{r['dst']}[{r['dst']}]" for r in rows)])


def dot(edges: DataFrame) -> str:
    """GRA-11: the same as a DOT drawing."""
    rows = edges.orderBy("src", "dst").limit(501).collect()
    if len(rows) > 500:
        raise ValueError("too many edges to draw")
    return "\n".join(["digraph dependencies {", *(f'  "{r["src"]}" -> "{r["dst"]}";' for r in rows), "}"])
