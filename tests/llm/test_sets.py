"""Terms, co-occurrence and shared spans against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from codelens.llm import cooccurrence, queries, spans, terms


def test_scores(spark):
    texts = {1: "Alpha alpha ALPHA beta", 2: "alpha_1 beta", 3: None, 4: "", 5: "beta beta gamma Été", None: "beta"}
    rows = [(k, v, "x") for k, v in texts.items()] + [(1, texts[1], "x")]
    got = {(r.id, r.term): r for r in terms.scores(spark.createDataFrame(rows, "id bigint, enriched_text string, term string")).collect()}
    tf = {k: Counter(re.findall(r"\w+", v.lower())) for k, v in texts.items() if v}
    mean = sum(len(v.encode()) for v in texts.values() if v is not None) / 5
    for k, c in tf.items():
        for t, n in c.items():
            f = sum(x[t] for x in tf.values()) / len(texts)
            tfn = n * math.log2(1 + mean / len(texts[k].encode()))
            want = (math.log2(1 + f) + tfn * math.log2((1 + f) / f)) / (tfn + 1)
            assert abs(got[k, t].score - want) < 1e-9 and got[k, t].tf == n and got[k, t].df == sum(t in x for x in tf.values())
    assert len(got) == sum(map(len, tf.values()))
    assert terms.scores(spark.createDataFrame([], "id bigint, enriched_text string")).collect() == []


def test_shared_rare_terms_need_no_score(spark, tmp_path):
    """Rows follow from the counts; scores, which are above 0 for every term, are not computed for them."""
    texts = {1: "a a a b b b c c c", 2: "a b", 3: "b c c c c", 4: None, **{k: "b" for k in range(5, 10)}}
    df = spark.createDataFrame(list(texts.items()), "id bigint, enriched_text string")
    assert df.count() == terms.scores(df).select("id").distinct().count() + 1 and terms.scores(df).where("not score > 0").collect() == []
    df.write.parquet(f"{tmp_path}/symbols.parquet")
    found = queries.p3_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, "a"), (1, "c"), (3, "c")}
    assert "LOG2" not in found._jdf.queryExecution().optimizedPlan().toString().upper()


def brute_pairs(rows, known, most, least, ratio):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None and b in known:
            baskets[b].add(i)
    baskets = {b: x for b, x in baskets.items() if len(x) <= most}
    n1, n2 = Counter(i for x in baskets.values() for i in x), Counter(p for x in baskets.values() for p in combinations(sorted(x), 2))
    return {(a, b, n1[a], n1[b], k, len(baskets)) for (a, b), k in n2.items() if k >= least and k / max(n1[a], n1[b]) >= ratio}


def test_pair_counts(spark):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(60)}", f"p{int(rng.paretovariate(0.7)) % 40}") for _ in range(1500)] + [("big", f"p{i}") for i in range(300)] + [(None, "p1"), ("s1", None)] * 3
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "sha string, path string, n int")
    known = {f"s{i}" for i in range(50)} | {"big"}
    kdf = spark.createDataFrame([(k,) for k in sorted(known)] * 2, "sha string")
    for most, least, ratio in ((100, 1, 0.0), (12, 3, 0.3), (1000, 4, 0.1)):
        got = {tuple(r)[:6] for r in cooccurrence.pair_counts(df, "sha", "path", kdf, most, least, ratio).collect()}
        assert got == brute_pairs(rows, known, most, least, ratio)
    assert cooccurrence.pair_counts(df.limit(0), "sha", "path").collect() == []


def brute_spans(files, length):
    where = defaultdict(set)
    for k, c in files.items():
        for i in range(len(c or b"") - length + 1):
            where[c[i : i + length]].add(k)
    pairs = {p for x in where.values() for p in combinations(sorted(x), 2)}
    covered = defaultdict(set)
    for k, c in files.items():
        for i in range(len(c or b"") - length + 1):
            if len(where[c[i : i + length]]) > 1:
                covered[k] |= set(range(i, i + length))
    return pairs, {k: len(v) for k, v in covered.items()}


def test_shared_spans(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 4096)
    rng = random.Random(5)
    noise = lambda n, a="abcdefgh \n": "".join(rng.choice(a) for _ in range(n)).encode()
    files = {i: noise(rng.randrange(0, 900)) for i in range(60)}
    for i in range(60, 120):  # spans of exactly, just under and over the length, anywhere
        span = noise(rng.choice([79, 80, 81, 100, 119, 160, 400]))
        for j in rng.sample(range(60), rng.choice([2, 2, 3])):
            at = rng.randrange(len(files[j]) + 1)
            files[j] = files[j][:at] + span + files[j][at:]
    files |= {200: files[3], 201: files[3], 202: b"a" * 500, 203: b"x" + b"a" * 300, 204: b"", 205: None, 206: noise(30_000), 207: b"0, " * 200}
    files[208] = noise(9_000) + files[206][11_111:11_191] + noise(9_000)
    files[209] = files[206][:200]
    rows = [(k, c, "y") for k, c in files.items()] + [(3, files[3], "y")]
    want, covered = brute_spans(files, 80)
    for n in (1, 3):
        s = spans.Spans(spark.createDataFrame(rows, "file_id bigint, content binary, k string").repartition(n), length=80)
        assert {tuple(r) for r in s.pairs().collect()} == want
        assert {r.k: r.shared_bytes for r in s.shared().collect() if r.shared_bytes} == covered
    assert spans.Spans(spark.createDataFrame([], "file_id bigint, content binary")).pairs().collect() == []


def test_spans_double_until_none_survives(spark):
    """The greatest doubled length that two different contents share, against brute force."""
    rng = random.Random(12)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    long, short = noise(700), noise(90)
    files = {1: noise(50) + long + noise(30), 2: long[:650] + noise(200), 3: noise(100) + short, 4: short + noise(60), 5: noise(300), 6: long[100:430] + noise(9)}

    def share(a, b, n):
        return bool({a[i : i + n] for i in range(len(a) - n + 1)} & {b[i : i + n] for i in range(len(b) - n + 1)})

    want = {}
    for k, c in files.items():
        for n in (80, 160, 320, 640, 1280):
            if any(share(c, d, n) for j, d in files.items() if j != k):
                want[k] = n
    s = spans.Spans(spark.createDataFrame(list(files.items()), "file_id bigint, content binary"), length=80)
    assert {r.k: r.longest for r in s.levels().collect()} == want == {1: 640, 2: 640, 3: 80, 4: 80, 6: 320}
