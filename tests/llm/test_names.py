"""Linking of name variants on literal cases."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from codelens.llm import names

ROWS = [
    (1, "Robert Sinifa", "rsinifa@inbox.example"), (2, "Sinifa, Bob", "RSinifa@Inbox.Example"), (3, "rsinifa", "<rsinifa+git@inbox.example>"), (4, "R. Sinifa", "991+rsinifa@noreply.forge.example"), (5, "Robret Sinifa", None),
    (10, "Søren Truzafö", "truzafo.soren@fernhold.example"), (11, "Soren  Truzafo ", "(none)"), (12, "Truzafö Søren", "dev-team@fernhold.example"), (13, "SØREN TRUZAFÖ (on leave)", "soren@laptop-1.local"), (14, "Søren Truzafö-Rika", "truzafo.soren at fernhold.example"),
    (20, "Ines Pojusto", "ines.pojusto@pebble.example"), (21, "Inés P.", "ines.pojusto@pebbleexample"), (22, "Leonard Pojusto", "lpojusto@tidewheel.test"), (23, "Ines Bibriri", "dev-team@fernhold.example"),
    (30, "Kuroki Systems", "ci@kuroki.example"), (31, "The Kuroki Systems", "build@kuroki.example"), (32, "kuroki-systems[bot]", "ci@kuroki.example"), (33, "Relali Works", "ci@relali.example"),
    (40, None, None), (41, "root", None), (42, "", "nobody@inbox.example"), (43, "Developer", "you@inbox.example"), (44, "git", "git@forge.example"),
]


def test_contributors(spark):
    df = spark.createDataFrame([(*r, "x") for r in [*ROWS, ROWS[0]]], "identity_id bigint, author string, email string, contributor string")
    linked = names.contributors(df)
    by = defaultdict(set)
    for r in linked.collect():
        by[r.contributor].add(r.identity_id)
    want = [{1, 2, 3, 4, 5}, {10, 11, 12, 13, 14}, {20, 21}, {22}, {23}, {30, 31, 32}, {33}]
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want))
    pairs = {tuple(r) for r in names.pairs(linked).collect()}
    assert pairs == {(a, b) for w in want for a in w for b in w if a < b}


def test_variants_whatever_the_addresses(spark):
    """Spellings are compared whether or not an address spells them; names that only look alike are not linked."""
    people = [
        ["Katarzyna Kowalska", None], ["Katarzyna Kowalsak", None], ["Ahmed Hassan", "ahmed.hassan@x.example"], ["Ahmed Hasan", "ahmed.hasan@y.example"], ["Hans-Peter Vogel", None], ["Hans Peter Vogel", "hp@z.example"],
        ["Mohammed Al-Sayed", None], ["Muhammad Al Sayed", None], ["Giovanni Rossi", "g.rossi@x.example"], ["Gianni Rossi", None], ["Anna Berger", None], ["Hanna Bergmann", None],
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "identity_id bigint, author string, email string")
    assert {tuple(r) for r in names.pairs(names.contributors(df)).collect()} == {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)}


def test_division_of_hot_blocks_loses_little(spark):
    """Pairs of misspelt names found with every block divided, of those found with none."""
    rng = random.Random(4)
    made = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = set()
    for _ in range(150):
        f, x = made(), made()
        i = rng.randrange(1, len(x) - 1)
        rows |= {(f, x), (f, x[:i] + x[i + 1] + x[i] + x[i + 2 :])}
    forms = spark.createDataFrame([(f"{a} {b}", a, b, False) for a, b in sorted(rows)], "form string, first string, last string, attested boolean")

    def found(hot):
        k = names.blocks(forms, hot)
        to = k.select("key", F.col("form").alias("to"))
        return {tuple(r) for r in k.join(to, "key").where("form < to").select("form", "to").distinct().collect() if names.jaro_winkler(r[0], r[1]) >= 0.95}

    whole, divided = found(10**9), found(1)
    assert divided <= whole and len(divided) >= 0.95 * len(whole) > 50


def test_results_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    """All forms of a block meet, however it is divided: also those of other first letters and lengths."""
    rng = random.Random(8)
    made = lambda *x: "".join(rng.choice(y) for y in x)
    rows = {("carlos", "berger"), ("karlos", "berger"), ("leonard", "pojusto"), ("leonhard", "pojusto")}
    while len(rows) < 200:
        rows.add((made("cgk", "aeiou", "l", "aeiou", ["", "a", "o"]), made("bpf", "ao", "r", "ao", "mn", "ao", ["", "e", "ia"])))
    forms = [(f"{a} {b}", a, b, i % 3 == 0) for i, (a, b) in enumerate(sorted(rows))]
    df = spark.createDataFrame(forms, "form string, first string, last string, attested boolean")
    none = spark.createDataFrame([], "form string, to string")
    whole, near, meet = names.blocks, [], []
    for hot in (10**9, 30, 1):
        k = names.cut(whole(df, hot))
        monkeypatch.setattr(names, "blocks", lambda forms, k=k: k)
        near.append({tuple(r) for r in names.near_forms(df, none).collect()})
        meet.append({tuple(r) for r in k.join(k.select("key", F.col("form").alias("to")), "key").where("form < to").select("form", "to").distinct().collect()})
    assert ("karlos berger", "carlos berger") in near[0] | {(b, a) for a, b in near[0]}
    assert near[0] == near[1] == near[2] and meet[0] == meet[1] == meet[2] and len(meet[0]) > 10_000


def test_bound_on_similarity_leaves_out_no_pair(spark):
    rng = random.Random(9)
    made = lambda: "".join(rng.choice("abcdeé'я") for _ in range(rng.randrange(0, 8)))
    rows = []
    for _ in range(4000):
        x = made()
        y = made() if rng.random() < 0.3 else "".join(rng.sample(x, len(x))) if rng.random() < 0.3 else x[: rng.randrange(8)] + rng.choice(["", "a", "я"]) + x[rng.randrange(1, 8) :]
        rows.append((x, y, names.letters(x), names.letters(y), names.jaro_winkler(x, y)))
    df = spark.createDataFrame(rows, "x string, y string, in_x bigint, in_y bigint, s double").withColumn("most", F.expr(names._most("x", "y", "in_x", "in_y")))
    assert df.where("most < s - 1e-9 or most is null").collect() == [] and df.where("most < 0.84").count() > 500


def test_a_shared_mailbox_links_nobody(spark):
    rows = [(1, "Ann Lee", "crew@x.example"), (2, "Bob Moss", "crew@x.example"), (3, "Cy Nord", "crew@x.example")]
    got = {r.contributor for r in names.contributors(spark.createDataFrame(rows, "identity_id bigint, author string, email string")).collect()}
    assert got == {1, 2, 3}


def test_empty(spark):
    assert names.contributors(spark.createDataFrame([], "identity_id bigint, author string, email string")).collect() == []


def test_kernels():
    assert abs(names.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5 and names.jaro_winkler("a", "") == 0 and names.jaro_winkler("dixon", "dicksonx") > 0.81
    assert names.fold("  Łukasz  TIDAWÄ ") == "lukasz tidawa"
    assert names.phonetic("robert") == names.phonetic("rupert")
    assert names.read_email("16741+a.b@noreply.forge.example") == (None, "a.b", "noreply.forge.example")
    assert names.read_email("ci@x.example")[0] is None and names.read_email("(none)") == (None, None, None)
