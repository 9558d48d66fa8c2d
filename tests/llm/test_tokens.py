"""Encoding, mixing and splitting against the public library, exact round trips and exact sums."""

import base64
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelens.llm import bpe, encoding, mixing, splitting

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{bpe.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken", "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n", "<|endoftext|> x", "a\r\nb", "naïve – café ☕️ 漢字かな", "\x1c\x1d  x \x85 y\xa0z", "aaaa" * 400, "I'm 'S  \n\n x", "​﻿", "x" * 3000, "  " * 50]


def test_encode_equals_public_library(reference):
    enc, rng = bpe.encoder(), random.Random(1)
    for t in [*ODD, *("".join(rng.choice("ab cdé\n1'") for _ in range(400)) for _ in range(200))]:
        assert list(enc.encode(t)) == reference.encode_ordinary(t)
        assert enc.count(t) == len(reference.encode_ordinary(t))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_encode_any_text(text):
    enc = bpe.encoder()
    ids = list(enc.encode(text))
    back = {v: k for k, v in enc.ranks.items()} if not hasattr(enc, "back") else enc.back
    enc.back = back
    assert b"".join(back[i] for i in ids) == text.encode("utf-8", "surrogatepass")


def test_token_ids_of_rows(spark, reference):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None, ODD[3]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.token_ids(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert encoding.token_ids(df.limit(0)).collect() == []
    assert {r.doc_id: r.n_tokens for r in encoding.token_counts(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got.items()}


@pytest.mark.parametrize("limit,overlap", [(64, 8), (1024, 64), (16, 4)])
def test_pieces_round_trip(spark, reference, limit, overlap):
    rng = random.Random(2)
    words = ["alpha", "beta.", "gamma\n", "delta\n\n", "12", "é", "(x)"]
    texts = [*ODD, None, " ".join(rng.choice(words) for _ in range(4000)), "z9" * 5000, "".join(rng.choice("abcdef") for _ in range(9000)), "word " * 1025]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    by = defaultdict(list)
    for r in splitting.pieces(df, limit=limit, overlap=overlap).collect():
        by[r.doc_id].append(r)
    long = {i for i, t in enumerate(texts) if t and len(reference.encode_ordinary(t)) > limit}
    assert set(by) == long
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(rows[0].n_pieces)) and rows[0].overlap_chars == 0
        assert "".join(r.piece_text[r.overlap_chars :] for r in rows) == texts[i]
        for r in rows:
            assert len(reference.encode_ordinary(r.piece_text)) == r.n_tokens <= limit
            assert len(reference.encode_ordinary(r.piece_text[: r.overlap_chars])) <= overlap
            assert r.piece_text == texts[i][r.start : r.end]


def test_pieces_cut_at_blank_lines():
    enc = bpe.encoder()
    text = "\n\n".join(" ".join(["word"] * 50) + "." for _ in range(40))
    cuts = splitting.cut(enc, text, 256, 0)
    assert all(text[:e].endswith("\n\n") for _, e, _, _ in cuts[:-1])


def test_flow_prefers_thin_repetition():
    got = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": (0.5, 1), "b": (0.5, 3)}, 200)
    assert sum(v for (_, s), v in got.items() if s == "a") == 100 and sum(v for (_, s), v in got.items() if s == "b") == 100
    uses = defaultdict(int)
    for (p, _), v in got.items():
        uses[p] += v
    assert uses[("a",)] <= 100 and uses[("b",)] <= 30
    assert mixing.route({}, {"a": (1.0, 1)}) == {}


def test_mixture_shares_and_limits(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "zzz"]), rng.randrange(0, 9)) for i in range(6000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("none", 0.05, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int")
    mixed = mixing.mixture(df, targets)
    rows = mixed.collect()
    most = {"a": 1, "b": 2, "c": 3}
    assert all(0 < r.copies <= most[r.source] for r in rows) and len({(r.doc_id, r.source) for r in rows}) == len(rows)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s].actual_share - want / 0.95) < 0.01
    assert got["none"].tokens == 0
    assert mixing.mixture(df.limit(0), targets).collect() == []
    assert mixing.mixture(df, targets.limit(0)).collect() == []
    assert sorted(map(tuple, mixing.mixture(df.repartition(7), targets).collect())) == sorted(map(tuple, rows))


def test_mixture_of_overlapping_sources(spark):
    df = spark.createDataFrame([(i, (["a"], ["b"], ["a", "b"])[i % 3], 5) for i in range(3000)], "doc_id bigint, source array<string>, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r.actual_share for r in mixing.shares(mixing.mixture(df, targets), targets).collect()}
    assert abs(got["a"] - 0.5) < 0.01


def test_shares_meet_targets_with_documents_of_very_different_sizes(spark):
    """What a source misses is bounded by its smallest document, however long the others are."""
    rng = random.Random(11)
    docs = [(i, rng.choice("aab"), rng.choice([1, 2, 3, 5, 8, 40, 900, 7000])) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(df, targets).collect()
    tokens = {s: sum(r.copies * r.n_tokens for r in rows if r.source == s) for s in "ab"}
    assert all(r.copies <= {"a": 2, "b": 3}[r.source] for r in rows)
    assert abs(tokens["a"] - 0.3 * sum(tokens.values())) <= 2 and abs(tokens["b"] - 0.7 * sum(tokens.values())) <= 2
