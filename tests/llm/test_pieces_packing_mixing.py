"""Splitting, packing and mixing: invariants, exact round trips, edge cases."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspan.llm.mixing import min_cost_flow, plan_mixes, reached, select_documents
from reelspan.llm.packing import containers, pack, usage
from reelspan.llm.pieces import split_oversized, split_text

PARTS = st.lists(st.sampled_from(["Hello there. ", "word ", "Ünï ", "漢字。", "x" * 40, "\n", "\n\n", "End!\n", " ", "😀"]), min_size=1, max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(PARTS, st.integers(8, 90), st.integers(0, 30))
def test_pieces_are_a_round_trip(text, most, overlap):
    pieces = split_text(text, most, overlap)
    assert "".join(text[own:end] for _, own, end in pieces) == text
    want = min(overlap, (most - 4) // 2)
    for n, (first, own, end) in enumerate(pieces):
        assert len(text[first:end].encode()) <= most and own < end
        shared = len(text[first:own].encode())
        assert shared <= want
        if n:
            # the overlap is as long as whole characters allow, or the whole piece before
            assert first == pieces[n - 1][0] or shared + len(text[first - 1].encode()) > want


def test_cuts_are_at_natural_ends():
    text = "One two three. Four five six.\nSeven eight nine. Ten eleven.\n\nTwelve thirteen fourteen. Fifteen."
    assert [text[a:b] for _, a, b in split_text(text, 64, 0)] == ["One two three. Four five six.\nSeven eight nine. Ten eleven.\n\n", "Twelve thirteen fourteen. Fifteen."]
    with pytest.raises(ValueError):
        split_text("x", 3, 0)


def test_split_operator(spark):
    docs = spark.createDataFrame([(1, "a b c. " * 40, " SRC "), (2, "short", "src"), (3, None, "src"), (4, "", "src"), (5, "z" * 999, None), (6, "é" * 200_000, "src"), (6, "x" * 101, "src")], "doc_id long, text string, source string")
    limits = spark.createDataFrame([("src", 100, 10), ("Src", 120, 0), ("none", None, None)], "source string, max_tokens int, overlap_tokens int")
    rows = split_oversized(docs, limits).collect()
    assert {r.doc_id for r in rows} == {1, 6} and all(r.size_tokens <= 100 for r in rows)
    assert sum(r.size_tokens - r.overlap_size for r in rows if r.doc_id == 6) == 400_101
    assert split_oversized(docs.limit(0), limits).count() == 0 and split_oversized(docs, limits.limit(0)).count() == 0


def test_packing_fills_and_never_overflows():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5, 1.2, 4000).astype(np.int64), 2048)
    k = pack(sizes, 2048)
    used = np.bincount(k, weights=sizes)
    assert used.max() <= 2048 and sizes.sum() / (2048 * len(used)) > 0.98
    assert list(pack(np.array([], np.int64), 10)) == [] and set(pack(np.array([0, 0]), 10)) == {0}


def test_every_document_is_assigned_once(spark):
    rng = random.Random(2)
    sizes = [0, 100, 101, 250, 300] + [rng.randint(0, 100) for _ in range(500)]
    docs = spark.createDataFrame([(i, "a" * s, "x") for i, s in enumerate(sizes)] + [(900, None, "x")], "doc_id long, text string, container_kind string")
    kinds = spark.createDataFrame([("k", 100), ("k", 100), ("big", 1000), ("bad", 0), ("bad", None)], "container_kind string, capacity_tokens int")
    rows = containers(docs, kinds, shard_items=100).collect()
    for kind, cap in (("k", 100), ("big", 1000)):
        mine = [r for r in rows if r.container_kind == kind]
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.size_tokens
        assert max(fill.values()) <= cap
        for i, s in enumerate(sizes):
            pieces = sorted((r.start_token, r.size_tokens) for r in mine if r.doc_id == i)
            assert sum(p[1] for p in pieces) == s and len(pieces) == (1 if s <= cap else -(-s // cap))
        assert sum(r.doc_id == 900 for r in mine) == 1
    assert usage(containers(docs, kinds), kinds).count() == 2
    assert containers(docs.limit(0), kinds).count() == 0 and containers(docs, kinds.limit(0)).count() == 0


def test_flow_of_overlapping_sources():
    # the documents of both sources go where they are needed, and nothing is repeated before all of it is used
    f = min_cost_flow([100, 50, 80], [[0], [0, 1], [1]], [Fraction(120), Fraction(110)], [3, 3])
    assert sum(v for (_, j), v in f.items() if j == 0) == 120 and sum(v for (_, j), v in f.items() if j == 1) == 110
    assert sum(v for (i, _), v in f.items() if i == 1) == 50
    f = min_cost_flow([10], [[0]], [Fraction(100)], [4])
    assert f == {(0, 0): 40}
    assert min_cost_flow([], [], [Fraction(1)], [1]) == {}


def test_flow_is_the_cheapest_of_the_largest():
    from itertools import product

    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 2)
        sizes, repeats = [rng.randint(1, 2) for _ in range(n)], [rng.randint(0, 2) for _ in range(m)]
        member = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)]
        quotas = [rng.randint(0, 5) for _ in range(m)]
        edges = [(i, j) for i in range(n) for j in member[i]]

        def value(f, edges=edges, sizes=sizes, n=n):
            per = [sum(x for (i, _), x in zip(edges, f) if i == p) for p in range(n)]
            return sum(f), -sum(t // s * (t // s - 1) // 2 * s + t % s * (t // s) for t, s in zip(per, sizes))

        best = max(value(f) for f in product(*[range(sizes[i] * repeats[j] + 1) for i, j in edges]) if all(sum(x for (_, b), x in zip(edges, f) if b == j) <= quotas[j] for j in range(m)))
        got = min_cost_flow(sizes, member, [Fraction(q) for q in quotas], repeats)
        assert value([got.get(e, 0) for e in edges]) == best


def test_ten_thousand_patterns_take_seconds():
    import time

    rng = random.Random(6)
    sizes = [rng.randint(1, 10**6) for _ in range(10_000)]
    member = [sorted(rng.sample(range(16), rng.randint(1, 5))) for _ in sizes]
    quotas = [Fraction(0.3 * rng.random()) * sum(sizes) for _ in range(16)]
    began = time.time()
    flow = min_cost_flow(sizes, member, quotas, [3] * 16)
    assert time.time() - began < 30 and all(sum(v for (_, b), v in flow.items() if b == j) <= q for j, q in enumerate(quotas))


def test_repeated_and_differently_spelled_targets_are_one(spark):
    docs = spark.createDataFrame([(1, 100, ["a"]), (2, 100, ["none"])], "doc_id long, size long, sources array<string>")
    targets = spark.createDataFrame([("m", "A ", 0.2, 1, 1.0), ("m", "a", 0.5, 2, 1.0), ("m", None, 0.5, 1, 1.0)], "mix_id string, source string, target_share double, max_repeats int, size_factor double")
    rows = {r.source: (r.quota, r.flow_size, r.out_of_reach) for r in plan_mixes(docs, targets).where("pattern IS NULL").collect()}
    assert rows == {"a": (100.0, 100.0, False), None: (100.0, 0.0, True)}


def test_mix_comes_near_its_shares(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 900), ["a"] if i % 3 else ["a", "b"]) for i in range(3000)] + [(9000 + i, 100, ["c"]) for i in range(10)] + [(9999, 70, None), (9998, None, [])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, size long, sources array<string>, h int")
    total = sum(r[1] or 0 for r in rows)
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 0.4), ("m", " B ", 0.4, 2, 0.4), ("m", "c", 0.1, 3, 0.4), ("n", "d", 1.0, 5, 0.1)], "mix_id string, source string, target_share double, max_repeats int, size_factor double")
    plan = plan_mixes(docs, targets)
    picked = select_documents(docs, plan)
    got = {(r.mix_id, r.source.strip().lower()): r for r in reached(picked, plan).collect()}
    for s, share in (("a", 0.5), ("b", 0.4)):
        assert abs(got["m", s].got - share * 0.4 * total) <= 2 * 900 and not got["m", s].out_of_reach
    assert got["m", "c"].out_of_reach and got["m", "c"].got == 3 * 1000 and got["m", "c"].most_repeats == 3
    assert got["n", "d"].out_of_reach and got["n", "d"].got == 0
    assert sorted((r.mix_id, r.doc_id, r.repeats) for r in picked.collect()) == sorted((r.mix_id, r.doc_id, r.repeats) for r in select_documents(docs.repartition(7), plan).collect())
    assert select_documents(docs.limit(0), plan_mixes(docs.limit(0), targets)).count() == 0
    assert plan_mixes(docs, targets.limit(0)).count() == 0


def test_overlaps_over_half_of_the_limit_are_kept(spark):
    text = "One two three. Four five six. " * 20 + "漢字。" * 30
    docs = spark.createDataFrame([(1, text, "src")], "doc_id long, text string, source string")
    limits = "source string, max_tokens int, overlap_tokens int"
    for overlap in (70, 96):
        rows = sorted(split_oversized(docs, spark.createDataFrame([("src", 100, overlap)], limits)).collect(), key=lambda r: r.piece_no)
        assert all(r.size_tokens <= 100 for r in rows) and "".join(text[r.own_start_char : r.end_char] for r in rows) == text
        assert all(r.overlap_size > overlap - 4 or r.start_char == p.start_char for p, r in zip(rows, rows[1:])) and any(r.overlap_size > 48 for r in rows)
    with pytest.raises(Exception, match="leaves no room"):
        split_oversized(docs, spark.createDataFrame([("src", 100, 97)], limits)).collect()
