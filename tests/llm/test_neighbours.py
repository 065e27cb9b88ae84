"""The neighbour index: recall against brute force, copies, unusable vectors, small tables."""

import tracemalloc

import numpy as np
import pytest

from reelspan.llm.neighbours import IndexParams, Lists, codebooks, encode, kmeans, nearest

DDL = "id int, v array<float>, vec string, neighbour int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x", 0) for i, v in rows], DDL)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 32))).astype(np.float32) * rng.uniform(0.2, 5, (1500, 1)).astype(np.float32)
    got = {}
    for r in nearest(frame(spark, list(enumerate(x)) + list(enumerate(x[:30]))), "id", "v").collect():
        got.setdefault(r.id, {})[r.neighbour] = r.cosine
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    hits = 0
    for i in range(0, 1500, 50):
        best = np.argsort(-sims[i])[:5]
        assert len(got[i]) == 5 and i not in got[i]
        hits += len(set(best) & set(got[i]))
        for n, c in got[i].items():
            assert abs(c - sims[i, n]) < 1e-5
    assert hits / (5 * 30) >= 0.9


def test_a_third_of_copies_stands_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1, 2, 3, 4] if i % 3 == 0 else rng.normal(size=4)) for i in range(900)]
    p = IndexParams(heavy_share=0.1, heavy_least=20)
    got = {}
    for r in nearest(frame(spark, rows), "id", "v", params=p).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.cosine))
    assert len(got) == 900
    for i in range(0, 900, 3):
        assert len(got[i]) == 5 and all(n % 3 == 0 and n != i and c > 0.999 for n, c in got[i])


def test_unusable_vectors_and_small_tables(spark):
    rows = [(1, [1, 0]), (2, [0, 0]), (3, None), (4, [float("nan"), 1]), (5, [2, 0.1]), (6, [-1, 0]), (None, [1, 1])]
    got = {(r.id, r.neighbour) for r in nearest(frame(spark, rows), "id", "v").collect()}
    assert got == {(1, 5), (1, 6), (5, 1), (5, 6), (6, 1), (6, 5)}
    assert nearest(frame(spark, rows[:1]), "id", "v").count() == 0
    assert nearest(frame(spark, rows[1:4]), "id", "v").count() == 0
    assert nearest(frame(spark, []), "id", "v").count() == 0


def test_codes_are_the_nearest_codewords():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 10)).astype(np.float32)
    cents, p = kmeans(x, 8, 4, rng), IndexParams(subspaces=4)
    rest = x - cents[((x[:, None] - cents[None]) ** 2).sum(2).argmin(1)]
    books = codebooks(rest, p)
    padded = np.pad(rest, ((0, 0), (0, 2))).reshape(600, 4, 3)
    codes = encode(rest, books)
    for m in range(4):
        dist = ((padded[:, m, None] - books[m][None]) ** 2).sum(2)
        assert np.allclose(dist[np.arange(600), codes[:, m]], dist.min(1), atol=1e-4)


def test_another_width_in_any_partitioning_takes_nothing_from_the_usual_one(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16)) for i in range(300)] + [(1000 + i, rng.normal(size=9)) for i in range(100)]
    for order in (rows, rows[250:] + rows[:250]):
        for parts in (1, 3):
            got = {r.id for r in nearest(frame(spark, order).coalesce(parts), "id", "v").collect()}
            assert got == set(range(300))


@pytest.mark.parametrize("params", [{"part_rows": 60}, {"part_rows": 10**9}])
def test_lists_of_nearly_equal_vectors_are_divided_or_searched_in_blocks(spark, params):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[::2] = x[0] + 1e-4 * rng.normal(size=(600, 16))
    x[3::6] = x[3] + 0.3 * rng.normal(size=(200, 16))
    got = {}
    for r in nearest(frame(spark, list(enumerate(x))), "id", "v", params=IndexParams(list_most=100, **params)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert set(got) == set(range(1200)) and all(len(set(v)) == 5 for v in got.values())
    for i in range(0, 1200, 50):  # of the nearly equal ones, any of what is as near to within single precision
        sims = unit @ unit[i]
        sims[i] = -2
        assert (sims[got[i]] >= np.sort(sims)[-5] - 1e-7).all()


def test_an_id_with_a_third_of_all_rows_counts_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8)) for i in range(60)] + [(7, [1.0] * 8)] * 200
    got = {}
    for r in nearest(frame(spark, rows), "id", "v").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(range(60)) and all(len(set(v)) == 5 for v in got.values())


@pytest.mark.parametrize("lists", [2000, 8000])
def test_the_lists_of_a_whole_batch_are_found_in_bounded_memory(lists):
    rng = np.random.default_rng(9)
    x, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(n, 16)).astype(np.float32) for n in (10_000, lists)))
    of = Lists.of(c, np.ones(lists, np.float32))
    tracemalloc.start()
    row, at, own = of.nearest(x, IndexParams(margin=0.02))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 100  # MB; at 6 GB of vectors two workers share 900 MB beside their executor's heap
    for i in range(0, 10_000, 500):
        sims = c @ x[i]
        best = [j for j in np.argsort(-sims)[:8] if sims[j] >= sims.max() - 0.02]
        assert set(at[row == i]) == set(best) and at[(row == i) & own].tolist() == best[:1]


def test_a_batch_of_many_pieces_gives_each_id_once_and_the_pairs_of_its_first_rows(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(5000, 8)).astype(np.float32)
    rows = list(enumerate(x)) + list(enumerate(x[:2000])) + [(10_000, None), (10_001, [float("nan")] * 8)]
    got = {}
    for r in nearest(frame(spark, rows).coalesce(1), "id", "v").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(range(5000)) and all(len(set(v)) == len(v) == 5 and i not in v for i, v in got.items())


def test_divided_lists_take_few_copies_and_all_near_vectors():
    rng = np.random.default_rng(11)
    unit = lambda v: (v / np.linalg.norm(v, axis=-1, keepdims=True)).astype(np.float32)
    coarse = unit(rng.normal(size=(20, 32)))
    parts = rng.normal(scale=0.15, size=(20, 20, 32)).astype(np.float32)
    of = Lists(coarse, np.ones(420, np.float32), np.arange(0, 401, 20), parts.reshape(-1, 32))
    x = unit((coarse[:, None] + parts).reshape(-1, 32)[np.repeat(np.arange(400), 10)] + 0.08 * rng.normal(size=(4000, 32)))
    row, at, own = of.nearest(x, IndexParams())
    assert own.sum() == 4000 and len(set(zip(row.tolist(), at.tolist()))) == len(row) and (at >= 20).all()
    assert np.bincount(row).max() <= 8
    home = np.empty(4000, np.int64)
    home[row[own]] = at[own]
    stands = set(zip(row.tolist(), at.tolist()))
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    close = np.argwhere(sims >= 0.9)
    assert len(close) and np.mean([(b, home[a]) in stands for a, b in close.tolist()]) > 0.97
