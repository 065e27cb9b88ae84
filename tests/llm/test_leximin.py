"""Leximin ranking: against a plain version, ties, nulls, flat scores, groups of all sizes."""

import math
import random

from reelspan.llm.leximin import STEPS, leximin_rank, top_of_each

S = ["a", "b", "c"]
DDL = "g int, k int, a double, b double, c double, rank_pos int, _g string, p int"


def plain(rows):
    ok = lambda x: x is not None and not math.isnan(x)
    out = {}
    for g in {r[0] for r in rows}:
        mine = list({r[1]: r for r in rows if r[0] == g}.values())
        vecs = {}
        for r in mine:
            pct = []
            for j in range(2, 5):
                vals = [x[j] for x in mine if ok(x[j])]
                if len(set(vals)) == 1:
                    pct.append(STEPS // 2)
                elif ok(r[j]):
                    pct.append(min(STEPS - 1, math.floor((sum(v < r[j] for v in vals) + vals.count(r[j]) / 2) / len(vals) * STEPS)))
                else:
                    pct.append(None)
            known = [p for p in pct if p is not None]
            fill = sum(known) // len(known) if known else STEPS // 2
            vecs[r[1]] = sorted(fill if p is None else p for p in pct)
        for place, k in enumerate(sorted(vecs, key=lambda k: ([-x for x in vecs[k]], k)), 1):
            out[g, k] = place
    return out


def test_against_a_plain_version(spark):
    rng = random.Random(1)
    val = lambda: rng.choice([None, float("nan"), rng.gauss(0, 1e6), rng.randint(0, 3) * 1.0, -0.0])
    rows = [(g, k, val(), val(), 7.0 if g == 2 else val(), 0, "x", 1) for g, n in ((1, 700), (2, 40), (3, 1)) for k in range(n)]
    rows += rows[:50]  # repeated rows
    got = {(r.g, r.k): r.rank_pos for r in leximin_rank(spark.createDataFrame(rows, DDL), "g", ["k"], S).collect()}
    assert got == plain(rows)


def test_large_groups_with_many_ties_and_missing_scores_are_ranked_by_ranges(spark):
    rng = random.Random(2)
    val = lambda: rng.choice([None, 1.0, 1.0, rng.gauss(0, 1)])
    rows = [(1, k, 0.5 if k % 3 else val(), None if k % 3 else val(), 7.0, 0, "x", 1) for k in range(900)] + [(g, k, val(), val(), val(), 0, "x", 1) for g in (2, 3) for k in range(20)]
    rows += rows[:40]
    got = {(r.g, r.k): r.rank_pos for r in leximin_rank(spark.createDataFrame(rows, DDL), "g", ["k"], S, most=100).collect()}
    assert got == plain(rows)


def test_scale_does_not_matter(spark):
    rows = [(1, k, float(k), 1e9 * (10 - k), None) for k in range(11)]
    small = [(g, k, a, b / 1e12, c) for g, k, a, b, c in rows]
    rank = lambda x: {r.k: r.rank_pos for r in leximin_rank(spark.createDataFrame(x, "g int, k int, a double, b double, c double"), "g", ["k"], S).collect()}
    assert rank(rows) == rank(small) and rank(rows)[5] == 1


def test_no_rows_null_groups_and_limits(spark):
    ddl = "g int, k int, a double, b double, c double"
    assert leximin_rank(spark.createDataFrame([], ddl), "g", ["k"], S).count() == 0
    r = leximin_rank(spark.createDataFrame([(None, 1, None, None, None), (None, 2, 1.0, None, None), (1, None, 1.0, 1.0, 1.0)], ddl), "g", ["k"], S)
    assert r.count() == 3
    want = spark.createDataFrame([(1, 1), (1, 5), (2, None)], "g int, n int")
    assert top_of_each(r, want, "g", "n").count() == 1
