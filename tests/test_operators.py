"""Operators against plain sequential versions, on random and on edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.operators import intervals, islands, prefix, timeline
from reelspan.session import once


def test_running_total_of_skewed_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 40), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, n int")
    got = {r.i: (r.total_before, r.group_total) for r in prefix.running_total(df, ["g"], "o", "n", ties=["i"]).collect()}
    for g in ("hot", "a", None):
        before, mine = 0, sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        for r in mine:
            assert got[r[2]] == (before, sum(x[3] for x in mine))
            before += r[3]
    assert prefix.running_total(df.limit(0), ["g"], "o", "n").count() == 0


def sequential_merge(spans, gap):
    out = []
    for s, e, i, score in sorted(spans):
        if out and s - out[-1]["e"] <= gap:
            cur = out[-1]
            cur["e"], cur["n"] = max(cur["e"], e), cur["n"] + 1
            if score > cur["score"]:
                cur["score"], cur["i"] = score, i
        else:
            out.append({"s": s, "e": e, "i": i, "score": score, "n": 1})
    return sorted((c["s"], c["e"], c["i"], c["score"], c["n"]) for c in out)


def test_merge_spans_is_the_sequential_merge(spark):
    rng = random.Random(2)
    rows = []
    for g in ("q1", "q2", "q3"):
        for i in range(400 if g == "q1" else 30):
            s = round(rng.uniform(0, 9000 if g == "q1" else 600), 1)
            rows.append((g, s, s + rng.randint(0, 30), i, rng.choice([0.1, 0.5, 0.9])))
    df = spark.createDataFrame(rows, "g string, s double, e double, i int, score double")
    got = islands.merge_spans(df, ["g"], "s", "e", "score", ["i"], 20.0).collect()
    for g in ("q1", "q2", "q3"):
        assert sorted((r.s, r.e, r.i, r.score, r.merged) for r in got if r.g == g) == sequential_merge([r[1:] for r in rows if r[0] == g], 20.0)


@pytest.mark.parametrize(("spans", "want"), [([(0, 10), (30, 40)], [(0, 40)]), ([(0, 10), (30.1, 40)], [(0, 10), (30.1, 40)]), ([(0, 100), (10, 20), (115, 120)], [(0, 120)])])
def test_merge_gap_is_inclusive(spark, spans, want):
    df = spark.createDataFrame([("q", float(s), float(e), i, 0.5) for i, (s, e) in enumerate(spans)], "g string, s double, e double, i int, score double")
    assert sorted((r.s, r.e) for r in islands.merge_spans(df, ["g"], "s", "e", "score", ["i"], 20.0).collect()) == want


def test_merge_spans_of_nulls_and_none(spark):
    df = spark.createDataFrame([("q", None, 1.0, 0, None), ("q", 0.0, 1.0, 1, float("nan")), ("q", 0.5, 2.0, 2, None)], "g string, s double, e double, i int, score double")
    assert sorted((r.i, r.merged) for r in islands.merge_spans(df, ["g"], "s", "e", "score", ["i"]).collect()) == [(0, 1), (1, 2)]
    assert islands.merge_spans(df.limit(0), ["g"], "s", "e", "score", ["i"]).count() == 0
    assert islands.merge_spans(df, ["g"], "s", "e", "score", ["i"], 0).count() == 3


def random_timeline(seed):
    rng = random.Random(seed)
    spans = [(v, i, round(s, 1), round(s + rng.uniform(0, 200), 1)) for v in ("a", "b") for i, s in enumerate(rng.uniform(0, 900) for _ in range(40))]
    lines = [(v, i, round(s, 1), round(s + rng.uniform(0, 90), 1), rng.choice(["the red scarf", "old Radio!", "nothing"])) for v in ("a", "b") for i, s in enumerate(sorted(rng.uniform(0, 900) for _ in range(120)))]
    return spans, lines


def test_overlap_join_and_ordered_concat(spark):
    spans, lines = random_timeline(3)
    a = spark.createDataFrame(spans, "video string, id int, s double, e double")
    b = spark.createDataFrame(lines, "video string, line_no int, ls double, le double, line string")
    want = sorted((v, i, n) for v, i, s, e in spans for w, n, ls, le, _ in lines if v == w and le >= s and ls <= e)
    assert sorted((r.video, r.id, r.line_no) for r in intervals.overlap_join(a, b).collect()) == want
    texts = {(r.video, r.id): r.line_text for r in intervals.concat_lines(a, ["video", "id"], b).collect()}
    for v, i, s, e in spans:
        assert texts[v, i] == " ".join(x[4] for x in lines if x[0] == v and x[3] >= s and x[2] <= e)
    touching = intervals.overlap_join(spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 3.0), ("a", None, 3.0)], "video string, s double, e double"), spark.createDataFrame([("a", 1.0, 2.0)], "video string, ls double, le double"))
    assert touching.count() == 2


def test_snap_and_widen(spark):
    spans, lines = random_timeline(4)
    a = spark.createDataFrame([(*x, "Who sold the old radio?") for x in spans], "video string, id int, s double, e double, q string")
    b = spark.createDataFrame(lines, "video string, line_no int, ls double, le double, line string")
    snapped = {(r.video, r.id): (r.s, r.e) for r in intervals.snap(a, ["video", "id"], b, 3.0).collect()}
    widened = {(r.video, r.id): (r.s, r.e) for r in intervals.widen_by_keywords(a, ["video", "id"], "q", b, 8.0).collect()}
    for v, i, s, e in spans:
        mine = [x for x in lines if x[0] == v]
        lo = min([s, *(x[2] for x in mine if abs(x[2] - s) <= 3.0 and x[3] <= e + 3.0)])
        hi = max([e, *(x[3] for x in mine if abs(x[3] - e) <= 3.0 and x[2] >= s - 3.0)])
        assert snapped[v, i] == (lo, hi)
        near = [x for x in mine if x[3] >= s - 8 and x[2] <= e + 8 and ("old" in x[4].lower() or "radio" in x[4].lower())]
        assert widened[v, i] == (min([s, *(x[2] for x in near)]), max([e, *(x[3] for x in near)]))


def test_bins(spark):
    df = spark.createDataFrame([(0, 0.0, 3.0), (1, 2.0, 2.0), (2, 5.0, 1.0)], "c int, lo double, hi double")
    rows = timeline.sliding_bins(df).orderBy("i").collect()
    assert [(r.b_s, r.b_e) for r in rows] == [(0, 2), (0.5, 2.5), (1, 3), (1.5, 3), (2, 3), (2.5, 3)]
    times = df.select(timeline.frame_times(F.lit(0.0), F.lit(1.0), 3).alias("t"), timeline.frame_times(F.lit(0.0), F.lit(1.0), 1).alias("u")).first()
    assert times.t == pytest.approx([0.15, 0.5, 0.85]) and times.u == pytest.approx([0.15])


@pytest.mark.parametrize("window", [3, 4, 5, 6])
def test_smoothing_is_the_zero_padded_convolution(spark, window):
    rng = np.random.default_rng(window)
    curves = {c: rng.random(n) for c, n in (("a", 50), ("b", window), ("c", window - 1))}
    df = spark.createDataFrame([(c, i, float(x)) for c, v in curves.items() for i, x in enumerate(v)], "c string, i int, x double")
    got = {(r.c, r.i): r.smoothed for r in timeline.smooth(df, ["c"], "i", "x", window).collect()}
    for c, v in curves.items():
        want = np.convolve(v, np.ones(window) / window, mode="same") if len(v) >= window else v
        assert [got[c, i] for i in range(len(v))] == pytest.approx(list(want))


def test_peaks_grow_as_a_walk_does(spark):
    rng = np.random.default_rng(5)
    curves = [np.round(rng.random(rng.integers(1, 30)) * rng.choice([0.2, 1.0]), 2) for _ in range(40)]
    df = spark.createDataFrame([(c, i, float(x), i * 0.5, i * 0.5 + 2) for c, v in enumerate(curves) for i, x in enumerate(v)], "c int, i int, x double, b double, e double")
    got = {r.c: (r.peak_at, r.left_at, r.right_at, r.s, r.e) for r in timeline.expand_peaks(df, ["c"], "i", "x", "b", "e").collect()}
    for c, v in enumerate(curves):
        p = int(np.argmax(v))
        thr = max(0.25, 0.5 * v[p])
        left = right = p
        while left > 0 and v[left - 1] >= thr:
            left -= 1
        while right < len(v) - 1 and v[right + 1] >= thr:
            right += 1
        assert got[c] == (p, left, right, left * 0.5, right * 0.5 + 2)


def test_scene_bounds_and_numbers(spark):
    df = spark.createDataFrame([("v", i, float(i), x) for i, x in enumerate([99.0, 1.0, 30.0, 27.0, 28.0])], "video string, i int, t double, x double")
    assert [(r.scene_id, r.s, r.e) for r in timeline.scene_bounds(df, "video", "i", "t", "x").orderBy("scene_id").collect()] == [(0, 0, 2), (1, 2, 4), (2, 4, 4)]
    assert [r.number for r in timeline.number_scenes(df, "video", "i").orderBy("i").collect()] == [0, 1, 2, 3, 4]


def test_names_match_exactly_first_then_by_containment(spark):
    v = spark.createDataFrame([("Show_One.s01",), ("Other",), ("Lost",), (None,), ("",)], "name string")
    f = spark.createDataFrame([("showone s01 extra", "b.srt"), ("Other", "z.srt"), ("oth", "a.srt"), ("", "e.srt")], "name string, path string")
    assert {r.name: r.path for r in intervals.match_names(v, f).collect()} == {"Show_One.s01": "b.srt", "Other": "z.srt", "Lost": None, None: None, "": "e.srt"}


def test_once_keeps_the_first_delivery(spark):
    df = spark.createDataFrame([("a", 1, "x", 5), ("a", 1, "x", 3), ("b", None, "y", None), ("b", None, "y", 1)], "k string, i int, t string, ingested_at int")
    assert sorted((r.k, r.ingested_at) for r in once(df, ["k", "i"]).collect()) == [("a", 3), ("b", 1)]


def test_large_groups_are_cut_into_ranges(spark):
    rng = random.Random(9)
    rows = [("hot", i, rng.choice([1.0, 1.0, rng.random()]), rng.randint(0, 5)) for i in range(800)] + [("few", i, rng.random(), 1) for i in range(7)] + [(None, 1, 0.5, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, x double, n int").repartition(5)
    got = {(r.g, r.i): (r.total_before, r.group_total) for r in prefix.running_total(df, ["g"], "x", "n", ["i"], most=50).collect()}
    for g in ("hot", "few", None):
        total = 0
        for _, i, n in sorted((x, i, n) for h, i, x, n in rows if h == g):
            assert got[g, i] == (total, sum(n for h, _, _, n in rows if h == g))
            total += n
    number = {(r.g, r.i): r.number for r in timeline.number_scenes(df, "g", "i", most=50).collect()}
    assert all(number["hot", i] == i for i in range(800))
    a, b = [{(r.g, r.i): round(r.smoothed, 9) for r in timeline.smooth(df, ["g"], "i", "x", most=m).collect()} for m in (50, 10_000)]
    assert a == b
    for most in (50, 10_000):
        p = {(r.g, r.i): r.pause for r in timeline.pauses(df.withColumn("e", F.col("x") + 1), "g", "i", "x", "e", most=most).collect()}
        at = {(g, i): x for g, i, x, _ in rows}
        assert p["hot", 0] == 0 and all(abs(p["hot", i] - (at["hot", i] - at["hot", i - 1] - 1)) < 1e-9 for i in range(1, 800))
        s = timeline.scene_bounds(df, "g", "i", "x", "x", 0.9, most=most).where("g = 'hot'").orderBy("scene_id").collect()
        cuts = [i for i in range(1, 800) if at["hot", i] > 0.9]
        assert len(s) == len(cuts) + 1 and [r.scene_id for r in s] == list(range(len(s)))


def test_islands_of_large_groups(spark):
    rng = random.Random(10)
    rows = [(g, i, float(s), float(s + rng.randint(0, 30)), rng.random()) for g, n in (("hot", 500), ("few", 5)) for i, s in enumerate(rng.randint(0, 20_000) for _ in range(n))]
    df = spark.createDataFrame(rows, "g string, i int, s double, e double, x double")
    a, b = [sorted(map(tuple, islands.mark_islands(df, ["g"], "s", "e", ["i"], 20.0, most=m).select("g", "i", "island").collect())) for m in (50, 10_000)]
    assert a == b


def test_repeated_keys_are_found_by_their_keys_alone(spark):
    rows = [(f"v{i % 40}", i // 40, "t" * 50, i) for i in range(2000)] + [(None, 1, "x", 5), (None, 1, "x", 4)] + [("v1", 3, "t" * 50, 9000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "v string, k int, text string, ingested_at int").repartition(4)
    for most in (4_000_000, 0):
        got = once(df, ["v", "k"], most=most).collect()
        assert len(got) == 2001 and {(r.v, r.k) for r in got if r.ingested_at >= 9000} == set() and [r.ingested_at for r in got if r.v is None] == [4]
    assert once(df.limit(0), ["v", "k"]).count() == 0
    plan = once(df, ["v", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
