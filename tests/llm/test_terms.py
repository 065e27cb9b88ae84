"""Term totals: against a counter, under spilling, with nulls, long texts and hot terms."""

import random
from collections import Counter

from pyspark.sql import functions as F

from reelspan.llm.terms import banded, labels_of, term_totals, words_of


def test_spilling_gives_what_a_counter_gives(spark):
    rng = random.Random(1)
    rows = [("f" if i % 3 else "g", [f"t{int(rng.expovariate(1 / 3000))}" for _ in range(rng.randint(0, 12))] + ["hot"] * (i % 2)) for i in range(6000)]
    occ, rec = Counter(), Counter()
    for f, ts in rows:
        for t in ts:
            occ[f, t] += 1
        for t in set(ts):
            rec[f, t] += 1
    df = spark.createDataFrame([(f, t, 1) for f, t in rows], "field_name string, terms array<string>, term int").repartition(6)
    for memory in (64, 0.01):  # in memory; in many rounds on disk
        got = {(r.field_name, r.term): (r.occurrences, r.records) for r in term_totals(df, memory_mb=memory, combine_rows=500).collect()}
        assert got == {k: (occ[k], rec[k]) for k in occ}


def test_terms_of_texts(spark):
    df = spark.createDataFrame([("İzmir K2 don't ÉTÉ_x", [" Rain  on\tGlass ", None, "", "  ", "RAIN on glass"]), (None, None), ("", [])], "s string, a array<string>")
    rows = df.select(words_of(F.col("s")).alias("w"), labels_of(F.col("a")).alias("l")).collect()
    assert rows[0].w == ["zmir", "k2", "don", "t", "t", "x"] and rows[0].l == ["rain on glass", "rain on glass"]
    assert rows[1].w == [] and rows[1].l == [] and rows[2].w == [] and rows[2].l == []


def test_null_arrays_long_texts_and_bands(spark):
    df = spark.createDataFrame([("f", None), ("f", []), ("f", ["a"] * 50_000 + ["b"])], "field_name string, terms array<string>")
    got = {r.term: (r.occurrences, r.records) for r in term_totals(df).collect()}
    assert got == {"a": (50_000, 1), "b": (1, 1)}
    assert term_totals(df.limit(0)).count() == 0
    totals = spark.createDataFrame([("x", 2), ("y", 3), ("z", 11)], "term string, records int")
    n = spark.createDataFrame([(100,)], "n int")
    assert {r.term: r.band for r in banded(totals, n).collect()} == {"x": "rare", "y": None, "z": "common"}
