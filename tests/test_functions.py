"""Scalar functions by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from reelspan.functions import scores, text, vectors
from reelspan.settings import load_settings, normalised, settings_from


def one(spark, col, **values):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<float>' if isinstance(v, list) else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(col.alias("r")).first()["r"]


def test_keyword_overlap_keeps_punctuation(spark):
    assert one(spark, text.kw_overlap(F.col("q"), F.col("t")), q="Chandler, Ross", t="chandler ross").asDict() == {"hits": 1, "frac": 0.5}
    assert one(spark, text.kw_ratio(text.content_words(F.col("q")), F.col("t")), q="Chandler, Ross", t="chandler ross") == 1.0
    assert one(spark, text.kw_ratio(text.content_words(F.col("q")), F.col("t")), q="a of", t="x") == 0.0
    assert one(spark, text.kw_overlap(F.col("q"), F.col("t")), q=None, t=None)["frac"] == 0.0


def test_classes_of_queries(spark):
    assert one(spark, text.classify_query(F.col("q")), q="friends discussing kissing in coffee shop") == "dialogue"
    assert one(spark, text.classify_query(F.col("q")), q="Chandler starts smoking") == "action"
    assert one(spark, text.classify_query(F.col("q")), q="Monica cooking for her parents and discussing restaurant work") == "mixed"
    assert one(spark, text.classify_query(F.col("q")), q="") == "mixed"


def test_characters_are_substrings_unless_whole_words(spark):
    assert one(spark, text.characters_in(F.col("q"), ["ross", "ben"]), q="walk across") == ["ross"]
    assert one(spark, text.characters_in(F.col("q"), ["ross"], whole_words=True), q="walk across") == []
    assert one(spark, text.character_match(F.col("q"), F.col("s"), ["ross", "joey"]), q="Ross and Joey", s="hi ROSS") == 0.5
    assert one(spark, text.character_match(F.col("q"), F.col("s"), []), q="Ross", s="x") == 0.0


@pytest.mark.parametrize(("s", "want"), [(125.5, "02:05.50"), (59.999, "00:60.00"), (0.125, "00:00.13"), (0.0, "00:00.00")])
def test_times(spark, s, want):
    assert one(spark, text.fmt_time(F.col("s")), s=s) == want


def test_texts(spark):
    assert one(spark, text.embed_text(F.col("t")), t="  ") == text.SILENT
    assert one(spark, text.embed_text(F.col("t")), t=None) == text.SILENT
    assert one(spark, text.clean_line(F.col("t")), t=" a\\Nb\nc ") == "a b c"
    assert one(spark, text.norm_text(F.col("t")), t="É, A--b") == "a b"
    assert one(spark, text.scene_path(F.lit("out"), "frames", F.col("v"), F.lit("3")), v="Show 1.mkv") == "out/frames/Show 1/3"


def test_scores(spark):
    assert one(spark, text.keyword_bonus(F.lit(1.0), F.lit(5))) == 0.05
    for raw, want in ((0.05, 0.0), (0.40, 0.5), (0.90, 1.0)):
        assert one(spark, scores.calibrate(F.lit(raw))) == pytest.approx(want)
    with pytest.raises(ValueError):
        scores.calibrate(F.lit(1.0), 0.5, 0.5)
    assert one(spark, scores.iou(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(15.0))) == pytest.approx(5 / 15)
    assert one(spark, scores.iou(F.lit(0.0), F.lit(5.0), F.lit(10.0), F.lit(15.0))) == 0
    assert one(spark, scores.clamp(F.lit(float("nan")))) == 0 and one(spark, scores.clamp(F.lit(-1.0))) == 0
    assert one(spark, scores.without_audio(F.lit(0.0), F.lit(0.0))).asDict() == {"text": 0.5, "image": 0.5, "audio": 0.0}


def test_minmax_of_flat_and_null_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", None), ("b", 3.0), (None, 5.0)], "k string, x double")
    rows = {(r.k, r.x): r.x_norm for r in scores.minmax(df, ["x"], ["k"]).collect()}
    assert rows == {("a", 2.0): 0.0, ("b", 1.0): 0.0, ("b", None): None, ("b", 3.0): 1.0, (None, 5.0): 0.0}
    assert scores.minmax(df.limit(0), ["x"]).count() == 0


def test_vectors(spark):
    assert one(spark, vectors.l2_normalize(F.col("v")), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.l2_normalize(F.col("v")), v=[float("nan"), 1.0]) is None
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", None), ("b", [0.0, 0.0])], "k string, v array<float>")
    rows = vectors.pool_mean(df, "k", "v").collect()
    assert len(rows) == 1 and rows[0]["v"] == pytest.approx([0.5**0.5] * 2) and rows[0]["n"] == 2
    labels = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [1.0, 0.0]), ("z", 2, [0.0, 1.0])], "label string, label_ord int, vec array<float>")
    got = {r.k: r.audio_event_text for r in vectors.label_topk(df.where("v IS NOT NULL AND v[0] = 1 OR k = 'b'"), ["k"], "v", labels, 2).collect()}
    assert got == {"a": "x y", "b": ""}


def test_settings(tmp_path):
    assert normalised((0, 0, 0)) == (0.5, 0.5, 0.0)
    s = settings_from({"retrieval": {"top_k": 3, "weights": {"action": {"text": 1, "image": 1, "audio": 2}}}, "characters": ["a"], "unknown": 1})
    assert s.retrieval.top_k == 3 and s.retrieval.weights["action"] == (0.25, 0.25, 0.5) and s.characters == ("a",)
    (tmp_path / "s.yaml").write_text("refinement:\n  stride: 1.0\n")
    assert load_settings(tmp_path / "s.yaml").refinement.stride == 1.0
    with pytest.raises(FileNotFoundError):
        load_settings(tmp_path / "none.yaml")
