"""Files in and out: subtitles, scenes, media names, wave files, the index, the command line, streams."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan import cli
from reelspan import engine as en
from reelspan.operators.intervals import line_seconds
from reelspan.schemas import SEGMENTS
from reelspan.settings import Paths, Settings
from reelspan.sources import index, media, segments, subtitles
from reelspan.streaming import scenes as st

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello <i>there</i>\r\nyou\r\n\r\n2\r\n00:01:00.5 --> 00:01:02,000\r\nred radio\r\n"
ASS = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:03.00,0:00:04.50,D,{\\i1}One,\\Ntwo\nComment: 0,0:00:05.00,0:00:06.00,D,note\nDialogue: broken\n"


def test_parsers():
    assert subtitles.parse_srt(SRT) == [(1000, 2500, "Hello <i>there</i>\\Nyou"), (60500, 62000, "red radio")]
    assert subtitles.parse_ass(ASS) == [(3000, 4500, "{\\i1}One,\\Ntwo"), (5000, 6000, "note")]
    assert subtitles.parse_srt("") == [] and subtitles.parse_ass("nothing") == []
    assert subtitles.decode("é".encode("latin-1")) == "é" and subtitles.decode("é".encode("utf-16")) == "é" and subtitles.decode("é".encode()) == "é"


@pytest.fixture
def library(tmp_path):
    v, s = tmp_path / "videos", tmp_path / "subs"
    v.mkdir(), s.mkdir()
    for n in ("Show S01E01.mkv", "Show S01E02.MP4", "Other.avi", "note.txt"):
        (v / n).write_bytes(b"0")
    (s / "Show S01E01.srt").write_text(SRT)
    (s / "Show S01E01.ass").write_text(ASS)
    (s / "show.s01e02.extra.ass").write_text(ASS)
    return tmp_path


def test_discovery_and_subtitles(spark, library):
    videos = media.list_videos(spark, str(library / "videos"))
    assert [r.video for r in videos.collect()] == ["Other.avi", "Show S01E01.mkv", "Show S01E02.MP4"]
    assert media.list_videos(spark, str(library / "videos"), name_filter="SHOW").count() == 2
    with pytest.raises(FileNotFoundError):
        media.list_videos(spark, str(library / "videos"), name_filter="zzz")
    found = {r.video: (r.path or "").rpartition("/")[2] for r in media.find_subtitles(spark, videos, str(library / "subs"), str(library / "videos")).collect()}
    assert found == {"Other.avi": "", "Show S01E01.mkv": "Show S01E01.srt", "Show S01E02.MP4": "show.s01e02.extra.ass"}
    lines = subtitles.read_subtitles(spark, media.find_subtitles(spark, videos, str(library / "subs"), str(library / "videos")))
    assert sorted((r.video, r.line_no, r.start_ms) for r in lines.collect())[0] == ("Show S01E01.mkv", 0, 1000)


def test_csv_and_parquet_round_trip(spark, tmp_path):
    rows = [("a", 0, 0.0, 1.5, 1.5, 'He said "hi",\nthen left', ["f0.jpg", 'q"x'], "a.wav", ["rain"], "rain"), ("b", 0, 0.0, 1.0, None, None, None, None, [], "")]
    df = spark.createDataFrame(rows, SEGMENTS)
    segments.write_csv(df, str(tmp_path / "csv"))
    back = segments.read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(str, back.where("video = 'a'").collect())) == sorted(map(str, df.where("video = 'a'").collect()))
    assert segments.filled(back).where("video = 'b'").first().embed_text == "silent scene no dialogue"
    segments.write_parquet(df, str(tmp_path / "pq"))
    segments.write_parquet(df.where("video = 'a'").limit(0).unionByName(df.where("video = 'b'")), str(tmp_path / "pq"))
    assert segments.read_parquet(spark, str(tmp_path / "pq")).count() == 2
    assert segments.stats(df).first().asDict() == {"n_scenes": 2, "min_frames": 0, "mean_frames": 1.0, "max_frames": 2, "sum_frames": 2, "with_subtitle": 1}
    (tmp_path / "old.csv").write_text("video,scene_id,frames\nx,3,not json\n")
    r = segments.read_csv(spark, str(tmp_path / "old.csv")).first()
    assert r.scene_id == 3 and r.frames is None and r.audio_path is None


def test_wave_files(spark):
    def made(width, channels):
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(channels), w.setsampwidth(width), w.setframerate(8000)
            w.writeframes(np.array([0, 16384, -32768, 32767], "<i2").tobytes())
        return b.getvalue()

    assert media.load_wav(made(2, 1)) == pytest.approx([0, 0.5, -1, 32767 / 32768])
    assert media.load_wav(made(2, 2)) == pytest.approx([0.25, -0.5 / 32768], abs=1e-6)
    assert media.load_wav(made(1, 1)) is None and media.load_wav(b"junk") is None and media.scene_audio("x", 2, 1) is None
    df = spark.createDataFrame([(made(2, 1),), (None,), (b"junk",)], "c binary")
    assert [r.s and len(r.s) for r in df.select(media.wav_samples("c").alias("s")).collect()] == [4, None, None]


def test_index_is_rebuilt_only_when_something_changed(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "red scarf"), ("a", 1, None)], "video string, scene_id int, subtitle string")
    enc = index.HashingEncoder(8)
    build = lambda s: index.encoded(s, "subtitle", "v", enc)
    path = str(tmp_path / "ix")
    assert index.build_or_load(spark, df, path, {"m": enc.name}, build)[1]
    vecs, built = index.build_or_load(spark, df.repartition(3), path, {"m": enc.name}, build)
    assert not built and {r.scene_id: r.v is None for r in vecs.collect()} == {0: False, 1: True}
    assert index.build_or_load(spark, df, path, {"m": "other"}, build)[1]
    assert index.build_or_load(spark, df.limit(1), path, {"m": "other"}, build)[1]
    assert index.build_or_load(spark, df.limit(1), path, {"m": "other"}, build, force=True)[1]


def scores_of(spark):
    rows = [(v, i, i * 0.5, 40.0 if i in (20, 130) else 1.0) for v in ("Show S01E01.mkv", "Show S01E02.MP4") for i in range(160)]
    return spark.createDataFrame(rows, "video string, frame int, t double, score double")


def test_preprocess_and_engine(spark, library):
    s = Settings(paths=Paths(str(library / "videos"), str(library / "subs"), str(library / "out")))
    scenes = en.preprocess(spark, s, scores_of(spark))
    rows = {(r.video, r.scene_id): r for r in scenes.collect()}
    assert (rows["Show S01E01.mkv", 0].start, rows["Show S01E01.mkv", 0].end, rows["Show S01E01.mkv", 0].subtitle) == (0.0, 10.0, "Hello <i>there</i> you")
    assert rows["Show S01E01.mkv", 1].subtitle == "red radio" and len(rows["Show S01E01.mkv", 1].frames) == 5 and len(rows) == 6
    videos = media.list_videos(spark, s.paths.video_root)
    lines = line_seconds(subtitles.read_subtitles(spark, media.find_subtitles(spark, videos, s.paths.subtitle_root, s.paths.video_root)))
    e = en.text_engine(spark, scenes, lines, index.HashingEncoder(), str(library / "ix"), s)
    got = e.answer("who has the red radio")
    assert got["video"] == "Show S01E01.mkv" and got["scene_id"] == 1 and got["predicted_start"] <= 60.5 <= got["predicted_end"]
    assert set(got) == {"query", "video", "scene_id", "predicted_start", "predicted_end", "span_seconds", "query_type", "frame_aggregation", "confidence", "evidence"}


def test_command_line(spark, library, capsys):
    (library / "c.yaml").write_text(f"paths:\n  video_root: {library / 'videos'}\n  subtitle_root: {library / 'subs'}\n  output_root: {library / 'out'}\nmodels:\n  text_model: hashing\n")
    scores_of(spark).write.parquet(str(library / "scores"))
    spark.createDataFrame([(0, "red radio", "Show S01E01.mkv", 60.0, 63.0, "mixed")], "query_id int, query_text string, video string, gt_start double, gt_end double, query_type string").write.parquet(str(library / "gold"))
    base = ["--config", str(library / "c.yaml")]
    assert cli.main([*base, "run-all", "--scores", str(library / "scores"), "--gold", str(library / "gold"), "--text", "hello"], spark) == 0
    assert cli.main([*base, "query", "red radio"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["video"] == "Show S01E01.mkv"
    assert spark.read.csv(str(library / "out/evaluation_final"), header=True).count() == 1


def test_streams_take_each_record_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("a", 0, "x", "2024-01-01 00:00:00"), ("a", 0, "x", "2024-01-02 00:00:00"), ("a", 1, "y", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "video string, line_no int, text string, ingested_at string").selectExpr("video", "line_no", "text", "cast(ingested_at as timestamp_ntz) as ingested_at")
    df.write.parquet(src)
    for _ in range(2):  # the second time there is nothing new
        stream = st.once_in_stream(spark.readStream.schema(df.schema).parquet(src), ["video", "line_no"])
        st.append_to(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.video, r.line_no) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 1)]
    q = st.line_rates(spark.readStream.schema(df.schema).parquet(src), late="1 hour").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n_lines for r in spark.table("rates").collect()) == [1, 1, 1]


def test_frames_sounds_tracks_and_labels_reach_the_index(spark, library):
    """By stand-ins for ffmpeg and the encoders: files hold a word, which is encoded."""
    from dataclasses import replace

    class Files(index.HashingEncoder):
        def encode(self, items):
            return super().encode([open(p).read() if p else "" for p in items])

    s = Settings(paths=Paths(str(library / "videos"), str(library / "subs"), str(library / "out")))
    s = replace(s, audio=replace(s.audio, enabled=True, event_labels=("rain", "siren"), top_k_events=1))
    track = lambda path: ("1\n00:00:01,000 --> 00:00:02,000\ninside\n", ".srt") if path.endswith("Other.avi") else None
    grab = lambda path, t: b"scarf" if t < 10 else None
    sound = lambda path, a, b, rate: b"siren" if a < 10 else b"rain" if a < 60 else None
    scores = scores_of(spark).unionByName(scores_of(spark).where("video LIKE '%E01%'").selectExpr("'Other.avi' AS video", "frame", "t", "score"))
    scenes = en.preprocess(spark, s, scores, track, grab, sound)
    segments.write_parquet(scenes, str(library / "scenes"))
    scenes = segments.read_parquet(spark, str(library / "scenes"))
    rows = {(r.video, r.scene_id): r for r in scenes.collect()}
    assert rows["Other.avi", 0].subtitle == "inside" and len(rows["Other.avi", 0].frames) == 5 and rows["Other.avi", 1].frames == [] and rows["Other.avi", 2].audio_path == ""
    enc, files = index.HashingEncoder(), Files()
    videos = media.list_videos(spark, s.paths.video_root)
    e = en.text_engine(spark, scenes, en.subtitle_lines(spark, s, videos, track), enc, str(library / "ix3"), s, image=(files, enc), audio=(files, enc))
    got = {r.scene_id: r for r in e.scenes.where("video = 'Other.avi'").collect()}
    assert got[0].image_vec and not got[1].image_vec and got[0].audio_vec and not got[2].audio_vec
    assert (got[0].audio_event_text, got[1].audio_event_text, got[2].audio_event_text) == ("siren", "rain", "")
    found = {(r.video, r.scene_id): r for r in e.search(spark.createDataFrame([(0, "siren scarf")], "query_id int, query_text string")).collect()}
    assert found["Other.avi", 0].image_score > 0.5 and found["Other.avi", 0].audio_score > 0.5


def test_frames_and_sounds_of_bins_are_sampled_for_the_curves(spark, library):
    """By stand-ins: a file holds the word that is seen or heard at its time."""

    class Files(index.HashingEncoder):
        def encode(self, items):
            return super().encode([open(p).read() if p else "" for p in items])

    s = Settings(paths=Paths(str(library / "videos"), str(library / "subs"), str(library / "out")))
    grab = lambda path, t: b"scarf" if "E02" in path and 40 <= t < 44 else b"wall"
    sound = lambda path, a, b, rate: None if "E01" in path else b"siren"
    scenes = en.preprocess(spark, s, scores_of(spark), None, lambda p, t: b"scarf" if "E02" in p else b"wall", None)
    videos, enc = media.list_videos(spark, s.paths.video_root), index.HashingEncoder()
    frames, sounds = en.samplers(videos, s, Files(), Files(), grab, sound)
    e = en.text_engine(spark, scenes, en.subtitle_lines(spark, s, videos), enc, str(library / "ix4"), s, image=(Files(), enc), audio=None, sample_frames=frames, sample_sounds=sounds)
    got = e.ground(spark.createDataFrame([(0, "scarf")], "query_id int, query_text string"), top_k=1).first()
    e.durations = media.durations(videos, lambda p: 43.0 if "E02" in p else None)
    assert e.search(spark.createDataFrame([(0, "scarf")], "query_id int, query_text string"), 1).first().duration == 43.0
    assert got.video == "Show S01E02.MP4" and got.refined_start <= 40 and got.refined_end >= 43.5
    assert sounds(spark.createDataFrame([("Show S01E01.mkv", 1.0, 0.0, 2.0), ("Show S01E02.MP4", 1.0, 0.0, 2.0)], "video string, t double, b_s double, b_e double")).count() == 1
    assert en.samplers(videos, s, None, None, grab, sound) == (None, None)


def test_pictures_that_all_fail_are_an_error(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, v array<float>")
    with pytest.raises(ValueError, match="no picture"):
        index.some_usable(df, "v", "picture")
    assert index.some_usable(df.limit(0), "v", "picture").count() == 0
    sim = spark.createDataFrame([("red scarf", "a red scarf"), ("red", ""), (None, "x")], "a string, b string").select(index.similarity(index.HashingEncoder())(F.col("a"), F.col("b")).alias("s"))
    assert [round(r.s, 3) for r in sim.collect()] == [0.816, 0.0, 0.0]
