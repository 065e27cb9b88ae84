"""The engine: preprocess, index, ground one query or many, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import vectors
from reelspan.functions.text import classify_query, cut, fmt_time, frame_pooling
from reelspan.operators import intervals, timeline
from reelspan.plans import evaluate as ev
from reelspan.plans import refine as rf
from reelspan.plans.search import hybrid_search, query_blocks
from reelspan.session import cut_lineage
from reelspan.settings import Settings
from reelspan.sources import index, media, segments, subtitles

#: No vectors of a modality.
NONE = "array<float>"
POINTS = "query_id int, video string, t double, image_sim double, audio_sim double"


def subtitle_lines(spark: SparkSession, settings: Settings, videos: DataFrame, track: Callable | None = None) -> DataFrame:
    """Timed lines of the videos' subtitle files, or of the tracks inside those without a file: by ``track``, else by ffmpeg where there is one."""
    p = settings.paths
    subs = media.find_subtitles(spark, videos, p.subtitle_root, p.video_root)
    lines = subtitles.read_subtitles(spark, subs)
    track = track or (media.embedded_subtitles if media.ffmpeg() else None)
    if track:
        bare = videos.select("video", "path").join(subs.where("path IS NULL").select("video"), "video", "left_semi")
        lines = lines.unionByName(subtitles.read_embedded(bare, track))
    return intervals.line_seconds(lines)


def preprocess(spark: SparkSession, settings: Settings = Settings(), scores: DataFrame | None = None, track: Callable | None = None, grab: Callable | None = None, sound: Callable | None = None) -> DataFrame:
    """Scenes of the videos under ``video_root`` with their subtitle text and keyframe names.

    ``scores`` (``video, frame, t, score``) are the frames' changes; without it they are decoded, which needs OpenCV.
    Bounds are rounded to milliseconds. Keyframes and, if enabled, sounds are written as files by ``grab`` and ``sound``, else by
    ffmpeg; where there is neither, the frames are names only.
    """
    p, out = settings.paths, settings.preprocessing
    videos = media.list_videos(spark, p.video_root, out.suffixes, out.name_filter)
    lines = subtitle_lines(spark, settings, videos, track)
    scores = media.frame_scores(spark, videos, media.hsv_change) if scores is None else scores
    spans = timeline.scene_bounds(scores, "video", "frame", "t", "score", out.scene_threshold)
    text = intervals.concat_lines(spans, ["video", "scene_id"], lines)
    names = F.transform(F.sequence(F.lit(0), F.lit(len(out.frame_fractions) - 1)), lambda i: F.concat_ws("/", F.lit(p.output_root), F.lit("frames"), F.regexp_replace("video", r"\.[^.]+$", ""), F.col("scene_id").cast("string"), F.concat(F.lit("f"), i.cast("string"), F.lit(".jpg"))))
    empty = F.array().cast("array<string>")
    made = text.select(
        "video", F.col("scene_id").cast("int").alias("scene_id"), F.round("s", 3).alias("start"), F.round("e", 3).alias("end"), F.round(F.col("e") - F.col("s"), 3).alias("duration"), F.col("line_text").alias("subtitle"),
        names.alias("frames"), F.lit("").alias("audio_path"), empty.alias("audio_events"), F.lit("").alias("audio_event_text"),
    )
    if not (grab or sound or media.ffmpeg()):
        return made
    at = made.withColumn("times", timeline.keyframe_times(F.col("start"), F.col("end"), out.frame_fractions)).join(videos.select("video", "path"), "video")
    folder = f"{p.output_root}/{settings.audio.scene_audio_dir}" if settings.audio.enabled else None
    return media.with_scene_files(at, folder, settings.audio.sample_rate, grab or media.keyframe, sound or media.scene_audio).select(*made.columns)


@dataclass
class Engine:
    """Scenes with vectors, subtitle lines and a grid of frame and sound vectors, ready for queries.

    ``scenes``: ``ord, video, scene_id, scene_start, scene_end, subtitle, text_vec, image_vec, audio_vec``; ``lines``: as from
    ``line_seconds``; ``frames``, ``sounds``: ``video, t, vec`` on a grid, or None; ``encode``: from queries (``query_id,
    query_text``) to the same with ``text_vec, image_vec, audio_vec``; ``text_similarity``: of a query and a bin's lines; ``sample_frames``,
    ``sample_sounds``: from the times of bins (``video, t`` or ``video, t, b_s, b_e``) to vectors (``video, t, vec``), decoded when they are asked for;
    ``durations``: ``video, duration``; a video without one ends with its last scene.
    """

    spark: SparkSession
    scenes: DataFrame
    lines: DataFrame
    encode: Callable[[DataFrame], DataFrame]
    frames: DataFrame | None = None
    sounds: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    text_similarity: Callable = rf.bag_cosine
    sample_frames: Callable[[DataFrame], DataFrame] | None = None
    sample_sounds: Callable[[DataFrame], DataFrame] | None = None
    durations: DataFrame | None = None

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        found = hybrid_search(self.encode(queries), self.scenes, self.settings, top_k)
        extent = self.scenes.groupBy("video").agg(F.max("scene_end").alias("duration"))
        if self.durations is not None:
            known = self.durations.groupBy("video").agg(F.max("duration").alias("_known"))
            extent = extent.join(known, "video", "left").select("video", F.coalesce("_known", "duration").alias("duration"))
        s = self.scenes.select("video", "scene_id", "scene_start", "scene_end", "subtitle").dropDuplicates(["video", "scene_id"])
        return found.join(s, ["video", "scene_id"]).join(extent, "video", "left").fillna(0.0, ["duration"])

    def _points(self, found: DataFrame, queries: DataFrame, block: int = 2048) -> DataFrame:
        """``query_id, video, t, image_sim, audio_sim`` of the frames and sounds around each candidate: of its bins, where they are sampled, else on the grids.

        Queries are taken in blocks; a block's vectors are broadcast, and each pair of a query and a point is one product."""
        parts = []
        for mode, grid, sample in (("image", self.frames, self.sample_frames), ("audio", self.sounds, self.sample_sounds)):
            if grid is None and sample is None:
                continue
            vecs = sample(self._bin_times(found, mode)) if sample else grid
            e = self.settings.refinement.expand
            win = found.select("query_id", "video", (F.col("scene_start") - e).alias("s"), (F.col("scene_end") + e).alias("e"))
            points = vecs.select("video", F.col("t").alias("ls"), F.col("t").alias("le"), "vec")
            near = intervals.overlap_join(win, points).select("query_id", "video", F.col("ls").alias("t"), "vec").dropDuplicates(["query_id", "video", "t"])
            for rows in query_blocks(queries.select("query_id", F.col(f"{mode}_vec").alias("q")).where("q IS NOT NULL"), "query_id", block):
                parts.append(vectors.pair_scores(near, "vec", np.array([r.query_id for r in rows], np.int64), [r.q for r in rows], f"{mode}_sim"))
        out = self.spark.createDataFrame([], POINTS)
        for p in parts:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _bin_times(self, found: DataFrame, mode: str) -> DataFrame:
        """``video, t`` of the frames of each candidate's bins, or ``video, t, t_end`` of their sounds, each once."""
        r = self.settings.refinement
        bins = timeline.sliding_bins(timeline.search_window(found, "scene_start", "scene_end", "duration", r.expand), r.bin_size, r.stride)
        if mode == "audio":
            return bins.select("video", F.round((F.col("b_s") + F.col("b_e")) / 2, 3).alias("t"), F.round("b_s", 3).alias("b_s"), F.round("b_e", 3).alias("b_e")).dropDuplicates(["video", "t"])
        return bins.select("video", F.explode(timeline.frame_times(F.col("b_s"), F.col("b_e"), r.bin_frames)).alias("t")).select("video", F.round("t", 3).alias("t")).distinct()

    def ground(self, queries: DataFrame, top_k: int | None = None, merge_gap: float | None = None) -> DataFrame:
        """Ranked spans of all ``queries`` (``query_id, query_text``)."""
        found = cut_lineage(self.search(queries, top_k))
        vecs = cut_lineage(self.encode(queries))
        return rf.ground(found, self.lines, self._points(found, vecs), None, self.settings, merge_gap, self.text_similarity)

    def evaluate(self, gold: DataFrame, top_k: int | None = None, merge_gap: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, summary) of annotated queries."""
        got = self.ground(gold.select("query_id", "query_text"), top_k, merge_gap)
        rows = cut_lineage(ev.evaluate(gold, got.select("query_id", "rank_pos", "video", F.col("refined_start").alias("s"), F.col("refined_end").alias("e"), "confidence")))
        return rows, ev.summary(rows)

    def answer(self, query: str, top_k: int | None = None, merge_gap: float | None = None) -> dict | None:
        """The best span of one query as a dictionary; None where nothing is found."""
        g = self.ground(self.spark.createDataFrame([(0, query)], "query_id int, query_text string"), top_k, merge_gap)
        row = g.where("rank_pos = 1").select(
            F.lit(query).alias("query"), "video", "scene_id", F.col("refined_start").alias("predicted_start"), F.col("refined_end").alias("predicted_end"), "span_seconds", "query_type",
            frame_pooling(F.col("query_type")).alias("frame_aggregation"), "confidence", cut(F.col("subtitle"), 500).alias("evidence"),
        ).first()
        return row.asDict() if row else None

    def show(self, query: str, top_k: int | None = None, merge_gap: float | None = None, show_top: int = 5) -> None:
        """Prints the best spans of one query."""
        g = self.ground(self.spark.createDataFrame([(0, query)], "query_id int, query_text string"), top_k, merge_gap)
        label = g.select(classify_query(F.lit(query)).alias("l")).first()
        print(f"{query}\n{label.l if label else 'mixed'}")
        g.orderBy("rank_pos").limit(show_top).select("rank_pos", "video", fmt_time(F.col("refined_start")).alias("begins"), fmt_time(F.col("refined_end")).alias("ends"), F.round("confidence", 3).alias("confidence"), cut(F.col("subtitle"), 200).alias("subtitle")).show(show_top, truncate=60)


def text_engine(spark: SparkSession, scenes: DataFrame, lines: DataFrame, encoder: index.Encoder, path: str, settings: Settings = Settings(), force: bool = False, image: tuple[index.Encoder, index.Encoder] | None = None, audio: tuple[index.Encoder, index.Encoder] | None = None, sample_frames: Callable | None = None, sample_sounds: Callable | None = None, durations: DataFrame | None = None) -> Engine:
    """An engine over text and, where there are encoders of (files, queries), over ``image`` and ``audio``: scenes (``SEGMENTS``) are encoded
    and kept at ``path`` while nothing changes. With ``audio``, the settings' labels nearest to a scene's sound become its ``audio_events``."""
    none = F.lit(None).cast(NONE)

    def build(s: DataFrame) -> DataFrame:
        out, key = text_part(s), ["video", "scene_id"]
        if image:
            f = index.some_usable(cut_lineage(index.encoded(s.select(*key, F.explode("frames").alias("frame")), "frame", "image_vec", image[0])), "image_vec", "picture")
            pooled = vectors.pool_mean(f.select(F.to_json(F.struct(*key)).alias("key"), "image_vec"), "key", "image_vec")
            out = out.join(pooled.select(F.from_json("key", "video string, scene_id int").alias("key"), "image_vec").select("key.*", "image_vec"), key, "left")
        if audio:
            sounds = index.encoded(s.select(*key, F.nullif("audio_path", F.lit("")).alias("sound")), "sound", "audio_vec", audio[0]).drop("sound")
            names = spark.createDataFrame([(x, i) for i, x in enumerate(settings.audio.event_labels)], "label string, label_ord int")
            sounds = cut_lineage(sounds)
            labels = vectors.label_topk(sounds, key, "audio_vec", index.encoded(names, "label", "vec", audio[1]), settings.audio.top_k_events)
            out = out.join(sounds, key, "left").join(labels, key, "left")
        return out

    def text_part(s: DataFrame) -> DataFrame:
        return index.encoded(segments.filled(s).select("video", "scene_id", F.col("start").alias("scene_start"), F.col("end").alias("scene_end"), "subtitle", "embed_text"), "embed_text", "text_vec", encoder)

    vecs, _ = index.build_or_load(spark, scenes, path, {"text_model": encoder.name, **{k: e.name for k, x in (("image", image), ("audio", audio)) if x for k, e in ((k, x[0]), (f"{k}_query", x[1]))}, **({"labels": "|".join(settings.audio.event_labels), "top_k_events": str(settings.audio.top_k_events)} if audio else {})}, build, force)
    # a stable number for ties: the scene's own key
    ready = vecs.withColumn("ord", F.xxhash64("video", "scene_id"))
    for c, pair in (("image_vec", image), ("audio_vec", audio)):
        ready = ready if pair else ready.withColumn(c, none)

    def encode(q: DataFrame) -> DataFrame:
        out = index.encoded(q.select("query_id", "query_text"), "query_text", "text_vec", encoder)
        for c, pair in (("image_vec", image), ("audio_vec", audio)):
            out = index.encoded(out, "query_text", c, pair[1]) if pair else out.withColumn(c, none)
        return out

    return Engine(spark, ready, lines, encode, settings=settings, text_similarity=index.similarity(encoder), sample_frames=sample_frames, sample_sounds=sample_sounds, durations=durations)


def samplers(videos: DataFrame, settings: Settings, image: index.Encoder | None, audio: index.Encoder | None, grab: Callable | None = None, sound: Callable | None = None) -> tuple[Callable | None, Callable | None]:
    """(frames, sounds) of bins as vectors, by ffmpeg or by ``grab`` and ``sound``, on the executors; None where nothing can decode or encode them.

    A time that several bins or candidates ask for is decoded once. Files are written below ``output_root``, which all workers share."""
    root, rate = settings.paths.output_root, settings.audio.sample_rate
    grab, sound = grab or (media.keyframe if media.ffmpeg() else None), sound or (media.scene_audio if media.ffmpeg() else None)

    def made(times: DataFrame, take: Callable, suffix: str, encoder: index.Encoder) -> DataFrame:
        at = times.join(videos.select("video", "path"), "video").repartition(F.col("video"), F.floor(F.col("t") / 30))
        return index.encoded(media.with_sample_files(at, f"{root}/samples", suffix, take), "file", "vec", encoder).select("video", "t", "vec").where("vec IS NOT NULL")

    def frames(times: DataFrame) -> DataFrame:
        return made(times, lambda r: grab(r["path"], float(r["t"])), ".jpg", image)

    def sounds(times: DataFrame) -> DataFrame:
        return made(times, lambda r: sound(r["path"], float(r["b_s"]), float(r["b_e"]), rate), ".wav", audio)

    return frames if image and grab else None, sounds if audio and sound else None
