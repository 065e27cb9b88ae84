"""The engine's own queries, one or more for each operator, over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.functions import scores, text, vectors
from reelspan.operators import intervals, islands, timeline
from reelspan.plans import evaluate as ev
from reelspan.plans import refine as rf
from reelspan.plans.search import hybrid_search as search
from reelspan.plans.search import query_blocks
from reelspan.session import cut_lineage, once, table
from reelspan.settings import Audio, Settings

#: Names of this project's recordings that a query may ask for.
CHARACTERS = ("mirelle", "tamsin", "ferris", "odette", "corvin", "yselle", "tobin", "bram")
SETTINGS = Settings(characters=CHARACTERS, audio=Audio(enabled=True))
#: Rows of keys that are broadcast at most; beyond that both sides are exchanged.
FEW = 1_000_000


def scenes(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "segments"), ["video", "scene_id"])


def lines(spark: SparkSession, d: str) -> DataFrame:
    return intervals.line_seconds(once(table(spark, d, "subtitle_lines"), ["video", "line_no"]))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "candidates"), ["query_id", "video", "scene_id"])


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold").dropDuplicates(["query_id"])


def scene_vectors(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "segment_vectors"), ["ord"])


def query_vectors(spark: SparkSession, d: str, s: DataFrame | None = None, v: DataFrame | None = None) -> DataFrame:
    """Queries with the vectors of the first scene at their annotated start, which stand in for encoded ones."""
    s = (scenes(spark, d) if s is None else s).select("video", "scene_id", F.col("scene_start").alias("s"), F.col("scene_end").alias("e"))
    v = (scene_vectors(spark, d) if v is None else v).select("video", "scene_id", "text_vec", "image_vec", "audio_vec")
    g = gold(spark, d).select("query_id", "query_text", "video", "query_type", F.col("gt_start").alias("ls"), F.col("gt_start").alias("le"))
    at = intervals.overlap_join(s, g, 600.0).where("ls >= s AND ls < e").groupBy("query_id").agg(F.min(F.struct("scene_id", "video")).alias("m"))
    at = cut_lineage(at.select("query_id", "m.video", "m.scene_id"))
    # the scenes of the queries, of which there is a stated set, go to the vectors and not the other way
    at = (F.broadcast(at) if at.count() <= FEW else at).join(v, ["video", "scene_id"]).drop("video", "scene_id")
    return g.select("query_id", "query_text").join(at, "query_id", "left")


def searchable(spark: SparkSession, d: str, s: DataFrame | None = None, v: DataFrame | None = None) -> DataFrame:
    """Scenes with their vectors and the names that a query may ask for. Names are few: they go to the vectors, in place of the texts."""
    s = scenes(spark, d) if s is None else s
    v = scene_vectors(spark, d) if v is None else v
    named = cut_lineage(s.select("video", "scene_id", F.array_join(text.characters_in(F.col("subtitle"), list(CHARACTERS)), " ").alias("subtitle")).where("subtitle <> ''"))
    return v.join(F.broadcast(named) if named.count() <= FEW else named, ["video", "scene_id"], "left")


def _first_query(spark: SparkSession, d: str) -> DataFrame:
    """The usable scene with the lowest ``ord``: its vectors are the query."""
    v = scene_vectors(spark, d).where("text_vec IS NOT NULL AND image_vec IS NOT NULL AND audio_vec IS NOT NULL")
    return v.orderBy("ord").limit(1)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """``video, scene_id, ord, text_score, image_score, audio_score`` of all scenes against the first query."""
    import pyarrow as pa

    q = _first_query(spark, d).collect()
    modes = ["text_vec", "image_vec", "audio_vec"]
    box = {m: vectors.unit(np.array([q[0][m]], np.float32)) for m in modes} if q else {m: np.zeros((1, 1)) for m in modes}

    def score(batches):  # noqa: ANN001, ANN202
        for b, s in vectors.score_batches(batches, box):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(s[m][:, 0]) for m in modes]], ["video", "scene_id", "ord", "text_score", "image_score", "audio_score"])

    return scene_vectors(spark, d).select("video", "scene_id", "ord", *modes).mapInArrow(score, "video string, scene_id int, ord int, text_score double, image_score double, audio_score double")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten scenes most similar in text to each scene whose ``ord`` is divisible by 50, itself among them."""
    import pyarrow as pa

    v = scene_vectors(spark, d).select("ord", "video", "scene_id", "text_vec")
    parts = []
    for rows in query_blocks(v.where("ord % 50 = 0 AND text_vec IS NOT NULL").select("ord", "text_vec"), "ord", 2048):
        q = vectors.unit(vectors.matrix(pa.array([r.text_vec for r in rows], pa.list_(pa.float32()))))
        parts.append(vectors.top_of_block(v, "ord", "text_vec", np.array([r.ord for r in rows], np.int64), q, 10))
    found = spark.createDataFrame([], "query bigint, key bigint, score double")
    for p in parts:
        found = found.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("key"))
    top = found.withColumn("place", F.row_number().over(w)).where("place <= 10")
    return top.select(F.col("query").cast("int").alias("query_ord"), "place", F.col("key").cast("int").alias("ord"), "score")


def vector_clamped_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("ord", *[F.round(c, 6).alias(c) for c in ("text_score", "image_score", "audio_score")])


def _all_of(vec: str) -> Column:
    """A number that all components of a vector have a part in, each by its place."""
    by_place = F.transform(vec, lambda x, i: x * (i + 1))
    return F.round(F.aggregate(by_place, F.lit(0.0), lambda a, x: a + x), 5).alias("by_place")


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = scene_vectors(spark, d).select("ord", vectors.l2_normalize(F.col("image_vec")).alias("v"))
    return v.select("ord", _all_of("v"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


def mean_pool_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = vectors.pool_mean(scene_vectors(spark, d).select("video", "audio_vec"), "video", "audio_vec")
    return p.select("video", "n", _all_of("audio_vec"))


def label_topk(spark: SparkSession, d: str) -> DataFrame:
    t = vectors.label_topk(scene_vectors(spark, d), ["ord"], "audio_vec", table(spark, d, "label_vectors"), 5)
    return t.select("ord", "audio_event_text", F.size("audio_events").alias("n_events"))


def vector_failures(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of each modality are missing, zero or broken, and would be filled with zeros."""
    v = scene_vectors(spark, d)
    parts = []
    for m in ("text", "image", "audio"):
        c = F.col(f"{m}_vec")
        s = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        parts.append(v.select(F.lit(m).alias("modality"), s.alias("s")))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("modality").agg(F.count_if(F.col("s").isNull()).alias("n_null"), F.count_if(F.col("s") == 0).alias("n_zero"), F.count_if(F.isnan("s")).alias("n_nan"), F.count("*").alias("n"))


def minmax_global(spark: SparkSession, d: str) -> DataFrame:
    s = scenes(spark, d).select("video", "scene_id", (F.col("scene_end") - F.col("scene_start")).alias("span"))
    return scores.minmax(s, ["span"]).select("video", "scene_id", F.round("span_norm", 6).alias("span_norm"))


def _clamped(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return c.withColumns({m: scores.clamp(F.col(m)) for m in ("text_score", "image_score", "audio_score")})


def minmax_by_query(spark: SparkSession, d: str) -> DataFrame:
    n = scores.minmax(_clamped(spark, d).select("query_id", "video", "scene_id", "text_score", "image_score", "audio_score"), ["text_score", "image_score", "audio_score"], ["query_id"])
    return n.select("query_id", "video", "scene_id", *[F.round(f"{m}_score_norm", 6).alias(f"{m}_norm") for m in ("text", "image", "audio")])


def _fused(spark: SparkSession, d: str, audio: bool) -> DataFrame:
    g = gold(spark, d).select("query_id", "query_text")
    n = scores.minmax(_clamped(spark, d), ["text_score", "image_score", "audio_score"], ["query_id"]).join(g, "query_id")
    w = scores.weights_of(text.classify_query(F.col("query_text")), SETTINGS.retrieval.weights)
    n = n.withColumn("_w", w)
    if not audio:
        n = n.withColumn("_w", scores.without_audio(F.col("_w.text"), F.col("_w.image")))
    fused = F.col("_w.text") * F.col("text_score_norm") + F.col("_w.image") * F.col("image_score_norm") + F.col("_w.audio") * F.col("audio_score_norm")
    return n.withColumn("fused", F.round(fused, 6))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, True).select("query_id", "video", "scene_id", "fused")


def hybrid_fusion_no_audio(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, False).select("query_id", "video", "scene_id", "fused")


def query_classify(spark: SparkSession, d: str) -> DataFrame:
    h = text.class_hits(F.col("query_text"))
    return gold(spark, d).select("query_id", text.classify_query(F.col("query_text")).alias("label"), h["action"].alias("n_action"), h["dialogue"].alias("n_dialogue"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("query_id", "video", "scene_id", "subtitle", "hybrid_score").join(gold(spark, d).select("query_id", "query_text"), "query_id")


def kw_overlap(spark: SparkSession, d: str) -> DataFrame:
    k = text.kw_overlap(F.col("query_text"), F.col("subtitle"))
    return _asked(spark, d).withColumn("k", k).select("query_id", "video", "scene_id", "k.hits", F.round("k.frac", 6).alias("frac"))


def kw_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", "video", "scene_id", F.round(text.kw_ratio(text.content_words(F.col("query_text")), F.col("subtitle")), 6).alias("ratio"))


def content_words(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("query_id", F.array_join(text.content_words(F.col("query_text")), " ").alias("words"))


def character_boost(spark: SparkSession, d: str) -> DataFrame:
    m = text.character_match(F.col("query_text"), F.col("subtitle"), list(CHARACTERS))
    return _asked(spark, d).select("query_id", "video", "scene_id", F.round(0.3 * m, 6).alias("boost"))


def keyword_bonus(spark: SparkSession, d: str) -> DataFrame:
    k = text.kw_overlap(F.col("query_text"), F.col("subtitle"))
    return _asked(spark, d).withColumn("k", k).select("query_id", "video", "scene_id", F.round(text.keyword_bonus(F.col("k.frac"), F.col("k.hits")), 6).alias("bonus"))


def calibrate(spark: SparkSession, d: str) -> DataFrame:
    raw = scores.raw_score(scores.clamp(F.col("hybrid_score")), scores.clamp(F.col("text_score")), F.lit(0.0))
    return candidates(spark, d).select("query_id", "video", "scene_id", F.round(scores.calibrate(raw), 6).alias("confidence"))


def temporal_iou(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).select("query_id", "video", "gt_start", "gt_end")
    c = candidates(spark, d).select("query_id", "video", "scene_id", "scene_start", "scene_end").join(g, ["query_id", "video"])
    return c.select("query_id", "video", "scene_id", F.round(scores.iou(F.col("scene_start"), F.col("scene_end"), F.col("gt_start"), F.col("gt_end")), 6).alias("iou"), text.status(F.round(scores.iou(F.col("scene_start"), F.col("scene_end"), F.col("gt_start"), F.col("gt_end")), 6)).alias("status"))


def fmt_time(spark: SparkSession, d: str) -> DataFrame:
    return scenes(spark, d).select("video", "scene_id", text.fmt_time(F.col("scene_start")).alias("begins"), text.fmt_time(F.col("scene_end")).alias("ends"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return scenes(spark, d).select("video", "scene_id", F.col("scene_start").alias("s"), F.col("scene_end").alias("e"))


def subtitle_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_join(_spans(spark, d), lines(spark, d)).select("video", "scene_id", "line_no")


def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    return intervals.concat_lines(_spans(spark, d), ["video", "scene_id"], lines(spark, d)).select("video", "scene_id", "line_text")


def silent_scene_fill(spark: SparkSession, d: str) -> DataFrame:
    return scenes(spark, d).select("video", "scene_id", text.embed_text(F.col("subtitle")).alias("embed_text"))


def scene_numbering(spark: SparkSession, d: str) -> DataFrame:
    return timeline.number_scenes(scenes(spark, d), "video", "scene_start", "scene_id").select("video", "scene_id", "number")


def scene_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Scenes cut where the pause before a subtitle line is longer than four seconds; the pause stands in for a frame's change."""
    f = timeline.pauses(lines(spark, d), "video", "line_no", "ls", "le")
    return timeline.scene_bounds(f, "video", "line_no", "ls", "pause", 4.0)


def keyframe_times(spark: SparkSession, d: str) -> DataFrame:
    t = timeline.keyframe_times(F.col("scene_start"), F.col("scene_end"))
    return scenes(spark, d).select("video", "scene_id", F.posexplode(t).alias("i", "t")).withColumn("t", F.round("t", 6))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return scenes(spark, d).groupBy("video").agg(F.max("scene_end").alias("duration"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).join(_durations(spark, d), "video")
    return timeline.search_window(g, "gt_start", "gt_end", "duration")


def sliding_bins(spark: SparkSession, d: str) -> DataFrame:
    b = timeline.sliding_bins(_windows(spark, d))
    return b.select("query_id", "i", F.round("b_s", 6).alias("b_s"), F.round("b_e", 6).alias("b_e"))


def bin_subtitle_join(spark: SparkSession, d: str) -> DataFrame:
    b = timeline.sliding_bins(_windows(spark, d)).select("query_id", "video", "i", F.col("b_s").alias("s"), F.col("b_e").alias("e"))
    return intervals.concat_lines(b, ["query_id", "video", "i"], lines(spark, d)).select("query_id", "i", "line_text")


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """A curve for each video: the clamped text score of its scenes in order."""
    s = _scored(spark, d).select("video", "scene_id", F.round("text_score", 6).alias("score"))
    return timeline.number_scenes(s, "video", "scene_id").withColumnRenamed("number", "i")


def frame_pool_max_mean(spark: SparkSession, d: str) -> DataFrame:
    """Bins of ten scenes, pooled by the greatest and by the mean of their clamped scores."""
    c = _curve(spark, d).groupBy("video", F.floor(F.col("i") / 10).alias("bin")).agg(F.max("score").alias("pooled_max"), F.avg("score").alias("m"))
    return c.select("video", "bin", "pooled_max", F.round("m", 6).alias("pooled_mean"))


def smooth_scores(spark: SparkSession, d: str) -> DataFrame:
    return timeline.smooth(_curve(spark, d), ["video"], "i", "score").select("video", "i", F.round("smoothed", 6).alias("smoothed"))


def peak_expand(spark: SparkSession, d: str) -> DataFrame:
    c = timeline.smooth(_curve(spark, d), ["video"], "i", "score").withColumn("v", F.round("smoothed", 6))
    c = c.withColumn("b_s", F.col("i") * 0.5).withColumn("b_e", F.col("i") * 0.5 + 2)
    return timeline.expand_peaks(c, ["video"], "i", "v", "b_s", "b_e").select("video", F.col("peak"), "peak_at", "left_at", "right_at", "s", "e")


def min_max_span(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d).select("query_id", "lo", "hi", F.col("gt_start").alias("s"), F.col("gt_end").alias("e"), "duration")
    w = timeline.inside(timeline.at_most(timeline.at_least(timeline.pad(w)), 35.0))
    return w.select("query_id", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


def _gold_spans(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("query_id", "query_text", "video", F.col("gt_start").alias("s"), F.col("gt_end").alias("e"))


def snap_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return intervals.snap(_gold_spans(spark, d), ["query_id", "video"], lines(spark, d), 3.0).select("query_id", "s", "e")


def expand_keywords(spark: SparkSession, d: str) -> DataFrame:
    return intervals.widen_by_keywords(_gold_spans(spark, d), ["query_id", "video"], "query_text", lines(spark, d), 8.0).select("query_id", "s", "e")


def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("query_id", "video", "scene_id", "scene_start", "scene_end", F.round("hybrid_score", 6).alias("score"))
    return islands.merge_spans(c, ["query_id", "video"], "scene_start", "scene_end", "score", ["scene_id"], 20.0)


def final_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*[F.desc(F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))) for c in ("hybrid_score", "text_score", "image_score")], "video", "scene_id")
    return candidates(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 20").select("query_id", "place", "video", "scene_id")


def _as_results(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("query_id", "rank_pos", "video", F.col("scene_start").alias("s"), F.col("scene_end").alias("e"), scores.calibrate(scores.clamp(F.col("hybrid_score"))).alias("confidence"))


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return ev.evaluate(gold(spark, d), _as_results(spark, d)).select("query_id", "query_type", "top1_video", "top1_correct", "top1_iou", "topk_hit", "best_iou_k", "best_pred_k", "gt", "confidence")


def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(ev.evaluate(gold(spark, d), _as_results(spark, d)))


def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("frames"), F.lit(0))
    return scenes(spark, d).agg(
        F.count("*").alias("n_scenes"), F.min(n).alias("min_frames"), F.round(F.avg(n), 6).alias("mean_frames"), F.max(n).alias("max_frames"), F.sum(n).alias("sum_frames"),
        F.count_if(F.length(text.strip(F.coalesce("subtitle", F.lit("")))) > 0).alias("with_subtitle"),
    )


def list_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lists as JSON and back, and a list joined with blanks."""
    s = scenes(spark, d).select("video", "scene_id", "audio_events", F.to_json("frames").alias("frames_json"))
    back = F.from_json("frames_json", "array<string>")
    return s.select("video", "scene_id", F.size(F.coalesce(back, F.array().cast("array<string>"))).alias("n_frames"), F.coalesce(F.array_join("audio_events", " "), F.lit("")).alias("event_text"))


def fuzzy_name_match(spark: SparkSession, d: str) -> DataFrame:
    """Each video's subtitle file, of files named after shows and after all videos."""
    v = table(spark, d, "segments").select(F.regexp_replace("video", r"\.[^.]+$", "").alias("name")).distinct()
    shows = v.select(F.regexp_replace("name", r" S\d+E\d+$", "").alias("name")).distinct()
    files = shows.unionByName(v).distinct().select("name", F.concat(F.lit("subs/"), "name", F.lit(".srt")).alias("path"))
    return intervals.match_names(v, files)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    s, v = scenes(spark, d), scene_vectors(spark, d)
    r = search(query_vectors(spark, d, s, v), searchable(spark, d, s, v), SETTINGS)
    return r.select("query_id", "rank_pos", "video", "scene_id", F.round("hybrid_score", 6).alias("hybrid_score"), F.round("text_score", 6).alias("text_score"), F.round("image_score", 6).alias("image_score"), F.round("audio_score", 6).alias("audio_score"), "query_type")


def _points(spark: SparkSession, d: str, q: DataFrame, found: DataFrame, s: DataFrame, v: DataFrame, block: int = 2048) -> DataFrame:
    """``query_id, video, t, image_sim, audio_sim`` of the scenes around each candidate: a grid with one frame and one sound in the middle of each scene.

    Queries are taken in blocks; of a block, the pairs with scenes go to the vectors, and both products are taken in one pass."""
    import pyarrow as pa

    at = s.select("video", "scene_id", ((F.col("scene_start") + F.col("scene_end")) / 2).alias("ls")).withColumn("le", F.col("ls"))
    win = found.select("query_id", "video", (F.col("scene_start") - 15.0).alias("s"), (F.col("scene_end") + 15.0).alias("e"))
    pairs = cut_lineage(intervals.overlap_join(win, at).select("query_id", "video", "scene_id", F.col("ls").alias("t")).distinct())
    few = pairs.count() <= FEW
    parts = []
    for rows in query_blocks(q.select("query_id", "image_vec", "audio_vec"), "query_id", block):
        ids = np.array([r.query_id for r in rows])
        units = [vectors.unit(vectors.matrix(pa.array([r[c] for r in rows], pa.list_(pa.float32())), next((len(r[c]) for r in rows if r[c] is not None), 1))) for c in ("image_vec", "audio_vec")]
        box = spark.sparkContext.broadcast((ids, units))

        def sims(batches, box=box):  # noqa: ANN001, ANN202
            ids, units = box.value
            for b in batches:
                at = np.searchsorted(ids, b.column(0).to_numpy(zero_copy_only=False))
                got = [np.einsum("ij,ij->i", vectors.unit(vectors.matrix(b.column(3 + i), u.shape[1])).astype(np.float64), u[at].astype(np.float64)) for i, u in enumerate(units)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, got)], ["query_id", "video", "t", "image_sim", "audio_sim"])

        mine = pairs.where(F.col("query_id").isin(ids.tolist())) if len(rows) < 100 else pairs.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "query_id int")), "query_id")
        near = v.select("video", "scene_id", "image_vec", "audio_vec").join(F.broadcast(mine) if few else mine, ["video", "scene_id"])
        parts.append(near.select("query_id", "video", "t", "image_vec", "audio_vec").mapInArrow(sims, "query_id int, video string, t double, image_sim double, audio_sim double"))
    if not parts:
        return spark.createDataFrame([], "query_id int, video string, t double, image_sim double, audio_sim double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, subtitle lines, points) of all queries: each table is prepared once."""
    s, v = scenes(spark, d), scene_vectors(spark, d)
    q = cut_lineage(query_vectors(spark, d, s, v))
    r = search(q, searchable(spark, d, s, v), SETTINGS)
    length = s.groupBy("video").agg(F.max("scene_end").alias("duration"))
    found = cut_lineage(r.join(s.select("video", "scene_id", "scene_start", "scene_end", "subtitle"), ["video", "scene_id"]).join(length, "video"))
    return found, lines(spark, d), _points(spark, d, q, found, s, v)


def refined_spans(spark: SparkSession, d: str) -> DataFrame:
    r = rf.refine(*_found(spark, d), settings=SETTINGS)
    return r.select("query_id", "video", "scene_id", *[F.round(c, 4).alias(c) for c in ("refined_start", "refined_end", "grounding_conf")])


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    return rf.ground(*_found(spark, d), settings=SETTINGS)


def ground(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d).select("query_id", "rank_pos", "video", "scene_id", "merged", *[F.round(c, 4).alias(c) for c in ("refined_start", "refined_end", "span_seconds", "grounding_conf", "keyword_bonus", "raw_score", "confidence")])


def evaluate(spark: SparkSession, d: str) -> DataFrame:
    g = _grounded(spark, d).select("query_id", "rank_pos", "video", F.col("refined_start").alias("s"), F.col("refined_end").alias("e"), "confidence")
    return ev.summary(ev.evaluate(gold(spark, d), g))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        vector_topk, vector_clamped_scores, l2_normalize, mean_pool_vectors, label_topk, vector_failures, minmax_global, minmax_by_query, hybrid_fusion, hybrid_fusion_no_audio, query_classify,
        kw_overlap, kw_ratio, content_words, character_boost, keyword_bonus, calibrate, temporal_iou, fmt_time, subtitle_overlap_join, ordered_concat, silent_scene_fill, scene_numbering, scene_boundaries,
        keyframe_times, sliding_bins, bin_subtitle_join, frame_pool_max_mean, smooth_scores, peak_expand, min_max_span, snap_boundaries, expand_keywords, merge_spans, final_rank, eval_rows, eval_rollup,
        segment_stats, list_columns, fuzzy_name_match, hybrid_search, refined_spans, ground, evaluate,
    ]
    return {f.__name__: f for f in named}
