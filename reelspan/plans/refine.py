"""Temporal refinement and grounding of candidates, all of them at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.scores import calibrate, clamp, raw_score, scaled, weights_of
from reelspan.functions.text import content_words, keyword_bonus, kw_overlap, kw_ratio, norm_text
from reelspan.operators import intervals, islands, timeline
from reelspan.session import cut_lineage
from reelspan.settings import Settings

KEY = ["query_id", "video", "scene_id"]


def bag_cosine(query: Column, text: Column) -> Column:
    """Cosine of the sets of words of two texts: the text similarity where no encoder is at hand."""
    a, b = F.array_distinct(F.split(norm_text(query), " ")), F.array_distinct(F.split(norm_text(text), " "))
    return F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b))


def _apart(df: DataFrame) -> DataFrame:
    """The same rows. What comes after is planned by itself: merged, steps that use a column many times grow beyond any plan."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def points_of(frames: DataFrame, sounds: DataFrame) -> DataFrame:
    """``query_id, video, t, image_sim, audio_sim`` of the grids of frames and of sounds (``query_id, video, t, sim``)."""
    none = F.lit(None).cast("double")
    a = frames.select("query_id", "video", "t", F.col("sim").alias("image_sim"), none.alias("audio_sim"))
    return a.unionByName(sounds.select("query_id", "video", "t", none.alias("image_sim"), F.col("sim").alias("audio_sim")))


def _surrounded(candidates: DataFrame, lines: DataFrame, points: DataFrame, settings: Settings) -> DataFrame:
    """``candidates`` with their window ``lo, hi`` and what lies in it: arrays ``_lines`` and ``_points``, in order.

    Spans meet lines and points once, by video and time; a candidate's arrays are as long as its window. Lines are also those that
    snapping and widening can reach.
    """
    r = settings.refinement
    out = timeline.search_window(candidates, "scene_start", "scene_end", "duration", r.expand)
    reach = r.snap_tolerance + r.expand_max_extra
    win = out.where("hi > lo").select(*KEY, (F.col("lo") - reach).alias("s"), (F.col("hi") + reach).alias("e"))
    line = F.struct("line_no", "ls", "le", "line")
    point = F.struct("t", clamp_known("image_sim").alias("image_sim"), clamp_known("audio_sim").alias("audio_sim"))
    near = intervals.overlap_join(win, lines.select("video", "ls", "le", line.alias("_line"))).select(*KEY, "_line")
    # points are those of a query: the pair takes the place of the video
    pair = F.struct("query_id", "video").alias("video")
    at = points.select(pair, F.col("t").alias("ls"), F.col("t").alias("le"), point.alias("_point"))
    seen = intervals.overlap_join(win.select(pair, "scene_id", "s", "e"), at).select("video.query_id", "video.video", "scene_id", "_point")
    # candidates are few bytes and much work: in a stated number of tasks, which adaptive execution keeps; the join finds both sides by key
    n = max(candidates.sparkSession.sparkContext.defaultParallelism, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = near.unionByName(seen, allowMissingColumns=True).repartition(n, *KEY).groupBy(*KEY).agg(F.array_sort(F.collect_list("_line")).alias("_lines"), F.array_sort(F.collect_list("_point")).alias("_points"))
    return out.repartition(n, *KEY).join(both, KEY, "left")


def clamp_known(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), clamp(F.col(name)))


def _binned(candidates: DataFrame, lines: DataFrame, points: DataFrame, settings: Settings, text_similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """``candidates`` with the arrays ``_lines, _bins, _score`` and, of the bins, ``_s, _i, _a``: a candidate is one row, so nothing more is exchanged."""
    r = settings.refinement
    out = _apart(_surrounded(candidates, lines, points, settings))
    n = F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / r.stride)).cast("int")
    begins = F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("lo") + i * r.stride), lambda b: b < F.col("hi"))
    bins = F.transform(begins, lambda b: F.struct(b.alias("s"), F.least(b + r.bin_size, F.col("hi")).alias("e")))
    none = F.array().cast("array<struct<s:double,e:double>>")
    out = out.withColumn("_bins", F.when(F.col("hi") > F.col("lo"), bins).otherwise(none))
    text = lambda b: F.array_join(F.transform(F.filter("_lines", lambda x: (x["le"] >= b["s"]) & (x["ls"] <= b["e"])), lambda x: x["line"]), " ")
    out = out.withColumn("_texts", F.transform("_bins", lambda b: F.coalesce(text(b), F.lit(""))))
    out, words = _apart(out.withColumn("_words", content_words(F.col("query_text")))), F.col("_words")
    score = lambda sim, t: F.when(F.length(t) > 0, 0.75 * sim + 0.25 * kw_ratio(words, t)).otherwise(0.0)
    if getattr(text_similarity, "by_rows", False):  # an encoder, which takes no lambda's variable: distinct texts as rows, and back by their candidate
        rows = out.select(*KEY, "query_text", F.explode(F.array_distinct("_texts")).alias("_t")).where("_t <> ''")
        sims = rows.withColumn("_sim", text_similarity(F.col("query_text"), F.col("_t"))).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_sim"))).alias("_sims"))
        out = out.join(sims, KEY, "left")
        out = out.withColumn("_s", F.transform("_texts", lambda t: score(F.coalesce(F.try_element_at("_sims", t), F.lit(0.0)), t))).drop("_sims")
    else:
        out = out.withColumn("_s", F.transform("_texts", lambda t: score(text_similarity(F.col("query_text"), t), t)))

    def pooled(b: Column, name: str, greatest: Column) -> Column:
        some = F.filter(F.transform(F.filter("_points", lambda p: (p["t"] >= b["s"]) & (p["t"] <= b["e"])), lambda p: p[name]), lambda x: x.isNotNull())
        mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)
        return F.when(F.coalesce(F.size(some), F.lit(0)) == 0, 0.0).when(greatest, F.array_max(some)).otherwise(mean)

    out = out.withColumn("_i", F.transform("_bins", lambda b: pooled(b, "image_sim", F.col("query_type") == "action"))).withColumn("_a", F.transform("_bins", lambda b: pooled(b, "audio_sim", F.lit(True))))
    out = _apart(out).withColumn("_range", F.struct(*[f(c).alias(f"{n}{c}") for c in ("_s", "_i", "_a") for n, f in (("lo", F.array_min), ("hi", F.array_max))]))
    out = out.withColumn("_w", weights_of(F.col("query_type"), settings.retrieval.weights))
    norm = lambda x, c: scaled(x, F.col(f"_range.lo{c}"), F.col(f"_range.hi{c}"))
    two = F.zip_with("_s", "_i", lambda x, y: F.col("_w.text") * norm(x, "_s") + F.col("_w.image") * norm(y, "_i"))
    out = out.withColumn("_fused", F.zip_with(two, "_a", lambda x, y: x + F.col("_w.audio") * norm(y, "_a"))).drop("_range", "_w", "_texts", "_points", "_words")
    out = _apart(out)
    before, after, size = r.smooth_window // 2, (r.smooth_window - 1) // 2, F.size("_fused")
    moved = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.slice("_fused", F.greatest(i - before, F.lit(0)) + 1, i + after - F.greatest(i - before, F.lit(0)) + 1), F.lit(0.0), lambda a, x: a + x) / r.smooth_window)
    # nine digits, so that bins of equal score tie in whatever order they were added
    return out.withColumn("_score", F.transform(F.when(size >= r.smooth_window, moved).otherwise(F.col("_fused")), lambda x: F.round(x, 9))).drop("_fused")


def bin_scores(candidates: DataFrame, lines: DataFrame, frames: DataFrame, sounds: DataFrame | None = None, settings: Settings = Settings(), text_similarity: Callable[[Column, Column], Column] = bag_cosine) -> DataFrame:
    """The bins of every candidate with their smoothed score: ``KEY, i, b_s, b_e, lo, hi, s_raw, i_raw, a_raw, score``.

    ``candidates``: ``KEY, scene_start, scene_end, duration, query_text, query_type``; ``lines``: as from ``line_seconds``;
    ``frames``: ``query_id, video, t, sim`` similarities of frames on a grid; ``sounds``: ``query_id, video, t, sim`` likewise, or None where
    ``frames`` are points with both (see ``points_of``). A bin's text score is 0.75 of the similarity and 0.25 of the keyword share; its
    frames count by their greatest for action, else their mean; each is scaled to its range in the candidate's window.
    """
    points = frames if sounds is None else points_of(frames, sounds)
    out = _binned(candidates, lines, points, settings, text_similarity)
    rows = out.select(*KEY, "lo", "hi", F.posexplode(F.arrays_zip("_bins", "_s", "_i", "_a", "_score")).alias("i", "b"))
    return rows.select(*KEY, "i", F.col("b._bins.s").alias("b_s"), F.col("b._bins.e").alias("b_e"), "lo", "hi", F.col("b._s").alias("s_raw"), F.col("b._i").alias("i_raw"), F.col("b._a").alias("a_raw"), F.col("b._score").alias("score"))


def refine(candidates: DataFrame, lines: DataFrame, frames: DataFrame, sounds: DataFrame | None = None, settings: Settings = Settings(), text_similarity: Callable[[Column, Column], Column] = bag_cosine) -> DataFrame:
    """``candidates`` with ``refined_start, refined_end, grounding_conf``.

    The best bin grows while its neighbours reach half its score, at least 0.25; the span is padded, held between the
    least and the greatest length, moved out to line bounds and to lines with the query's words, and held again. A
    candidate without bins (its video has no duration) keeps its scene and its ``hybrid_score`` as confidence. ``frames`` and ``sounds``:
    as in ``bin_scores``. Lines and points are brought to their candidate once; the rest is done inside its row.
    """
    r = settings.refinement
    points = frames if sounds is None else points_of(frames, sounds)
    out = _apart(_binned(candidates, lines, points, settings, text_similarity))
    out = out.withColumn("_peak", F.array_max("_score")).withColumn("_at", (F.array_position("_score", F.col("_peak")) - 1).cast("int"))
    out = out.withColumn("_least", F.greatest(F.lit(0.25), 0.5 * F.col("_peak"))).withColumn("_low", F.filter(F.sequence(F.lit(0), F.size("_score") - 1), lambda i: F.get("_score", i) < F.col("_least")))
    left = F.coalesce(F.array_max(F.filter("_low", lambda i: i < F.col("_at"))) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter("_low", lambda i: i > F.col("_at"))) - 1, F.size("_score") - 1)
    out = _apart(out)
    spans = out.withColumn("s", F.get("_bins", left)["s"]).withColumn("e", F.get("_bins", right)["e"]).drop("_at", "_least", "_low", "_score", "_bins", "_s", "_i", "_a")
    spans = _apart(timeline.at_least(_apart(timeline.pad(_apart(spans))), r.min_span))
    spans = _apart(timeline.at_most(spans, r.max_span))
    t, most = r.snap_tolerance, r.expand_max_extra
    s, e = F.col("s"), F.col("e")
    starts = F.transform(F.filter("_lines", lambda x: (F.abs(x["ls"] - s) <= t) & (x["le"] <= e + t) & (x["le"] >= s - t)), lambda x: x["ls"])
    ends = F.transform(F.filter("_lines", lambda x: (F.abs(x["le"] - e) <= t) & (x["ls"] >= s - t) & (x["ls"] <= e + t)), lambda x: x["le"])
    spans = _moved(spans.withColumn("_lo", F.array_min(starts)).withColumn("_hi", F.array_max(ends)))
    spans, words = _apart(spans), content_words(F.col("query_text"))
    near = F.filter("_lines", lambda x: (x["le"] >= s - most) & (x["ls"] <= e + most) & F.exists(words, lambda w: F.contains(norm_text(x["line"]), w)))
    spans = _apart(spans.withColumn("_near", near))
    spans = _moved(spans.withColumn("_lo", F.array_min(F.transform("_near", lambda x: x["ls"]))).withColumn("_hi", F.array_max(F.transform("_near", lambda x: x["le"]))))
    spans = _apart(timeline.at_most(_apart(timeline.inside(_apart(spans))), r.max_span, 0.0, "duration"))
    some = F.col("_peak").isNotNull()
    got = spans.withColumn("refined_start", F.when(some, F.col("s")).otherwise(F.col("scene_start"))).withColumn("refined_end", F.when(some, F.col("e")).otherwise(F.col("scene_end"))).withColumn("grounding_conf", F.coalesce("_peak", "hybrid_score"))
    return got.select(*[c for c in candidates.columns if c not in ("refined_start", "refined_end", "grounding_conf")], "refined_start", "refined_end", "grounding_conf")


def _moved(spans: DataFrame) -> DataFrame:
    """``s, e`` out to ``_lo, _hi``, where there are any."""
    return spans.withColumn("s", F.least("s", F.coalesce("_lo", "s"))).withColumn("e", F.greatest("e", F.coalesce("_hi", "e")))


def score_spans(refined: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``span_seconds, retrieval_score, keyword_bonus, raw_score, confidence``."""
    p = settings.pipeline
    kw = kw_overlap(F.col("query_text"), F.col("subtitle"))
    out = refined.withColumn("span_seconds", F.col("refined_end") - F.col("refined_start")).withColumn("retrieval_score", F.col("hybrid_score")).withColumn("_kw", kw)
    out = out.withColumn("keyword_bonus", keyword_bonus(F.col("_kw.frac"), F.col("_kw.hits"))).drop("_kw")
    out = out.withColumn("raw_score", raw_score(F.col("hybrid_score"), F.col("grounding_conf"), F.col("keyword_bonus"), (p.hybrid_weight, p.grounding_weight, p.keyword_weight)))
    return out.withColumn("confidence", calibrate(F.col("raw_score"), p.calibrate_floor, p.calibrate_ceiling))


def merged_results(scored: DataFrame, gap: float) -> DataFrame:
    """Spans of a query and video that lie near each other as one, ranked: ``rank_pos`` by raw, grounding and retrieval score."""
    out = islands.merge_spans(cut_lineage(scored), ["query_id", "video"], "refined_start", "refined_end", "raw_score", ["scene_id"], gap)
    out = out.withColumn("span_seconds", F.col("refined_end") - F.col("refined_start"))
    w = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), F.desc("grounding_conf"), F.desc("retrieval_score"), "video", "scene_id")
    return out.withColumn("rank_pos", F.row_number().over(w))


def ground(candidates: DataFrame, lines: DataFrame, frames: DataFrame, sounds: DataFrame | None = None, settings: Settings = Settings(), merge_gap: float | None = None, text_similarity: Callable[[Column, Column], Column] = bag_cosine) -> DataFrame:
    """Refined, scored, merged and ranked spans of all candidates; one row each, ``rank_pos`` in its query."""
    gap = settings.retrieval.merge_gap if merge_gap is None else merge_gap
    return merged_results(score_spans(refine(candidates, lines, frames, sounds, settings, text_similarity), settings), gap)
