"""Bins over time, smoothing, peaks, and the bounds of a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.prefix import MOST, attach, by_size, join_by, running_total


def search_window(df: DataFrame, start: str, end: str, duration: str, expand: float = 15.0) -> DataFrame:
    """Adds ``lo`` and ``hi``: the span with ``expand`` seconds on both sides, inside the video."""
    return df.withColumn("lo", F.greatest(F.lit(0.0), F.col(start) - expand)).withColumn("hi", F.least(F.col(duration), F.col(end) + expand))


def sliding_bins(df: DataFrame, size: float = 2.0, stride: float = 0.5) -> DataFrame:
    """Explodes ``lo, hi`` into bins ``i, b_s, b_e``, one each ``stride`` seconds, cut at ``hi``; an empty window has none."""
    n = F.ceil((F.col("hi") - F.col("lo")) / stride).cast("int")
    rows = df.where("hi > lo").withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    rows = rows.withColumn("b_s", F.col("lo") + F.col("i") * stride).where("b_s < hi")
    return rows.withColumn("b_e", F.least(F.col("b_s") + size, F.col("hi")))


def frame_times(start: Column, end: Column, n: int) -> Column:
    """Array of ``n`` times evenly from 15 % to 85 % of a bin; of one, 15 %."""
    fraction = lambda i: 0.15 + 0.70 * i / (n - 1) if n > 1 else F.lit(0.15)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + fraction(i.cast("double")) * (end - start))


def keyframe_times(start: Column, end: Column, fractions: tuple[float, ...] = (0.10, 0.30, 0.50, 0.70, 0.90)) -> Column:
    return F.transform(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: start + f * (end - start))


def smooth(df: DataFrame, by: list[str], order: str, value: str, window: int = 5, out: str = "smoothed", most: int = MOST) -> DataFrame:
    """Adds the moving sum over ``window`` rows by ``window``, zeros beyond the ends; a shorter series stays.

    A curve of more than ``most`` rows is not held by one task: its rows are numbered by ranges, and each is added to its neighbours' sums.
    """
    small, large = by_size(df, by, most)
    before, after = window // 2, (window - 1) // 2
    w = Window.partitionBy(*by).orderBy(order)
    moved = F.sum(value).over(w.rowsBetween(-before, after)) / window
    got = small.withColumn(out, F.when(F.count(F.lit(1)).over(Window.partitionBy(*by)) >= window, moved).otherwise(F.col(value)))
    if large is None:
        return got
    rows = running_total(large.withColumn("_one", F.lit(1)), by, order, "_one", most=most).withColumnRenamed("total_before", "_at")
    parts = rows.select(*by, F.explode(F.sequence(F.col("_at") - after, F.col("_at") + before)).alias("_at"), F.col(value).alias("_v"))
    sums = parts.groupBy(*by, "_at").agg((F.sum("_v") / window).alias("_moved"))
    rows = join_by(rows, sums, [*by, "_at"])
    return got.unionByName(rows.withColumn(out, F.when(F.col("group_total") >= window, F.col("_moved")).otherwise(F.col(value))).drop("_one", "_at", "group_total", "_moved"))


def expand_peaks(df: DataFrame, by: list[str], order: str, score: str, start: str, end: str, least: float = 0.25, share: float = 0.5) -> DataFrame:
    """One row for each curve: ``peak``, ``peak_at`` (the first, if several), ``left_at``, ``right_at`` and their times ``s, e``.

    The peak grows on both sides while the neighbour is at least ``max(least, share * peak)``. Everything is an aggregate, so that a
    curve of any length is added up where its rows are.
    """
    at = F.col(order)
    top = df.groupBy(*by).agg(F.max_by(F.struct(at.alias("at"), F.col(score).alias("v")), F.struct(score, -at)).alias("_p"))
    rows = attach(df, top, by)
    under = F.col(score) < F.greatest(F.lit(least), share * F.col("_p.v"))
    edges = rows.groupBy(*by).agg(
        F.any_value("_p").alias("_p"),
        F.coalesce(F.max(F.when(under & (at < F.col("_p.at")), at)) + 1, F.min(at)).alias("left_at"),
        F.coalesce(F.min(F.when(under & (at > F.col("_p.at")), at)) - 1, F.max(at)).alias("right_at"),
    )
    edges = edges.select(*by, F.col("_p.v").alias("peak"), F.col("_p.at").alias("peak_at"), "left_at", "right_at")
    rows = attach(df.select(*by, at.alias("_o"), F.col(start).alias("_s"), F.col(end).alias("_e")), edges, by)
    return rows.groupBy(*by, "peak", "peak_at", "left_at", "right_at").agg(F.max(F.when(F.col("_o") == F.col("left_at"), F.col("_s"))).alias("s"), F.max(F.when(F.col("_o") == F.col("right_at"), F.col("_e"))).alias("e"))


def pad(df: DataFrame, seconds: float = 3.0) -> DataFrame:
    """``s, e`` with ``seconds`` on both sides, inside ``lo, hi``."""
    return df.withColumn("s", F.greatest("lo", F.col("s") - seconds)).withColumn("e", F.least("hi", F.col("e") + seconds))


def at_least(df: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Spans shorter than ``seconds`` padded evenly inside ``lo, hi``; what is still missing is added on the free side."""
    short = F.col("e") - F.col("s") < seconds
    half = (seconds - (F.col("e") - F.col("s"))) / 2
    df = df.withColumn("_s", F.when(short, F.greatest("lo", F.col("s") - half)).otherwise(F.col("s"))).withColumn("_e", F.when(short, F.least("hi", F.col("e") + half)).otherwise(F.col("e")))
    still = short & (F.col("_e") - F.col("_s") < seconds)
    at_lo = F.col("_s") <= F.col("lo")
    df = df.withColumn("e", F.when(still & at_lo, F.least(F.col("hi"), F.col("_s") + seconds)).otherwise(F.col("_e")))
    return df.withColumn("s", F.when(still & ~at_lo, F.greatest(F.col("lo"), F.col("_e") - seconds)).otherwise(F.col("_s"))).drop("_s", "_e")


def at_most(df: DataFrame, seconds: float, lo: str | float = "lo", hi: str = "hi") -> DataFrame:
    """Spans longer than ``seconds`` cut around their middle, inside ``lo, hi``."""
    long = F.col("e") - F.col("s") > seconds
    mid = (F.col("s") + F.col("e")) / 2
    low = F.col(lo) if isinstance(lo, str) else F.lit(lo)
    df = df.withColumn("_s", F.when(long, F.greatest(low, mid - seconds / 2)).otherwise(F.col("s")))
    return df.withColumn("e", F.when(long, F.least(F.col(hi), mid + seconds / 2)).otherwise(F.col("e"))).withColumn("s", F.col("_s")).drop("_s")


def inside(df: DataFrame) -> DataFrame:
    """The start from 0 to ``hi``, the end from the start to ``hi``."""
    df = df.withColumn("s", F.least(F.greatest(F.lit(0.0), F.col("s")), F.col("hi")))
    return df.withColumn("e", F.least(F.greatest(F.col("s"), F.col("e")), F.col("hi")))


def scene_bounds(frames: DataFrame, video: str, order: str, time: str, score: str, threshold: float = 27.0, most: int = MOST) -> DataFrame:
    """Scenes of a table of frame scores: a frame over the ``threshold`` begins a scene; ``video, scene_id, s, e``.

    ``e`` is the begin of the next scene, of the last one its last frame's time. Scenes are numbered from 0. Cuts are counted by
    ``running_total``, so a video of any length is not held by one task.
    """
    rows = frames.withColumn("_over", (F.coalesce(F.col(score), F.lit(0.0)) > threshold).cast("int"))
    rows = attach(rows, rows.groupBy(video).agg(F.min(order).alias("_first")), [video])
    rows = rows.withColumn("_over", F.when(F.col(order) == F.col("_first"), 0).otherwise(F.col("_over")))
    cut = running_total(rows, [video], order, "_over", most=most).withColumn("_cut", (F.col("total_before") + F.col("_over")).cast("int"))
    scenes = cut.groupBy(video, "_cut").agg(F.min(time).alias("s"), F.max(time).alias("_last"))
    after = scenes.select(video, (F.col("_cut") - 1).alias("_cut"), F.col("s").alias("_next"))
    return join_by(scenes, after, [video, "_cut"], "left").select(video, F.col("_cut").alias("scene_id"), "s", F.coalesce("_next", "_last").alias("e"))


def number_scenes(df: DataFrame, video: str, *order: str, most: int = MOST) -> DataFrame:
    """Adds ``number``: the scene's place in its video by ``order``, from 0."""
    rows = running_total(df.withColumn("_one", F.lit(1)), [video], order[0], "_one", list(order[1:]), most=most)
    return rows.withColumn("number", F.col("total_before").cast("int")).drop("_one", "total_before", "group_total")


def pauses(df: DataFrame, video: str, order: str, start: str, end: str, most: int = MOST) -> DataFrame:
    """Adds ``pause``: from the end of the row before, by ``order``, to a row's start; 0 for the first."""
    rows = number_scenes(df, video, order, most=most)
    last = rows.select(video, (F.col("number") + 1).alias("number"), F.col(end).alias("_end"))
    return join_by(rows, last, [video, "number"], "left").withColumn("pause", F.coalesce(F.col(start) - F.col("_end"), F.lit(0.0))).drop("number", "_end")
