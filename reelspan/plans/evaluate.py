"""Evaluation of grounded spans against annotated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions.scores import iou
from reelspan.functions.text import cut, fmt_time


def evaluate(gold: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each gold query: how its first result and the best of its results meet the annotated span.

    ``gold``: ``query_id, query_text, video, gt_start, gt_end, query_type``; ``results``: ``query_id, rank_pos, video, s, e,
    confidence``. A query without results has no hit and an overlap of 0; a best overlap of 0 has no span (``N/A``).
    """
    g = gold.select("query_id", "query_text", "query_type", F.col("video").alias("gt_video"), "gt_start", "gt_end").dropDuplicates(["query_id"])
    r = results.select("query_id", "rank_pos", F.col("video").alias("p_video"), "s", "e", "confidence")
    both = g.join(r, "query_id", "left")
    same = F.coalesce(F.col("p_video") == F.col("gt_video"), F.lit(False))
    over = F.when(same, iou(F.col("s"), F.col("e"), F.col("gt_start"), F.col("gt_end"))).otherwise(0.0)
    span = lambda a, b: F.concat(fmt_time(a), F.lit("-"), fmt_time(b))
    rows = both.withColumn("_same", same.cast("int")).withColumn("_iou", over)
    top = F.min_by(F.struct("p_video", "s", "e", "confidence", "_same", "_iou"), "rank_pos")
    best = F.max_by(F.struct("s", "e", "_iou"), F.struct("_iou", -F.col("rank_pos")))
    out = rows.groupBy("query_id", "query_text", "query_type", "gt_video", "gt_start", "gt_end").agg(top.alias("t"), best.alias("b"), F.max("_same").alias("topk_hit"))
    hit = F.coalesce(F.col("b._iou"), F.lit(0.0)) > 0
    return out.select(
        "query_id", cut(F.col("query_text"), 55).alias("query_text"), "query_type", "gt_video", span(F.col("gt_start"), F.col("gt_end")).alias("gt"), F.round(F.col("gt_end") - F.col("gt_start"), 2).alias("gt_span"),
        span(F.col("t.s"), F.col("t.e")).alias("pred"), F.round(F.col("t.e") - F.col("t.s"), 2).alias("pred_span"), F.col("t.p_video").alias("top1_video"), F.coalesce("t._same", F.lit(0)).alias("top1_correct"),
        F.round(F.coalesce("t._iou", F.lit(0.0)), 4).alias("top1_iou"), F.coalesce("topk_hit", F.lit(0)).alias("topk_hit"), F.round(F.coalesce("b._iou", F.lit(0.0)), 4).alias("best_iou_k"),
        F.when(hit, span(F.col("b.s"), F.col("b.e"))).otherwise("N/A").alias("best_pred_k"), F.round("t.confidence", 4).alias("confidence"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """By query type and for all (``ALL``): number, means of overlap and hits, recall at 0.3 and 0.5; a null type is ``none``."""
    share = lambda c, t: F.round(F.avg((F.col(c) >= t).cast("int")), 4)
    out = rows.rollup("query_type").agg(
        F.count("*").alias("n"), F.round(F.avg("top1_correct"), 4).alias("top1_accuracy"), F.round(F.avg("topk_hit"), 4).alias("topk_recall"), F.round(F.avg("top1_iou"), 4).alias("mean_iou"),
        share("top1_iou", 0.3).alias("r1_03"), share("top1_iou", 0.5).alias("r1_05"), F.round(F.avg("best_iou_k"), 4).alias("mean_best_iou"), share("best_iou_k", 0.3).alias("rk_03"), share("best_iou_k", 0.5).alias("rk_05"), F.grouping("query_type").alias("_all"),
    )
    return out.withColumn("query_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.coalesce("query_type", F.lit("none")))).drop("_all")
