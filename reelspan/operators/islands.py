"""Merging spans that lie near each other, in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reelspan.operators.prefix import MOST, by_size, in_ranges, join_by
from reelspan.session import cut_lineage


def mark_islands(spans: DataFrame, by: list[str], start: str, end: str, ties: list[str], gap: float, bins: int = 16, most: int = MOST) -> DataFrame:
    """Adds ``island``: the (start, ties) of the first span of the run that a span belongs to.

    A span begins a run if it starts more than ``gap`` after everything before it has ended; a gap of exactly ``gap``
    merges. Spans are taken by ``start``, then ``ties``, which identify a span in its group. A group of more than ``most`` rows is cut
    into ranges of ``start``; the windows run inside a range, and what a range needs of those before (the greatest end, the last
    begin of a run) is one row a range. So no task holds a large group. Null bounds are not allowed.
    """
    small, large = by_size(spans, by, most)
    out = _marked(small.withColumn("_before", F.lit(None).cast("double")), by, start, end, ties, gap)
    out = out.withColumn("island", F.last("_mark", ignorenulls=True).over(_inner(by, start, ties).rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_mark")
    if large is None:
        return out
    rows, keys = in_ranges(large, by, [start, *ties], bins), [*by, "_bin"]
    ranges = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut_lineage(rows.groupBy(*keys).agg(F.max(end).cast("double").alias("_m")).withColumn("_before", F.max("_m").over(ranges)).drop("_m"))
    rows = _marked(join_by(rows, ends, keys, small=True), keys, start, end, ties, gap)
    marks = cut_lineage(rows.groupBy(*keys).agg(F.max("_mark").alias("_m")).withColumn("_carried", F.max("_m").over(ranges)).drop("_m"))
    last = F.last("_mark", ignorenulls=True).over(_inner(keys, start, ties).rowsBetween(Window.unboundedPreceding, 0))
    got = join_by(rows, marks, keys, small=True).withColumn("island", F.coalesce(last, "_carried"))
    return out.unionByName(got.drop("_bin", "_before", "_mark", "_carried"))


def _inner(keys: list[str], start: str, ties: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(start, *ties)


def _marked(rows: DataFrame, keys: list[str], start: str, end: str, ties: list[str], gap: float) -> DataFrame:
    """Adds ``_mark``, set where a run begins, by what ended in the group of ``keys`` and in ``_before``."""
    reached = F.greatest(F.col("_before"), F.max(end).over(_inner(keys, start, ties).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_reached", reached)
    begins = F.col("_reached").isNull() | (F.col(start) - F.col("_reached") > gap)
    return rows.withColumn("_mark", F.when(begins, F.struct(F.col(start).alias("at"), *ties))).drop("_reached")


def merge_spans(spans: DataFrame, by: list[str], start: str, end: str, score: str, ties: list[str], gap: float = 20.0) -> DataFrame:
    """One row for each run: the columns of its best span, with ``start`` and ``end`` of the run and ``merged``, its number of spans.

    The best span has the greatest ``score``, of equal ones the earliest start, then the least ``ties``. With a ``gap`` of
    0 or less nothing is merged (``merged`` is 1). Spans with a null bound stand alone.
    """
    if gap <= 0:
        return spans.withColumn("merged", F.lit(1).cast("bigint"))
    known = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    alone = spans.where(F.col(start).isNull() | F.col(end).isNull()).withColumn("merged", F.lit(1).cast("bigint"))
    rows = mark_islands(known, by, start, end, ties, gap)
    rest = [c for c in spans.columns if c not in (*by, start, end)]
    worse = F.struct((-F.nanvl(F.coalesce(F.col(score), F.lit(float("-inf"))), F.lit(float("-inf")))).alias("a"), F.col(start).alias("b"), *ties)
    runs = rows.groupBy(*by, "island").agg(
        F.min(start).alias("_s"), F.max(end).alias("_e"), F.min_by(F.struct(*rest), worse).alias("_best"), F.count(F.lit(1)).alias("merged")
    )
    out = runs.select(*by, F.col("_s").alias(start), F.col("_e").alias(end), "_best", "merged")
    return out.select(*[F.col(c) if c in (*by, start, end) else F.col(f"_best.`{c}`").alias(c) for c in spans.columns], "merged").unionByName(alone)
