"""Running totals inside groups of any size, without one task per large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.session import cut_lineage

#: Rows of a group that one task may hold; larger groups are cut into ranges.
MOST = 100_000


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Joins on equal ``by``, null meeting null; ``right``'s own columns follow, its keys are dropped. ``small``: the right side is broadcast."""
    keys = [f"_right_{i}" for i in range(len(by))]
    other = right.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *[c for c in right.columns if c not in by])
    return left.join(F.broadcast(other) if small else other, [F.equal_null(F.col(c), F.col(k)) for c, k in zip(by, keys)], how).drop(*keys)


def attach(df: DataFrame, per: DataFrame, by: list[str], most: int = 200_000) -> DataFrame:
    """``df`` with the columns of ``per``, one row a group: broadcast up to ``most`` groups, so that a large group stays where it is."""
    per = cut_lineage(per)
    return join_by(df, per, by, small=per.limit(most + 1).count() <= most)


def by_size(df: DataFrame, by: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without the groups of more than ``most`` rows, and those, if there are any; at most one in ``most`` rows is such a group."""
    large = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by))
    if large.isEmpty():
        return df, None
    return join_by(df, large, by, "left_anti", True), join_by(df, large, by, "left_semi", True)


def in_ranges(df: DataFrame, by: list[str], order: list[str], bins: int) -> DataFrame:
    """Adds ``_bin``: the range of ``order`` in the group, of about ``bins``. For large groups, which are few. Written once.

    The bounds are those of a sample by hash, some 64 rows a range, so they only decide how even the ranges are. Rows equal in all of
    ``order`` share a range.
    """
    sizes = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("_n")))
    some = join_by(df.select(*by, F.struct(*order).alias("_at")), sizes, by, small=True).where(F.pmod(F.xxhash64("_at"), F.col("_n")) < 64 * bins)
    sample = some.groupBy(*by).agg(F.array_sort(F.collect_set("_at")).alias("_all"))
    every = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / bins).cast("int")))
    cuts = cut_lineage(sample.select(*by, every.alias("_cuts")))
    bin_ = F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.struct(*order))), F.lit(0))
    return cut_lineage(join_by(df, cuts, by, "left", small=True).withColumn("_bin", F.when(F.col("_cuts").isNull(), 0).otherwise(bin_)).drop("_cuts"))


def running_total(df: DataFrame, by: list[str], order: str, value: str, ties: list[str] = (), bins: int = 32, most: int = MOST) -> DataFrame:
    """Adds ``total_before`` (sum of ``value`` over the rows of the group ahead by ``order``, then ``ties``) and ``group_total``.

    A group of at most ``most`` rows is summed in one task. A larger one is cut into about ``bins`` ranges of ``order`` and ``ties``;
    the windows run inside a range, and the ranges' own totals, at most ``bins`` per group, give the offsets. So a group that holds a
    third of all rows is spread over ``bins`` tasks. ``value`` is not null; rows equal in ``order`` and ``ties`` share a range, so where
    many rows may be the same in both the caller aggregates them first. An empty table stays empty.
    """
    small, large = by_size(df, by, most)
    whole = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum(value).over(whole.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = small.withColumn("total_before", ahead).withColumn("group_total", F.sum(value).over(whole))
    if large is None:
        return out
    binned = in_ranges(large, by, [order, *ties], bins)
    w = Window.partitionBy(*by).orderBy("_bin")
    offsets = (
        binned.groupBy(*by, "_bin").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("group_total", F.sum("_sum").over(whole))
        .drop("_sum")
    )
    inside = Window.partitionBy(*by, "_bin").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    got = join_by(binned.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))), cut_lineage(offsets), [*by, "_bin"], small=True)
    return out.unionByName(got.withColumn("total_before", F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", "_bin"))
