"""One ranking from several differently scaled scores, by leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.prefix import MOST, by_size, join_by, running_total
from reelspan.session import cut_lineage

#: Percentiles are whole millionths in 0..STEPS-1; places closer than that are equal.
STEPS = 1_000_000


def _percentile(below: Column, same: Column, all_: Column) -> Column:
    """The place of a value, in whole millionths."""
    return F.least(F.floor((below + same / 2) / all_ * STEPS), F.lit(STEPS - 1))


def _in_one_task(items: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """Adds ``<score>_pct``, by windows over groups that one task may hold."""
    whole = Window.partitionBy(group)
    for s in scores:
        v = F.col(s)
        below, same, all_ = F.rank().over(whole.orderBy(v.asc_nulls_last())) - 1, F.count(v).over(Window.partitionBy(group, s)), F.count(v).over(whole)
        flat = F.min(v).over(whole) == F.max(v).over(whole)
        items = items.withColumn(f"{s}_pct", F.when(flat, STEPS // 2).when(v.isNotNull(), _percentile(below, same, all_)).cast("bigint"))
    return items


def _by_values(items: DataFrame, group: str, scores: list[str], salts: int = 16) -> DataFrame:
    """Adds ``<score>_pct`` in large groups: values are counted per distinct (group, score, value) before anything is ordered, so that ties
    are one row, and come back by a salted join, so that the items of one value are spread; missing values do not take part in it."""
    for s in scores:
        values = cut_lineage(items.where(F.col(s).isNotNull()).groupBy(group, F.col(s).alias("_v")).agg(F.count("*").alias("_n")))
        place = running_total(values, [group], "_v", "_n")
        flat = cut_lineage(place.where(F.col("_n") == F.col("group_total")).select(group, F.lit(True).alias("_flat")))
        place = place.select(group, "_v", _percentile(F.col("total_before"), F.col("_n"), F.col("group_total")).alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        known = items.where(F.col(s).isNotNull()).withColumn("_v", F.col(s)).withColumn("_salt", F.pmod(F.xxhash64(*items.columns), F.lit(salts)).cast("int"))
        known = join_by(known, place, [group, "_v", "_salt"]).drop("_v", "_salt")
        items = known.unionByName(items.where(F.col(s).isNull()).withColumn("_p", F.lit(None).cast("bigint")))
        items = join_by(items, flat, [group], "left", small=True).withColumn(f"{s}_pct", F.when(F.col("_flat"), STEPS // 2).otherwise(F.col("_p")).cast("bigint")).drop("_flat", "_p")
    return items


def leximin_rank(items: DataFrame, group: str, keys: list[str], scores: list[str], most: int = MOST) -> DataFrame:
    """``group, *keys, <score>_pct, leximin, rank_pos``: items of each group ordered so that the weakest score counts first.

    ``<score>_pct`` is the share of the group's values below an item's plus half of its equals, in whole millionths: places closer than
    that are equal. Null and NaN have none, but the middle where the group has one value only: it tells nothing of anybody.
    An item's percentiles are sorted ascending and compared as arrays, the larger being better, so a high score cannot
    make up for a low one. A missing score takes the mean of the item's other percentiles, or the middle if it has
    none: it counts neither for nor against. Items with equal arrays are ordered by ``keys``. Repeated items
    (same group and keys) count once. Groups of at most ``most`` rows are ranked whole after one exchange; larger ones by ranges,
    so a group of any size and any number of equal scores is spread.
    """
    clean = [F.when(~F.isnan(x), x + 0.0).alias(s) for s in scores for x in [F.col(s).cast("double")]]
    box = dict(zip([group, *keys], ["_g", *[f"_k{i}" for i in range(len(keys))]]))  # names that no other column has
    rows = items.select(*[F.col(c).alias(n) for c, n in box.items()], *clean)
    small, large = by_size(rows, ["_g"], most)
    ids = list(box.values())

    def arrays(df: DataFrame) -> DataFrame:
        cols = [F.col(f"{s}_pct") for s in scores]
        known = F.filter(F.array(*cols), lambda x: x.isNotNull())
        mean = F.when(F.size(known) > 0, F.floor(F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(known))).otherwise(STEPS // 2)
        return df.withColumn("leximin", F.array_sort(F.array(*[F.coalesce(c, mean) for c in cols]))).drop(*scores)

    # partitioned by the group once: what follows needs no other exchange
    out = arrays(_in_one_task(small.repartition("_g").dropDuplicates(ids), "_g", scores))
    out = out.withColumn("rank_pos", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("leximin"), *ids[1:])).cast("bigint"))
    if large is not None:
        own = cut_lineage(arrays(_by_values(large.dropDuplicates(ids), "_g", scores)).withColumn("_worse", F.transform("leximin", lambda x: -x)).withColumn("_one", F.lit(1)))
        ranked = running_total(own, ["_g"], "_worse", "_one", ties=ids[1:], most=most)
        out = out.unionByName(ranked.withColumn("rank_pos", (F.col("total_before") + 1).cast("bigint")).drop("_worse", "_one", "total_before", "group_total"))
    return out.select(*[F.col(n).alias(c) for c, n in box.items()], *[f"{s}_pct" for s in scores], "leximin", "rank_pos")


def top_of_each(ranked: DataFrame, wanted: DataFrame, group: str, limit: str) -> DataFrame:
    """Rows of ``ranked`` whose ``rank_pos`` is at most ``limit`` of their group in ``wanted``; a null limit wants none."""
    w = wanted.groupBy(F.col(group).alias("_g")).agg(F.max(limit).alias("_limit"))
    return ranked.join(w, (F.col(group) == F.col("_g")) & (F.col("rank_pos") <= F.col("_limit"))).drop("_g", "_limit")
