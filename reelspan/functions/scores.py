"""Score functions: clamping, min-max, fusion weights, calibration, overlap of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.operators.prefix import join_by

#: A range of values not wider than this is flat.
FLAT = 1e-8


def clamp(c: Column) -> Column:
    """Not below 0; null and NaN are 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)))


def scaled(x: Column, low: Column, high: Column) -> Column:
    """``x`` in its range as a share; 0 where the range is flat."""
    return F.when(high - low > FLAT, (x - low) / (high - low)).otherwise(0.0)


def minmax(df: DataFrame, cols: list[str], by: list[str] = (), suffix: str = "_norm") -> DataFrame:
    """``df`` with each of ``cols`` scaled to its range in the group, or in the whole table without ``by``.

    The ranges are aggregated, partly before the exchange, and joined back; there is no window over a group or the
    table. Null values stay out of the range and stay null; NaN counts as 0 after ``clamp``, which the caller applies.
    """
    by = list(by)
    ranges = df.groupBy(*by).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    wide = join_by(df, ranges, by) if by else df.crossJoin(F.broadcast(ranges))
    out = wide.withColumns({c + suffix: F.when(F.col(c).isNotNull(), scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))) for c in cols})
    return out.drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def weights_of(label: Column, weights: dict[str, tuple[float, float, float]]) -> Column:
    """struct(text, image, audio) of a query class; a class without weights has those of ``mixed``."""
    w = lambda k: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(weights[k], ("text", "image", "audio"))])
    out = F.when(F.lit(False), w("mixed"))
    for k in weights:
        if k != "mixed":
            out = out.when(label == k, w(k))
    return out.otherwise(w("mixed"))


def without_audio(text: Column, image: Column) -> Column:
    """struct(text, image, audio) when there is no audio: the other two sum to 1; halves if they are 0."""
    s = text + image
    return F.struct(
        F.when(s > FLAT, text / s).otherwise(0.5).alias("text"), F.when(s > FLAT, image / s).otherwise(0.5).alias("image"), F.lit(0.0).alias("audio")
    )


def calibrate(raw: Column, floor: float = 0.10, ceiling: float = 0.70) -> Column:
    """The raw score between floor and ceiling as a share, from 0 to 1."""
    if not ceiling > floor:
        raise ValueError("the ceiling must be above the floor")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - floor) / (ceiling - floor)))


def raw_score(hybrid: Column, grounding: Column, bonus: Column, weights: tuple[float, float, float] = (0.50, 0.40, 0.10)) -> Column:
    return weights[0] * hybrid + weights[1] * grounding + weights[2] * bonus


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two spans by the hull of both."""
    inter = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return inter / F.greatest(F.lit(FLAT), F.greatest(a_end, b_end) - F.least(a_start, b_start))
