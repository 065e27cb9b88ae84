"""Scenes and evaluation rows as files: CSV with JSON lists, Parquet by video, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions.text import embed_text, strip
from reelspan.schemas import SEGMENTS_CSV

LISTS = ("frames", "audio_events")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of a CSV file with a header: texts may hold line breaks, lists are JSON, invalid JSON is null.

    Columns are taken by name; those the file lacks (the audio columns of older files) are null, others are left out.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    out = raw
    for part in SEGMENTS_CSV.split(", "):
        name, kind = part.split()
        out = out.withColumn(name, F.col(f"`{name}`").cast(kind) if name in raw.columns else F.lit(None).cast(kind))
    for c in LISTS:
        out = out.withColumn(c, F.from_json(c, "array<string>"))
    return out.select(*[p.split()[0] for p in SEGMENTS_CSV.split(", ")])


def filled(segments: DataFrame) -> DataFrame:
    """As queries need them: no null text or list, and ``embed_text``."""
    none = F.array().cast("array<string>")
    out = segments.withColumns({"subtitle": F.coalesce("subtitle", F.lit("")), "frames": F.coalesce("frames", none), "audio_path": F.coalesce("audio_path", F.lit("")), "audio_events": F.coalesce("audio_events", none), "audio_event_text": F.coalesce("audio_event_text", F.lit(""))})
    return out.withColumn("embed_text", embed_text(F.col("subtitle")))


def write_csv(df: DataFrame, path: str) -> None:
    """Lists become JSON; the folder is replaced."""
    for c, kind in df.dtypes:
        if kind.startswith("array"):
            df = df.withColumn(c, F.to_json(c))
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def write_parquet(df: DataFrame, path: str) -> None:
    """One folder a video. Only the videos in ``df`` are replaced, so a run may go on where another ended."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stats(segments: DataFrame) -> DataFrame:
    """One row: scenes, frames a scene (least, mean, most, all), scenes with text. Null lists have no frames."""
    n = F.coalesce(F.size("frames"), F.lit(0))
    return segments.agg(
        F.count("*").alias("n_scenes"), F.min(n).alias("min_frames"), F.avg(n).alias("mean_frames"), F.max(n).alias("max_frames"), F.sum(n).alias("sum_frames"),
        F.count_if(F.length(strip(F.coalesce("subtitle", F.lit("")))) > 0).alias("with_subtitle"),
    )
