"""Media files: discovery of videos and their subtitles, and decoders where the machine has them."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.operators.intervals import match_names
from reelspan.schemas import FRAME_SCORES

SUBTITLE_SUFFIXES = (".srt", ".ass", ".ssa")


def _files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, file, name`` of the files right under ``root`` with one of the suffixes, in any letter case; empty files are left out."""
    if root.startswith("/") and not os.path.isdir(root):
        raise FileNotFoundError(root)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root + "/*").select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    f = f.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("name", F.regexp_replace("file", r"\.[^.]+$", ""))
    return f.where(F.lower("file").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def list_videos(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".mkv", ".mp4", ".avi"), name_filter: str = "") -> DataFrame:
    """``video, name, path``, ordered by path; a folder without any raises FileNotFoundError."""
    v = _files(spark, root, suffixes).where(F.contains(F.lower("file"), F.lit(name_filter.lower()))).select(F.col("file").alias("video"), "name", "path").orderBy("path")
    if v.isEmpty():
        raise FileNotFoundError(f"no videos in {root}")
    return v


def find_subtitles(spark: SparkSession, videos: DataFrame, subtitle_root: str | None, video_root: str) -> DataFrame:
    """``video, path``: an equal name under ``subtitle_root``, else beside the video, ``.srt`` before ``.ass`` and ``.ssa``; else a
    similar name under ``subtitle_root``; else null."""
    found = []
    for place, root in enumerate(r for r in (subtitle_root, video_root) if r and (not r.startswith("/") or os.path.isdir(r))):
        found.append(_files(spark, root, SUBTITLE_SUFFIXES).withColumn("place", F.lit(place)))
    if not found:
        return videos.select("video", F.lit(None).cast("string").alias("path"))
    subs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    order = F.struct("place", F.when(F.lower("file").endswith(".srt"), 0).when(F.lower("file").endswith(".ass"), 1).otherwise(2).alias("k"), "path")
    exact = subs.groupBy("name").agg(F.min(order).alias("o")).select("name", F.col("o.path").alias("exact"))
    out = videos.select("video", "name").join(exact, "name", "left")
    if subtitle_root:
        fuzzy = match_names(videos.select("name"), subs.where("place = 0").select("name", "path")).withColumnRenamed("path", "fuzzy")
        return out.join(fuzzy, "name", "left").select("video", F.coalesce("exact", "fuzzy").alias("path"))
    return out.select("video", F.col("exact").alias("path"))


def load_wav(data: bytes) -> np.ndarray | None:
    """Samples from -1 to 1 of a 16-bit wave file, channels averaged; anything else is None."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768.0
            return x.reshape(-1, w.getnchannels()).mean(1) if w.getnchannels() > 1 else x
    except (wave.Error, EOFError, ValueError):
        return None


@F.pandas_udf(T.ArrayType(T.FloatType()))
def wav_samples(content: pd.Series) -> pd.Series:
    """Samples of a column of wave files; null where one can't be read."""
    return pd.Series([None if c is None else load_wav(bytes(c)) for c in content], dtype=object)


def ffmpeg() -> str | None:
    return shutil.which("ffmpeg")


def run_ffmpeg(args: list[str], least_bytes: int = 0, output: str | None = None) -> bytes | None:
    """Output of ffmpeg, or of the file it writes; None where it is missing, fails, or writes no more than ``least_bytes``."""
    if not ffmpeg():
        return None
    done = subprocess.run([ffmpeg(), "-hide_banner", "-loglevel", "error", "-y", *args], capture_output=True, check=False)
    if done.returncode:
        return None
    data = open(output, "rb").read() if output and os.path.exists(output) else done.stdout
    return data if len(data) > least_bytes else None


def scene_audio(video: str, start: float, end: float, rate: int = 16_000) -> bytes | None:
    """A wave file of a span, mono, 16 bits; None for an empty span."""
    if end <= start:
        return None
    return run_ffmpeg(["-ss", f"{start:.3f}", "-to", f"{end:.3f}", "-i", video, "-vn", "-ac", "1", "-ar", str(rate), "-f", "wav", "pipe:1"], 44)


def embedded_subtitles(video: str) -> tuple[str, str] | None:
    """(text, suffix) of a video's first subtitle track, as SubRip or else as SubStation."""
    for kind in ("srt", "ass"):
        if data := run_ffmpeg(["-i", video, "-map", "0:s:0", "-f", kind, "pipe:1"]):
            return data.decode("utf-8", "replace"), "." + kind
    return None


def keyframe(video: str, t: float) -> bytes | None:
    """The picture at a time, as JPEG."""
    return run_ffmpeg(["-ss", f"{t:.3f}", "-i", video, "-frames:v", "1", "-f", "mjpeg", "pipe:1"])


def with_scene_files(scenes: DataFrame, audio: str | None, rate: int, grab: Callable[[str, float], bytes | None] = keyframe, sound: Callable[[str, float, float, int], bytes | None] = scene_audio) -> DataFrame:
    """``scenes`` (with ``path, times`` and names in ``frames``) with their pictures written, those that can't be left out of ``frames``, and,
    under the folder ``audio`` if given, their sounds, in ``audio_path`` (empty where there is none). The folders are shared by all workers."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scenes.schema.fields)

    def save(name: str, data: bytes | None) -> bool:
        if data:
            os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
            with open(name, "wb") as f:
                f.write(data)
        return bool(data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pictures, sounds = [], []
            for video, scene, path, s, e, times, names in zip(f["video"], f["scene_id"], f["path"], f["start"], f["end"], f["times"], f["frames"]):
                pictures.append([n for n, t in zip(names, times) if save(n, grab(path, float(t)))])
                name = f"{audio}/{video.rpartition('.')[0] or video}/{scene}.wav" if audio else ""
                sounds.append(name if audio and save(name, sound(path, float(s), float(e), rate)) else "")
            yield f.assign(frames=pd.Series(pictures, index=f.index, dtype=object), audio_path=sounds)

    return scenes.mapInPandas(run, fields)


def with_sample_files(times: DataFrame, folder: str, suffix: str, take: Callable[[dict], bytes | None]) -> DataFrame:
    """``times`` (``video, t`` and what ``take`` needs of a row) with ``file``: what ``take`` gives, written below ``folder``; null where it gives nothing."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in times.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names: list[str | None] = []
            for row in f.to_dict("records"):
                name = f"{folder}/{row['video'].rpartition('.')[0] or row['video']}/{row['t']:.3f}{suffix}"
                data = take(row)
                if data:
                    os.makedirs(os.path.dirname(name), exist_ok=True)
                    with open(name, "wb") as out:
                        out.write(data)
                names.append(name if data else None)
            yield f.assign(file=pd.Series(names, index=f.index, dtype=object))

    return times.mapInPandas(run, f"{fields}, file string")


def frame_scores(spark: SparkSession, videos: DataFrame, score: Callable[[str], Iterator[tuple[int, float, float]]]) -> DataFrame:
    """``video, frame, t, score`` of ``videos`` (``video, path``) by a decoder: (frame, seconds, change from the frame before)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for video, path in zip(f["video"], f["path"]):
                yield pd.DataFrame([(video, *x) for x in score(path)], columns=["video", "frame", "t", "score"])

    return videos.select("video", "path").mapInPandas(run, FRAME_SCORES)


def seconds_of(path: str) -> float | None:
    """The length of a video by its frames and rate; None where OpenCV is missing or can't tell."""
    try:
        import cv2
    except ImportError:
        return None
    cap = cv2.VideoCapture(path)
    fps, n = cap.get(cv2.CAP_PROP_FPS) or 0, cap.get(cv2.CAP_PROP_FRAME_COUNT) or 0
    cap.release()
    return n / fps if fps > 0 and n > 0 else None


def durations(videos: DataFrame, probe: Callable[[str], float | None] = seconds_of) -> DataFrame:
    """``video, duration`` of ``videos`` (``video, path``) that ``probe`` can tell the length of, one file a row on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"video": f["video"], "duration": [probe(p) for p in f["path"]]}).dropna().astype({"duration": float})

    return videos.select("video", "path").mapInPandas(run, "video string, duration double")


def hsv_change(path: str) -> Iterator[tuple[int, float, float]]:
    """Mean change of hue, saturation and value from frame to frame; needs OpenCV."""
    import cv2

    cap, last, n = cv2.VideoCapture(path), None, 0
    fps = cap.get(cv2.CAP_PROP_FPS) or 0
    while fps > 0:
        ok, frame = cap.read()
        if not ok:
            break
        hsv = cv2.cvtColor(frame, cv2.COLOR_BGR2HSV).astype(np.int16)
        yield n, n / fps, 0.0 if last is None else float(np.abs(hsv - last).mean())
        last, n = hsv, n + 1
    cap.release()
