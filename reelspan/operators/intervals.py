"""Joins of time spans with subtitle lines: overlap, snapping to line bounds, widening by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import clean_line, content_words, norm_text


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width)))


def overlap_join(spans: DataFrame, lines: DataFrame, width: float = 60.0) -> DataFrame:
    """Every pair of a span (``video, s, e``) and a line (``video, ls, le``) that overlap, ends included.

    Both sides are cut into time buckets of ``width`` seconds and joined by video and bucket, so that a video with very
    many spans and lines is spread over its buckets and only neighbours in time meet; a pair is kept in the first
    bucket they share. Spans with a null bound and lines with one meet nothing. A line longer than its bucket stands
    in several.
    """
    a = spans.where("s IS NOT NULL AND e IS NOT NULL").withColumn("_b", F.explode(_buckets(F.col("s"), F.col("e"), width)))
    b = lines.where("ls IS NOT NULL AND le IS NOT NULL").withColumnRenamed("video", "_video").withColumn("_lb", F.explode(_buckets(F.col("ls"), F.col("le"), width)))
    first = F.greatest(F.floor(F.col("s") / width), F.floor(F.col("ls") / width))
    on = (F.col("video") == F.col("_video")) & (F.col("_b") == F.col("_lb")) & (F.col("le") >= F.col("s")) & (F.col("ls") <= F.col("e")) & (F.col("_b") == first)
    return a.join(b, on).drop("_video", "_b", "_lb")


def line_seconds(lines: DataFrame) -> DataFrame:
    """``video, line_no, ls, le, line``: subtitle lines in seconds with their cleaned text; blank lines are left out."""
    return lines.select("video", "line_no", (F.col("start_ms") / 1000.0).alias("ls"), (F.col("end_ms") / 1000.0).alias("le"), clean_line(F.coalesce("text", F.lit(""))).alias("line")).where("length(line) > 0")


def concat_lines(spans: DataFrame, keys: list[str], lines: DataFrame, width: float = 60.0) -> DataFrame:
    """``spans`` with ``line_text``: the lines that overlap each (``keys``), in file order with a blank between; none: empty.

    ``spans`` has ``video, s, e`` and ``keys``, which identify a span.
    """
    pairs = overlap_join(spans.select("video", "s", "e", *[k for k in keys if k not in ("video", "s", "e")]), lines, width)
    text = pairs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line_text"))
    return spans.join(text, keys, "left").withColumn("line_text", F.coalesce("line_text", F.lit("")))


def snap(spans: DataFrame, keys: list[str], lines: DataFrame, tolerance: float = 1.5, width: float = 60.0) -> DataFrame:
    """``spans`` (``video, s, e``) with bounds moved out to those of lines within ``tolerance``; a span never shrinks.

    The start goes to the earliest line start within the tolerance whose line does not end past the end and tolerance;
    the end likewise. Without such a line a bound stays.
    """
    ids = [k for k in keys if k != "video"]
    wide = spans.select("video", *ids, F.col("s").alias("_s"), F.col("e").alias("_e"), (F.col("s") - tolerance).alias("s"), (F.col("e") + tolerance).alias("e"))
    near = overlap_join(wide, lines.select("video", "ls", "le"), width)
    at_start = (F.abs(F.col("ls") - F.col("_s")) <= tolerance) & (F.col("le") <= F.col("_e") + tolerance)
    at_end = (F.abs(F.col("le") - F.col("_e")) <= tolerance) & (F.col("ls") >= F.col("_s") - tolerance)
    ext = near.groupBy(*keys).agg(F.min(F.when(at_start, F.col("ls"))).alias("_lo"), F.max(F.when(at_end, F.col("le"))).alias("_hi"))
    return _widened(spans, ext, keys)


def widen_by_keywords(spans: DataFrame, keys: list[str], query: str, lines: DataFrame, most: float = 4.0, width: float = 60.0) -> DataFrame:
    """``spans`` widened to the lines at most ``most`` seconds away that hold a content word of the span's ``query``."""
    ids = [k for k in keys if k != "video"]
    wide = spans.select("video", *ids, content_words(F.col(query)).alias("_words"), (F.col("s") - most).alias("s"), (F.col("e") + most).alias("e")).where(F.size("_words") > 0)
    near = overlap_join(wide, lines.select("video", "ls", "le", norm_text(F.col("line")).alias("_line")), width)
    hit = near.where(F.exists("_words", lambda w: F.contains(F.col("_line"), w)))
    ext = hit.groupBy(*keys).agg(F.min("ls").alias("_lo"), F.max("le").alias("_hi"))
    return _widened(spans, ext, keys)


def _widened(spans: DataFrame, ext: DataFrame, keys: list[str]) -> DataFrame:
    both = spans.join(ext, keys, "left")
    return both.withColumn("s", F.least("s", F.coalesce("_lo", "s"))).withColumn("e", F.greatest("e", F.coalesce("_hi", "e"))).drop("_lo", "_hi")


def match_names(left: DataFrame, right: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """``name, path``: for each name of ``left`` the entry of ``right`` (``name, path``) that fits it.

    An equal name wins; else, lower-cased and without ``_ - .`` and blanks, one that contains the other. Of several the
    first path is taken. Containment is an equality join on all substrings of the longer side, not a cross join:
    a file name has a bounded number of them. Names that nothing fits have a null path; null and empty names fit nothing.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[_\-. ]", "")
    names = left.select(F.col(name).alias("name"), plain(F.col(name)).alias("a")).distinct()
    files = right.select(F.col(name).alias("file"), F.col(path).alias("path"), plain(F.col(name)).alias("b")).distinct()

    def parts(c: str) -> Column:
        n = F.length(c)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substring(F.col(c), i, m)))))

    exact = names.join(files, F.col("name") == F.col("file")).select("name", F.lit(0).alias("rank"), "path")
    names, files = names.where("length(a) > 0"), files.where("length(b) > 0")
    inside = names.select("name", F.explode(parts("a")).alias("key")).join(files.select(F.col("b").alias("key"), "path"), "key")
    around = files.select("path", F.explode(parts("b")).alias("key")).join(names.select(F.col("a").alias("key"), "name"), "key")
    fuzzy = inside.select("name", F.lit(1).alias("rank"), "path").unionByName(around.select("name", F.lit(1).alias("rank"), "path"))
    best = exact.unionByName(fuzzy).groupBy("name").agg(F.min(F.struct("rank", "path")).alias("m"))
    return left.select(F.col(name).alias("name")).distinct().join(best, "name", "left").select("name", F.col("m.path").alias("path"))
