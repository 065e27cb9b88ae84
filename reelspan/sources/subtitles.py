"""Subtitle files: SubRip and (Advanced) SubStation Alpha, as timed lines in file order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.schemas import LINES

_SRT_TIME = re.compile(r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})")
_ASS_TIME = re.compile(r"(\d+):(\d{1,2}):(\d{1,2})[.:](\d{1,3})")


def _ms(h: str, m: str, s: str, f: str) -> int:
    return ((int(h) * 60 + int(m)) * 60 + int(s)) * 1000 + int(f.ljust(3, "0"))


def parse_srt(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) in milliseconds; lines of one entry are joined by a written line break, tags stay."""
    out = []
    for block in re.split(r"\n\s*\n", text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")):
        rows = block.strip("\n").split("\n")
        for i, row in enumerate(rows[:2]):
            if m := _SRT_TIME.search(row):
                g = m.groups()
                out.append((_ms(*g[:4]), _ms(*g[4:]), "\\N".join(rows[i + 1 :])))
                break
    return out


def parse_ass(text: str) -> list[tuple[int, int, str]]:
    """Dialogues and comments of the events section, override codes and written line breaks as they stand."""
    out, fields, inside = [], [], False
    for row in text.lstrip("﻿").splitlines():
        row = row.strip()
        if row.startswith("["):
            inside = row.lower() == "[events]"
        elif inside and row.lower().startswith("format:"):
            fields = [f.strip().lower() for f in row[7:].split(",")]
        elif inside and fields and (row.startswith("Dialogue:") or row.startswith("Comment:")):
            values = row.split(":", 1)[1].strip().split(",", len(fields) - 1)
            if len(values) == len(fields):
                v = dict(zip(fields, values))
                a, b = _ASS_TIME.match(v.get("start", "").strip()), _ASS_TIME.match(v.get("end", "").strip())
                if a and b:
                    out.append((_ms(*a.groups()), _ms(*b.groups()), v.get("text", "")))
    return out


def read_subtitles(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``video, line_no, start_ms, end_ms, text`` of ``files`` (``video, path``); a null path gives no lines.

    Each file is read whole by one task, in an encoding told from its bytes: UTF-8, UTF-16 with a mark, else Latin-1.
    """
    # folders are few, files need not be: the content is found by a join
    folders = [r[0] for r in files.where("path IS NOT NULL").select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], LINES)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.{srt,ass,ssa,SRT,ASS,SSA}").load(folders).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    named = files.select("video", F.regexp_replace("path", "^file:/*", "/").alias("path"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for video, path, data in zip(f["video"], f["path"], f["content"]):
                text = decode(bytes(data))
                got = parse_srt(text) if path.lower().endswith(".srt") else parse_ass(text)
                rows += [(video, i, s, e, t) for i, (s, e, t) in enumerate(got)]
            yield pd.DataFrame(rows, columns=["video", "line_no", "start_ms", "end_ms", "text"])

    return named.join(content, "path").select("video", "path", "content").mapInPandas(parse, LINES)


def read_embedded(videos: DataFrame, track: Callable[[str], tuple[str, str] | None]) -> DataFrame:
    """Lines, as from ``read_subtitles``, of the subtitle tracks inside ``videos`` (``video, path``); ``track`` gives (text, suffix) or None."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for video, path in zip(f["video"], f["path"]):
                if got := track(path):
                    rows += [(video, i, *x) for i, x in enumerate(parse_srt(got[0]) if got[1] == ".srt" else parse_ass(got[0]))]
            yield pd.DataFrame(rows, columns=["video", "line_no", "start_ms", "end_ms", "text"])

    return videos.select("video", "path").mapInPandas(parse, LINES)


def decode(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")
