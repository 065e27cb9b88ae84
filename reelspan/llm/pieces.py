"""Splitting texts over a size limit at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths; a boundary belongs to the text before it.
CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_END = regex.compile(r"(?P<p>[^\S\n]*(?:\r?\n[^\S\n]*){2,})|(?P<l>[^\S\n]*\r?\n)|(?P<s>(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？｡．]+[」』”’）]*)[^\S\n]*)")
#: Boundaries inside of a sentence or line, looked for only where it is too large.
_INNER = regex.compile(r"(?P<c>[,;:—–、，；：][^\S\n]*)|(?P<w>[^\S\n]+)")
_KIND = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE, "w": WORD}


def _offsets(text: str) -> np.ndarray:
    """The first byte of each character in UTF-8, and the number of bytes."""
    if text.isascii():
        return np.arange(len(text) + 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(np.nonzero((data & 0xC0) != 0x80)[0], len(data))


def _atoms(text: str, most: int, at: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Ends (in characters), sizes (bytes) and strengths of the end of the smallest segments; ``at``: the offsets of ``text``.

    Sentences, lines and paragraphs are whole unless larger than ``most``; those are cut at clauses and blanks, and
    what is still larger, at characters.
    """
    marks = [(m.end(), _KIND[m.lastgroup]) for m in _END.finditer(text)]
    if not marks or marks[-1][0] < len(text):
        marks.append((len(text), PARAGRAPH))
    ends: list[int] = []
    sizes: list[int] = []
    kinds: list[int] = []
    byte = at.tolist()

    def add(start: int, end: int, kind: int) -> None:
        while byte[end] - byte[start] > most:
            cut = max(start + 1, int(np.searchsorted(at, byte[start] + most, "right")) - 1)
            ends.append(cut), sizes.append(byte[cut] - byte[start]), kinds.append(CHARACTER)
            start = cut
        ends.append(end), sizes.append(byte[end] - byte[start]), kinds.append(kind)

    start = 0
    for end, kind in marks:
        if byte[end] - byte[start] > most:
            body = start + len(text[start:end].rstrip())  # blanks before the boundary belong to it
            for m in _INNER.finditer(text, start, end):
                if m.start() < body and m.end() < end:
                    add(start, m.end(), _KIND[m.lastgroup])
                    start = m.end()
        add(start, end, kind)
        start = end
    return ends, sizes, kinds


def split_text(text: str, most: int, overlap: int, halved: bool = True) -> list[tuple[int, int, int]]:
    """(first character with overlap, first own character, end) of the pieces of ``text``, each at most ``most`` bytes.

    Neighbouring segments are merged as long as their size and the overlap fit, the weakest boundary first, of equally
    weak ones that of the smallest sum, then the leftmost. The overlap is the longest run of whole characters of at most
    ``overlap`` bytes at the end of the piece before. Where ``halved``, it is less than half of ``most`` at the utmost; else it is taken as
    it is, and one that leaves no room for a character (4 bytes) raises.
    """
    if most < 4:
        raise ValueError("a piece must have room for any character: 4 bytes")
    overlap = max(0, min(overlap, (most - 4) // 2) if halved else overlap)
    if overlap > most - 4:
        raise ValueError(f"an overlap of {overlap} leaves no room for a character in a piece of {most} bytes")
    at = _offsets(text)
    ends, sizes, kinds = _atoms(text, most - overlap, at)
    n = len(ends)
    left, right, alive, version = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, [0] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < n and kinds[i] < 99:
            size = sizes[i] + sizes[j]
            if size + (overlap if left[i] >= 0 else 0) <= most:
                heapq.heappush(heap, (kinds[i], size, i, version[i], version[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, size, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj or sizes[i] + sizes[j] != size:
            continue
        if size + (overlap if left[i] >= 0 else 0) > most:
            continue
        sizes[i], kinds[i], ends[i] = size, kinds[j], ends[j]
        alive[j] = False
        version[i] += 1
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out: list[tuple[int, int, int]] = []
    start, i = 0, 0
    while i < n:
        first = start
        if out and overlap:
            first = max(out[-1][0], int(np.searchsorted(at, at[start] - overlap, "left")))
        out.append((first, start, ends[i]))
        start, i = ends[i], right[i]
    return out


PIECES = "doc_id bigint, piece_no int, start_char bigint, own_start_char bigint, end_char bigint, size_tokens bigint, overlap_size bigint, piece string"


def split_oversized(documents: DataFrame, limits: DataFrame, key: str = "source") -> DataFrame:
    """Pieces of every text larger than the limit of its ``key``, which is compared trimmed and in lower case.

    ``documents`` has ``doc_id``, ``text`` and ``key``; ``limits`` has ``key``, ``max_tokens``, ``overlap_tokens`` and is
    broadcast by Spark only under its own threshold. A size is the number of UTF-8 bytes. Texts that fit, null texts,
    texts without a key or without a limit give no rows. With several limits of one key the smallest holds. Sizes are
    compared before the text goes to Python, and texts are independent, so there is no shuffle of texts. An overlap within 4
    bytes of its limit raises.
    """
    lim = limits.where(F.col("max_tokens").isNotNull()).groupBy(F.trim(F.lower(F.col(key))).alias("_key")).agg(F.min_by(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens")), F.struct("max_tokens", "overlap_tokens")).alias("_lim"))
    # the whole size, then the join by a short key: only texts over the limit leave the JVM
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.trim(F.lower(F.col(key))).alias("_key"), F.octet_length("text").alias("_size"))
    over = docs.join(lim, "_key").where(F.col("_size") > F.col("_lim.max_tokens")).select("doc_id", "text", F.col("_lim.max_tokens").alias("most"), F.col("_lim.overlap_tokens").alias("overlap"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text, most, overlap in zip(f["doc_id"], f["text"], f["most"], f["overlap"]):
                for no, (first, own, end) in enumerate(split_text(text, int(most), int(overlap), halved=False)):
                    piece = text[first:end]
                    rows.append((doc, no, first, own, end, len(piece.encode()), len(text[first:own].encode()), piece))
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
                        rows = []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return over.mapInPandas(cut, PIECES)
