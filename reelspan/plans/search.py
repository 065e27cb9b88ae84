"""Hybrid search: a set of queries against all scenes in three modalities, normalised, fused, boosted, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.scores import FLAT
from reelspan.functions.text import characters_in, classify_query
from reelspan.functions.vectors import matrix, score_batches, unit
from reelspan.session import cut_lineage
from reelspan.settings import Settings

MODES = ("text", "image", "audio")
CANDIDATES = "query_id bigint, ord bigint, video string, scene_id int, hybrid_score double, text_score double, image_score double, audio_score double"


def _vectors(rows: list, field: str) -> np.ndarray:
    vecs = [r[field] for r in rows]
    width = next((len(v) for v in vecs if v is not None), 1)
    return unit(matrix(pa.array(vecs, pa.list_(pa.float32())), width))


def hybrid_search(queries: DataFrame, scenes: DataFrame, settings: Settings = Settings(), top_k: int | None = None, block: int = 2048) -> DataFrame:
    """``query_id, rank_pos, video, scene_id, hybrid_score, text_score, image_score, audio_score, query_type``: the ``top_k`` scenes of each query.

    ``queries``: ``query_id, query_text, text_vec, image_vec, audio_vec``; ``scenes``: ``ord`` (unique), ``video, scene_id,
    subtitle, text_vec, image_vec, audio_vec``. Similarities are clamped at 0, scaled to their range over all scenes for each
    query, weighted by the query's class and summed; a scene with the query's characters is lifted. Ties go to the higher
    ``ord``. A missing or unusable vector scores 0; without any audio vector among the queries, or in the scenes, the
    weights of text and image take its share. Empty tables and ``top_k`` 0 give no rows.

    The stated queries are scored in blocks of ``block``: a block is a matrix that is broadcast; the scenes are read twice, for
    the ranges and for the fused scores, and are not shuffled. Of each task only ranges and the ``top_k`` of each query leave.
    """
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType
    queries = cut_lineage(queries.select("query_id", "query_text", *[f"{m}_vec" for m in MODES]).dropDuplicates(["query_id"]))  # read for the blocks and for the classes
    k = settings.retrieval.top_k if top_k is None else top_k
    names, boost = list(settings.characters), settings.retrieval.character_boost
    q = queries.select("query_id", classify_query(F.col("query_text")).alias("label"), characters_in(F.col("query_text"), names).alias("names"), *[f"{m}_vec" for m in MODES])
    parts = []
    # scenes of the same ord are one, repeated
    cols = scenes.select("ord", "video", "scene_id", characters_in(F.col("subtitle"), names).alias("names"), *[f"{m}_vec" for m in MODES])
    for rows in query_blocks(q, "query_id", block) if k > 0 else ():
        parts.append(_search_block(spark, cols, rows, names, boost, settings, k))
    if not parts:
        found = spark.createDataFrame([], CANDIDATES)
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    # a few rows a task and query
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.desc("ord"))
    best = found.dropDuplicates(["query_id", "ord"]).withColumn("rank_pos", F.row_number().over(w)).where(F.col("rank_pos") <= k)
    best = best.withColumn("query_id", F.col("query_id").cast(kind))
    kinds = queries.select("query_id", classify_query(F.col("query_text")).alias("query_type"), "query_text")
    return best.join(kinds, "query_id").select("query_id", "rank_pos", "video", "scene_id", "hybrid_score", *[f"{m}_score" for m in MODES], "query_type", "query_text")


def query_blocks(queries: DataFrame, key: str, block: int) -> Iterator[list]:
    """The rows of ``queries``, which are distinct by ``key``, by a hash of it, in blocks of ``block`` on average: what the driver holds at once."""
    n = max(1, -(-queries.count() // block))
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).collect() if n > 1 else queries.collect()
        if rows:
            yield sorted((r for r in rows if r[key] is not None), key=lambda r: r[key])


def _search_block(spark, scenes: DataFrame, rows: list, names: list[str], boost: float, settings: Settings, k: int) -> DataFrame:  # noqa: ANN001
    vecs = {f"{m}_vec": _vectors(rows, f"{m}_vec") for m in MODES}
    qids = np.array([r["query_id"] for r in rows], np.int64)
    named = np.array([[n in (r["names"] or []) for n in names] for r in rows], float).reshape(len(rows), len(names))
    named = named / np.maximum(1, named.sum(1, keepdims=True))
    box = spark.sparkContext.broadcast(vecs)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                yield b.slice(i, 512)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for _, sims in score_batches(slices(batches), box.value):
            s = np.stack([sims[f"{m}_vec"] for m in MODES])
            low = s.min(1) if low is None else np.minimum(low, s.min(1))
            high = s.max(1) if high is None else np.maximum(high, s.max(1))
        if low is not None:
            n = low.shape[1]
            yield pa.RecordBatch.from_pydict({"m": pa.array(np.repeat(np.arange(3), n), pa.int32()), "q": pa.array(np.tile(np.arange(n), 3), pa.int32()), "lo": low.ravel(), "hi": high.ravel()})

    vectors = scenes.select(*vecs)
    got = vectors.mapInArrow(ranges, "m int, q int, lo double, hi double").groupBy("m", "q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    low, high = np.zeros((3, len(rows))), np.zeros((3, len(rows)))
    for r in got:
        low[r.m, r.q], high[r.m, r.q] = r.lo, r.hi
    weights = np.array([settings.retrieval.weights[r["label"]] for r in rows]).T
    if not vecs["audio_vec"].any() or not high[2].any():
        two = weights[0] + weights[1]
        weights = np.stack([np.where(two > FLAT, weights[0] / np.where(two > FLAT, two, 1), 0.5), np.where(two > FLAT, weights[1] / np.where(two > FLAT, two, 1), 0.5), 0 * two])
    width = np.where(high - low > FLAT, high - low, np.inf)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(qids)
        # of each query the best so far: fused, ord, place in ``who``, the three similarities
        best = np.full((n, k), -np.inf)
        ords = np.full((n, k), -1, np.int64)
        at = np.full((n, k), -1, np.int64)
        kept = np.zeros((3, n, k))
        who: list[tuple] = []
        for b, sims in score_batches(slices(batches), box.value):
            s = [sims[f"{m}_vec"] for m in MODES]
            fused = sum(w * ((x - lo) / wd) for w, x, lo, wd in zip(weights, s, low, width))
            if names:
                has = np.array([[x in (row or []) for x in names] for row in b.column(3).to_pylist()], float).reshape(b.num_rows, len(names))
                fused = fused + boost * (has @ named.T)
            hits = fused.T >= best[:, -1:]
            who_now = b.column(0).to_numpy(zero_copy_only=False)
            for i in np.nonzero(hits.any(1))[0]:
                new = np.nonzero(hits[i])[0]
                if len(new) > 4 * k:
                    new = new[fused[new, i] >= np.partition(fused[new, i], len(new) - k)[len(new) - k]]
                v = np.concatenate([best[i], fused[new, i]])
                o = np.concatenate([ords[i], who_now[new]])
                order = np.lexsort((-o, -v))[:k]
                place = np.concatenate([at[i], len(who) + new])
                best[i], ords[i], at[i] = v[order], o[order], place[order]
                for m in range(3):
                    kept[m, i] = np.concatenate([kept[m, i], s[m][new, i]])[order]
            used = np.unique(at[at >= len(who)])
            fresh = {int(p): j + len(who) for j, p in enumerate(used)}
            base, videos, numbers = len(who), b.column(1), b.column(2)
            who += [(videos[int(p) - base].as_py(), numbers[int(p) - base].as_py()) for p in used]
            moved = at >= base
            at[moved] = [fresh[int(p)] for p in at[moved]]
        q, slot = np.nonzero(np.isfinite(best))
        flat = [who[i] for i in at[q, slot]]
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(qids[q].astype(np.int64), pa.int64()), "ord": pa.array(ords[q, slot], pa.int64()), "video": pa.array([w[0] for w in flat], pa.string()), "scene_id": pa.array([w[1] for w in flat], pa.int32()),
            "hybrid_score": best[q, slot], "text_score": kept[0][q, slot], "image_score": kept[1][q, slot], "audio_score": kept[2][q, slot],
        })

    return scenes.mapInArrow(top, CANDIDATES)
