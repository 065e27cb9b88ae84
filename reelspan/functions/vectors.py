"""Vector operators: usable vectors, scoring against a block of queries, normalising, pooling, label top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as float32; null rows, rows of another width and rows with NaN are zero vectors."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, width or 0), np.float32)
    offsets = col.offsets.to_numpy()
    lengths = np.diff(offsets)
    valid = np.asarray(col.is_valid())
    d = width or int(np.bincount(lengths[valid]).argmax() if valid.any() else 0)
    out = np.zeros((n, d), np.float32)
    rows = np.nonzero(valid & (lengths == d))[0]
    if len(rows) and d:
        flat = col.values.to_numpy(zero_copy_only=False)
        out[rows] = flat[offsets[rows][:, None] + np.arange(d)]
        out[~np.isfinite(out).all(1)] = 0
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def l2_normalize(c: Column) -> Column:
    """A vector of length 1; a zero vector and null stay as they are, NaN components make the vector null."""
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # as the element of an array, the length is computed once a vector and not once a component
    scaled = lambda n: F.when(n == 0, c.cast("array<double>")).when(~F.isnan(n), F.transform(c, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(length), scaled), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, for pairs of rows; blocks of queries go through ``score_block``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score_batches(batches: Iterator[pa.RecordBatch], queries: dict[str, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    """Of each batch the clamped similarities [row, query] by column; vectors and queries are made unit length.

    An unusable vector (null, zero, NaN) scores 0, as a missing one does.
    """
    for b in batches:
        out = {}
        for name, q in queries.items():
            x = unit(matrix(b.column(b.schema.get_field_index(name)), q.shape[1]))
            out[name] = np.maximum(0.0, x.astype(np.float64) @ q.T.astype(np.float64))
        yield b, out


def top_of_block(scenes: DataFrame, key: str, vec: str, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``query, key, score``: of a block of ``queries`` (vectors of length 1, with ``ids``), the ``k`` most similar rows of each task; scores have six digits, ties go to the higher ``key``.

    One pass over ``key`` and ``vec``, nothing else is read, and of each task ``k`` rows a query leave. An unusable vector scores 0.
    """
    box = scenes.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = box.value
        best, keys = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).min)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                sims = np.round(np.maximum(0.0, unit(matrix(part.column(1), q.shape[1])).astype(np.float64) @ q.T.astype(np.float64)), 6).T
                both, who = np.concatenate([best, sims], 1), np.concatenate([keys, np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), sims.shape)], 1)
                order = np.lexsort((-who, -both))[:, :k]
                best, keys = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        row, slot = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row, slot]), pa.array(best[row, slot])], ["query", "key", "score"])

    return scenes.select(F.col(key).cast("bigint").alias("key"), vec).mapInArrow(run, "query bigint, key bigint, score double")


def pair_scores(pairs: DataFrame, vec: str, ids: np.ndarray, queries: list, out: str) -> DataFrame:
    """``query_id, video, t`` of the ``pairs`` of the queries ``ids`` and ``out``, the cosine of ``vec`` and the query's vector; unusable ones are 0."""
    order = np.argsort(ids)
    q = unit(matrix(pa.array([queries[i] for i in order], pa.list_(pa.float32()))))
    box = pairs.sparkSession.sparkContext.broadcast((ids[order], q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = box.value
        for b in batches:
            who = b.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
            some = np.nonzero(ids[at] == who)[0]
            x = unit(matrix(b.column(3), q.shape[1]))[some].astype(np.float64)
            kept = b.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(np.einsum("ij,ij->i", x, q[at[some]].astype(np.float64)))], ["query_id", "video", "t", out])

    return pairs.select("query_id", "video", "t", vec).mapInArrow(run, f"query_id int, video string, t double, {out} double")


def pool_mean(df: DataFrame, by: str, vec: str) -> DataFrame:
    """``by, vec`` (length 1), ``n``: the mean of each group's usable vectors, normalised; no usable vector: no row.

    Sums are taken in each task over whole batches before anything travels, so a large group is one row a task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            x = matrix(b.column(1)).astype(np.float64)
            some = np.nonzero(x.any(1))[0]
            if not len(some):
                continue
            coded = b.column(0).dictionary_encode()  # null is a key of its own
            codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)[some]
            order = np.argsort(codes, kind="stable")
            at, first, n = np.unique(codes[order], return_index=True, return_counts=True)
            names = [*coded.dictionary.to_pylist(), None]
            for code, s, m in zip(at.tolist(), np.add.reduceat(x[some][order], first, axis=0), n.tolist()):
                had, k = sums.get(names[code], (0, 0))
                if k and len(had) != len(s):
                    raise ValueError("vectors of different width in one group")
                sums[names[code]] = (had + s, k + m)
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.string()), "s": pa.array([v[0].tolist() for v in sums.values()], pa.list_(pa.float64())), "n": pa.array([v[1] for v in sums.values()], pa.int64())})

    parts = df.select(F.col(by).cast("string").alias("k"), vec).mapInArrow(partial, "k string, s array<double>, n bigint")
    sums = parts.select("k", "n", F.posexplode("s").alias("pos", "x")).groupBy("k", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    mean = sums.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("m"), F.max("n").alias("n"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return mean.withColumn("_norm", norm).where(F.col("_norm") > 1e-8).select(F.col("k").alias(by), F.transform("m", lambda x: x / F.col("_norm")).alias(vec), "n")


def label_topk(df: DataFrame, keys: list[str], vec: str, labels: DataFrame, k: int = 5, most_labels: int = 10_000) -> DataFrame:
    """``keys, audio_events`` (the ``k`` labels nearest to the vector, nearest first), ``audio_event_text``; an unusable vector has none.

    ``labels``: ``label, label_ord, vec``, at most ``most_labels``; ties go to the lower ``label_ord``.
    """
    from reelspan.session import small_rows

    rows = sorted(small_rows(labels.select("label", "label_ord", "vec"), most_labels, "labels"), key=lambda r: r[1])
    names = np.array([r[0] for r in rows], object)
    q = unit(np.array([r[2] for r in rows], np.float32)) if rows else np.zeros((0, 0), np.float32)
    take = max(1, min(k, len(rows)))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column(b.num_columns - 1), q.shape[1] if len(q) else None))
            if len(q):
                sims = x.astype(np.float64) @ q.T.astype(np.float64)
                order = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :take]
            events = [names[o].tolist() if len(q) and v.any() else [] for o, v in zip(order if len(q) else x, x)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(events, pa.list_(pa.string()))], [*b.schema.names[:-1], "audio_events"])

    schema = df.select(*keys).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.select(*keys, vec).mapInArrow(top, f"{ddl}, audio_events array<string>").withColumn("audio_event_text", F.array_join("audio_events", " "))
