"""The most similar vectors for every vector: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.session import cut_lineage


@dataclass(frozen=True)
class IndexParams:
    """``lists_factor`` times the root of the number of vectors is the number of lists, less where a list would be made for under ``list_rows``
    vectors, and at most ``max_lists``, which bounds the centroids; ``sample``, ``fit_rows``: rows, and rows a list, that centroids and
    codebooks are fitted on (every row is indexed); ``margin``, ``max_copies``: a vector also stands in the lists whose centroid is by at
    most ``margin`` less similar than its nearest, up to ``max_copies`` lists; ``list_most``: rows that one task holds of a list. A larger
    list is divided into lists of ``part_rows``, at most ``max_parts`` in all, and what is still larger is searched in blocks. Where there
    are parts, a vector's lists are chosen by the same margin among the ``near_parts`` nearest parts of the ``near_lists`` nearest centroids.
    ``subspaces``: bytes of a code; ``rerank``: candidates of which the similarity is computed exactly."""

    lists_factor: float = 0.8
    list_rows: int = 200
    max_lists: int = 8192
    sample: int = 16_384
    fit_rows: int = 16
    margin: float = 0.10
    max_copies: int = 8
    list_most: int = 12_000
    part_rows: int = 2_400
    part_sample: int = 20_000
    near_lists: int = 32
    near_parts: int = 2
    max_parts: int = 65_536
    #: A list at home to fewer vectors, or to fewer than four times the wanted neighbours, is given up, and they go to the others.
    least_rows: int = 24
    subspaces: int = 64
    rerank: int = 96
    iterations: int = 8
    #: A vector repeated in more than this share of all rows is indexed once; there are fewer than its inverse of those.
    heavy_share: float = 1e-4
    heavy_least: int = 64
    seed: int = 42


#: Rows of a batch, and entries of a table of rows by lists, that a task works on at once: a worker's memory is bounded by these, not by the batch.
PIECE, ENTRIES = 2048, 4_000_000


def _at_once(columns: int) -> int:
    """Rows of a table of so many columns that are made at once."""
    return max(16, min(4096, ENTRIES // max(1, columns)))


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their vectors): not null, not all zero, only finite components, ``width`` long."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    offsets = col.offsets.to_numpy()
    rows = np.nonzero(np.asarray(col.is_valid()) & (np.diff(offsets) == width))[0]
    flat = col.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat[(offsets[rows] - offsets[0])[:, None] + np.arange(width)]
    fine = np.isfinite(x).all(1) & x.any(1)
    return rows[fine], x[fine]


def _usable(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the usable rows of a batch, piece by piece."""
    for at in range(0, b.num_rows, PIECE):
        piece = b.slice(at, PIECE)
        use, x = _matrix(piece.column(1), width)
        yield piece.column(0).to_numpy(zero_copy_only=False)[use], x


def _usable_once(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_usable`` with each id of the batch once, its first row; ids ascend in a piece."""
    had = np.zeros(0, np.int64)
    for ids, x in _usable(b, width):
        ids, first = np.unique(ids, return_index=True)
        new = ~np.isin(ids, had)
        had = np.concatenate([had, ids[new]])
        yield ids[new], x[first[new]]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    small = (n[:, 0] < 1e-18) | ~np.isfinite(n[:, 0])
    if small.any():  # squares outside of single precision
        y = x[small].astype(np.float64)
        n = n.astype(np.float64)
        n[small] = np.linalg.norm(y, axis=1, keepdims=True)
    return (x / n).astype(np.float32)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of ``c`` closest to each row of ``x``."""
    half, block, out = 0.5 * (c * c).sum(1), _at_once(len(c)), np.empty(len(x), np.int64)
    for i in range(0, len(x), block):
        near = x[i : i + block] @ c.T
        near -= half
        out[i : i + block] = near.argmax(1)
    return out


def kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    """Lloyd's iterations; an empty cluster starts anew at a random row."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(iterations):
        near = _closest(x, c)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        starts = np.r_[0, np.cumsum(n)[:-1]]
        some = n > 0
        c[some] = np.add.reduceat(x[order], starts[some], axis=0) / n[some, None]
        c[~some] = x[rng.choice(len(x), int((~some).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def radii(x: np.ndarray, c: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Root mean square distance of each list's rows from its row of ``c``; where there are none, of all."""
    k, length = len(c), np.empty(len(x), np.float32)
    for i in range(0, len(x), PIECE):
        rest = x[i : i + PIECE] - c[near[i : i + PIECE]]
        length[i : i + PIECE] = (rest * rest).sum(1)
    n = np.bincount(near, minlength=k)
    own = np.sqrt(np.bincount(near, weights=length, minlength=k) / np.maximum(n, 1))
    usual = float(np.sqrt(length.mean())) if len(length) and length.any() else 1.0
    return np.where(own > 0, own, usual).astype(np.float32)


@dataclass
class Lists:
    """Unit centroids ``centres``; those with parts have the rows ``starts[i]:starts[i + 1]`` of ``parts``, offsets from the centroid.

    Numbers of lists: that of the centroid, or, of a part, the number of centroids and that of the part. ``scale`` is by those."""

    centres: np.ndarray
    scale: np.ndarray
    starts: np.ndarray
    parts: np.ndarray

    def __len__(self) -> int:
        return len(self.scale)

    @staticmethod
    def of(centres: np.ndarray, scale: np.ndarray) -> Lists:
        return Lists(centres, scale, np.zeros(len(centres) + 1, np.int64), np.zeros((0, centres.shape[1]), np.float32))

    def nearest(self, x: np.ndarray, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether at home) of every list that the unit vectors ``x`` stand in; parts count as lists."""
        c = min(p.near_lists if len(self.parts) else p.max_copies, len(self.centres))
        lists, sims = np.empty((len(x), c), np.int64), np.empty((len(x), c), np.float32)
        block = _at_once(len(self.centres))
        for i in range(0, len(x), block):
            far = x[i : i + block] @ self.centres.T
            np.negative(far, out=far)
            lists[i : i + block] = np.argpartition(far, c - 1, axis=1)[:, :c] if c < len(self.centres) else np.arange(c)
            sims[i : i + block] = -np.take_along_axis(far, lists[i : i + block], 1)
        if not np.diff(self.starts).any():
            own = np.zeros(sims.shape, bool)
            own[np.arange(len(x)), sims.argmax(1)] = True
            row, slot = np.nonzero(sims >= sims.max(1, keepdims=True) - p.margin)
            return row, lists[row, slot], own[row, slot]
        row, at, sims = np.repeat(np.arange(len(x)), c), lists.ravel(), sims.ravel()
        split = np.diff(self.starts)[at] > 0
        out = [(row[~split], at[~split], sims[~split], np.zeros(int((~split).sum()), np.int64))]
        some = np.nonzero(split)[0]
        some = some[np.argsort(at[some], kind="stable")]
        for group in np.split(some, np.nonzero(np.diff(at[some]))[0] + 1) if len(some) else ():
            f = at[group[0]]
            parts, centre = self.parts[self.starts[f] : self.starts[f + 1]], self.centres[f]
            half, along, length = 0.5 * (parts * parts).sum(1), parts @ centre, np.linalg.norm(centre + parts, axis=1)
            block = _at_once(len(parts))
            for i in range(0, len(group), block):
                who = row[group[i : i + block]]
                dots = (x[who] - centre) @ parts.T  # differences tell apart nearly equal vectors, similarities don't
                near = np.argsort(half - dots, axis=1, kind="stable")[:, : p.near_parts]
                for j in range(near.shape[1]):
                    n = near[:, j]
                    sim = (sims[group[i : i + block]] + dots[np.arange(len(who)), n] + along[n]) / np.maximum(length[n], 1e-12)
                    out.append((who, len(self.centres) + self.starts[f] + n, sim, np.full(len(who), j)))
        row, at, sims, turn = (np.concatenate(v) for v in zip(*out))
        # at home in the most similar of the nearest parts of its lists and of those without parts
        order = np.lexsort((-sims, turn > 0, row))
        own = np.zeros(len(row), bool)
        own[order[np.r_[True, np.diff(row[order]) > 0]]] = True
        best = np.empty(len(x), sims.dtype)
        best[row[own]] = sims[own]
        order = np.lexsort((-sims, ~own, row))
        order = order[sims[order] >= best[row[order]] - p.margin]
        start = np.r_[True, np.diff(row[order]) > 0]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        order = order[rank < p.max_copies]
        return row[order], at[order], own[order]

    def keep(self, some: np.ndarray) -> Lists:
        """Only the lists marked in ``some``; a centroid stays as long as it or any part of it does."""
        n, owner = len(self.centres), np.repeat(np.arange(len(self.centres)), np.diff(self.starts))
        parts = np.bincount(owner[some[n:]], minlength=n)
        left = np.where(np.diff(self.starts) > 0, parts > 0, some[:n])
        return Lists(self.centres[left], np.r_[self.scale[:n][left], self.scale[n:][some[n:]]], np.r_[0, np.cumsum(parts[left])].astype(np.int64), self.parts[some[n:]])

    def offset(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Vectors less the centroids of their lists, by the radius of those."""
        part = lists - len(self.centres)
        owner = np.where(part < 0, lists, np.searchsorted(self.starts, part, side="right") - 1)
        rest = x - self.centres[owner]
        rest[part >= 0] -= self.parts[part[part >= 0]]
        return rest / self.scale[lists, None]


def _pad(x: np.ndarray, subspaces: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % subspaces)))


def codebooks(rest: np.ndarray, p: IndexParams) -> np.ndarray:
    """Codewords [subspace, 256, width] of scaled residuals; dimensions are padded to a multiple of the subspaces."""
    rest = _pad(rest, p.subspaces)
    rest = rest.reshape(len(rest), p.subspaces, -1)
    rng = np.random.default_rng(p.seed)
    return np.stack([kmeans(np.ascontiguousarray(rest[:, m]), 256, p.iterations, rng) for m in range(p.subspaces)])


def encode(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes [row, subspace] of residuals: the nearest codeword of each subspace."""
    m, _, width = books.shape
    rest = _pad(rest, m).reshape(len(rest), m, width)
    out = np.empty((len(rest), m), np.uint8)
    for j in range(m):
        out[:, j] = (np.ascontiguousarray(rest[:, j]) @ books[j].T - 0.5 * (books[j] * books[j]).sum(1)).argmax(1)
    return out


def search_list(x: np.ndarray, codes: np.ndarray, ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, asking: np.ndarray, offset: Callable[[np.ndarray], np.ndarray], books: np.ndarray, k: int, rerank: int, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, neighbour ids, cosines), flat, of the queries ``asking`` against the members ``rows`` of one list, both rows of ``x``; ``ids`` ascend.

    Each query has one table of inner products of its residual (``offset``) with all codewords; the sum of its entries at a member's
    codes, with the length of the member's own residual, is its estimated distance, which ranks the members. The first ``rerank``
    are compared exactly, by their difference, which tells apart nearly equal ones too. ``x`` is not copied but for a block.
    """
    m, _, width = books.shape
    out_q, out_n, out_s = [], [], []
    r = min(rerank, len(ids))
    half, codes = np.empty((len(ids), 1), np.float32), codes[rows]
    for at in range(0, len(ids), PIECE):
        rest = offset(x[rows[at : at + PIECE]])
        half[at : at + PIECE] = 0.5 * (rest * rest).sum(1, keepdims=True)
    for at in range(0, len(q_ids), block) if r else ():
        who, qs = q_ids[at : at + block], x[asking[at : at + block]]
        parts = _pad(offset(qs), m).reshape(len(who), m, width)
        sums = np.repeat(half, len(who), 1)
        for j in range(m):
            sums -= np.take(books[j] @ np.ascontiguousarray(parts[:, j]).T, codes[:, j], axis=0)
        me = np.searchsorted(ids, who)
        mine = (me < len(ids)) & (ids[np.minimum(me, len(ids) - 1)] == who)
        sums[me[mine], np.nonzero(mine)[0]] = np.inf
        sums = np.ascontiguousarray(sums.T)
        near = np.argpartition(sums, r - 1, axis=1)[:, :r] if r < len(ids) else np.repeat(np.arange(r)[None], len(who), 0)
        gap = x[rows[near]]
        gap -= qs[:, None, :]
        dist = np.einsum("qrd,qrd->qr", gap, gap)
        dist[ids[near] == who[:, None]] = np.inf
        if k < r:
            some = np.argpartition(dist, k - 1, axis=1)[:, :k]
            near, dist = np.take_along_axis(near, some, 1), np.take_along_axis(dist, some, 1)
        fine = np.isfinite(dist)
        row, slot = np.nonzero(fine)
        out_q.append(who[row]), out_n.append(ids[near[row, slot]]), out_s.append(1.0 - 0.5 * dist[row, slot].astype(np.float64))
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_n), np.concatenate(out_s)


def _planes(x: np.ndarray) -> np.ndarray:
    """Rows with the first bytes of all components first, then the second ones, and so on: equal bytes lie together for the exchange's codec."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)).reshape(len(x), -1)


def _from_planes(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.reshape(len(b), 4, -1).transpose(0, 2, 1)).reshape(len(b), -1).view(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a column."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _bytes(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of ``_binary``, each ``width`` bytes."""
    col = col.combine_chunks()
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset] if len(col) else 0
    return np.frombuffer(col.buffers()[2], np.uint8, count=len(col) * width, offset=int(start)).reshape(-1, width)


def _units(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a column of ``_binary(_planes(...))`` at length 1, piece by piece."""
    out = np.empty((len(col), width), np.float32)
    for at in range(0, len(col), PIECE):
        out[at : at + PIECE] = _unit(_from_planes(_bytes(col.slice(at, PIECE), 4 * width)))
    return out


def _prints(x: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in x], np.uint64).view(np.int64)


NEIGHBOURS = "id bigint, neighbour bigint, cosine double"


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, params: IndexParams = IndexParams()) -> DataFrame:
    """``id, neighbour, cosine``: the ``k`` most similar other vectors of every usable vector, with little lost.

    A vector is usable if it is not null, not all zero, finite in all components and as wide as most vectors of the table are (of
    equally frequent widths, the larger); its length does not matter. Rows with the same id are one vector (repeated rows); null
    ids are left out. Every usable row is indexed and is a query. Ties beyond the k-th go to any of the tied. A collection of one gives none.

    Centroids and codebooks are fitted on a sample in proportion to the lists on the driver, and broadcast. Each vector is at home in one
    list, and stands in those that are nearly as near; so the whole search of a query happens in its own list, after one exchange. Rows
    are counted by list before: lists with too few are given up, lists with more than ``list_most`` are divided by the differences from
    their centroid, which also part nearly equal vectors, and of what is larger still each block of queries meets each block of rows: no
    task holds a list of any
    size. A vector repeated in more than ``heavy_share`` of the rows stands there once, and its copies are each other's neighbours.
    """
    spark, p = vectors.sparkSession, params
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    empty = spark.createDataFrame([], NEIGHBOURS)
    # a row a width
    widths = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).where("w > 0").orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not widths:
        return empty
    width = int(widths[0].w)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in _usable(b, width):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_prints(x), pa.int64())], ["id", "print"])

    # without the vectors: ids and fingerprints
    seen = cut_lineage(rows.mapInArrow(scan, "id bigint, print bigint"))
    per_id = seen.groupBy("id").agg(F.count("*").alias("c"))
    n = per_id.count()
    if not n:
        return empty
    limit = max(p.heavy_least, int(n * p.heavy_share))
    copies = _copies(seen, limit, k)
    # ids of very many repeated rows, of which a task sends the first: fewer than 1 / heavy_share
    repeated = frozenset(r.id for r in per_id.where(F.col("c") > limit).select("id").collect())
    lists, books = _fit(rows, n, width, p)
    box = spark.sparkContext.broadcast((lists, books, copies))

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, vectors) of a task that stand in lists, piece by piece: usable ones, each id of a batch once, of copies the first; of repeated ids one."""
        sent: set[int] = set()
        for ids, x in (piece for b in batches for piece in _usable_once(b, width)):
            if repeated and len(ids):
                keep = np.array([i not in sent for i in ids.tolist()], bool)
                ids, x = ids[keep], x[keep]
                sent.update(repeated.intersection(ids.tolist()))
            if copies and len(ids):
                found = box.value[2]
                keep = np.array([f not in found or found[f][0] == i for f, i in zip(_prints(x).tolist(), ids.tolist())], bool)
                ids, x = ids[keep], x[keep]
            if len(ids):
                yield ids, x

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = box.value[0]
        home, all_ = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
        for _, x in standing(batches):
            _, at, own = lists.nearest(_unit(x), p)
            all_ += np.bincount(at, minlength=len(lists))
            home += np.bincount(at[own], minlength=len(lists))
        some = np.nonzero(all_)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(home[some]), pa.array(all_[some])], ["list", "home", "n"])

    def counted() -> tuple[np.ndarray, np.ndarray]:
        """(rows at home, rows) of the lists: a row a list and task, added up."""
        home, size = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
        for r in rows.mapInArrow(count, "list bigint, home bigint, n bigint").groupBy("list").agg(F.sum("home").alias("home"), F.sum("n").alias("n")).collect():
            home[r.list], size[r.list] = r.home, r.n
        return home, size

    home, size = counted()
    if (size > p.list_most).any():
        lists = _divided(rows, lists, size, width, p)
        box = spark.sparkContext.broadcast((lists, books, copies))
        home, size = counted()
    is_list = np.r_[np.diff(lists.starts) == 0, np.ones(len(lists.parts), bool)]
    kept = is_list & (home >= min(max(p.least_rows, 4 * k), int(home.max())))
    lists = lists.keep(kept)
    # numbered as before, without those given up; a centroid with parts has its number still
    blocks = np.ones(len(lists), np.int64)
    split = np.diff(lists.starts) > 0
    blocks[np.r_[~split, np.ones(len(lists.parts), bool)]] = np.maximum(1, -(-size[kept] // p.list_most))
    box = spark.sparkContext.broadcast((lists, books, copies))
    blocks_box = spark.sparkContext.broadcast(blocks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, books, _ = box.value
        blocks, most = blocks_box.value, max(1, 8_000_000 // (4 * width))
        for ids, x in standing(batches):
            unit, planes = _unit(x), _planes(x)
            row, at, own = lists.nearest(unit, p)
            codes = np.empty((len(row), books.shape[0]), np.uint8)
            for i in range(0, len(row), PIECE):
                codes[i : i + PIECE] = encode(lists.offset(unit[row[i : i + PIECE]], at[i : i + PIECE]), books)
            # a list in one block: (0, 0). Else a row goes as a member to every block of queries, and as a query to every block of members
            times = np.where(blocks[at] == 1, 1, np.where(own, 2, 1) * blocks[at])
            batch = (np.cumsum(times) - 1) // most
            for some in np.split(np.arange(len(row)), np.nonzero(np.diff(batch))[0] + 1):
                rep = np.repeat(some, times[some])
                turn = np.arange(len(rep)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
                many = blocks[at[rep]]
                mine = ids[row[rep]] % many
                asks = (many > 1) & (turn >= many)
                q_block = np.where(asks, mine, np.where(many > 1, turn, 0))
                m_block = np.where(asks, turn - many, np.where(many > 1, mine, 0))
                role = np.where(many == 1, np.where(own[rep], 3, 1), np.where(asks, 2, 1)).astype(np.int8)  # 1 a member, 2 a query, 3 both
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[rep]), pa.array(q_block.astype(np.int32)), pa.array(m_block.astype(np.int32)), pa.array(ids[row[rep]]), pa.array(role), _binary(planes[row[rep]]), _binary(codes[rep])],
                    ["list", "q_block", "m_block", "id", "role", "vec", "code"],
                )

    def search(group: pa.Table) -> pa.Table:
        lists, books, copies = box.value
        ids, role = group["id"].to_numpy(), group["role"].to_numpy()
        unit = _units(group["vec"], width)
        codes = _bytes(group["code"], books.shape[0])
        rows = np.nonzero(role & 1)[0]
        m_ids, first = np.unique(ids[rows], return_index=True)
        rows = rows[first]
        asking = np.nonzero(role & 2)[0]
        q_ids, first = np.unique(ids[asking], return_index=True)
        asking = asking[first]
        many = {v[0]: v for v in copies.values()}
        if many:
            left = ~np.isin(q_ids, np.fromiter(many, np.int64))
            q_ids, asking = q_ids[left], asking[left]
        which = group["list"][0].as_py()
        q, nb, s = search_list(unit, codes, m_ids, rows, q_ids, asking, lambda x: lists.offset(x, np.full(len(x), which)), books, k, p.rerank)
        if many:
            q, nb, s = _expand(q, nb, s, many, k)
        return pa.table({"id": q.astype(np.int64), "neighbour": nb.astype(np.int64), "cosine": s.astype(np.float64)})

    placed = rows.mapInArrow(place, "list bigint, q_block int, m_block int, id bigint, role tinyint, vec binary, code binary")
    # tasks in proportion to the rows, of about 32 MB, whatever the session's number of partitions is
    tasks = max(spark.sparkContext.defaultParallelism, 1 + int(size[kept].sum()) * 4 * width // 32_000_000)
    keys = ["list", "q_block", "m_block"]
    found = placed.repartition(tasks, *keys).groupBy(*keys).applyInArrow(search, NEIGHBOURS)
    if (blocks > 1).any():  # the best of all blocks, k rows a query and block
        best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
        found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    # the exchanged vectors go before another search begins: their files stay until the driver has collected what refers to them, in turns
    found = cut_lineage(found)
    del placed
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    if not copies:
        return found
    # of the many copies of one vector each has the first k others
    few = spark.createDataFrame([(f, v) for f, v in copies.items()], "print bigint, others array<bigint>")
    others = F.slice(F.filter("others", lambda o: o != F.col("id")), 1, k)
    same = seen.select("id", "print").distinct().join(F.broadcast(few), "print").select("id", F.explode(others).alias("neighbour"), F.lit(1.0).alias("cosine"))
    return found.unionByName(same)


def _picked(seed: int, share: float) -> Column:
    """About ``share`` of all ids, by a hash: the same whatever the order or the partitions."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))


def _sampled(rows: DataFrame, share: float, width: int, seed: int, key: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``key, vec`` of the usable vectors of about ``share`` of the ids, those with a negative key left out; of repeated ids each task has one.

    ``key`` is of vectors of length 1 and of numbers from 0 to 1 that depend on the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for ids, x in (piece for b in batches for piece in _usable_once(b, width)):
            new = np.array([i not in had for i in ids.tolist()], bool)
            had.update(ids.tolist())
            ids, x = ids[new], x[new]
            of = key(_unit(x), (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2**53) if key and len(x) else np.zeros(len(x), np.int64)
            if (of >= 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(of[of >= 0]), _binary(_planes(x[of >= 0]))], ["key", "vec"])

    return rows.where(_picked(seed, share)).mapInArrow(run, "key bigint, vec binary")


def _fit(rows: DataFrame, n: int, width: int, p: IndexParams) -> tuple[Lists, np.ndarray]:
    """The lists and codebooks of ``n`` usable vectors, from a sample in proportion to the lists."""
    total = max(1, min(int(p.lists_factor * n**0.5), n // p.list_rows, p.max_lists))
    share, got = max(p.sample, p.fit_rows * total) / n, []
    while not len(got):  # a few vectors, none of them picked
        got = _sampled(rows, share, width, p.seed).toArrow()["vec"]
        share *= 4
    x = _units(got, width)
    centres = kmeans(x, min(total, len(x)), p.iterations, np.random.default_rng(p.seed), spherical=True)
    near = _closest(x, centres)
    lists = Lists.of(centres, radii(x, centres, near))
    some = np.random.default_rng(p.seed).permutation(len(x))[: p.sample]
    return lists, codebooks(lists.offset(x[some], near[some]), p)


def _divided(rows: DataFrame, lists: Lists, size: np.ndarray, width: int, p: IndexParams) -> Lists:
    """``lists`` with those of more than ``list_most`` rows in parts of about ``part_rows``, fitted on the executors on ``part_sample`` rows each."""
    large = np.nonzero(size > p.list_most)[0]
    want = np.maximum(2, size[large] // p.part_rows)
    want = np.maximum(2, (want * min(1.0, p.max_parts / want.sum())).astype(np.int64))
    number = np.full(len(lists.centres), -1)
    number[large] = np.arange(len(large))
    box = rows.sparkSession.sparkContext.broadcast((lists.centres, number, np.minimum(want, p.part_sample // 8), p.part_sample / size[large]))

    def key(x: np.ndarray, chance: np.ndarray) -> np.ndarray:
        centres, number, _, share = box.value
        of = number[_closest(x, centres)]
        return np.where(chance < share[of], of, -1)

    def fit(group: pa.Table) -> pa.Table:
        centres, number, want, _ = box.value
        f = group["key"][0].as_py()
        rest = _units(group["vec"], width)
        rest -= centres[np.nonzero(number == f)[0][0]]
        c = kmeans(rest, int(min(want[f], len(rest))), p.iterations, np.random.default_rng(p.seed))
        near = _closest(rest, c)
        return pa.table({"key": pa.array([f] * len(c), pa.int64()), "part": _binary(c.astype(np.float32).view(np.uint8).reshape(len(c), -1)), "radius": pa.array(radii(rest, c, near), pa.float32())})

    # a row a part, at most max_parts
    made = _sampled(rows, 1.0, width, p.seed, key).groupBy("key").applyInArrow(fit, "key bigint, part binary, radius float").toArrow()
    owner, part, radius = made["key"].to_numpy(), _bytes(made["part"], 4 * width).view(np.float32), made["radius"].to_numpy()
    order = np.argsort(owner, kind="stable")
    counts = np.zeros(len(lists.centres), np.int64)
    counts[large] = np.bincount(owner, minlength=len(large))
    return Lists(lists.centres, np.concatenate([lists.scale, radius[order]]).astype(np.float32), np.r_[0, np.cumsum(counts)], part[order].astype(np.float32))


def _copies(seen: DataFrame, limit: int, k: int) -> dict[int, list[int]]:
    """The first ids of each vector that more than ``limit`` ids have, in bounded number: fewer than 1 / heavy_share vectors."""
    heavy = seen.groupBy("print").agg(F.count_distinct("id").alias("c")).where(F.col("c") > limit).select("print")
    first = seen.join(F.broadcast(heavy), "print").select("print", "id").distinct()
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("print").orderBy("id"))).where(F.col("r") <= k + 1)
    copies: dict[int, list[int]] = {}
    for r in first.collect():
        copies.setdefault(r["print"], []).append(r["id"])
    return {key: sorted(v) for key, v in copies.items()}


def _expand(q: np.ndarray, nb: np.ndarray, s: np.ndarray, many: dict[int, list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Puts the copies beside the one that stands for them, and keeps the first k of each query."""
    rows: list[tuple[int, float, int]] = []
    for a, b, c in zip(q.tolist(), nb.tolist(), s.tolist()):
        rows += [(a, -c, o) for o in many.get(b, [b])[:k]]
    rows.sort()
    out, last, have = [], None, 0
    for a, c, o in rows:
        have = have + 1 if a == last else 1
        last = a
        if have <= k:
            out.append((a, o, -c))
    if not out:
        return q, nb, s
    a, b, c = zip(*out)
    return np.array(a), np.array(b), np.array(c)
