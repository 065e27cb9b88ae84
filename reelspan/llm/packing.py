"""Filling containers of fixed capacity, by cost-balanced packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.session import small_rows

OUT = "container_kind string, container_id string, doc_id bigint, piece_no int, start_token bigint, size_tokens bigint"


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1e-3) -> np.ndarray:
    """Container number of each item (all at most ``capacity``); items are taken in descending size, ties as given.

    There are at first as many open sequences as the sum of sizes needs. Each item goes to the sequence of lowest
    estimated cost (``linear`` times size plus ``quadratic`` times its square, as attention has it) among those with
    room; where none has, to a new one.
    """
    order = np.argsort(-sizes, kind="stable")
    n0 = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    room = np.full(max(len(sizes), n0, 1), capacity, np.int64)
    cost = np.full(len(room), np.inf)
    cost[:n0] = 0.0
    n, out = n0, np.empty(len(sizes), np.int64)
    for i in order:
        s = int(sizes[i])
        fits = np.where(room[:n] >= s, cost[:n], np.inf)
        k = int(fits.argmin()) if n else 0
        if n == 0 or not np.isfinite(fits[k]):
            k, n = n, n + 1
            cost[k] = 0.0
        room[k] -= s
        cost[k] += linear * s + quadratic * s * s
        out[i] = k
    return out


def containers(documents: DataFrame, kinds: DataFrame, shard_items: int = 4000, most_kinds: int = 1000, linear: float = 1.0, quadratic: float = 1e-3) -> DataFrame:
    """An assignment of all documents to containers of every kind: ``container_kind, container_id, doc_id, piece_no, start_token, size_tokens``.

    ``documents``: ``doc_id, text``; ``kinds``: ``container_kind, capacity_tokens`` (positive), at most ``most_kinds``.
    A size is the number of UTF-8 bytes; a null or empty text has size 0 and is assigned too. Only documents larger
    than the capacity are divided: full pieces are containers of their own, the rest is packed as an item.
    Items are spread by a hash of their id over shards of about ``shard_items`` items, each packed by itself; what a
    shard's last containers leave unused is the cost of this, a fraction of a percent. Only ids and sizes travel.
    """
    kind_rows = [r for r in small_rows(kinds.select("container_kind", "capacity_tokens").distinct(), most_kinds, "containers") if r[1] and r[1] > 0]
    sized = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("_size"))
    shards = max(1, -(-sized.count() // shard_items))
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).cast("bigint").alias("cap")) for k, c in kind_rows]).cast("array<struct<kind:string,cap:bigint>>"))
    items = sized.select("doc_id", "_size", kind.alias("k")).select("doc_id", "_size", "k.kind", "k.cap")
    full = F.floor(F.col("_size") / F.col("cap"))
    full = F.when(F.col("_size") > F.col("cap"), full).otherwise(F.lit(0))
    rest = F.col("_size") - full * F.col("cap")
    whole = items.where("_size > cap").select("kind", "doc_id", "cap", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("p"))
    whole = whole.select(
        F.col("kind").alias("container_kind"), F.format_string("%d/%d", "doc_id", "p").alias("container_id"), "doc_id",
        F.col("p").cast("int").alias("piece_no"), (F.col("p") * F.col("cap")).alias("start_token"), F.col("cap").alias("size_tokens"),
    )
    loose = items.where((F.col("_size") <= F.col("cap")) | (rest > 0)).select(
        "kind", "cap", "doc_id", full.cast("int").alias("piece_no"), (full * F.col("cap")).alias("start_token"), rest.alias("size_tokens"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
    )

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size_tokens", "doc_id"], ascending=[False, True], kind="stable")
        k = pack(f["size_tokens"].to_numpy(np.int64), int(f["cap"].iloc[0]), linear, quadratic)
        ids = [f"s{f['shard'].iloc[0]}/{i}" for i in k]
        return pd.DataFrame({"container_kind": f["kind"].to_numpy(), "container_id": ids, "doc_id": f["doc_id"].to_numpy(), "piece_no": f["piece_no"].to_numpy(np.int32), "start_token": f["start_token"].to_numpy(), "size_tokens": f["size_tokens"].to_numpy()})

    return whole.unionByName(loose.groupBy("kind", "shard").applyInPandas(fill, OUT))


def usage(assigned: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, capacity and the share of it that is used; ``used`` is null where nothing was assigned."""
    per = assigned.groupBy("container_kind", "container_id").agg(F.sum("size_tokens").alias("t"), F.count("*").alias("n"))
    per = per.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("t").alias("tokens"), F.sum("n").alias("n_items"), F.max("t").alias("largest"))
    return per.join(kinds.select("container_kind", "capacity_tokens").distinct(), "container_kind").withColumn("used", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4))
