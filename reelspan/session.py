"""Session helpers: local session for tests, shared folder, lineage cut, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "reelspan") -> SparkSession:
    """A session for tests and benches; a cluster passes its own session to every operator."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REELSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own, deleted at exit; on a
    cluster that raises, as no machine's own folder outlives its loss."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="reelspan-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = "file://" + path
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder, so a lost executor costs no recomputation of what came before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, keys: list[str], order: str = "ingested_at", most: int = 4_000_000) -> DataFrame:
    """One row per key, the one delivered first; equal delivery times are ordered by the row's hash.

    Redelivered rows repeat an earlier row in all columns but ``order``. Null keys form a key of their own. Keys that stand more than
    once are found by an exchange of the keys alone; only rows with the hash of such a key are grouped, all others stay where they
    are. The hashes are broadcast up to ``most`` of them; beyond that whole rows are exchanged.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    key = F.xxhash64(*keys).alias("_key")
    # two different keys of one hash are taken apart below
    again = cut_lineage(df.select(key).groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    n = again.count()
    if not n:
        return df
    if n > most:
        return _first_delivered(df, keys, rest, order)
    marked, again = df.withColumn("_row_key", key), F.broadcast(again)
    single = marked.join(again, F.col("_row_key") == F.col("_key"), "left_anti").drop("_row_key")
    repeated = marked.join(again, F.col("_row_key") == F.col("_key"), "left_semi").drop("_row_key")
    return single.unionByName(_first_delivered(repeated, keys, rest, order))


def _first_delivered(df: DataFrame, keys: list[str], rest: list[str], order: str) -> DataFrame:
    rank: list[Column] = [F.col(order).isNull(), F.col(order)] if order in rest else []
    best = F.min_by(F.struct(*rest), F.struct(*rank, F.xxhash64(*rest))).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a dimension table on the driver; raises when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
