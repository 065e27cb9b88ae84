"""How often every term occurs and in how many records, by recursive radix spilling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTIAL = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("hash", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])


def labels_of(col: Column) -> Column:
    """Array of labels in lower case, blanks at the ends removed and inner runs made one; null and empty ones are none."""
    clean = F.transform(col, lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " ")))
    return F.coalesce(F.filter(clean, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def words_of(col: Column) -> Column:
    """Array of the longest runs of a-z and 0-9 after A-Z are made lower case; nothing else is folded."""
    return F.coalesce(F.regexp_extract_all(F.translate(col, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def _combine(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Adds up equal terms of a task before they travel; holds at most ``rows`` rows and what one batch adds."""
    held: list[pa.RecordBatch] = []
    have = 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(["field_name", "term", "hash"]).aggregate([("occurrences", "sum"), ("records", "sum")])
        yield from t.select(["field_name", "term", "hash", "occurrences_sum", "records_sum"]).rename_columns(PARTIAL.names).cast(PARTIAL).to_batches()

    for b in batches:
        held += pa.Table.from_batches([b]).cast(PARTIAL).to_batches()
        have += b.num_rows
        if have >= rows:
            held, have = list(flush()), 0
            have = sum(x.num_rows for x in held)
            if have > rows // 2:
                yield from held
                held, have = [], 0
    if held:
        yield from flush()


def _radix_aggregate(batches: Iterator[pa.RecordBatch], folder: str, memory_mb: int, bits: int, used_bits: int) -> Iterator[pa.RecordBatch]:
    """Totals of the terms in ``batches``, which are partitioned to disk by the next hash bits.

    Every partition over the memory goes through the same split with the bits after; when the bits are used up, only rows of
    one hash are left, which add up in a stream. Each leaf is aggregated by DuckDB under the same memory limit.
    """
    import duckdb
    import pyarrow.ipc as ipc
    from pyarrow import fs

    limit = memory_mb * 1_000_000
    name = f"terms-{uuid.uuid4().hex}"
    local = folder.startswith(("file:", "/"))
    place: list = []

    def spill_to() -> tuple:
        """File system and folder of this attempt, first asked for when there are rows."""
        if not place:
            files, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
            place.extend((files, f"{root}/{name}"))
        return place[0], place[1]

    def leaf(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(place) == 2:  # one DuckDB a task
            place.append(duckdb.connect(config={"threads": 1, "memory_limit": f"{max(64, 3 * memory_mb)}MB", "temp_directory": f"{spill_to()[1]}/duckdb" if local else ""}))
        part = pa.RecordBatchReader.from_batches(PARTIAL, rows)  # noqa: F841 - named in the SQL
        total = place[2].sql("SELECT field_name, term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY ALL")
        yield from total.fetch_arrow_reader(10_000) if not hasattr(total, "to_arrow_reader") else total.to_arrow_reader(10_000)

    def split(source: Iterator[pa.RecordBatch], start: int, below: str) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, parts = 0, 1 << bits
        sinks: dict[int, tuple] = {}
        sizes = [0] * parts

        def spill() -> None:
            t = pa.Table.from_batches(held, PARTIAL).combine_chunks()
            h = t["hash"].to_numpy()
            digit = (h.view("uint64") >> (64 - start - bits)) & (parts - 1)
            for d in range(parts):
                rows = (digit == d).nonzero()[0]
                if len(rows):
                    if d not in sinks:
                        files, root = spill_to()
                        files.create_dir(root + below, recursive=True)
                        out = files.open_output_stream(f"{root}{below}/{d}.arrow")
                        sinks[d] = (out, ipc.new_stream(out, PARTIAL, options=ipc.IpcWriteOptions(compression="zstd")))
                    sub = t.take(pa.array(rows))
                    sinks[d][1].write_table(sub)
                    sizes[d] += sub.nbytes
            held.clear()

        final = start + bits > 64
        if final:
            yield from leaf(source)
            return
        for b in source:
            held += pa.Table.from_batches([b]).cast(PARTIAL).to_batches()
            size += b.nbytes
            if size > limit:
                spill()
                size = 0
        if held:
            spill()
        if not sinks:
            return
        for out, sink in sinks.values():
            sink.close()
            out.close()
        files, root = spill_to()
        for d in sinks:
            part = f"{root}{below}/{d}.arrow"
            with files.open_input_stream(part) as f:
                stored = ipc.open_stream(f)
                yield from split(stored, start + bits, f"{below}/{d}") if sizes[d] > limit else leaf(iter(stored))
            files.delete_file(part)

    try:
        yield from split(iter(batches), used_bits, "")
    finally:
        if len(place) > 2:
            place[2].close()
        files, run = spill_to() if place else (None, "")
        if files and files.get_file_info(run).type != fs.FileType.NotFound:
            files.delete_dir(run)


def term_totals(terms: DataFrame, memory_mb: int = 64, bits: int = 4, combine_rows: int = 200_000) -> DataFrame:
    """``field_name, term, occurrences, records`` over ``field_name, terms array<string>``, one row per record and field.

    Terms are counted inside each record, then inside each task, so that a frequent term travels once per task; the
    rest is partitioned by the leading bits of the term's hash between the tasks, and in a task by the bits after, on disk in the
    shared folder; what exceeds ``memory_mb`` there is split further. A null array is a record without terms; an empty table gives none.
    """
    spark = terms.sparkSession
    folder = shared_dir(spark)
    # sorted, equal terms are neighbours: the first of each run counts the record
    runs = terms.select("field_name", F.sort_array("terms").alias("s")).select(
        "field_name", F.explode(F.transform("s", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("s", i - 1))).cast("bigint").alias("first")))).alias("t")
    )
    rows = runs.select("field_name", "t.term", F.xxhash64("field_name", "t.term").alias("hash"), F.lit(1).cast("bigint").alias("occurrences"), F.col("t.first").alias("records"))
    ddl = "field_name string, term string, hash bigint, occurrences bigint, records bigint"
    combined = rows.mapInArrow(lambda it: _combine(it, combine_rows), ddl)
    # the first radix pass is the exchange itself: by the hash, so each task has whole terms
    spread = combined.repartition(F.shiftrightunsigned("hash", 48))
    return spread.mapInArrow(lambda it: _radix_aggregate(it, folder, memory_mb, bits, 16), "field_name string, term string, occurrences bigint, records bigint")


def banded(totals: DataFrame, n_records: DataFrame, rare_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """Adds ``band``: ``rare`` at most ``rare_most`` records, else ``common`` above ``common_share`` of ``n_records`` (one row, ``n``), else null."""
    return totals.crossJoin(F.broadcast(n_records.select(F.col("n").alias("_n")))).withColumn(
        "band", F.when(F.col("records") <= rare_most, "rare").when(F.col("records") > common_share * F.col("_n"), "common")
    ).drop("_n")
