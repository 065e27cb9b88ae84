"""Sorted tables with a text key in the shared folder, looked up block by block: for what is too large to be sent to every worker."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame

from reelspan.session import shared_dir


class SortedTable:
    """Rows by key; at most ``kept`` blocks of 10,000 rows or fewer are held in memory. Its firsts are one text a block."""

    def __init__(self, folder: str, blocks: list[tuple[str, str, int]], kept: int = 64) -> None:
        self.folder, self.blocks, self.kept = folder, sorted(blocks), kept
        self.firsts = [b[0] for b in self.blocks]
        self._open()

    def _open(self) -> None:
        self.block = lru_cache(maxsize=self.kept)(self._block)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "block"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _block(self, i: int) -> list[list]:
        files, root = fs.FileSystem.from_uri(self.folder.replace("s3a://", "s3://"))
        _, name, n = self.blocks[i]
        with files.open_input_file(f"{root}/{name}") as f:
            return [c.to_pylist() for c in ipc.open_file(f).get_batch(n).columns]

    def row(self, key: str) -> tuple | None:
        """The row of ``key`` less the key."""
        i = bisect_right(self.firsts, key) - 1
        if i < 0:
            return None
        cols = self.block(i)
        at = bisect_left(cols[0], key)
        return tuple(c[at] for c in cols[1:]) if at < len(cols[0]) and cols[0][at] == key else None

    def next_key(self, key: str) -> str | None:
        """The first key from ``key`` on."""
        i = max(0, bisect_right(self.firsts, key) - 1)
        if i < len(self.firsts):
            keys = self.block(i)[0]
            if (at := bisect_left(keys, key)) < len(keys):
                return keys[at]
            return self.firsts[i + 1] if i + 1 < len(self.firsts) else None
        return None


def sorted_table(df: DataFrame, key: str, rows: int = 10_000) -> SortedTable:
    """Writes ``df``, of which ``key`` (text, not null, unique) is the first column, sorted into the shared folder; it stays there."""
    folder, name = shared_dir(df.sparkSession), f"words-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
        file, firsts, out, sink = f"{name}-{uuid.uuid4().hex}.arrow", [], None, None  # of this attempt
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                if sink is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{file}")
                    sink = ipc.new_file(out, part.schema)
                sink.write_batch(part)
                firsts.append(part.column(0)[0].as_py())
        if sink is not None:
            sink.close()
            out.close()
        yield pa.RecordBatch.from_pydict({"first": pa.array(firsts, pa.string()), "file": pa.array([file] * len(firsts), pa.string()), "n": pa.array(range(len(firsts)), pa.int32())})

    # a plain sort is by bytes of UTF-8, as Python's texts are by characters: the same order
    got = df.orderBy(key).mapInArrow(write, "first string, file string, n int").collect()
    return SortedTable(folder, [tuple(r) for r in got])
