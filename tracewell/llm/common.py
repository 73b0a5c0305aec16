"""Shared pieces: reading tables, tables in the shared folder, walking sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.shared import own_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost no rework."""
    path = own_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `most` bytes of `column` (one row at least)."""
    if not batch.num_rows:
        return
    data = batch.column(column)
    lengths = np.diff(np.frombuffer(data.buffers()[1], dtype=np.int64 if pa.types.is_large_string(data.type) or pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1])
    piece = np.cumsum(lengths, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by `keys`; each has `least` rows or more but for the last.

    What is held is put together only once another group has begun, so a long group is not copied at every batch.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least or all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            continue
        whole = pa.Table.from_batches(held)
        last = bounds(whole, keys)[-2]
        yield whole.slice(0, last)
        held, rows = whole.slice(last).combine_chunks().to_batches(), whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


class BitMap:
    """Which places, of 1 << 27, hold something: 16 MB at most, whatever the table's size. It comes to the driver as Arrow
    and goes to tasks to keep what is surely not asked for from an exchange; a full map only lets more pass."""

    MASK = (1 << 27) - 1

    def __init__(self, places: DataFrame) -> None:
        """places: a column of longs, of which the lowest 27 bits are the place."""
        p = F.col(places.columns[0]).bitwiseAND(F.lit(self.MASK))
        bit = places.select(p.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
        words = bit.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        at, bits = (np.append(words.column(c).to_numpy(), last) for c, last in (("word", 1 << 40), ("bits", 0)))
        order = np.argsort(at)
        self.at, self.bits = at[order].astype(np.int64), bits[order].astype(np.int64).view(np.uint64)

    def has(self, places: np.ndarray) -> np.ndarray:
        p = places.astype(np.int64) & self.MASK
        k = np.searchsorted(self.at, p >> 6)
        return (self.at[k] == p >> 6) & ((self.bits[k] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def bounds(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a group starts, and the number of rows."""
    n = rows.num_rows
    new = np.zeros(max(n, 1), dtype=bool)
    new[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:n] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new[:n]), n)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str | None = None, most: int = 8 << 20):
    """A mapInArrow function from one on batches; `column` cuts large batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, most) if column else [batch]:
                yield fn(piece)

    return run
