"""What the training-data operators share: bounded batches, and bitmaps that thin out rows before joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import outlasting, passing_tables, saved

__all__ = ["MaybeAmong", "outlasting", "passing_tables", "saved", "small_batches", "table"]


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that tasks exchange with Python, in rows and bytes, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Least and most bits of the map below, as powers of two: 16 megabytes at most, whatever is put in.
LEAST_BITS, MOST_BITS = 20, 27
#: Bits of one piece of the map, as a power of two.
PIECE_BITS = 16


class MaybeAmong:
    """A bitmap over 64-bit ids, with some eight bits an id: ids put in always pass, most others don't.

    It only thins out rows before an exact join, so that join moves less.  Beyond 2**24 ids it lets more and more pass,
    since its size is bounded.
    """

    def __init__(self, ids: DataFrame):
        self.power = power = min(MOST_BITS, max(LEAST_BITS, (8 * ids.count()).bit_length()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(1 << power, dtype=bool)
            for batch in batches:
                seen[_place(batch.column(0).to_numpy(zero_copy_only=False), power)] = True
            pieces = np.packbits(seen).reshape(-1, 1 << PIECE_BITS - 3)
            some = np.flatnonzero(pieces.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([pieces[k].tobytes() for k in some], pa.binary())], names=["piece", "bits"])

        def merge(table: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("bits").combine_chunks()])
            return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

        whole = np.zeros((1 << power - PIECE_BITS, 1 << PIECE_BITS - 3), dtype=np.uint8)
        kinds = "piece bigint, bits binary"
        for row in ids.mapInArrow(mark, kinds).groupBy("piece").applyInArrow(merge, kinds).toLocalIterator():
            whole[row["piece"]] = np.frombuffer(row["bits"], dtype=np.uint8)
        self.held = ids.sparkSession.sparkContext.broadcast(whole.ravel())

    def __getstate__(self) -> dict:
        return {"held": self.held, "power": self.power}

    def mask(self, ids: np.ndarray) -> np.ndarray:
        place = _place(ids, self.power)
        return (self.held.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)

    def passes(self, column: str) -> Column:
        """The same as a condition on a column of ids."""

        @F.arrow_udf("boolean")
        def known(ids: pa.Array) -> pa.Array:
            return pa.array(self.mask(ids.fill_null(0).to_numpy(zero_copy_only=False)))

        return known(F.col(column))


def _place(ids: np.ndarray, power: int) -> np.ndarray:
    return (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - power)).astype(np.int64)
