"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import released, stored

__all__ = ["bits", "broadcast_bits", "read", "released", "slices", "stored"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def broadcast_bits(df: DataFrame, column: str, size: int) -> Broadcast:
    """A packed array of ``size`` bits to all tasks, set where the column (from 0) has a
    value; ``bits`` unpacks it. Only the bits reach the driver, by the kilobyte."""
    place = F.col(column).cast("long") + 1
    rows = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    ).collect()
    packed = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for row in rows:
        packed[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(packed)


def bits(known: Broadcast) -> np.ndarray:
    return np.unpackbits(known.value, bitorder="little").view(bool)


#: Bytes of text that a task turns over at a time.
SLICE = 2_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """An Arrow batch in parts of bounded size, each with a column's values; a
    single larger value is a part by itself."""
    start, values = 0, []
    array = batch.column(batch.schema.get_field_index(column))
    held = 0
    for i, value in enumerate(array):
        values.append(value.as_py())
        held += len(values[-1] or ()) * (4 if pa.types.is_list(array.type) else 1) + 16
        if held >= SLICE:
            yield batch.slice(start, i + 1 - start), values
            start, held, values = i + 1, 0, []
    if values:
        yield batch.slice(start), values
