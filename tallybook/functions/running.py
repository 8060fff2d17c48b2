"""Running sums that never gather one key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS = 20


def _zero(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        kind = T.DecimalType(38, kind.scale)
    return F.lit(0).cast(kind)


def sums_before(
    df: DataFrame,
    keys: Sequence[str],
    major: str,
    row_id: str,
    values: Sequence[str],
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add ``<v>_before``: the sum of ``v`` over earlier rows of the same keys in
    (``major``, ``row_id``) order. ``row_id`` is a long, unique within its key.

    Keys with at most ``2**block_bits`` rows take a plain window: one shuffle.
    Larger keys, of which there can be at most one per ``2**block_bits`` rows,
    are told apart by a broadcast of just those keys and go block-wise; where
    there are none, that branch is dropped at run time.
    """
    return _before(df, keys, major, row_id, values, block_bits, F.sum, lambda a, b: a + b, _sum_type, True)


def maxima_before(
    df: DataFrame, keys: Sequence[str], major: str, row_id: str, values: Sequence[str], block_bits: int = BLOCK_BITS
) -> DataFrame:
    """The same with the largest earlier value; NULL where there is none."""
    return _before(df, keys, major, row_id, values, block_bits, F.max, F.greatest, lambda d, v: d.schema[v].dataType, False)


def _before(df, keys, major, row_id, values, block_bits, agg, combine, kind, from_zero) -> DataFrame:
    keys = list(keys)

    def earlier(v: str, over: list[str], *order: str) -> Column:
        w = Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        found = agg(v).over(w)
        return F.coalesce(found, _zero(df, v)) if from_zero else found

    large = F.broadcast(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1 << block_bits).select(*keys)
    )
    small = df.join(large, keys, "left_anti").select(
        *df.columns, *[earlier(v, keys, major, row_id).cast(kind(df, v)).alias(f"{v}_before") for v in values]
    )
    hot = df.join(large, keys, "left_semi")
    return small.unionByName(_blockwise(hot, keys, major, row_id, values, block_bits, agg, combine, kind, earlier))


def _blockwise(df, keys, major, row_id, values, block_bits, agg, combine, kind, earlier) -> DataFrame:
    """The same for keys of any size.

    The result is combined from three: whole earlier ``major`` values (one row
    each), whole earlier blocks of ``2**block_bits`` ids within the ``major``
    value (one row each), and rows within the block, of which there are at most
    the block size. Only the last step moves rows, once, on (keys, major, block).
    """
    day, block = [*keys, major], [*keys, major, "_block"]
    rows = df.withColumn("_block", F.shiftright(F.col(row_id), block_bits))
    blocks = rows.groupBy(*block).agg(*[agg(v).alias(v) for v in values])
    days = blocks.groupBy(*day).agg(*[agg(v).alias(v) for v in values])
    days = days.select(*day, *[earlier(v, keys, major).alias(f"_day_{v}") for v in values])
    blocks = blocks.select(*block, *[earlier(v, day, "_block").alias(f"_block_{v}") for v in values])
    offsets = blocks.join(days, day).select(
        *block, *[combine(F.col(f"_day_{v}"), F.col(f"_block_{v}")).alias(f"_offset_{v}") for v in values]
    )
    own = [earlier(v, block, row_id).alias(f"_own_{v}") for v in values]
    out = rows.select("*", *own).join(offsets, block)
    return out.select(
        *df.columns,
        *[combine(F.col(f"_own_{v}"), F.col(f"_offset_{v}")).cast(kind(df, v)).alias(f"{v}_before") for v in values],
    )


def _sum_type(df: DataFrame, name: str) -> T.DataType:
    kind = df.schema[name].dataType
    return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
