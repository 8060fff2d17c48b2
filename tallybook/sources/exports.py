"""Exports and summary storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_text_decimals(df: DataFrame) -> DataFrame:
    """Decimals as plain strings."""
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema
    ])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header each; no rows, no part with data."""
    with_text_decimals(df).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, decimals as strings, NULLs kept."""
    with_text_decimals(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_rows(df: DataFrame, pretty: bool = True) -> DataFrame:
    """Each row as one JSON text, indented by 2 by default."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return with_text_decimals(df).select(F.to_json(F.struct("*"), options).alias("json"))


def write_summary(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Store a summary. With a partition column only the partitions present in
    ``df`` are replaced (dynamic overwrite).

    Never write to a path that ``df`` still reads: refreshes go to a new version
    or are stored first.
    """
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)
