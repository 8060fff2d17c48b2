"""Core tables, ad-hoc SQL and column mappings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.schemas import MAPPING_SCHEMA, TABLES


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One core table, read with its declared schema (no inference)."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def load_ledger(spark: SparkSession, root: str) -> Ledger:
    return Ledger(**{name: load_table(spark, root, name) for name in Ledger.__dataclass_fields__})


@contextmanager
def views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[None]:
    """The tables by name for as long as the block runs; the session's own views of
    these names come back afterwards."""
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    covered = {name: spark.table(name) for name in tables if name in own}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, table in covered.items():
            table.createOrReplaceTempView(name)


def run_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], params: Mapping | None = None) -> DataFrame:
    """Ad-hoc SQL over the tables, with bound parameters (``:name``). Anything but
    a query is refused before it runs: only a query can stand in parentheses."""
    text, args = sql.strip().rstrip(";"), dict(params or {})
    with views(spark, tables):
        spark.sql(f"SELECT * FROM (\n{text}\n) LIMIT 0", args=args)
        return spark.sql(text, args=args)


def save_mappings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert column mappings by name; ``mapping`` is JSON text. Of several rows of
    one name in a batch the greatest text stays."""
    new = new.groupBy("name").agg(*[F.max_by(c, "mapping").alias(c) for c in new.columns if c != "name"]).select(*new.columns)
    kept = stored.join(new.select("name"), "name", "left_anti")
    return kept.unionByName(new)


def load_mapping(stored: DataFrame, name: str) -> DataFrame:
    """The named mapping as a struct: one row, or none."""
    return stored.filter(F.col("name") == name).select(F.from_json("mapping", MAPPING_SCHEMA).alias("m")).select("m.*")
