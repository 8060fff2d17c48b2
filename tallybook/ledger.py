"""The set of core tables an operator works on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.calendar import month_key
from tallybook.schemas import TABLES
from tallybook.session import stored

#: Where a ledger is laid out by month: the column that tells it.
MONTH = "ledger_month"


@dataclass(frozen=True)
class Ledger:
    """Core tables; summaries are derived from them (see ``plans.summaries``)."""

    accounts: DataFrame
    transactions: DataFrame
    postings: DataFrame
    transaction_tags: DataFrame
    prices: DataFrame
    lots: DataFrame
    lot_dispositions: DataFrame
    corporate_actions: DataFrame
    transfers: DataFrame
    source_files: DataFrame
    raw_extractions: DataFrame
    currency_tolerances: DataFrame

    def with_tables(self, **tables: DataFrame) -> "Ledger":
        return replace(self, **tables)

    @classmethod
    def empty(cls, spark: SparkSession) -> "Ledger":
        return cls(**{
            name: spark.createDataFrame([], TABLES[name])
            for name in cls.__dataclass_fields__
        })

    def stored(self) -> "Ledger":
        """The same tables written to the shared folder as a new version and read
        back. Changes are built on stored tables, so that a chain of them does
        not repeat the work of the ones before."""
        return Ledger(**{name: stored(table, name) for name, table in self.tables().items()})

    def laid_out(self, path: str) -> "Ledger":
        """Transactions and postings written below ``path`` by month of the transaction,
        so that what is looked up around some days reads their months only."""
        spark, month = self.transactions.sparkSession, month_key(F.col("date")).alias(MONTH)
        months = self.transactions.select(F.col("id").alias("transaction_id"), month)
        wide = {
            "transactions": self.transactions.drop(MONTH).select("*", month),
            "postings": self.postings.drop(MONTH).join(months, "transaction_id").select(*self.postings.drop(MONTH).columns, MONTH),
        }
        for name, table in wide.items():
            table.repartition(MONTH).write.partitionBy(MONTH).parquet(f"{path}/{name}")
        return self.with_tables(**{name: spark.read.schema(table.schema).parquet(f"{path}/{name}") for name, table in wide.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.__dataclass_fields__}
