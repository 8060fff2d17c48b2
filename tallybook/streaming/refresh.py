"""Summaries kept up to date from a stream of postings.

State is what sums are made of: a row per account, currency and day with the day's
total and the balance within its month, and a row per account, currency and month
with the month's total. Both are laid out by month and by a bucket of accounts. A
micro-batch is summed up, merged with the partitions that it touches, and these
alone are written as a new version; a small table of versions per batch says which
version of a partition counts. What a batch costs follows from the months and
buckets it touches, not from the history before, and postings of any date are
taken: a balance before a month is a sum over months, made when a summary is read.

A retried batch starts from the versions of the batch before and writes the same
files again, so retries change nothing. No watermark drops rows. A transaction
comes whole, in one batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallybook.functions.calendar import month_key
from tallybook.ledger import Ledger
from tallybook.plans import summaries
from tallybook.schemas import TOTAL
from tallybook.session import removed

POSTED = "id long, transaction_id long, account_id long, amount decimal(18,2), currency string, date date"
#: Buckets of accounts within a month.
BUCKETS = 16
_KEYS = ["account_id", "currency"]
_PLACE = ["year_month", "bucket"]
_DAYS = f"account_id long, currency string, date date, day_total {TOTAL.simpleString()}, transaction_count long, month_balance {TOTAL.simpleString()}"
_MONTHS = f"account_id long, currency string, month_total {TOTAL.simpleString()}, transaction_count long"
_VERSIONS = "year_month string, bucket int, version long"


def _file(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch={batch_id}"


def _versions(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Which version of each partition counts after a batch."""
    if batch_id < 0:
        return spark.createDataFrame([], _VERSIONS)
    return spark.read.schema(_VERSIONS).parquet(_file(root, "versions", batch_id))


def _partitions(spark: SparkSession, root: str, name: str, schema: str, places: Sequence) -> DataFrame:
    """State rows of some partitions ``(year_month, bucket, version)``."""
    wide = f"{schema}, version long, year_month string, bucket int"
    paths = [f"{root}/{name}/version={p.version}/year_month={p.year_month}/bucket={p.bucket}" for p in places]
    if not paths:
        return spark.createDataFrame([], wide).drop("version")
    return spark.read.schema(wide).option("basePath", f"{root}/{name}").parquet(*paths).drop("version")


def _overwrite(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    """The partitions of one version, a file each."""
    path = f"{root}/{name}/version={batch_id}"
    writer = df.repartition(*_PLACE).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*_PLACE).parquet(path)


def refresh_batch(batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS) -> None:
    """One micro-batch of rows with the ``POSTED`` columns."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("account_id"), F.lit(buckets)).cast("int")
    day_totals = batch.groupBy(*_KEYS, "date").agg(
        F.sum("amount").cast(TOTAL).alias("day_total"), F.count_distinct("transaction_id").alias("transaction_count")
    ).select("*", month_key(F.col("date")).alias("year_month"), bucket.alias("bucket"))
    day_totals.write.mode("overwrite").parquet(_file(root, "arrived", batch_id))
    arrived = spark.read.schema(day_totals.schema).parquet(_file(root, "arrived", batch_id))

    before = _versions(spark, root, batch_id - 1)
    places = arrived.select(*_PLACE).distinct()
    # One row per touched month and bucket: the paths to read.
    touched = before.join(places, _PLACE, "left_semi").collect()
    amounts = ["day_total", "transaction_count"]
    rows = _partitions(spark, root, "days", _DAYS, touched).select(*_KEYS, "date", *amounts, *_PLACE).unionByName(arrived)
    days = rows.groupBy(*_KEYS, "date", *_PLACE).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in amounts])
    within = Window.partitionBy(*_KEYS, *_PLACE).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    _overwrite(days.withColumn("month_balance", F.sum("day_total").over(within).cast(TOTAL)), root, "days", batch_id)
    month = arrived.groupBy(*_KEYS, *_PLACE).agg(F.sum("day_total").alias("month_total"), F.sum("transaction_count").alias("transaction_count"))
    old = _partitions(spark, root, "months", _MONTHS, touched)
    months = old.unionByName(month.select(*old.columns)).groupBy(*_KEYS, *_PLACE).agg(
        F.sum("month_total").cast(TOTAL).alias("month_total"), F.sum("transaction_count").alias("transaction_count")
    )
    _overwrite(months, root, "months", batch_id)
    after = before.join(places, _PLACE, "left_anti").unionByName(places.withColumn("version", F.lit(batch_id).cast("long")))
    # Last of all: until it is there, the batch has not happened.
    after.select(*[c.split()[0] for c in _VERSIONS.split(", ")]).coalesce(1).write.mode("overwrite").parquet(_file(root, "versions", batch_id))


def _state(spark: SparkSession, root: str, name: str, schema: str, batch_id: int, since: str | None = None) -> DataFrame:
    versions = _versions(spark, root, batch_id)
    if since is not None:
        versions = versions.filter(F.col("year_month") >= since)
    return _partitions(spark, root, name, schema, versions.collect())  # one row per month and bucket


def _running(months: DataFrame, to_here: int) -> Column:
    """The sum of an account's month totals, up to the month (0) or the one before (-1)."""
    w = Window.partitionBy(*_KEYS).orderBy("year_month").rowsBetween(Window.unboundedPreceding, to_here)
    return F.coalesce(F.sum("month_total").over(w), F.lit(0)).cast(TOTAL)


def read_summary(spark: SparkSession, root: str, name: str, batch_id: int, base: Ledger) -> DataFrame:
    """A summary as of a batch; ``base`` has the accounts and prices."""
    months = _state(spark, root, "months", _MONTHS, batch_id)
    if name == "s_daily_balances":
        days = _state(spark, root, "days", _DAYS, batch_id)
        opening = months.select(*_KEYS, "year_month", _running(months, -1).alias("opening"))
        return days.join(opening, [*_KEYS, "year_month"]).select(
            "account_id", "date", "currency", (F.col("opening") + F.col("month_balance")).cast(TOTAL).alias("balance"), "transaction_count"
        )
    if name == "s_monthly_spending":
        kinds = base.accounts.filter(F.col("type").isin("Expenses", "Income")).select(F.col("id").alias("account_id"))
        return months.join(kinds, "account_id", "left_semi").select(
            "account_id", "year_month", "currency", F.col("month_total").alias("total"), "transaction_count"
        )
    balances = months.select("account_id", "year_month", "currency", _running(months, 0).alias("closing_balance"))
    if name == "s_account_monthly_balances":
        return balances
    if name == "s_net_worth":
        return summaries.net_worth(base, balances)
    raise KeyError(f"no summary of postings named {name!r}")


def vacuum(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove the versions of partitions that batches from this one on no longer read.
    Neither this batch nor later ones may still be retried from before it."""
    live = {(p.version, p.year_month, p.bucket) for p in _versions(spark, root, batch_id).collect()}
    for batch in range(batch_id):
        gone = [p for p in _versions(spark, root, batch).filter(F.col("version") == batch).collect() if (p.version, p.year_month, p.bucket) not in live]
        for name in ("days", "months"):
            for p in gone:
                removed(spark, f"{root}/{name}/version={p.version}/year_month={p.year_month}/bucket={p.bucket}")


def refresh_stream(posted: DataFrame, root: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """The stream's writer; the caller sets the trigger and starts it."""
    return (
        posted.writeStream.queryName("summary_refresh")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(lambda batch, batch_id: refresh_batch(batch, batch_id, root, buckets))
    )
