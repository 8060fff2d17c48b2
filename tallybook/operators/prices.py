"""Price tables: upserts, as-of lookups, conversion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.schemas import RATE

PAIR = ["commodity", "currency"]


def upsert_prices(stored: DataFrame, arriving: DataFrame, order: str = "seq") -> DataFrame:
    """Last write wins per (commodity, currency, date).

    ``arriving`` carries its arrival order in ``order``; every stored row is older.
    """
    columns = [*PAIR, "date", "price", "source"]
    rows = stored.select(*columns, F.lit(None).cast("long").alias(order)).unionByName(
        arriving.select(*columns, F.col(order).cast("long"))
    )
    # struct order: NULL sequence sorts first, so any arrival beats a stored row.
    latest = F.max(F.struct(F.col(order), F.struct("price", "source").alias("row"))).alias("last")
    return (
        rows.groupBy(*PAIR, "date").agg(latest)
        .select(*PAIR, "date", "last.row.price", "last.row.source")
    )


def prices_from_postings(postings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Prices implied by postings, the last posting of a day winning; source ``transaction``."""
    priced = postings.filter(F.col("price").isNotNull() & F.col("price_currency").isNotNull())
    headers = transactions.select(F.col("id").alias("transaction_id"), "date")
    return (
        priced.join(headers, "transaction_id")
        .groupBy(
            F.col("currency").alias("commodity"), F.col("price_currency").alias("currency"), "date"
        )
        .agg(F.max_by("price", F.struct("transaction_id", "id")).alias("price"))
        .withColumn("source", F.lit("transaction"))
    )


def latest_prices(prices: DataFrame, commodity: str | None = None) -> DataFrame:
    """Newest price per pair."""
    if commodity is not None:
        prices = prices.filter(F.col("commodity") == commodity)
    return prices.groupBy(*PAIR).agg(
        F.max_by("price", "date").alias("price"), F.max("date").alias("date")
    )


def price_history(
    prices: DataFrame,
    commodity: str,
    currency: str,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> DataFrame:
    """One pair's prices in date order, bounds inclusive."""
    rows = prices.filter((F.col("commodity") == commodity) & (F.col("currency") == currency))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows.orderBy("date")


def inverse(price: Column) -> Column:
    """1 / price at rate precision; NULL for a zero price."""
    return F.try_divide(F.lit(1).cast(RATE), price.cast(RATE)).cast(RATE)


def asof_prices(probes: DataFrame, prices: DataFrame, with_inverse: bool = False) -> DataFrame:
    """Last price at or before each probe's date.

    ``probes`` holds (commodity, currency, date). The result has one row per
    distinct probe, with ``price`` (NULL when there is none) and ``price_date``.
    With ``with_inverse`` a pair without a direct price takes 1 / the reversed
    pair's price; a direct price wins even when it is older.

    Probes and prices are both reduced to one row per pair and day before the
    window, so a pair's partition is bounded by the calendar, not by the number
    of facts that ask for it.
    """
    keys = [*PAIR, "date"]
    price = F.col("price").cast(RATE)
    none = F.lit(None).cast(RATE)
    asked = probes.select(*keys).distinct().select(
        *keys, none.alias("direct"), none.alias("reversed"), F.lit(True).alias("asked")
    )
    quotes = prices.select(
        *keys, price.alias("direct"), none.alias("reversed"), F.lit(False).alias("asked")
    )
    rows = asked.unionByName(quotes)
    if with_inverse:
        rows = rows.unionByName(prices.select(
            F.col("currency").alias("commodity"), F.col("commodity").alias("currency"), "date",
            none.alias("direct"), price.alias("reversed"), F.lit(False).alias("asked"),
        ))
    days = rows.groupBy(*keys).agg(
        F.max("direct").alias("direct"), F.max("reversed").alias("reversed"), F.max("asked").alias("asked")
    )
    so_far = (
        Window.partitionBy(*PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def last_of(value: str) -> Column:
        return F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("price"), "date")), True).over(so_far)

    found = days.select(*keys, "asked", last_of("direct").alias("d"), last_of("reversed").alias("r")).filter("asked")
    return found.select(
        *keys,
        F.coalesce(F.col("d.price"), inverse(F.col("r.price"))).alias("price"),
        F.coalesce(F.col("d.date"), F.col("r.date")).alias("price_date"),
    )


def with_asof_price(
    facts: DataFrame,
    prices: DataFrame,
    commodity: str = "commodity",
    currency: str = "currency",
    date: str = "date",
    with_inverse: bool = False,
    out: str = "price",
) -> DataFrame:
    """Facts with the price as of their date (NULL when there is none)."""
    probes = facts.select(
        F.col(commodity).alias("commodity"), F.col(currency).alias("currency"), F.col(date).alias("date")
    )
    found = asof_prices(probes, prices, with_inverse).select(
        F.col("commodity").alias("_commodity"), F.col("currency").alias("_currency"),
        F.col("date").alias("_date"), F.col("price").alias(out),
    )
    match = (
        (F.col(commodity) == F.col("_commodity"))
        & (F.col(currency) == F.col("_currency"))
        & (F.col(date) == F.col("_date"))
    )
    return facts.join(found, match, "left").drop("_commodity", "_currency", "_date")


def convert_amounts(
    facts: DataFrame,
    prices: DataFrame,
    to_currency: str,
    amount: str = "amount",
    currency: str = "currency",
    date: str = "date",
    out: str = "converted",
) -> DataFrame:
    """Amount in ``to_currency`` at the rate of its date, direct or inverse.

    The same currency converts to itself; without a rate the result is NULL.
    """
    rated = with_asof_price(
        facts.withColumn("_to", F.lit(to_currency)), prices, currency, "_to", date, True, "_rate"
    )
    value = F.when(F.col(currency) == to_currency, F.col(amount).cast("decimal(38,10)")).otherwise(
        (F.col(amount) * F.col("_rate")).cast("decimal(38,10)")
    )
    return rated.withColumn(out, value).drop("_to", "_rate")
