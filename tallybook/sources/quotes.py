"""Landed quote files as prices. Fetching them is not part of this library.

Each reader returns ``(prices, errors)``: prices(commodity, currency, date,
price, source) for ``operators.prices.upsert_prices``, errors(item, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.schemas import RATE

STOCK_SCHEMA = "symbol string, regularMarketPrice double, previousClose double, lastClose double, currency string, date date"
COIN_SCHEMA = "date date, quotes map<string, map<string, double>>"
FOREX_SCHEMA = "date date, base_code string, conversion_rates map<string, double>"


def _split(rows: DataFrame, item: Column, error: Column, source: str) -> tuple[DataFrame, DataFrame]:
    good = rows.filter(F.col("price").isNotNull()).select(
        "commodity", "currency", "date", F.col("price").cast("string").cast(RATE).alias("price"), F.lit(source).alias("source")
    )
    bad = rows.filter(F.col("price").isNull()).select(item.alias("item"), error.alias("error"))
    return good, bad


def stock_prices(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First of market price, previous close (zero counts as missing) and last
    close; the currency defaults to USD."""
    zero = F.lit(0.0)
    rows = quotes.select(
        "symbol", F.upper("symbol").alias("commodity"),
        F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD"))).alias("currency"), "date",
        F.coalesce(F.nullif("regularMarketPrice", zero), F.nullif("previousClose", zero), "lastClose").alias("price"),
    )
    return _split(rows, F.col("symbol"), F.lit("no price data available"), "stock")


def coin_prices(quotes: DataFrame, wanted: DataFrame, currency: str = "USD") -> tuple[DataFrame, DataFrame]:
    """Wanted ``(coin)`` in one currency from a nested map of coin to currency to price."""
    listed = quotes.select("date", F.explode("quotes").alias("key", "by_currency"))
    asked = wanted.select("coin", F.lower("coin").alias("key")).distinct()
    rows = asked.join(listed, "key", "left").select(
        "coin", F.upper("coin").alias("commodity"), F.lit(currency.upper()).alias("currency"), "date", "by_currency",
        F.try_element_at("by_currency", F.lit(currency.lower())).alias("price"),
    )
    error = F.when(F.col("by_currency").isNull(), "not found").otherwise(f"price in {currency} not available")
    return _split(rows, F.col("coin"), error, "crypto")


def forex_rates(quotes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted ``(base, quote)`` pairs from one rate map per base currency."""
    asked = wanted.select(F.upper("base").alias("commodity"), F.upper("quote").alias("currency")).distinct()
    rates = quotes.select("date", F.upper("base_code").alias("commodity"), "conversion_rates")
    rows = asked.join(rates, "commodity", "left").withColumn("price", F.try_element_at("conversion_rates", F.col("currency")))
    return _split(rows, F.concat_ws("/", "commodity", "currency"), F.lit("rate not available"), "forex")


def manual_prices(rows: DataFrame) -> DataFrame:
    """Hand-entered prices as upsert rows."""
    return rows.select("commodity", "currency", "date", F.col("price").cast(RATE).alias("price"), F.lit("manual").alias("source"))
