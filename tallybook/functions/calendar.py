"""Month and year keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    """``yyyy-MM`` of a date."""
    return F.date_format(day, "yyyy-MM")


def month_start(month: Column) -> Column:
    """First day of a ``yyyy-MM`` key."""
    return F.to_date(F.concat(month, F.lit("-01")))


def month_bounds(month_from: str, month_to: str) -> tuple[dt.date, dt.date]:
    """[first day, first day after] of a month range, as plain dates, so that a
    filter on the date column itself reaches the scan."""
    year, month = (int(part) for part in month_to.split("-"))
    after = dt.date(year + month // 12, month % 12 + 1, 1)
    return dt.date.fromisoformat(f"{month_from}-01"), after


def trailing_months(last: Column, months: int) -> Column:
    """Array of the ``months`` month keys that end at ``last``, oldest first."""
    end = month_start(last)
    spine = F.sequence(F.add_months(end, 1 - months), end, F.expr("interval 1 month"))
    return F.transform(spine, month_key)


def month_spine(spark: SparkSession, last: str, months: int) -> DataFrame:
    """One row per trailing month."""
    return spark.range(1).select(F.explode(trailing_months(F.lit(last), months)).alias("year_month"))
