"""Balances: as of a date, per subtree, running by day and by month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.calendar import month_key
from tallybook.operators.accounts import in_subtree
from tallybook.schemas import DEFAULT_TOLERANCE

Day = dt.date | str | None


def dated_postings(postings: DataFrame, transactions: DataFrame, as_of: Day = None) -> DataFrame:
    """Postings with their transaction's date, optionally only up to ``as_of``."""
    headers = transactions.select(F.col("id").alias("transaction_id"), "date")
    if as_of is not None:
        headers = headers.filter(F.col("date") <= F.lit(as_of).cast("date"))
    return postings.join(headers, "transaction_id")


def account_balances(
    postings: DataFrame,
    transactions: DataFrame,
    accounts: DataFrame | None = None,
    account_type: str | None = None,
    as_of: Day = None,
    currency: str | None = None,
) -> DataFrame:
    """``(account_id, currency, balance)``.

    Without ``as_of`` the join to transactions adds nothing (every posting has
    one) and is left out.
    """
    if currency is not None:
        postings = postings.filter(F.col("currency") == currency)
    postings = postings.select("transaction_id", "account_id", "currency", "amount")
    if account_type is not None:
        wanted = accounts.filter(F.col("type") == account_type).select(F.col("id").alias("account_id"))
        postings = postings.join(wanted, "account_id", "left_semi")
    if as_of is not None:
        postings = dated_postings(postings, transactions, as_of)
    return postings.groupBy("account_id", "currency").agg(F.sum("amount").alias("balance"))


def subtree_balance(
    postings: DataFrame, transactions: DataFrame, accounts: DataFrame, prefix: str, as_of: Day = None
) -> DataFrame:
    """``(currency, balance)`` over one account and everything below it."""
    inside = accounts.filter(in_subtree(F.col("name"), prefix)).select(F.col("id").alias("account_id"))
    members = postings.join(inside, "account_id", "left_semi")
    if as_of is not None:
        members = dated_postings(members, transactions, as_of)
    return members.groupBy("currency").agg(F.sum("amount").alias("balance"))


def tree_balances(
    postings: DataFrame, transactions: DataFrame, accounts: DataFrame, as_of: Day = None
) -> DataFrame:
    """``(node, currency, balance)`` for every node of the account tree.

    Postings are summed per account first; only those sums are repeated for the
    account's ancestors.
    """
    leaves = account_balances(postings, transactions, as_of=as_of)
    named = leaves.join(accounts.select(F.col("id").alias("account_id"), "name"), "account_id")
    parts = F.split("name", ":")
    nodes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":")
    )
    return (
        named.select(F.explode(nodes).alias("node"), "currency", "balance")
        .groupBy("node", "currency").agg(F.sum("balance").alias("balance"))
    )


def daily_totals(postings: DataFrame, transactions: DataFrame) -> DataFrame:
    """``(account_id, currency, date, day_total, transaction_count)``.

    Spark aggregates by key and transaction first and then by key, so a hot
    account is spread over its transactions before it is counted.
    """
    return (
        dated_postings(
            postings.select("transaction_id", "account_id", "currency", "amount"), transactions
        )
        .groupBy("account_id", "currency", "date")
        .agg(
            F.sum("amount").alias("day_total"),
            F.countDistinct("transaction_id").alias("transaction_count"),
        )
    )


def running_balances(totals: DataFrame, period: str, total: str, out: str = "balance") -> DataFrame:
    """Replace ``total`` per period by the running balance ``out``.

    The input holds one row per account, currency and period, so a window's
    partition is bounded by the calendar however many postings an account has.
    """
    frame = (
        Window.partitionBy("account_id", "currency").orderBy(period)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return totals.withColumn(out, F.sum(total).over(frame)).drop(total)


def daily_balances(postings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Running balance per account and currency, on days with activity."""
    return running_balances(daily_totals(postings, transactions), "date", "day_total").select(
        "account_id", "date", "currency", "balance", "transaction_count"
    )


def monthly_totals(postings: DataFrame, transactions: DataFrame) -> DataFrame:
    """``(account_id, currency, year_month, month_total)``."""
    return (
        dated_postings(
            postings.select("transaction_id", "account_id", "currency", "amount"), transactions
        )
        .groupBy("account_id", "currency", month_key(F.col("date")).alias("year_month"))
        .agg(F.sum("amount").alias("month_total"))
    )


def monthly_balances(postings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Closing balance per account, currency and month with activity."""
    return running_balances(
        monthly_totals(postings, transactions), "year_month", "month_total", "closing_balance"
    ).select("account_id", "year_month", "currency", "closing_balance")


def latest_balances(daily: DataFrame, as_of: Day = None) -> DataFrame:
    """Last stored balance at or before ``as_of``, per account and currency.

    One row per currency, also for accounts that hold several.
    """
    if as_of is not None:
        daily = daily.filter(F.col("date") <= F.lit(as_of).cast("date"))
    return daily.groupBy("account_id", "currency").agg(F.max_by("balance", "date").alias("balance"))


def balances_report(
    daily: DataFrame,
    postings: DataFrame,
    transactions: DataFrame,
    accounts: DataFrame,
    account_type: str | None = None,
    as_of: Day = None,
) -> DataFrame:
    """``(account, currency, balance)``: stored balances, computed from postings
    for accounts the daily summary does not know at that date."""
    stored = latest_balances(daily, as_of)
    unsummarised = postings.join(stored.select("account_id").distinct(), "account_id", "left_anti")
    computed = account_balances(unsummarised, transactions, as_of=as_of)
    if account_type is not None:
        accounts = accounts.filter(F.col("type") == account_type)
    return (
        stored.unionByName(computed)
        .join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account")), "account_id")
        .select("account", "currency", "balance")
    )


def check_assertions(
    assertions: DataFrame, postings: DataFrame, transactions: DataFrame, tolerances: DataFrame
) -> DataFrame:
    """Assertions with ``actual_amount``, ``difference`` and ``matches``.

    Asserted dates are merged into the daily totals as zero rows, so one running
    sum answers all assertions; there is no posting x assertion join. The
    default tolerance is 0.01 for every currency (validation has another default
    for crypto).
    """
    keys = ["account_id", "currency", "date"]
    asked = assertions.select(*keys).distinct()
    wanted = postings.join(asked.select("account_id", "currency").distinct(), ["account_id", "currency"], "left_semi")
    days = dated_postings(
        wanted.select("transaction_id", "account_id", "currency", "amount"), transactions
    ).groupBy(*keys).agg(F.sum("amount").alias("day_total"))
    kind = days.schema["day_total"].dataType
    frame = (
        Window.partitionBy("account_id", "currency").orderBy("date")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = (
        days.withColumn("asked", F.lit(False))
        .unionByName(asked.select(*keys, F.lit(0).cast(kind).alias("day_total"), F.lit(True).alias("asked")))
        .withColumn("actual_amount", F.sum("day_total").over(frame))
        .filter("asked").select(*keys, "actual_amount")
    )
    tolerance = F.coalesce(F.col("tolerance"), F.lit(DEFAULT_TOLERANCE).cast("decimal(18,8)"))
    return (
        assertions.join(merged, keys)
        .join(tolerances.select("currency", "tolerance"), "currency", "left")
        .withColumn("difference", F.col("actual_amount") - F.col("expected_amount"))
        .withColumn("matches", F.abs("difference") <= tolerance)
        .drop("tolerance")
    )
