"""Reports over summaries. A report with several parts is several DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.amounts import percent
from tallybook.functions.calendar import month_spine, trailing_months
from tallybook.ledger import Ledger
from tallybook.schemas import TOTAL

# ---- spending ---------------------------------------------------------------


def latest_month(spending: DataFrame, currency: str) -> str | None:
    """Newest month with spending in a currency: one value."""
    return spending.filter(F.col("currency") == currency).agg(F.max("year_month")).first()[0]


def spending_rows(
    spending: DataFrame,
    accounts: DataFrame,
    year_month: str,
    months: int = 6,
    category: str | None = None,
    currency: str = "USD",
) -> DataFrame:
    """Expenses and Income rows of the trailing months: ``(account, type, year_month, total)``.

    ``category`` keeps accounts whose name contains it, ignoring case.
    """
    named = accounts.filter(F.col("type").isin("Expenses", "Income")).select(
        F.col("id").alias("account_id"), F.col("name").alias("account"), "type"
    )
    if category:
        named = named.filter(F.lower("account").contains(category.lower()))
    inside = F.array_contains(trailing_months(F.lit(year_month), months), F.col("year_month"))
    # Month keys sort as text, so the range reaches the scan; the array is exact.
    recent = spending.filter((F.col("currency") == currency) & (F.col("year_month") <= year_month) & inside)
    return recent.join(named, "account_id").select("account", "type", "year_month", F.col("total").cast(TOTAL).alias("total"))


def _of(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("total"))), F.lit(0)).cast(TOTAL)


def spending_totals(rows: DataFrame) -> DataFrame:
    """Expenses, income and ``net = income - expenses``.

    Income is negative in double entry, so ``net`` adds two outflows; what was
    actually kept is ``net_cash = -(income + expenses)``.
    """
    sums = rows.agg(_of("Expenses").alias("total_expenses"), _of("Income").alias("total_income"))
    expenses, income = F.col("total_expenses"), F.col("total_income")
    return sums.select(
        "*", (income - expenses).cast(TOTAL).alias("net"), (-(income + expenses)).cast(TOTAL).alias("net_cash")
    )


def spending_by_category(rows: DataFrame) -> DataFrame:
    """Total per account, largest first."""
    return rows.groupBy("account").agg(F.sum("total").cast(TOTAL).alias("total")).orderBy(F.col("total").desc(), "account")


def spending_trend(rows: DataFrame, year_month: str, months: int = 6) -> DataFrame:
    """Expenses and income per trailing month, 0 for months without rows, plus the
    change of expenses against the month before."""
    spine = month_spine(rows.sparkSession, year_month, months)
    found = rows.groupBy("year_month").agg(_of("Expenses").alias("expenses"), _of("Income").alias("income"))
    zero = F.lit(0).cast(TOTAL)
    trend = spine.join(found, "year_month", "left").select(
        "year_month", F.coalesce("expenses", zero).alias("expenses"), F.coalesce("income", zero).alias("income")
    )
    before = F.lag("expenses").over(Window.orderBy("year_month"))
    return trend.withColumn("expenses_change", (F.col("expenses") - before).cast(TOTAL)).orderBy("year_month")


def spending_anomalies(trend: DataFrame) -> DataFrame:
    """Months with expenses above mean + 2 sample deviations of the trend.

    Over n months no value can lie further than (n-1)/sqrt(n) deviations from
    the mean, so nothing is ever anomalous for n <= 5.
    """
    over_all = Window.partitionBy()
    value = F.col("expenses").cast("double")
    stats = trend.select(
        "year_month", F.col("expenses").alias("amount"),
        F.avg(value).over(over_all).alias("mean"), F.stddev_samp(value).over(over_all).alias("std_dev"),
    )
    return stats.filter((F.col("std_dev") > 0) & (F.col("amount") > F.col("mean") + 2 * F.col("std_dev")))


# ---- budgets ----------------------------------------------------------------


def _named(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    return rows.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account")), "account_id")


def compare_budget(
    budgets: DataFrame, spending: DataFrame, accounts: DataFrame, year_month: str, currency: str = "USD"
) -> DataFrame:
    """Budgeted accounts with actual, difference and percent used, by name."""
    month = (F.col("year_month") == year_month) & (F.col("currency") == currency)
    spent = spending.filter(month).select("account_id", F.col("total").alias("actual"))
    rows = _named(budgets.filter(month).select("account_id", F.col("amount").alias("budget")), accounts)
    actual = F.coalesce(F.col("actual"), F.lit(0)).cast(TOTAL)
    budget = F.col("budget").cast(TOTAL)
    return rows.join(spent, "account_id", "left").select(
        "account", budget.alias("budget"), actual.alias("actual"), (budget - actual).cast(TOTAL).alias("difference"),
        percent(actual, budget).alias("percent_used"),
    ).orderBy("account")


def budget_vs_actual(
    budgets: DataFrame, spending: DataFrame, accounts: DataFrame, year_month: str, currency: str = "USD"
) -> DataFrame:
    """Budgeted accounts and accounts that only have spending, missing sides 0."""
    month = (F.col("year_month") == year_month) & (F.col("currency") == currency)
    planned = budgets.filter(month).select("account_id", F.col("amount").alias("budget"))
    spent = spending.filter(month).select("account_id", F.col("total").alias("actual"))
    both = planned.join(spent, "account_id", "full_outer")
    budget = F.coalesce(F.col("budget"), F.lit(0)).cast(TOTAL)
    actual = F.coalesce(F.col("actual"), F.lit(0)).cast(TOTAL)
    return _named(both, accounts).select(
        "account", budget.alias("budget"), actual.alias("actual"), (budget - actual).cast(TOTAL).alias("difference"),
        F.lit(currency).alias("currency"),
    )


def unbudgeted_spending(
    budgets: DataFrame, spending: DataFrame, accounts: DataFrame, year_month: str, currency: str = "USD"
) -> DataFrame:
    """Accounts with spending but no budget."""
    month = (F.col("year_month") == year_month) & (F.col("currency") == currency)
    only = spending.filter(month).join(budgets.filter(month).select("account_id"), "account_id", "left_anti")
    return _named(only, accounts).select("account", F.col("total").cast(TOTAL).alias("actual"))


# ---- portfolio --------------------------------------------------------------


def holdings_list(holdings: DataFrame, accounts: DataFrame, currency: str | None = None) -> DataFrame:
    """Holdings with the account name, by name and commodity."""
    if currency is not None:
        holdings = holdings.filter(F.col("cost_currency") == currency)
    return _named(holdings, accounts).drop("account_id").orderBy("account", "commodity")


def latest_net_worth(net_worth: DataFrame, currency: str | None = None) -> DataFrame:
    """Net worth of each currency's last month."""
    if currency is not None:
        net_worth = net_worth.filter(F.col("currency") == currency)
    return net_worth.groupBy("currency").agg(
        F.max("year_month").alias("year_month"), F.max_by("net_worth", "year_month").alias("net_worth")
    )


def net_worth_trend(net_worth: DataFrame, currency: str | None = None) -> DataFrame:
    if currency is not None:
        net_worth = net_worth.filter(F.col("currency") == currency)
    return net_worth.select("year_month", "currency", "net_worth", "total_assets", "total_liabilities").orderBy(
        "year_month", "currency"
    )


def asset_allocation(holdings: DataFrame) -> DataFrame:
    """Market value per asset class and its share of the total in percent.

    The total is a window over the aggregated classes, a handful of rows.
    """
    classes = holdings.filter(F.col("market_value").isNotNull()).groupBy(
        F.coalesce(F.nullif("asset_class", F.lit("")), F.lit("Unclassified")).alias("asset_class")
    ).agg(F.sum("market_value").cast("decimal(38,8)").alias("value"))
    whole = F.sum("value").over(Window.partitionBy()).cast("decimal(38,8)")
    return classes.select(
        "asset_class", "value", percent(F.col("value"), whole).alias("percentage")
    ).orderBy(F.col("value").desc(), "asset_class")


def portfolio_report(
    holdings: DataFrame, net_worth: DataFrame, accounts: DataFrame, currency: str | None = None
) -> dict[str, DataFrame]:
    return {
        "holdings": holdings_list(holdings, accounts, currency),
        "total_net_worth": latest_net_worth(net_worth, currency),
        "historical_trend": net_worth_trend(net_worth, currency),
        "asset_allocation": asset_allocation(holdings),
    }


# ---- capital gains ----------------------------------------------------------


def capital_gains_detail(ledger: Ledger, year: int | None = None, currency: str | None = None) -> DataFrame:
    """Dispositions with their lot, sale and account, by sale date and id."""
    sold = ledger.lot_dispositions
    if currency is not None:
        sold = sold.filter(F.col("proceeds_currency") == currency)
    sales = ledger.transactions
    if year is not None:
        sales = sales.filter(F.col("date").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))))
    sales = sales.select(F.col("id").alias("sell_transaction_id"), F.col("date").alias("sell_date"))
    bought = ledger.lots.select(
        F.col("id").alias("lot_id"), "account_id", "commodity", "cost_price", "cost_currency", "acquired_date"
    )
    owners = ledger.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account"), "jurisdiction")
    return (
        sold.withColumnRenamed("id", "disposition_id").join(sales, "sell_transaction_id").join(bought, "lot_id")
        .join(owners, "account_id")
        .select(
            "disposition_id", "lot_id", "account", "commodity", "quantity", "cost_price", "cost_currency",
            "acquired_date", "sell_date", "proceeds_per_unit", "proceeds_currency", "gain_loss",
            "gain_loss_currency", "term", "jurisdiction", "wash_sale", "wash_sale_adjustment",
        )
        .orderBy("sell_date", "disposition_id")
    )


def capital_gains_report(
    ledger: Ledger, yearly: DataFrame, year: int | None = None, currency: str | None = None
) -> dict[str, DataFrame]:
    """Summary by the gain's currency, detail by the proceeds' currency, and the
    wash sales among the detail."""
    summary = yearly
    if year is not None:
        summary = summary.filter(F.col("year") == year)
    if currency is not None:
        summary = summary.filter(F.col("currency") == currency)
    detail = capital_gains_detail(ledger, year, currency)
    return {
        "summary": summary.orderBy("year", "term", "currency"),
        "detail": detail,
        "wash_sales": detail.filter("wash_sale"),
    }


def gains_by_jurisdiction(detail: DataFrame) -> DataFrame:
    """Subtotals of the detail by jurisdiction, term and currency."""
    return detail.groupBy("jurisdiction", "term", F.col("gain_loss_currency").alias("currency")).agg(
        F.sum("gain_loss").cast("decimal(38,8)").alias("total_gain_loss"), F.count(F.lit(1)).alias("disposition_count")
    )
