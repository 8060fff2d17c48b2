"""Prices, exchange rates, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.catalog.binding import Binding
from tallybook.catalog.registry import query
from tallybook.operators import prices as px
from tallybook.plans import reports, summaries
from tallybook.session import stored

# ---- prices ----

_TRADE_DATES = "SELECT id, commodity, 'USD' AS currency, date - 1 AS date FROM trades"


def _probes(b: Binding) -> DataFrame:
    """Every trade, asking for the price of the day before."""
    return b.trades.select("id", "commodity", F.lit("USD").alias("currency"), F.date_sub("date", 1).alias("date"))


@query("J5", f"""
    SELECT q.id, q.commodity, q.date, p.price::DECIMAL(18,8) AS price
    FROM ({_TRADE_DATES}) q ASOF LEFT JOIN prices p
      ON p.commodity = q.commodity AND p.currency = q.currency AND q.date >= p.date""")
def asof_prices(b: Binding) -> DataFrame:
    return px.with_asof_price(_probes(b), b.prices).select("id", "commodity", "date", "price")


_RATES = """
    asked AS (SELECT DISTINCT currency, date FROM dated),
    direct AS (SELECT q.*, p.price FROM asked q ASOF LEFT JOIN
               (SELECT * FROM fx WHERE currency = 'USD') p ON p.commodity = q.currency AND q.date >= p.date),
    days AS (SELECT q.currency, q.date, q.price AS direct, p.price AS reversed FROM direct q ASOF LEFT JOIN
               (SELECT * FROM fx WHERE commodity = 'USD') p ON p.currency = q.currency AND q.date >= p.date),
    rates AS (SELECT id, amount, d.currency, d.date, direct, reversed FROM dated d JOIN days USING (currency, date))"""
_RATE = "coalesce(direct, round(1::DOUBLE / reversed::DOUBLE, 8)::DECIMAL(18,8))"


@query("J6", f"WITH {_RATES} SELECT id, currency, date, {_RATE}::DECIMAL(18,8) AS rate FROM rates")
def asof_rates(b: Binding) -> DataFrame:
    """Rates to USD for every posting: direct (EUR, GBP) or inverse (INR)."""
    asked = b.postings.select("id", "transaction_id", "currency").join(
        b.transactions.select(F.col("id").alias("transaction_id"), "date"), "transaction_id"
    ).withColumn("base", F.lit("USD"))
    return px.with_asof_price(asked, b.fx, "currency", "base", "date", True, "rate").select("id", "currency", "date", "rate")


@query("X10", f"""
    WITH {_RATES}
    SELECT id, amount, currency,
           CASE WHEN currency = 'USD' THEN amount::DECIMAL(38,10) ELSE (amount::DECIMAL(20,2) * {_RATE})::DECIMAL(38,10) END AS converted
    FROM rates""")
def converted_amounts(b: Binding) -> DataFrame:
    dated = b.postings.select("id", "transaction_id", "amount", "currency").join(
        b.transactions.select(F.col("id").alias("transaction_id"), "date"), "transaction_id"
    )
    return px.convert_amounts(dated, b.fx, "USD").select("id", "amount", "currency", "converted")


@query("J7 J10", """
    SELECT commodity, currency, arg_max(price, date)::DECIMAL(18,8) AS price, max(date) AS date FROM prices GROUP BY 1, 2""")
def latest_prices(b: Binding) -> DataFrame:
    return px.latest_prices(b.prices)


@query("F9", """
    SELECT date, price FROM prices WHERE commodity = 'Brand#7' AND currency = 'USD'
      AND date BETWEEN DATE '1996-03-01' AND DATE '1999-09-30'""")
def price_history(b: Binding) -> DataFrame:
    return px.price_history(b.prices, "Brand#7", "USD", "1996-03-01", "1999-09-30").select("date", "price")


@query("M2", """
    SELECT coalesce(n.commodity, p.commodity) AS commodity, coalesce(n.date, p.date) AS date,
           coalesce(n.price, p.price)::DECIMAL(18,8) AS price, CASE WHEN n.price IS NULL THEN 'market' ELSE 'trade' END AS source
    FROM commodity_prices p FULL JOIN
         (SELECT commodity, date, arg_max(price, id)::DECIMAL(18,8) AS price FROM trades WHERE sale GROUP BY 1, 2) n
      ON n.commodity = p.commodity AND n.date = p.date""")
def upserted_prices(b: Binding) -> DataFrame:
    """Prices of all sales written over the market prices, the last sale of a day winning."""
    arriving = b.trades.filter("sale").select(
        "commodity", F.lit("USD").alias("currency"), "date", "price", F.lit("trade").alias("source"), F.col("id").alias("seq")
    )
    return px.upsert_prices(b.commodity_prices, arriving).drop("currency")


@query("M3", """
    SELECT commodity, 'USD' AS currency, date, arg_max(price, id)::DECIMAL(18,8) AS price, 'transaction' AS source
    FROM trades GROUP BY commodity, date""")
def implied_prices(b: Binding) -> DataFrame:
    return px.prices_from_postings(b.trade_postings, b.trade_transactions)


# ---- net worth ----

_MEASURES = ["total_assets", "total_liabilities", "net_worth", "assets_cash", "assets_equity", "assets_debt", "assets_crypto", "assets_other"]
_WIDE = dict.fromkeys(_MEASURES, "decimal(38,6)")


@query("A10", f"SELECT year_month, currency, {', '.join(_MEASURES)} FROM net_worth", **dict.fromkeys(_MEASURES, "decimal(28,2)"))
def net_worth_by_currency(b: Binding) -> DataFrame:
    monthly = summaries.monthly_balances(b.ledger)
    return summaries.net_worth_by_currency(monthly, b.accounts)


@query("A10 A11 J6 U1 U2", f"""
    WITH ends AS (SELECT *, last_day((year_month || '-01')::DATE) AS month_end FROM net_worth),
    direct AS (SELECT q.*, p.price AS direct FROM ends q ASOF LEFT JOIN
               (SELECT * FROM fx WHERE currency = 'USD') p ON p.commodity = q.currency AND q.month_end >= p.date),
    both_ways AS (SELECT q.*, p.price AS reversed FROM direct q ASOF LEFT JOIN
               (SELECT * FROM fx WHERE commodity = 'USD') p ON p.currency = q.currency AND q.month_end >= p.date),
    rated AS (SELECT *, {_RATE} AS found, CASE WHEN currency = 'USD' THEN 1::DECIMAL(18,8) ELSE coalesce({_RATE}, 1)::DECIMAL(18,8) END AS fx_rate
              FROM both_ways)
    SELECT year_month, currency, {', '.join(f'{m}::DECIMAL(38,6) AS {m}' for m in _MEASURES)}, FALSE AS rate_missing FROM net_worth
    UNION ALL
    SELECT year_month, 'CONSOLIDATED', {', '.join(f'sum(({m}::DECIMAL(20,2) * fx_rate)::DECIMAL(38,10))::DECIMAL(38,6) AS {m}' for m in _MEASURES)},
           bool_or(found IS NULL AND currency <> 'USD') FROM rated GROUP BY 1""", **_WIDE)
def net_worth(b: Binding) -> DataFrame:
    """Per currency and consolidated in USD; BTC has no rate and counts at 1."""
    return summaries.net_worth(b.ledger)


@query("A10", """
    WITH months AS (SELECT DISTINCT unnest(generate_series((SELECT min(year_month) || '-01' FROM monthly)::DATE,
                    (SELECT max(year_month) || '-01' FROM monthly)::DATE, INTERVAL 1 MONTH))::DATE AS first_day),
    held AS (SELECT m.first_day, a.id, a.type, b.currency, arg_max(b.closing_balance, b.year_month) AS balance
             FROM months m JOIN monthly b ON (b.year_month || '-01')::DATE <= m.first_day JOIN accounts a ON a.id = b.account_id
             WHERE a.type IN ('Assets', 'Liabilities') GROUP BY 1, 2, 3, 4)
    SELECT strftime(first_day, '%Y-%m') AS year_month, currency,
           sum(CASE WHEN type = 'Assets' THEN balance ELSE 0 END)::DECIMAL(28,2) AS total_assets,
           sum(CASE WHEN type <> 'Assets' THEN balance ELSE 0 END)::DECIMAL(28,2) AS total_liabilities,
           sum(balance)::DECIMAL(28,2) AS net_worth
    FROM held GROUP BY 1, 2""")
def net_worth_carried_forward(b: Binding) -> DataFrame:
    """Idle accounts keep their last balance."""
    monthly = summaries.monthly_balances(b.ledger)
    return summaries.net_worth_by_currency(monthly, b.accounts, carry_forward=True).select(
        "year_month", "currency", "total_assets", "total_liabilities", "net_worth"
    )


@query("A15 W6 O3", "SELECT currency, max(year_month) AS year_month, arg_max(net_worth, year_month)::DECIMAL(28,2) AS net_worth FROM net_worth GROUP BY 1", net_worth="decimal(28,2)")
def latest_net_worth(b: Binding) -> DataFrame:
    return reports.latest_net_worth(summaries.net_worth(b.ledger).filter(F.col("currency") != summaries.CONSOLIDATED))


@query("A15", "SELECT year_month, currency, net_worth, total_assets, total_liabilities FROM net_worth WHERE currency = 'EUR'",
       net_worth="decimal(28,2)", total_assets="decimal(28,2)", total_liabilities="decimal(28,2)")
def net_worth_trend(b: Binding) -> DataFrame:
    return reports.net_worth_trend(summaries.net_worth(b.ledger), "EUR")


# ---- spending ----

_SPENT = """
    rows AS (SELECT a.name AS account, a.type, s.year_month, s.total FROM spending s JOIN accounts a ON a.id = s.account_id
             WHERE s.currency = 'USD' AND (s.year_month || '-01')::DATE BETWEEN
                   (SELECT (max(year_month) || '-01')::DATE - INTERVAL 5 MONTH FROM spending WHERE currency = 'USD')
                   AND (SELECT (max(year_month) || '-01')::DATE FROM spending WHERE currency = 'USD'))"""


def _spent(b: Binding) -> tuple[DataFrame, str]:
    """The spending summary, stored as reports read it, and its newest USD month."""
    spending = stored(summaries.monthly_spending(b.ledger), "spending")
    month = reports.latest_month(spending, "USD")
    return reports.spending_rows(spending, b.accounts, month), month


@query("A16 A24", f"""
    WITH {_SPENT}
    SELECT coalesce(sum(total) FILTER (type = 'Expenses'), 0)::DECIMAL(28,2) AS total_expenses,
           coalesce(sum(total) FILTER (type = 'Income'), 0)::DECIMAL(28,2) AS total_income,
           (coalesce(sum(total) FILTER (type = 'Income'), 0) - coalesce(sum(total) FILTER (type = 'Expenses'), 0))::DECIMAL(28,2) AS net,
           (-coalesce(sum(total), 0))::DECIMAL(28,2) AS net_cash FROM rows""")
def spending_totals(b: Binding) -> DataFrame:
    return reports.spending_totals(_spent(b)[0])


@query("A17", f"WITH {_SPENT} SELECT account, sum(total)::DECIMAL(28,2) AS total FROM rows GROUP BY 1")
def spending_by_category(b: Binding) -> DataFrame:
    return reports.spending_by_category(_spent(b)[0])


_TREND = """
    spine AS (SELECT strftime(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH)), '%Y-%m') AS year_month),
    trend AS (SELECT year_month, coalesce(sum(total) FILTER (a.type = 'Expenses'), 0)::DECIMAL(28,2) AS expenses,
                     coalesce(sum(total) FILTER (a.type = 'Income'), 0)::DECIMAL(28,2) AS income
              FROM spine LEFT JOIN (SELECT * FROM spending WHERE currency = 'USD') s USING (year_month)
              LEFT JOIN accounts a ON a.id = s.account_id GROUP BY 1)"""


def _trend(b: Binding, last: str, months: int) -> DataFrame:
    spending = summaries.monthly_spending(b.ledger)
    return reports.spending_trend(reports.spending_rows(spending, b.accounts, last, months), last, months)


@query("A18 X6", f"""
    WITH {_TREND.format(first='2000-11-01', last='2001-10-01')}
    SELECT *, (expenses - lag(expenses) OVER (ORDER BY year_month))::DECIMAL(28,2) AS expenses_change FROM trend""")
def spending_trend(b: Binding) -> DataFrame:
    """Twelve months that reach past the data: the last ones are zero."""
    return _trend(b, "2001-10", 12)


@query("A19", f"""
    WITH {_TREND.format(first='1994-03-01', last='1995-01-01')},
    stats AS (SELECT avg(expenses::DOUBLE) AS mean, stddev_samp(expenses::DOUBLE) AS std_dev FROM trend)
    SELECT year_month, expenses AS amount, round(mean, 4) AS mean, round(std_dev, 4) AS std_dev FROM trend, stats
    WHERE std_dev > 0 AND expenses > mean + 2 * std_dev""")
def spending_anomalies(b: Binding) -> DataFrame:
    """The first month of business after ten empty ones."""
    found = reports.spending_anomalies(_trend(b, "1995-01", 11))
    return found.withColumns({"mean": F.round("mean", 4), "std_dev": F.round("std_dev", 4)})


@query("A20 J3", """
    SELECT a.name AS account, b.amount::DECIMAL(28,2) AS budget, coalesce(s.total, 0)::DECIMAL(28,2) AS actual,
           (b.amount - coalesce(s.total, 0))::DECIMAL(28,2) AS difference,
           CASE WHEN b.amount = 0 THEN 0 ELSE round_even(coalesce(s.total, 0)::DOUBLE / b.amount::DOUBLE * 100, 2) END::DECIMAL(18,2) AS percent_used
    FROM budgets b JOIN accounts a ON a.id = b.account_id
    LEFT JOIN spending s ON s.account_id = b.account_id AND s.year_month = b.year_month AND s.currency = b.currency
    WHERE b.year_month = '1999-05' AND b.currency = 'USD'""")
def budget_comparison(b: Binding) -> DataFrame:
    return reports.compare_budget(b.budgets, summaries.monthly_spending(b.ledger), b.accounts, "1999-05")


@query("J4 U2", """
    SELECT a.name AS account, coalesce(b.amount, 0)::DECIMAL(28,2) AS budget, coalesce(s.total, 0)::DECIMAL(28,2) AS actual,
           (coalesce(b.amount, 0) - coalesce(s.total, 0))::DECIMAL(28,2) AS difference, 'USD' AS currency
    FROM (SELECT * FROM budgets WHERE year_month = '1999-05' AND currency = 'USD') b
    FULL JOIN (SELECT * FROM spending WHERE year_month = '1999-05' AND currency = 'USD') s ON s.account_id = b.account_id
    JOIN accounts a ON a.id = coalesce(b.account_id, s.account_id)""")
def budget_and_actual(b: Binding) -> DataFrame:
    return reports.budget_vs_actual(b.budgets, summaries.monthly_spending(b.ledger), b.accounts, "1999-05")


@query("J17 U3", """
    SELECT a.name AS account, s.total::DECIMAL(28,2) AS actual FROM spending s JOIN accounts a ON a.id = s.account_id
    WHERE s.year_month = '1999-05' AND s.currency = 'USD' AND s.account_id NOT IN
          (SELECT account_id FROM budgets WHERE year_month = '1999-05' AND currency = 'USD')""")
def unbudgeted_spending(b: Binding) -> DataFrame:
    return reports.unbudgeted_spending(b.budgets, summaries.monthly_spending(b.ledger), b.accounts, "1999-05")


# ---- refresh equals rebuild ----


def _changed(b: Binding):
    """The ledger before and after the orders of 1999 (a back-dated batch), and
    what they affect."""
    late = b.transactions.filter(F.year("date") == 1999)
    ids = late.select(F.col("id").alias("transaction_id"))
    before = b.ledger.with_tables(
        transactions=b.transactions.filter(F.year("date") != 1999),
        postings=b.postings.join(ids, "transaction_id", "left_anti"),
    )
    return before, b.ledger, summaries.affected_by(late, b.postings.join(ids, "transaction_id", "left_semi"))


@query("T1 W3", "SELECT account_id, date, currency, balance::DECIMAL(28,2) AS balance, transaction_count::BIGINT AS transaction_count FROM daily", balance="decimal(28,2)")
def refreshed_daily_balances(b: Binding) -> DataFrame:
    before, after, affected = _changed(b)
    return summaries.refresh_daily_balances(summaries.daily_balances(before), after, affected)


@query("T1 W3", "SELECT account_id, year_month, currency, closing_balance FROM monthly", closing_balance="decimal(28,2)")
def refreshed_monthly_balances(b: Binding) -> DataFrame:
    before, after, affected = _changed(b)
    return summaries.refresh_monthly_balances(summaries.monthly_balances(before), after, affected)


@query("T1", "SELECT account_id, year_month, currency, total, transaction_count::BIGINT AS transaction_count FROM spending", total="decimal(28,2)")
def refreshed_monthly_spending(b: Binding) -> DataFrame:
    before, after, affected = _changed(b)
    return summaries.refresh_monthly_spending(summaries.monthly_spending(before), after, affected)


@query("T1", f"SELECT year_month, currency, {', '.join(_MEASURES)} FROM net_worth", **dict.fromkeys(_MEASURES, "decimal(28,2)"))
def refreshed_net_worth(b: Binding) -> DataFrame:
    before, after, affected = _changed(b)
    fresh = summaries.refresh_net_worth(summaries.net_worth(before), after, affected)
    return fresh.filter(F.col("currency") != summaries.CONSOLIDATED).drop("rate_missing")
