"""Summary tables: full rebuild, and refresh of the affected slice.

A refresh reads stored rows and the changed core tables and returns the whole
new summary: rows outside the slice as stored, rows inside recomputed. It equals
a rebuild, also for back-dated changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.calendar import month_bounds, month_key, month_start
from tallybook.ledger import Ledger
from tallybook.operators import balances, lots, prices
from tallybook.schemas import NET_WORTH_BUCKETS, RATE, TOTAL

BASE_CURRENCY = "USD"
CONSOLIDATED = "CONSOLIDATED"


@dataclass(frozen=True)
class Affected:
    """What a change touched. ``accounts(account_id)``, ``commodities(commodity)``;
    ``date_from`` is None when no transaction changed."""

    accounts: DataFrame
    commodities: DataFrame
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    prices_updated: bool = False


def affected_by(transactions: DataFrame, postings: DataFrame) -> Affected:
    """The affected set of changed rows (old and new versions together).

    The date range is one row, read to the driver so that it reaches the scans
    as a literal.
    """
    span = transactions.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return Affected(
        postings.select("account_id").distinct(),
        postings.select(F.col("currency").alias("commodity")).distinct(),
        span["lo"],
        span["hi"],
    )


def _from_day(ledger: Ledger, first: dt.date, last: dt.date | None = None) -> DataFrame:
    days = ledger.transactions.filter(F.col("date") >= F.lit(first))
    return days if last is None else days.filter(F.col("date") < F.lit(last))


def _outside(stored: DataFrame, keys: DataFrame, key: str, inside: Column) -> DataFrame:
    """Stored rows except those of ``keys`` for which ``inside`` holds."""
    marked = stored.join(keys.withColumn("_hit", F.lit(True)), key, "left")
    return marked.filter(F.col("_hit").isNull() | ~inside).drop("_hit").select(*stored.columns)


# ---- daily and monthly balances ---------------------------------------------


def daily_balances(ledger: Ledger) -> DataFrame:
    return balances.daily_balances(ledger.postings, ledger.transactions)


def resume_running(
    stored: DataFrame, totals: DataFrame, accounts: DataFrame, period: str, first: Column, total: str, balance: str
) -> DataFrame:
    """Running balances from ``first`` on, carried on from the last stored balance
    before it."""
    opening = (
        stored.join(accounts, "account_id", "left_semi").filter(F.col(period) < first)
        .groupBy("account_id", "currency").agg(F.max_by(balance, period).alias("opening"))
    )
    running = balances.running_balances(totals, period, total, balance)
    return (
        running.join(opening, ["account_id", "currency"], "left")
        .withColumn(balance, F.col(balance) + F.coalesce("opening", F.lit(0).cast(stored.schema[balance].dataType)))
        .drop("opening")
    )


def refresh_daily_balances(stored: DataFrame, ledger: Ledger, affected: Affected) -> DataFrame:
    if affected.date_from is None:
        return stored
    first = F.lit(affected.date_from)
    totals = balances.daily_totals(
        ledger.postings.join(affected.accounts, "account_id", "left_semi"), _from_day(ledger, affected.date_from)
    )
    resumed = resume_running(stored, totals, affected.accounts, "date", first, "day_total", "balance")
    return _like(stored, _outside(stored, affected.accounts, "account_id", F.col("date") >= first), resumed)


def monthly_balances(ledger: Ledger) -> DataFrame:
    return balances.monthly_balances(ledger.postings, ledger.transactions)


def refresh_monthly_balances(stored: DataFrame, ledger: Ledger, affected: Affected) -> DataFrame:
    if affected.date_from is None:
        return stored
    month = affected.date_from.strftime("%Y-%m")
    totals = balances.monthly_totals(
        ledger.postings.join(affected.accounts, "account_id", "left_semi"),
        _from_day(ledger, affected.date_from.replace(day=1)),
    )
    resumed = resume_running(
        stored, totals, affected.accounts, "year_month", F.lit(month), "month_total", "closing_balance"
    )
    kept = _outside(stored, affected.accounts, "account_id", F.col("year_month") >= month)
    return _like(stored, kept, resumed)


def _like(stored: DataFrame, kept: DataFrame, new: DataFrame) -> DataFrame:
    typed = new.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema])
    return kept.unionByName(typed)


# ---- monthly spending -------------------------------------------------------


def monthly_spending(ledger: Ledger, transactions: DataFrame | None = None) -> DataFrame:
    """Totals and transaction counts per Expenses or Income account and month."""
    spending = ledger.accounts.filter(F.col("type").isin("Expenses", "Income")).select(F.col("id").alias("account_id"))
    rows = ledger.postings.select("transaction_id", "account_id", "currency", "amount").join(
        spending, "account_id", "left_semi"
    )
    dated = balances.dated_postings(rows, ledger.transactions if transactions is None else transactions)
    return dated.groupBy("account_id", month_key(F.col("date")).alias("year_month"), "currency").agg(
        F.sum("amount").alias("total"), F.countDistinct("transaction_id").alias("transaction_count")
    )


def refresh_monthly_spending(stored: DataFrame, ledger: Ledger, affected: Affected) -> DataFrame:
    if affected.date_from is None:
        return stored
    first, last = affected.date_from.strftime("%Y-%m"), affected.date_to.strftime("%Y-%m")
    slice_ = _from_day(ledger, *month_bounds(first, last))
    kept = stored.filter(~F.col("year_month").between(first, last))
    return _like(stored, kept, monthly_spending(ledger, slice_))


# ---- holdings ---------------------------------------------------------------


def portfolio_holdings(ledger: Ledger, lot_rows: DataFrame | None = None) -> DataFrame:
    """Open quantity, cost and newest value per account, commodity and cost currency.

    The cost currency is part of the key, so a commodity bought in two
    currencies keeps two rows.
    """
    held = lots.open_lots(ledger.lots if lot_rows is None else lot_rows).groupBy(
        "account_id", "commodity", "cost_currency"
    ).agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum(F.col("quantity") * F.col("cost_price")).alias("total_cost_basis"),
    )
    newest = prices.latest_prices(ledger.prices).select(
        "commodity", F.col("currency").alias("cost_currency"),
        F.col("price").alias("latest_price"), F.col("date").alias("latest_price_date"),
    )
    classes = ledger.accounts.select(F.col("id").alias("account_id"), "asset_class")
    value = (F.col("total_quantity").cast("decimal(18,8)") * F.col("latest_price")).cast("decimal(37,8)")
    cost = F.col("total_cost_basis").cast("decimal(37,8)")
    return (
        held.join(newest, ["commodity", "cost_currency"], "left").join(classes, "account_id")
        .select(
            "account_id", "commodity", "cost_currency",
            F.col("total_quantity").cast("decimal(28,8)").alias("total_quantity"),
            cost.alias("total_cost_basis"), "latest_price", "latest_price_date",
            value.alias("market_value"), (value - cost).cast("decimal(37,8)").alias("unrealized_gain"), "asset_class",
        )
    )


def refresh_portfolio_holdings(stored: DataFrame, ledger: Ledger, affected: Affected) -> DataFrame:
    touched = F.col("_account").isNotNull() | F.col("_commodity").isNotNull()
    hit_accounts = affected.accounts.select("account_id", F.lit(1).alias("_account"))
    hit_commodities = affected.commodities.select("commodity", F.lit(1).alias("_commodity"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(hit_accounts, "account_id", "left").join(hit_commodities, "commodity", "left")

    kept = marked(stored).filter(~touched).select(*stored.columns)
    again = marked(ledger.lots).filter(touched).select(*ledger.lots.columns)
    return _like(stored, kept, portfolio_holdings(ledger, again))


# ---- net worth --------------------------------------------------------------


def _bucket(asset_class: Column) -> Column:
    known = [b for b in NET_WORTH_BUCKETS if b != "other"]
    return F.when(asset_class.isNull(), "cash").when(asset_class.isin(known), asset_class).otherwise("other")


def net_worth_by_currency(monthly: DataFrame, accounts: DataFrame, carry_forward: bool = False) -> DataFrame:
    """Assets, liabilities (negative), their sum and asset classes per month and currency.

    By default a month counts only accounts active in it. With
    ``carry_forward`` an idle account keeps its last closing balance: each
    balance is turned into its change, changes are summed per month, and those
    sums run over the months.
    """
    kinds = accounts.filter(F.col("type").isin("Assets", "Liabilities")).select(
        F.col("id").alias("account_id"), "type", _bucket(F.col("asset_class")).alias("bucket")
    )
    value = "closing_balance"
    rows = monthly
    if carry_forward:
        own = Window.partitionBy("account_id", "currency").orderBy("year_month")
        before = F.coalesce(F.lag(value).over(own), F.lit(0))
        rows = monthly.withColumn(value, (F.col(value) - before).cast(TOTAL))
    asset, amount = F.col("type") == "Assets", F.col(value)
    sums = {
        "total_assets": F.sum(F.when(asset, amount).otherwise(0)),
        "total_liabilities": F.sum(F.when(~asset, amount).otherwise(0)),
        **{
            f"assets_{b}": F.sum(F.when(asset & (F.col("bucket") == b), amount).otherwise(0))
            for b in NET_WORTH_BUCKETS
        },
    }
    months = rows.join(kinds, "account_id").groupBy("year_month", "currency").agg(
        *[total.cast(TOTAL).alias(name) for name, total in sums.items()]
    )
    if carry_forward:
        run = Window.partitionBy("currency").orderBy("year_month").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        # A currency enters every month from its first on, also those without a change.
        last = months.agg(month_start(F.max("year_month"))).scalar()
        spans = months.groupBy("currency").agg(month_start(F.min("year_month")).alias("_first"))
        steps = F.sequence(F.col("_first"), last, F.expr("interval 1 month"))
        grid = spans.select("currency", F.explode(steps).alias("_day")).select(
            "currency", month_key(F.col("_day")).alias("year_month")
        )
        months = grid.join(months, ["year_month", "currency"], "left").na.fill(0).select(
            "year_month", "currency", *[F.sum(c).over(run).cast(TOTAL).alias(c) for c in sums]
        )
    return months.withColumn("net_worth", (F.col("total_assets") + F.col("total_liabilities")).cast(TOTAL))


_MEASURES = [
    "total_assets", "total_liabilities", "net_worth", *[f"assets_{b}" for b in NET_WORTH_BUCKETS]
]


def consolidated_net_worth(by_currency: DataFrame, price_table: DataFrame, base: str = BASE_CURRENCY) -> DataFrame:
    """One row per month in the base currency at the month-end rate, direct or inverse.

    A currency without a rate counts at 1; ``rate_missing`` marks such months.
    """
    ends = by_currency.withColumn("_end", F.last_day(month_start(F.col("year_month")))).withColumn("_base", F.lit(base))
    rated = prices.with_asof_price(ends, price_table, "currency", "_base", "_end", True, "_rate")
    own = F.col("currency") == base
    rate = F.when(own, F.lit(1).cast(RATE)).otherwise(F.coalesce("_rate", F.lit(1).cast(RATE)))
    return rated.withColumn("_fx", rate).groupBy("year_month").agg(
        *[
            F.sum((F.col(m).cast("decimal(20,2)") * F.col("_fx")).cast("decimal(28,10)")).cast("decimal(38,10)").alias(m)
            for m in _MEASURES
        ],
        F.max(F.col("_rate").isNull() & ~own).alias("rate_missing"),
    ).withColumn("currency", F.lit(CONSOLIDATED))


def net_worth(ledger: Ledger, monthly: DataFrame | None = None) -> DataFrame:
    """Per currency and consolidated rows. ``monthly`` is the stored monthly
    balance summary, recomputed when not given."""
    by_currency = net_worth_by_currency(monthly_balances(ledger) if monthly is None else monthly, ledger.accounts)
    wide = by_currency.select(
        "year_month", "currency", *[F.col(m).cast("decimal(38,10)").alias(m) for m in _MEASURES],
        F.lit(False).alias("rate_missing"),
    )
    return wide.unionByName(consolidated_net_worth(by_currency, ledger.prices))


def refresh_net_worth(
    stored: DataFrame, ledger: Ledger, affected: Affected, monthly: DataFrame | None = None
) -> DataFrame:
    """From the first affected month on. A price update alone recomputes every
    month, since any month-end rate may have changed."""
    if affected.date_from is None and not affected.prices_updated:
        return stored
    source = monthly_balances(ledger) if monthly is None else monthly
    if affected.prices_updated:
        return _like(stored, stored.limit(0), net_worth(ledger, source))
    month = affected.date_from.strftime("%Y-%m")
    again = net_worth(ledger, source.filter(F.col("year_month") >= month))
    return _like(stored, stored.filter(F.col("year_month") < month), again)


# ---- capital gains ----------------------------------------------------------


def yearly_capital_gains(
    ledger: Ledger, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Proceeds, cost, gain and count per year, term and currency."""
    sales = ledger.transactions
    if first_year is not None:
        sales = _from_day(ledger, dt.date(first_year, 1, 1), dt.date(last_year + 1, 1, 1))
    sales = sales.select(F.col("id").alias("sell_transaction_id"), F.year("date").alias("year"))
    cost = ledger.lots.select(F.col("id").alias("lot_id"), "cost_price")
    wide = "decimal(38,8)"
    return (
        ledger.lot_dispositions.join(sales, "sell_transaction_id").join(cost, "lot_id")
        .groupBy("year", "term", F.col("gain_loss_currency").alias("currency"))
        .agg(
            F.sum(F.col("proceeds_per_unit") * F.col("quantity")).cast(wide).alias("total_proceeds"),
            F.sum(F.col("cost_price") * F.col("quantity")).cast(wide).alias("total_cost_basis"),
            F.sum("gain_loss").cast(wide).alias("total_gain_loss"),
            F.count(F.lit(1)).alias("disposition_count"),
        )
    )


def refresh_yearly_capital_gains(stored: DataFrame, ledger: Ledger, affected: Affected) -> DataFrame:
    if affected.date_from is None:
        return stored
    first, last = affected.date_from.year, affected.date_to.year
    again = yearly_capital_gains(ledger, first, last)
    return _like(stored, stored.filter(~F.col("year").between(first, last)), again)


# ---- registry ---------------------------------------------------------------


@dataclass(frozen=True)
class Summary:
    """How a summary is built and refreshed. ``reads`` names core tables, ``inputs`` the
    summaries it is derived from, by the name of the argument that ``refresh`` takes them as."""

    rebuild: Callable[..., DataFrame]
    refresh: Callable[..., DataFrame]
    partition_by: str | None = None
    reads: frozenset[str] = frozenset()
    inputs: Mapping[str, str] = field(default_factory=dict)


class Registry:
    """Named summaries and what they are derived from."""

    def __init__(self) -> None:
        self._summaries: dict[str, Summary] = {}

    def register(self, name: str, summary: Summary) -> None:
        self._summaries[name] = summary

    def names(self) -> list[str]:
        return list(self._summaries)

    def __getitem__(self, name: str) -> Summary:
        if name not in self._summaries:
            raise KeyError(f"no summary named {name!r}")
        return self._summaries[name]

    def ordered(self, names: Iterable[str] | None = None) -> list[str]:
        """The summaries, or some of them, as registered, but each behind those it is derived from."""
        inputs = {n: list(s.inputs.values()) for n, s in self._summaries.items()}
        try:
            TopologicalSorter(inputs).prepare()
        except CycleError as error:
            raise ValueError(f"summaries derived from each other: {', '.join(error.args[1])}") from error
        every: list[str] = []

        def add(name: str) -> None:
            if name not in every:
                self[name]
                for of in inputs[name]:
                    add(of)
                every.append(name)

        for name in inputs:
            add(name)
        wanted = set(every if names is None else names)
        return [n for n in every if n in wanted]

    def due(self, changed: Iterable[str]) -> list[str]:
        """The summaries that a change of some core tables or summaries reaches, in order."""
        reached = set(changed)
        found = []
        for name in self.ordered():
            summary = self[name]
            if summary.reads & reached or reached & set(summary.inputs.values()):
                reached.add(name)
                found.append(name)
        return found

    def rebuild_one(self, name: str, ledger: Ledger) -> DataFrame:
        return self[name].rebuild(ledger)

    def rebuild_all(self, ledger: Ledger, actions: DataFrame | None = None) -> dict[str, DataFrame]:
        """All summaries. Lot state is replayed from dispositions first, so
        holdings reflect past sales."""
        lot_rows = lots.replay_lots(ledger.lots, ledger.lot_dispositions, ledger.transactions, actions)
        ledger = ledger.with_tables(lots=lot_rows)
        return {name: self.rebuild_one(name, ledger) for name in self.ordered()}

    def refresh_all(
        self, stored: Mapping[str, DataFrame], ledger: Ledger, affected: Affected, changed: Iterable[str] | None = None
    ) -> dict[str, DataFrame]:
        """Each ``stored`` summary after the change; with ``changed`` core tables, those
        that the change does not reach as they were. A summary derived from another
        reads its refreshed rows; where those aren't stored, it derives them itself."""
        due = set(self._summaries if changed is None else self.due(changed))
        fresh: dict[str, DataFrame] = {}
        for name in self.ordered(stored):
            summary = self[name]
            given = {arg: fresh[of] for arg, of in summary.inputs.items() if of in fresh}
            fresh[name] = summary.refresh(stored[name], ledger, affected, **given) if name in due else stored[name]
        return fresh


def _reading(*tables: str) -> frozenset[str]:
    return frozenset(tables)


registry = Registry()
registry.register("s_daily_balances", Summary(daily_balances, refresh_daily_balances, None, _reading("transactions", "postings")))
registry.register("s_monthly_spending", Summary(
    monthly_spending, refresh_monthly_spending, "year_month", _reading("transactions", "postings", "accounts")))
registry.register("s_account_monthly_balances", Summary(
    monthly_balances, refresh_monthly_balances, "year_month", _reading("transactions", "postings")))
registry.register("s_portfolio_holdings", Summary(
    portfolio_holdings, refresh_portfolio_holdings, None, _reading("accounts", "lots", "prices")))
registry.register("s_net_worth", Summary(
    net_worth, refresh_net_worth, "year_month", _reading("accounts", "prices"), {"monthly": "s_account_monthly_balances"}))
registry.register("s_yearly_capital_gains", Summary(
    yearly_capital_gains, refresh_yearly_capital_gains, "year", _reading("accounts", "lots", "lot_dispositions", "transactions")))
