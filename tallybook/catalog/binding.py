"""The test tables seen as a ledger, for Spark and as SQL for the oracle.

Customers hold cash accounts, nations hold custody accounts, part types are
expense accounts, orders are transactions, line items are their postings and,
seen as trades, the lots and sales of custody accounts. Both sides derive every
table from the whole input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.operators.lot_history import dispose_history
from tallybook.schemas import MONEY, QUANTITY, RATE, SEED_TOLERANCES, TABLES
from tallybook.session import configure, scratch_path

# Region key -> currency, and exchange rates (commodity, currency, date, price).
CURRENCIES = {0: "USD", 1: "INR", 2: "EUR", 3: "GBP", 4: "BTC"}
FX = [
    ("USD", "INR", "1995-01-01", "31.40"),
    ("USD", "INR", "1998-01-01", "39.28"),
    ("USD", "INR", "2000-06-30", "44.69"),
    ("EUR", "USD", "1999-01-04", "1.1789"),
    ("EUR", "USD", "2000-10-26", "0.8252"),
    ("GBP", "USD", "1995-01-02", "1.5645"),
    ("GBP", "USD", "1998-10-08", "1.7112"),
    ("USD", "GBP", "2001-06-12", "0.7269"),
]

_STATUS = {"F": "cleared", "O": "pending", "P": "reconciled"}

# Segment -> asset class of a cash account (None: not given).
_CLASSES = {"BUILDING": "cash", "FURNITURE": "equity", "HOUSEHOLD": "debt", "MACHINERY": "real_estate"}


def _lookup(column: Column, values: dict) -> Column:
    found = F.lit(None).cast("string")
    for key, value in values.items():
        found = F.when(column == key, F.lit(value)).otherwise(found)
    return found


def _day(column: str) -> Column:
    return F.col(column).cast("date")


def _text_id(column: Column) -> Column:
    """32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


# Paths of tables already written, by application, directory and table.
_written: dict[tuple[str, str, str], str] = {}


def kept(build):
    """A ledger table: derived once per session and directory, written to the
    shared folder and read from there, as a ledger's tables are."""

    def read(self: "Binding") -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.root, build.__name__)
        if key not in _written:
            path = scratch_path(self.spark, build.__name__)
            build(self).write.parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])

    read.__name__, read.__doc__ = build.__name__, build.__doc__
    return property(read)


class Binding:
    """Ledger tables over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.root = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # ---- accounts ----

    @cached_property
    def nations(self) -> DataFrame:
        """25 nations with their currency."""
        return self.table("nation").select(
            "n_nationkey", "n_name", _lookup(F.col("n_regionkey"), CURRENCIES).alias("currency")
        )

    @cached_property
    def cash_accounts(self) -> DataFrame:
        customers = self.table("customer").join(self.nations, F.col("c_nationkey") == F.col("n_nationkey"))
        kind = F.when(F.col("c_acctbal") < 0, "Liabilities").otherwise("Assets")
        asset_class = F.when(F.col("currency") == "BTC", "crypto").otherwise(_lookup(F.col("c_mktsegment"), _CLASSES))
        return customers.select(
            (F.col("c_custkey") * 10 + 1).alias("id"),
            F.concat_ws(":", kind, "n_name", "c_name").alias("name"), kind.alias("type"), "currency",
            F.lit(None).cast("string").alias("booking_method"), F.col("c_mktsegment").alias("institution"),
            asset_class.alias("asset_class"), F.lit(None).cast("string").alias("jurisdiction"),
            F.when(F.col("c_acctbal") < -900, F.lit("2000-01-01").cast("date")).alias("closed_at"),
        )

    @cached_property
    def custody_accounts(self) -> DataFrame:
        key = F.col("n_nationkey")
        methods = {0: "FIFO", 1: "LIFO", 2: "HIFO"}
        classes = {0: "equity", 1: "debt", 2: "elss", 3: "crypto"}
        return self.nations.select(
            (key.cast("long") * 10 + 2).alias("id"), F.concat_ws(":", F.lit("Assets"), F.lit("Custody"), "n_name").alias("name"),
            F.lit("Assets").alias("type"), F.lit("USD").alias("currency"),
            _lookup(key % 3, methods).alias("booking_method"), F.lit(None).cast("string").alias("institution"),
            _lookup(key % 5, classes).alias("asset_class"), F.when(key % 2 == 0, "US").otherwise("IN").alias("jurisdiction"),
            F.lit(None).cast("date").alias("closed_at"),
        )

    @cached_property
    def expense_accounts(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.table("part").select("p_type").distinct().select(
            (_text_id(F.col("p_type")) * 10 + 3).alias("id"), F.concat_ws(":", F.lit("Expenses"), "p_type").alias("name"),
            F.lit("Expenses").alias("type"), F.lit("USD").alias("currency"), none.alias("booking_method"),
            none.alias("institution"), none.alias("asset_class"), none.alias("jurisdiction"),
            F.lit(None).cast("date").alias("closed_at"),
        )

    @kept
    def accounts(self) -> DataFrame:
        rows = self.cash_accounts.unionByName(self.custody_accounts).unionByName(self.expense_accounts)
        return rows.withColumn("opened_at", F.lit("1995-01-01 00:00:00").cast("timestamp"))

    # ---- transactions ----

    @kept
    def transactions(self) -> DataFrame:
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("payee"))
        day = _day("o_orderdate")
        return self.table("orders").join(customers, "o_custkey").select(
            F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("uuid"), day.alias("date"),
            "payee", F.col("o_orderpriority").alias("narration"), _lookup(F.col("o_orderstatus"), _STATUS).alias("status"),
            (F.year(day) * 100 + F.month(day)).cast("long").alias("source_file_id"),
        )

    @kept
    def order_sums(self) -> DataFrame:
        """Spent per order and part type."""
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), (price * kept).cast(MONEY).alias("amount")
        )
        types = self.table("part").select("p_partkey", "p_type")
        return lines.join(types, "p_partkey").groupBy("o_orderkey", "p_type").agg(F.sum("amount").cast(MONEY).alias("amount"))

    @cached_property
    def order_currencies(self) -> DataFrame:
        owners = self.table("customer").select("c_custkey", "c_nationkey").join(
            self.nations, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("c_custkey").alias("o_custkey"), "currency")
        return self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice").join(owners, "o_custkey")

    def _legs(self, cash: Column) -> DataFrame:
        """Expense legs numbered by part type within the order, and one cash leg."""
        number = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("p_type"))
        expense = self.order_sums.withColumn("n", number).join(self.order_currencies, "o_orderkey").select(
            (F.col("o_orderkey") * 100 + F.col("n")).alias("id"), F.col("o_orderkey").alias("transaction_id"),
            (_text_id(F.col("p_type")) * 10 + 3).alias("account_id"), "amount", "currency",
        )
        sums = self.order_sums.groupBy("o_orderkey").agg(F.sum("amount").alias("spent"))
        paid = sums.join(self.order_currencies, "o_orderkey").select(
            (F.col("o_orderkey") * 100).alias("id"), F.col("o_orderkey").alias("transaction_id"),
            (F.col("o_custkey") * 10 + 1).alias("account_id"), cash.cast(MONEY).alias("amount"), "currency",
        )
        none = {"cost_amount": QUANTITY, "cost_currency": "string", "cost_date": "date", "price": RATE, "price_currency": "string", "lot_id": "long"}
        return expense.unionByName(paid).select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])

    @kept
    def postings(self) -> DataFrame:
        return self._legs(-F.col("spent"))

    @kept
    def quoted_postings(self) -> DataFrame:
        """The same with the order's quoted total as cash leg, which rarely balances."""
        return self._legs(-F.col("o_totalprice").cast(MONEY))

    @kept
    def transaction_tags(self) -> DataFrame:
        segments = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        return self.table("orders").join(segments, "o_custkey").select(
            F.col("o_orderkey").alias("transaction_id"), F.explode(F.array("o_orderpriority", "c_mktsegment")).alias("tag")
        )

    # ---- prices ----

    @kept
    def commodity_prices(self) -> DataFrame:
        brands = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        return self.table("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(brands, "l_partkey").groupBy(
            F.col("p_brand").alias("commodity"), F.lit("USD").alias("currency"), _day("l_shipdate").alias("date")
        ).agg(F.max(F.col("l_extendedprice").cast(MONEY)).cast(RATE).alias("price")).withColumn("source", F.lit("market"))

    @cached_property
    def fx(self) -> DataFrame:
        """A fixed rate table."""
        rows = self.spark.createDataFrame(FX, "commodity string, currency string, date string, price string")
        return rows.select(
            "commodity", "currency", F.col("date").cast("date").alias("date"), F.col("price").cast(RATE).alias("price"),
            F.lit("forex").alias("source"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        return self.commodity_prices.unionByName(self.fx)

    # ---- trades ----

    @kept
    def trades(self) -> DataFrame:
        """Units of a brand bought (line returned flag A, N) or sold (R) by a nation
        in one order on one day; the id orders trades of a day."""
        owners = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(
            self.table("customer").select("c_custkey", "c_nationkey"), "c_custkey"
        )
        brands = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", _day("l_shipdate").alias("date"), (F.col("l_returnflag") == "R").alias("sale"),
            F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("price"),
        )
        grouped = lines.join(brands, "l_partkey").join(owners, "l_orderkey").groupBy(
            "c_nationkey", "p_brand", "date", "l_orderkey", "sale"
        ).agg(F.sum("quantity").cast(QUANTITY).alias("quantity"), F.max("price").cast(RATE).alias("price"))
        brand_no = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("long")
        number = ((F.col("l_orderkey") * 100 + brand_no) * 10000 + F.datediff(F.col("date"), F.lit("1995-01-01").cast("date"))) * 2
        return grouped.select(
            (number + F.col("sale").cast("long")).alias("id"), (F.col("c_nationkey").cast("long") * 10 + 2).alias("account_id"),
            F.col("p_brand").alias("commodity"), "date", "sale", "quantity", "price",
        )

    @cached_property
    def trade_transactions(self) -> DataFrame:
        return self.trades.select("id", "date")

    @cached_property
    def trade_postings(self) -> DataFrame:
        """Trades as postings of units, priced in USD. Many holdings run short."""
        amount = F.when(F.col("sale"), -F.col("quantity")).otherwise(F.col("quantity"))
        return self.trades.select(
            "id", F.col("id").alias("transaction_id"), "account_id", amount.cast(QUANTITY).alias("amount"),
            F.col("commodity").alias("currency"), F.lit(None).cast(QUANTITY).alias("cost_amount"),
            F.lit(None).cast("string").alias("cost_currency"), "price", F.lit("USD").alias("price_currency"),
        )

    @cached_property
    def lots(self) -> DataFrame:
        """Purchases as lots, nothing sold yet; lots are locked for 200 days when
        bought in a year's first quarter."""
        day = F.col("date")
        return self.trades.filter(~F.col("sale")).select(
            "id", "account_id", "commodity", "quantity", F.col("quantity").alias("original_quantity"),
            F.col("price").alias("cost_price"), F.lit("USD").alias("cost_currency"), day.alias("acquired_date"),
            F.lit(None).cast("string").alias("label"), F.when(F.month(day) <= 3, F.date_add(day, 200)).alias("lock_until"),
            F.col("id").alias("source_transaction_id"), F.lit(False).alias("disposed"),
        )

    def _sales(self, rows: DataFrame) -> DataFrame:
        methods = self.custody_accounts.select(F.col("id").alias("account_id"), "booking_method")
        return rows.filter("sale").join(methods, "account_id").select(
            "id", "account_id", "commodity", "quantity", F.col("price").alias("proceeds_per_unit"),
            F.lit("USD").alias("proceeds_currency"), F.col("date").alias("sell_date"),
            F.col("id").alias("sell_transaction_id"), "booking_method",
        )

    @cached_property
    def sales(self) -> DataFrame:
        """All sales: many holdings run short."""
        return self._sales(self.trades)

    @cached_property
    def fifo_accounts(self) -> DataFrame:
        """All custody accounts booked first-in-first-out."""
        fifo = F.when(F.col("booking_method").isNotNull(), "FIFO")
        return self.accounts.withColumn("booking_method", fifo)

    @kept
    def lot_dispositions(self) -> DataFrame:
        """The sales' dispositions, first-in-first-out."""
        return dispose_history(self.lots, self.sales, self.fifo_accounts).select(
            F.xxhash64("lot_id", "sale_id").alias("id"), "lot_id", "sell_transaction_id", "quantity", "proceeds_per_unit",
            "proceeds_currency", "gain_loss", "gain_loss_currency", "term", "wash_sale", "wash_sale_adjustment",
        )

    @cached_property
    def custody_ledger(self) -> Ledger:
        """The custody side with its lots and dispositions."""
        return self.books.with_tables(
            lots=self.lots, lot_dispositions=self.lot_dispositions, transactions=self.trade_transactions, postings=self.trade_postings
        )

    @cached_property
    def tolerances(self) -> DataFrame:
        """The seed tolerances, a fixed table."""
        rows = self.spark.createDataFrame(list(SEED_TOLERANCES.items()), "currency string, tolerance string")
        return rows.select("currency", F.col("tolerance").cast("decimal(18,8)").alias("tolerance"))

    @kept
    def budgets(self) -> DataFrame:
        """90% of a month's shipped value per part type (none for PROMO), in USD."""
        types = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type").filter("p_type <> 'PROMO'")
        return self.table("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(types, "l_partkey").groupBy(
            "p_type", F.date_format("l_shipdate", "yyyy-MM").alias("year_month")
        ).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("shipped")).select(
            (_text_id(F.col("p_type")) * 10 + 3).alias("account_id"), "year_month", F.lit("USD").alias("currency"),
            (F.col("shipped") * F.lit("0.9").cast("decimal(2,1)")).cast(MONEY).alias("amount"),
        )

    # ---- statements ----

    @kept
    def statement_rows(self) -> DataFrame:
        """Events as raw statement rows: dates and amounts as text, money in for
        purchases and signups."""
        amount = F.format_number(F.col("value") * 10, 2)
        sign = F.when(F.col("event_type").isin("purchase", "signup"), "").otherwise("-")
        return self.table("events").select(
            F.lit(1).cast("long").alias("source_file_id"), F.col("event_id").alias("row_index"),
            F.create_map(
                F.lit("Posting Date"), F.date_format("ts", "MM/dd/yyyy"),
                F.lit("Description"), F.concat_ws(" ", F.upper("event_type"), F.col("user_id").cast("string")),
                F.lit("Amount"), F.concat(sign, F.lit("$"), amount),
                F.lit("Balance"), F.lit(""),
            ).alias("data"),
        )

    MAPPING = {
        "date_col": "Posting Date", "date_format": "%m/%d/%Y", "payee_col": "Description",
        "amount_col": "Amount", "amount_sign": "negative_is_debit", "default_currency": "USD",
    }

    @cached_property
    def books(self) -> Ledger:
        """Accounts, prices and tolerances, nothing posted yet: the custody side has
        transactions and postings of its own, so those of the orders aren't derived for it."""
        return Ledger.empty(self.spark).with_tables(accounts=self.accounts, prices=self.prices, currency_tolerances=self.tolerances)

    @cached_property
    def ledger(self) -> Ledger:
        """Everything but the custody side."""
        return self.books.with_tables(transactions=self.transactions, postings=self.postings, transaction_tags=self.transaction_tags)

    def empty_table(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])
