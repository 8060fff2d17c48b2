"""Lots: acquisition, booking order, sales against a snapshot, corporate actions, transfers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.amounts import gain
from tallybook.functions.running import BLOCK_BITS, sums_before
from tallybook.operators.prices import latest_prices
from tallybook.schemas import BOOKING_METHODS, DEFAULT_HOLDING_DAYS, HOLDING_DAYS, QUANTITY, RATE
from tallybook.session import stored

KEYS = ["account_id", "commodity"]
# Two of them multiply within 38 digits, so no decimal is lost on the way.
RATIO = "decimal(18,8)"


def open_lots(lots: DataFrame) -> DataFrame:
    """Lots that can still be sold."""
    return lots.filter(~F.col("disposed") & (F.col("quantity") > 0))


def lots_of(
    lots: DataFrame, account_id: int, commodity: str, include_disposed: bool = False
) -> DataFrame:
    """One holding's lots by acquisition date, then id."""
    own = lots.filter((F.col("account_id") == account_id) & (F.col("commodity") == commodity))
    if not include_disposed:
        own = own.filter(~F.col("disposed"))
    return own.orderBy("acquired_date", "id")


def dispositions_of(
    dispositions: DataFrame, sell_transaction_id: int | None = None, lot_id: int | None = None
) -> DataFrame:
    """Dispositions of a sale and/or a lot, by id."""
    if sell_transaction_id is not None:
        dispositions = dispositions.filter(F.col("sell_transaction_id") == sell_transaction_id)
    if lot_id is not None:
        dispositions = dispositions.filter(F.col("lot_id") == lot_id)
    return dispositions.orderBy("id")


def booked_postings(postings: DataFrame, transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Postings on accounts with a booking method, with the date and that method."""
    booked = accounts.filter(F.col("booking_method").isNotNull()).select(
        F.col("id").alias("account_id"), "booking_method"
    )
    headers = transactions.select(F.col("id").alias("transaction_id"), "date")
    return postings.join(booked, "account_id").join(headers, "transaction_id")


def lots_from_postings(postings: DataFrame, transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """A lot per positive posting on an account with a booking method; the lot
    takes the posting's id.

    Cost is the first non-zero of cost amount and price, else 0; its currency
    the first given, else USD.
    """
    return lots_from_booked(booked_postings(postings, transactions, accounts))


def lots_from_booked(booked: DataFrame) -> DataFrame:
    """The same from ``booked_postings``."""
    bought = booked.filter(F.col("amount") > 0)
    zero = F.lit(0).cast(RATE)

    def nonzero(name: str) -> Column:
        return F.nullif(F.col(name).cast(RATE), zero)

    def optional(name: str, kind: str) -> Column:
        given = F.col(name) if name in booked.columns else F.lit(None)
        return given.cast(kind)

    return bought.select(
        "id",
        "account_id",
        F.col("currency").alias("commodity"),
        F.col("amount").cast(QUANTITY).alias("quantity"),
        F.col("amount").cast(QUANTITY).alias("original_quantity"),
        F.coalesce(nonzero("cost_amount"), nonzero("price"), zero).alias("cost_price"),
        F.coalesce(
            F.nullif("cost_currency", F.lit("")), F.nullif("price_currency", F.lit("")), F.lit("USD")
        ).alias("cost_currency"),
        F.col("date").alias("acquired_date"),
        optional("lot_label", "string").alias("label"),
        optional("lock_until", "date").alias("lock_until"),
        F.col("transaction_id").alias("source_transaction_id"),
        F.lit(False).alias("disposed"),
    )


def sales_from_postings(postings: DataFrame, transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """A sale per negative posting on an account with a booking method. A missing
    price sells for 0 USD."""
    return sales_from_booked(booked_postings(postings, transactions, accounts))


def sales_from_booked(booked: DataFrame) -> DataFrame:
    """The same from ``booked_postings``."""
    sold = booked.filter(F.col("amount") < 0)
    return sold.select(
        "id",
        "account_id",
        F.col("currency").alias("commodity"),
        (-F.col("amount")).cast(QUANTITY).alias("quantity"),
        F.coalesce(F.col("price"), F.lit(0)).cast(RATE).alias("proceeds_per_unit"),
        F.coalesce(F.nullif("price_currency", F.lit("")), F.lit("USD")).alias("proceeds_currency"),
        F.col("date").alias("sell_date"),
        F.col("transaction_id").alias("sell_transaction_id"),
        "booking_method",
    )


# ---- booking order ----------------------------------------------------------


def in_booking_order(lots: DataFrame, method: str = "booking_method") -> DataFrame:
    """Add ``major`` and ``minor``: ascending order of the two is booking order.

    FIFO: oldest first, by id. LIFO: newest first, by id descending. HIFO:
    highest cost (as a number) first, by id.
    """
    days = F.unix_date("acquired_date").cast("decimal(28,8)")
    rule = F.col(method)
    major = (
        F.when(rule == "FIFO", days).when(rule == "LIFO", -days)
        .when(rule == "HIFO", -F.col("cost_price").cast("decimal(28,8)"))
    )
    minor = F.when(rule == "LIFO", -F.col("id")).otherwise(F.col("id"))
    return lots.withColumn("major", major).withColumn("minor", minor)


def take_lots(lots: DataFrame, demands: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """What each demand takes from each open lot of its holding.

    ``demands(demand_id, account_id, commodity, demand, booking_method)``; the
    result is the lot's columns plus ``demand_id``, ``demand`` and ``taken`` > 0.
    Every demand sees the same snapshot. Lots ahead of a lot in booking order
    are summed block-wise, so a hot holding is spread over many tasks; a demand
    that exceeds the holding takes all of it, one of an unknown booking method
    nothing (``rejected`` lists it).

    Lots and demands lie on one axis, lots where those ahead of them end. How many lots
    lie before a demand is one more running sum, and these are its lots, met by
    their numbers: the work grows with what is taken, however many demands ask.
    """
    booking = [*KEYS, "booking_method"]
    demands = demands.filter(known_method())
    wanted = demands.select(*booking).distinct()
    queue = in_booking_order(open_lots(lots).join(wanted, KEYS)).withColumn("one", F.lit(1).cast("long"))
    ahead = stored(sums_before(queue, booking, "major", "minor", ["quantity", "one"], block_bits), "queue")
    asked = stored(demands.select("demand_id", *booking, "demand"), "asked")

    # A lot where a demand ends is not before it, so demands go first.
    place = "decimal(38,8)"
    axis = ahead.select(*booking, F.struct(F.col("quantity_before").cast(place).alias("at"), F.lit(1).alias("side")).alias("at"), "id", "one").unionByName(
        asked.select(*booking, F.struct(F.col("demand").cast(place).alias("at"), F.lit(0).alias("side")).alias("at"), F.col("demand_id").alias("id"), F.lit(0).cast("long").alias("one"))
    )
    counted = sums_before(axis, booking, "at", "id", ["one"], block_bits).filter("at.side = 0 and one_before > 0")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("one_before") - 1))
    wanted = counted.select(*booking, F.col("id").alias("demand_id"), numbers.alias("one_before")).join(asked, [*booking, "demand_id"])
    met = ahead.join(wanted, [*booking, "one_before"])
    taken = F.least(F.col("quantity"), F.col("demand") - F.col("quantity_before")).cast(QUANTITY)
    return met.withColumn("taken", taken).select(*lots.columns, "booking_method", "demand_id", "demand", "taken")


def known_method(method: str = "booking_method") -> Column:
    return F.coalesce(F.col(method).isin(BOOKING_METHODS), F.lit(False))


def rejected(lots: DataFrame, demands: DataFrame) -> DataFrame:
    """Demands that can't be met from a snapshot, each with its ``rule``:
    ``unknown_method``, ``second_demand`` (a holding meets the demand of the
    smallest id; what is left for another depends on it), ``insufficient_lots``."""
    columns = ["demand_id", *KEYS, "demand"]
    known = demands.filter(known_method())
    first = known.groupBy(*KEYS).agg(F.min("demand_id").alias("demand_id"))
    met = known.join(first, [*KEYS, "demand_id"], "left_semi")

    def broken(rows: DataFrame, rule: str) -> DataFrame:
        return rows.select(*columns, F.lit(rule).alias("rule"))

    return (
        broken(demands.filter(~known_method()), "unknown_method")
        .unionByName(broken(known.join(first, [*KEYS, "demand_id"], "left_anti"), "second_demand"))
        .unionByName(broken(shortfalls(lots, met), "insufficient_lots"))
    )


def shortfalls(lots: DataFrame, demands: DataFrame) -> DataFrame:
    """Demands beyond what is held: ``(demand_id, account_id, commodity, demand, available)``."""
    held = open_lots(lots).groupBy(*KEYS).agg(F.sum("quantity").alias("available"))
    return (
        demands.join(held, KEYS, "left")
        .withColumn("available", F.coalesce("available", F.lit(0).cast("decimal(28,8)")))
        .filter(F.col("available") < F.col("demand"))
        .select("demand_id", *KEYS, "demand", "available")
    )


# ---- terms and wash sales ---------------------------------------------------


def holding_term(
    acquired: Column,
    sold: Column,
    jurisdiction: Column,
    asset_class: Column,
    thresholds: Mapping[str, int] = HOLDING_DAYS,
    inclusive: bool = False,
) -> Column:
    """``long`` when held longer than the threshold of ``jurisdiction.asset_class``
    (365 days where none is set), else ``short``. A sale uses ``>``; the preview
    uses ``inclusive`` (``>=``)."""
    limit = F.lit(DEFAULT_HOLDING_DAYS)
    key = F.concat(jurisdiction, F.lit("."), asset_class)
    for name, days in thresholds.items():
        limit = F.when(key == name, F.lit(days)).otherwise(limit)
    held = F.datediff(sold, acquired)
    return F.when(held >= limit if inclusive else held > limit, "long").otherwise("short")


def wash_sale_days(sales: DataFrame, purchases: DataFrame, mode: str = "full") -> DataFrame:
    """Sale days of a holding that have a purchase of it within 30 days, on another day.

    ``sales(account_id, commodity, sell_date)``, ``purchases(account_id,
    commodity, acquired_date)``. ``full`` looks both ways; ``recorded`` only at
    purchases before the sale. Both sides shrink to one row per holding and day;
    a range frame then counts purchases, without any pairing.
    """
    day = F.unix_date("day")
    bought = purchases.select(*KEYS, F.col("acquired_date").alias("day"), F.lit(1).alias("bought"), F.lit(0).alias("sold"))
    sold = sales.select(*KEYS, F.col("sell_date").alias("day"), F.lit(0).alias("bought"), F.lit(1).alias("sold"))
    days = bought.unionByName(sold).groupBy(*KEYS, "day").agg(
        F.max("bought").alias("bought"), F.max("sold").alias("sold")
    ).withColumn("n", day)
    last = 30 if mode == "full" else 0
    near = Window.partitionBy(*KEYS).orderBy("n").rangeBetween(-30, last)
    other = F.sum("bought").over(near) - F.col("bought")
    return days.withColumn("other", other).filter("sold = 1 and other > 0").select(
        *KEYS, F.col("day").alias("sell_date")
    )


def with_wash_sales(dispositions: DataFrame, purchases: DataFrame, mode: str = "full") -> DataFrame:
    """Add ``wash_sale`` and ``wash_sale_adjustment`` (the whole loss)."""
    losses = dispositions.filter(F.col("gain_loss") < 0).select(*KEYS, "sell_date").distinct()
    washed = wash_sale_days(losses, purchases, mode).withColumn("_washed", F.lit(True))
    flag = F.coalesce(F.col("_washed"), F.lit(False)) & (F.col("gain_loss") < 0)
    return (
        dispositions.join(washed, [*KEYS, "sell_date"], "left")
        .withColumn("wash_sale", flag)
        .withColumn("wash_sale_adjustment", F.when(flag, F.abs("gain_loss")))
        .drop("_washed")
    )


def priced_dispositions(matches: DataFrame, accounts: DataFrame, thresholds: Mapping[str, int] = HOLDING_DAYS) -> DataFrame:
    """Gain and term for matched pieces of lots and sales."""
    profile = accounts.select(F.col("id").alias("account_id"), "jurisdiction", "asset_class")
    return matches.join(profile, "account_id", "left").select(
        *KEYS,
        "lot_id",
        "sale_id",
        "sell_transaction_id",
        "quantity",
        "acquired_date",
        "sell_date",
        "cost_price",
        "cost_currency",
        "proceeds_per_unit",
        "proceeds_currency",
        gain(F.col("proceeds_per_unit"), F.col("cost_price"), F.col("quantity")).cast("decimal(37,8)").alias("gain_loss"),
        F.col("proceeds_currency").alias("gain_loss_currency"),
        holding_term(
            F.col("acquired_date"), F.col("sell_date"), F.col("jurisdiction"), F.col("asset_class"), thresholds
        ).alias("term"),
    )


def book_sales(
    lots: DataFrame,
    sales: DataFrame,
    accounts: DataFrame,
    thresholds: Mapping[str, int] = HOLDING_DAYS,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Dispositions of one sale per holding against a lot snapshot.

    Sales beyond the holding, further sales of a holding and those of an unknown
    booking method are left out whole; ``rejected`` lists them. Several sales of
    one holding over time are ``lot_history.dispose_history``.
    """
    demands = sales.select(
        F.col("id").alias("demand_id"), *KEYS, F.col("quantity").alias("demand"), "booking_method"
    )
    refused = rejected(lots, demands).select("demand_id")
    # One row per holding, read several times below.
    accepted = stored(demands.join(refused, "demand_id", "left_anti"), "demands")
    taken = take_lots(lots, accepted, block_bits)
    sale = sales.select(
        F.col("id").alias("sale_id"), "sell_transaction_id", "sell_date", "proceeds_per_unit", "proceeds_currency"
    )
    matches = taken.select(
        *KEYS, F.col("id").alias("lot_id"), F.col("demand_id").alias("sale_id"), F.col("taken").alias("quantity"),
        "acquired_date", "cost_price", "cost_currency",
    ).join(sale, "sale_id")
    return with_wash_sales(stored(priced_dispositions(matches, accounts, thresholds), "dispositions"), lots)


# ---- sale preview -----------------------------------------------------------


def priced_proposals(proposals: DataFrame, accounts: DataFrame, prices: DataFrame) -> DataFrame:
    """Proposals with ``price`` (the given one, else the newest price in the
    account's currency, of any date) and the account's tax profile."""
    profile = accounts.select(
        F.col("id").alias("account_id"), "jurisdiction", "asset_class", F.col("currency").alias("account_currency")
    )
    newest = latest_prices(prices).select(
        "commodity", F.col("currency").alias("account_currency"), F.col("price").alias("newest_price")
    )
    return (
        proposals.join(profile, "account_id", "left")
        .join(newest, ["commodity", "account_currency"], "left")
        .withColumn("price", F.coalesce(F.col("sell_price").cast(RATE), F.col("newest_price").cast(RATE)))
        .drop("newest_price", "sell_price")
    )


def preview_lots(
    proposals: DataFrame,
    lots: DataFrame,
    accounts: DataFrame,
    prices: DataFrame,
    thresholds: Mapping[str, int] = HOLDING_DAYS,
) -> DataFrame:
    """Lots each proposed sale would consume; partial where too little is held.

    ``proposals(proposal_id, account_id, commodity, quantity, booking_method,
    sell_price, sell_date)``. Nothing is written.
    """
    priced = priced_proposals(proposals, accounts, prices).filter(
        (F.col("quantity") > 0) & F.col("price").isNotNull()
    )
    demands = priced.select(
        F.col("proposal_id").alias("demand_id"), *KEYS, F.col("quantity").alias("demand"), "booking_method"
    )
    taken = take_lots(lots, demands).select(
        F.col("demand_id").alias("proposal_id"), F.col("id").alias("lot_id"), "acquired_date", "lock_until",
        F.col("taken").alias("quantity_from_lot"), "cost_price", "cost_currency",
    )
    terms = priced.select("proposal_id", *KEYS, "price", "sell_date", "jurisdiction", "asset_class")
    return taken.join(terms, "proposal_id").select(
        "proposal_id", *KEYS, "lot_id", "acquired_date", "quantity_from_lot", "cost_price", "cost_currency",
        F.col("price").alias("sell_price"),
        (F.col("quantity_from_lot") * F.col("price")).cast("decimal(37,8)").alias("proceeds"),
        gain(F.col("price"), F.col("cost_price"), F.col("quantity_from_lot")).cast("decimal(37,8)").alias("gain_loss"),
        holding_term(
            F.col("acquired_date"), F.col("sell_date"), F.col("jurisdiction"), F.col("asset_class"), thresholds, True
        ).alias("term"),
        F.datediff("sell_date", "acquired_date").alias("holding_days"),
        F.coalesce(F.col("sell_date") < F.col("lock_until"), F.lit(False)).alias("locked"),
        "lock_until",
    )


def preview_totals(proposals: DataFrame, previewed: DataFrame) -> DataFrame:
    """Totals per proposal, zero where nothing would be sold."""
    sums = previewed.groupBy("proposal_id").agg(
        F.sum("proceeds").alias("total_proceeds"),
        F.sum("gain_loss").alias("total_gain_loss"),
        F.sum("quantity_from_lot").alias("sold_quantity"),
        F.count(F.lit(1)).alias("lot_count"),
    )
    return proposals.select("proposal_id", *KEYS, "quantity").join(sums, "proposal_id", "left").na.fill(0)


# The texts of warnings.
WARN_QUANTITY = "Quantity must be positive"
WARN_PRICE = "No price found for {}. Provide sell_price explicitly."
WARN_LOCKED = "Lot {} (acquired {}) is locked until {}"
WARN_SHORT = "Insufficient lots: requested {}, available {}"


def _text(template: str, *values: Column) -> Column:
    """A template with its gaps filled; NULL where a value is."""
    parts = template.split("{}")
    filled = [x for part, value in zip(parts, values) for x in (F.lit(part), value.cast("string"))]
    return F.concat(*filled, F.lit(parts[-1]))


def preview_warnings(
    proposals: DataFrame, previewed: DataFrame, accounts: DataFrame, prices: DataFrame
) -> DataFrame:
    """``(proposal_id, lot_id, warning)``: one row per warning."""
    no_lot = F.lit(None).cast("long").alias("lot_id")
    priced = priced_proposals(proposals, accounts, prices)
    refused = priced.select(
        "proposal_id", no_lot,
        F.when(F.col("quantity") <= 0, F.lit(WARN_QUANTITY))
        .when(F.col("price").isNull(), _text(WARN_PRICE, F.col("commodity"))).alias("warning"),
    ).filter(F.col("warning").isNotNull())
    locked = previewed.filter("locked").select(
        "proposal_id", "lot_id", _text(WARN_LOCKED, F.col("lot_id"), F.col("acquired_date"), F.col("lock_until")).alias("warning")
    )
    sold = previewed.groupBy("proposal_id").agg(F.sum("quantity_from_lot").alias("sold"))
    short = (
        priced.filter((F.col("quantity") > 0) & F.col("price").isNotNull())
        .join(sold, "proposal_id", "left")
        .withColumn("sold", F.coalesce(F.col("sold").cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)")))
        .filter(F.col("sold") < F.col("quantity"))
        .select("proposal_id", no_lot, _text(
            WARN_SHORT, F.col("quantity"), F.col("sold").cast(proposals.schema["quantity"].dataType)
        ).alias("warning"))
    )
    return refused.unionByName(locked).unionByName(short)


# ---- corporate actions ------------------------------------------------------


def action_violations(actions: DataFrame) -> DataFrame:
    """Actions that may not be applied."""
    return actions.filter(
        ~F.coalesce(F.col("action_type").isin("split", "reverse_split", "bonus"), F.lit(False))
        | ~F.coalesce(F.col("ratio") > 0, F.lit(False))
    )


def _actions_by_commodity(actions: DataFrame) -> DataFrame:
    """One row per commodity with its actions as an array. A commodity has a
    handful of splits in its life, so the array stays small."""
    sound = actions.join(action_violations(actions).select("action_id"), "action_id", "left_anti")
    date = F.col("effective_date") if "effective_date" in actions.columns else F.lit(None)
    forward = F.col("action_type") != "reverse_split"
    one = F.lit(1).cast(RATIO)
    return sound.groupBy("commodity").agg(F.collect_list(F.struct(
        date.cast("date").alias("day"),
        F.when(forward, F.col("ratio").cast(RATIO)).otherwise(one).alias("up"),
        F.when(forward, one).otherwise(F.col("ratio").cast(RATIO)).alias("down"),
    )).alias("actions"))


def _after(actions: Column, day: Column) -> Column:
    """Actions that apply to units held since ``day``: undated ones and later ones."""
    return F.filter(actions, lambda a: a["day"].isNull() | (a["day"] > day))


def _product(actions: Column, side: str) -> Column:
    return F.aggregate(
        actions, F.lit(1).cast(RATIO), lambda total, a: (total * a[side]).cast(RATIO)
    )


def _scaled(value: Column, times: Column, over: Column, kind: T.DataType) -> Column:
    """``value * times / over``, all with 8 decimals; the product is exact."""
    product = value.cast(QUANTITY) * times.cast(QUANTITY)
    return F.when(over == 1, product.cast(kind)).otherwise((product / over.cast(QUANTITY)).cast(kind))


def apply_corporate_actions(lots: DataFrame, actions: DataFrame) -> DataFrame:
    """Scale undisposed lots by their commodity's actions.

    ``actions(action_id, commodity, action_type, ratio[, effective_date])``.
    Splits and bonuses multiply quantity and divide cost by the ratio, reverse
    splits do the inverse. Without a date an action applies to every open lot;
    with one only to lots acquired before it. Several actions compose.
    """
    scaled = lots.join(_actions_by_commodity(actions), "commodity", "left")
    due = _after(F.col("actions"), F.col("acquired_date"))
    up, down = _product(due, "up"), _product(due, "down")
    hit = F.col("actions").isNotNull() & ~F.col("disposed")

    def scale(name: str, times: Column, over: Column) -> Column:
        changed = _scaled(F.col(name), times, over, lots.schema[name].dataType)
        return F.when(hit, changed).otherwise(F.col(name)).alias(name)

    changed = {
        "quantity": scale("quantity", up, down),
        "original_quantity": scale("original_quantity", up, down),
        "cost_price": scale("cost_price", down, up),
    }
    return scaled.select(*[changed.get(c, F.col(c)) for c in lots.columns])


def sales_in_todays_units(sales: DataFrame, actions: DataFrame) -> DataFrame:
    """Sales with quantities and proceeds per unit scaled by the actions after
    their day, as the lots are; ``_up`` and ``_down`` lead back."""
    scaled = sales.join(_actions_by_commodity(actions), "commodity", "left")
    due = _after(F.col("actions"), F.col("sell_date"))
    one = F.lit(1).cast(RATIO)
    scaled = scaled.withColumn("_up", F.coalesce(_product(due, "up"), one)).withColumn("_down", F.coalesce(_product(due, "down"), one))
    return scaled.withColumn("quantity", _scaled(F.col("quantity"), F.col("_up"), F.col("_down"), QUANTITY)).withColumn(
        "proceeds_per_unit", _scaled(F.col("proceeds_per_unit"), F.col("_down"), F.col("_up"), RATE)
    ).select(*sales.columns, "_up", "_down")


def transfers_in_todays_units(transfers: DataFrame, actions: DataFrame) -> DataFrame:
    """Transfers with quantities scaled by the actions after their day."""
    scaled = transfers.join(_actions_by_commodity(actions), "commodity", "left")
    due = _after(F.col("actions"), F.col("date"))
    one = F.lit(1).cast(RATIO)
    quantity = _scaled(F.col("quantity"), F.coalesce(_product(due, "up"), one), F.coalesce(_product(due, "down"), one), QUANTITY)
    return scaled.withColumn("quantity", quantity).select(*transfers.columns)


def in_units_of_the_day(dispositions: DataFrame, sales: DataFrame) -> DataFrame:
    """Dispositions in today's units, matched from ``sales_in_todays_units``, back in
    those of their sale's day; gains stay as they are."""
    factors = sales.select(F.col("id").alias("sale_id"), "_up", "_down")
    back = dispositions.join(factors, "sale_id")
    changed = {
        "quantity": _scaled(F.col("quantity"), F.col("_down"), F.col("_up"), QUANTITY).alias("quantity"),
        "proceeds_per_unit": _scaled(F.col("proceeds_per_unit"), F.col("_up"), F.col("_down"), RATE).alias("proceeds_per_unit"),
    }
    return back.select(*[changed.get(c, F.col(c)) for c in dispositions.columns])


def affected_lot_counts(lots: DataFrame, actions: DataFrame) -> DataFrame:
    """``(commodity, affected_lots)``: undisposed lots an action touches."""
    sound = actions.join(action_violations(actions).select("action_id"), "action_id", "left_anti")
    return (
        lots.filter(~F.col("disposed")).join(sound.select("commodity"), "commodity", "left_semi")
        .groupBy("commodity").agg(F.count(F.lit(1)).alias("affected_lots"))
    )


# ---- transfers --------------------------------------------------------------


def transfer_demands(transfers: DataFrame) -> DataFrame:
    return transfers.select(
        F.col("transfer_id").alias("demand_id"), F.col("from_account_id").alias("account_id"), "commodity",
        F.col("quantity").alias("demand"), "booking_method",
    )


def transfer_lots(lots: DataFrame, transfers: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The lot table after the transfers.

    ``transfers(transfer_id, from_account_id, to_account_id, commodity,
    quantity, booking_method)``, one per source holding. Lots keep cost
    and date; the last one splits, its moved part getting a new id derived from
    the lot and the transfer. The kept part's original quantity shrinks by the
    moved one, so a replay does not restore it. Transfers that can't be met are
    left out (``rejected(lots, transfer_demands(transfers))`` lists them).
    """
    demands = transfer_demands(transfers)
    refused = rejected(lots, demands).select("demand_id")
    accepted = stored(demands.join(refused, "demand_id", "left_anti"), "demands")
    taken = (
        take_lots(lots, accepted, block_bits)
        .select("id", F.col("demand_id").alias("transfer_id"), "taken")
        .join(transfers.select("transfer_id", "to_account_id"), "transfer_id")
    )
    rows = lots.join(taken, "id", "left")
    whole = F.col("taken") == F.col("quantity")
    digest = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("transfer_id").cast("string")), 256)
    new_id = -F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def part(id_: Column, account: Column, quantity: Column, original: Column) -> Column:
        values = {"id": id_, "account_id": account, "quantity": quantity, "original_quantity": original}
        return F.struct(*[
            values.get(c, F.col(c)).cast(lots.schema[c].dataType).alias(c) for c in lots.columns
        ])

    untouched = part(F.col("id"), F.col("account_id"), F.col("quantity"), F.col("original_quantity"))
    moved = part(F.col("id"), F.col("to_account_id"), F.col("quantity"), F.col("original_quantity"))
    kept = part(
        F.col("id"), F.col("account_id"), F.col("quantity") - F.col("taken"),
        F.col("original_quantity") - F.col("taken"),
    )
    split = part(new_id, F.col("to_account_id"), F.col("taken"), F.col("taken"))
    parts = (
        F.when(F.col("taken").isNull(), F.array(untouched)).when(whole, F.array(moved)).otherwise(F.array(kept, split))
    )
    return rows.select(F.explode(parts).alias("lot")).select("lot.*")


# ---- replay -----------------------------------------------------------------


def replay_lots(
    lots: DataFrame,
    dispositions: DataFrame,
    transactions: DataFrame | None = None,
    actions: DataFrame | None = None,
) -> DataFrame:
    """Lot state from dispositions: remaining = original - disposed; disposed when
    nothing remains.

    Original quantities are in today's units. Given dated corporate ``actions``
    (and ``transactions`` for the sale dates), quantities sold before a split
    are scaled by it first, so a replay after a split does not drift.
    """
    sold = dispositions
    if actions is not None:
        headers = transactions.select(F.col("id").alias("sell_transaction_id"), F.col("date").alias("_sold_on"))
        commodity = lots.select(F.col("id").alias("lot_id"), F.col("commodity").alias("_commodity"))
        grouped = _actions_by_commodity(actions).withColumnRenamed("commodity", "_commodity")
        later = _after(F.col("actions"), F.col("_sold_on"))
        value = _scaled(F.col("quantity"), _product(later, "up"), _product(later, "down"), QUANTITY)
        sold = (
            sold.select("lot_id", "sell_transaction_id", "quantity")
            .join(headers, "sell_transaction_id").join(commodity, "lot_id").join(grouped, "_commodity", "left")
            .withColumn("quantity", F.when(F.col("actions").isNull(), F.col("quantity")).otherwise(value))
        )
    gone = sold.groupBy(F.col("lot_id").alias("id")).agg(F.sum("quantity").alias("_gone"))
    left = F.col("original_quantity") - F.coalesce(F.col("_gone"), F.lit(0).cast(QUANTITY))
    rows = lots.join(gone, "id", "left").withColumn("_left", left.cast(lots.schema["quantity"].dataType))
    changed = {"quantity": F.col("_left").alias("quantity"), "disposed": (F.col("_left") <= 0).alias("disposed")}
    return rows.select(*[changed.get(c, F.col(c)) for c in lots.columns])
