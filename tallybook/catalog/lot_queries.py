"""Lots, sales, gains and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.catalog.binding import Binding
from tallybook.catalog.registry import query
from tallybook.ledger import Ledger
from tallybook.operators import lot_history
from tallybook.operators import lots as lt
from tallybook.plans import changes, reports, summaries

_QTY = "decimal(18,2)"


@query("M5", "SELECT id, account_id, commodity, quantity, cost_price, 'USD' AS cost_currency, acquired_date FROM lots", quantity=_QTY, cost_price=_QTY)
def lots_from_postings(b: Binding) -> DataFrame:
    return lt.lots_from_postings(b.trade_postings, b.trade_transactions, b.accounts).select(
        "id", "account_id", "commodity", "quantity", "cost_price", "cost_currency", "acquired_date"
    )


@query("M5", "SELECT id, account_id, commodity, quantity, proceeds AS proceeds_per_unit, sell_date, booking_method FROM sales", quantity=_QTY, proceeds_per_unit=_QTY)
def sales_from_postings(b: Binding) -> DataFrame:
    return lt.sales_from_postings(b.trade_postings, b.trade_transactions, b.accounts).select(
        "id", "account_id", "commodity", "quantity", "proceeds_per_unit", "sell_date", "booking_method"
    )


# ---- one sale per holding against the snapshot ----

# Half of each holding is sold on one day at its newest lot's cost.
_HALF = """
    half AS (SELECT l.account_id, l.commodity, booking_method, floor(sum(quantity) / 2)::DECIMAL(18,2) AS demand,
                    arg_max(cost_price, id) AS price FROM lots l JOIN custody USING (account_id) GROUP BY 1, 2, 3),
    queue AS (SELECT l.*, h.demand, h.price, sum(quantity) OVER (PARTITION BY account_id, commodity ORDER BY
                  CASE booking_method WHEN 'FIFO' THEN date_diff('day', DATE '1970-01-01', acquired_date)
                       WHEN 'LIFO' THEN -date_diff('day', DATE '1970-01-01', acquired_date) ELSE -cost_price END,
                  CASE booking_method WHEN 'LIFO' THEN -id ELSE id END) - quantity AS ahead
              FROM lots l JOIN half h USING (account_id, commodity)),
    taken AS (SELECT *, least(quantity, demand - ahead)::DECIMAL(18,2) AS used FROM queue WHERE ahead < demand)"""
_TERM = """CASE WHEN date_diff('day', acquired_date, {sold}) {than} CASE jurisdiction || '.' || asset_class
           WHEN 'IN.debt' THEN 1095 WHEN 'IN.elss' THEN 1095 ELSE 365 END THEN 'long' ELSE 'short' END"""


def _half_sales(b: Binding) -> DataFrame:
    methods = b.custody_accounts.select(F.col("id").alias("account_id"), "booking_method")
    return b.lots.groupBy("account_id", "commodity").agg(
        F.floor(F.sum("quantity") / 2).cast("decimal(18,8)").alias("quantity"),
        F.max_by("cost_price", "id").alias("price"), F.min("id").alias("id"),
    ).join(methods, "account_id")


@query("M6 W4 O2 X9 X11 J11", f"""
    WITH {_HALF}, priced AS (
        SELECT t.account_id, t.commodity, t.id AS lot_id, used AS quantity, acquired_date,
               ((price - cost_price) * used)::DECIMAL(28,4) AS gain_loss,
               {_TERM.format(sold="DATE '2001-11-15'", than='>')} AS term
        FROM taken t JOIN custody USING (account_id))
    SELECT p.*, gain_loss < 0 AND EXISTS (SELECT 1 FROM lots l WHERE l.account_id = p.account_id AND l.commodity = p.commodity
                AND l.acquired_date BETWEEN DATE '2001-10-16' AND DATE '2001-12-15' AND l.acquired_date <> DATE '2001-11-15') AS wash_sale
    FROM priced p""", quantity=_QTY, gain_loss="decimal(28,4)")
def booked_sales(b: Binding) -> DataFrame:
    """Half of every holding sold in its booking order (FIFO, LIFO or HIFO)."""
    sales = _half_sales(b).select(
        "id", "account_id", "commodity", "quantity", F.col("price").alias("proceeds_per_unit"), F.lit("USD").alias("proceeds_currency"),
        F.lit("2001-11-15").cast("date").alias("sell_date"), F.col("id").alias("sell_transaction_id"), "booking_method",
    )
    return lt.book_sales(b.lots, sales, b.accounts).select(
        "account_id", "commodity", "lot_id", "quantity", "acquired_date", "gain_loss", "term", "wash_sale"
    )


@query("M6", """
    SELECT min(id) AS demand_id, account_id, commodity, (sum(quantity) + 1)::DECIMAL(18,2) AS demand, sum(quantity)::DECIMAL(18,2) AS available
    FROM lots GROUP BY 2, 3""", demand=_QTY, available=_QTY)
def sale_shortfalls(b: Binding) -> DataFrame:
    """One unit more than held is demanded of every holding."""
    demands = b.lots.groupBy("account_id", "commodity").agg(
        F.min("id").alias("demand_id"), (F.sum("quantity") + 1).cast("decimal(18,8)").alias("demand")
    )
    return lt.shortfalls(b.lots, demands)


@query("J11", """
    SELECT DISTINCT s.account_id, s.commodity, s.sell_date FROM sales s
    WHERE EXISTS (SELECT 1 FROM lots l WHERE l.account_id = s.account_id AND l.commodity = s.commodity
                  AND l.acquired_date BETWEEN s.sell_date - 30 AND s.sell_date + 30 AND l.acquired_date <> s.sell_date)""")
def wash_sale_days(b: Binding) -> DataFrame:
    return lt.wash_sale_days(b.sales, b.lots)


@query("J11", """
    SELECT DISTINCT s.account_id, s.commodity, s.sell_date FROM sales s
    WHERE EXISTS (SELECT 1 FROM lots l WHERE l.account_id = s.account_id AND l.commodity = s.commodity
                  AND l.acquired_date BETWEEN s.sell_date - 30 AND s.sell_date - 1)""")
def recorded_wash_sale_days(b: Binding) -> DataFrame:
    return lt.wash_sale_days(b.sales, b.lots, "recorded")


# ---- preview ----

# Every holding asked for half of it, at its newest market price.
_PREVIEW = f"""{_HALF},
    newest AS (SELECT commodity, arg_max(price, date)::DECIMAL(18,2) AS sell_price FROM commodity_prices GROUP BY 1)"""


def _proposals(b: Binding) -> DataFrame:
    return _half_sales(b).select(
        F.col("id").alias("proposal_id"), "account_id", "commodity", "quantity", "booking_method",
        F.lit(None).cast("decimal(18,8)").alias("sell_price"), F.lit("2001-06-30").cast("date").alias("sell_date"),
    )


@query("M7 W4 J7 J16 F10 X9", f"""
    WITH {_PREVIEW}
    SELECT account_id, commodity, id AS lot_id, used AS quantity_from_lot, sell_price,
           (used * sell_price)::DECIMAL(28,4) AS proceeds, ((sell_price - cost_price) * used)::DECIMAL(28,4) AS gain_loss,
           {_TERM.format(sold="DATE '2001-06-30'", than='>=')} AS term,
           date_diff('day', acquired_date, DATE '2001-06-30')::INTEGER AS holding_days,
           coalesce(DATE '2001-06-30' < lock_until, FALSE) AS locked
    FROM taken JOIN newest USING (commodity) JOIN custody USING (account_id)""",
    quantity_from_lot=_QTY, sell_price=_QTY, proceeds="decimal(28,4)", gain_loss="decimal(28,4)")
def previewed_lots(b: Binding) -> DataFrame:
    return lt.preview_lots(_proposals(b), b.lots, b.accounts, b.prices).select(
        "account_id", "commodity", "lot_id", "quantity_from_lot", "sell_price", "proceeds", "gain_loss", "term", "holding_days", "locked"
    )


@query("M7", f"""
    WITH {_PREVIEW}
    SELECT account_id, commodity, demand AS quantity, coalesce(sum(used * sell_price), 0)::DECIMAL(28,4) AS total_proceeds,
           coalesce(sum((sell_price - cost_price) * used), 0)::DECIMAL(28,4) AS total_gain_loss, count(t.id)::BIGINT AS lot_count
    FROM half h LEFT JOIN (SELECT id, account_id, commodity, used, sell_price, cost_price FROM taken JOIN newest USING (commodity)) t
         USING (account_id, commodity) GROUP BY 1, 2, 3""",
    quantity=_QTY, total_proceeds="decimal(28,4)", total_gain_loss="decimal(28,4)")
def preview_totals(b: Binding) -> DataFrame:
    proposals = _proposals(b)
    return lt.preview_totals(proposals, lt.preview_lots(proposals, b.lots, b.accounts, b.prices)).select(
        "account_id", "commodity", "quantity", "total_proceeds", "total_gain_loss", "lot_count"
    )


@query("M7 F10", """
    WITH held AS (SELECT account_id, commodity, min(id) AS proposal_id, sum(quantity)::DECIMAL(18,2) AS held FROM lots GROUP BY 1, 2)
    SELECT proposal_id, NULL::BIGINT AS lot_id, 'Insufficient lots: requested ' || (held + 5)::VARCHAR || ', available ' || held::VARCHAR AS warning
    FROM held WHERE commodity <> 'Brand#3' UNION ALL
    SELECT proposal_id, NULL, 'No price found for Brand#3. Provide sell_price explicitly.' FROM held WHERE commodity = 'Brand#3' UNION ALL
    SELECT proposal_id, l.id, 'Lot ' || l.id || ' (acquired ' || acquired_date || ') is locked until ' || lock_until
    FROM held JOIN lots l USING (account_id, commodity) WHERE commodity <> 'Brand#3' AND DATE '2001-06-30' < lock_until""")
def preview_warnings(b: Binding) -> DataFrame:
    """Five units more than held are asked for; one commodity has no price."""
    methods = b.custody_accounts.select(F.col("id").alias("account_id"), "booking_method")
    asked = b.lots.groupBy("account_id", "commodity").agg(
        F.min("id").alias("proposal_id"), (F.sum("quantity") + 5).cast("decimal(18,2)").alias("quantity")
    ).join(methods, "account_id").select(
        "*", F.lit(None).cast("decimal(18,8)").alias("sell_price"), F.lit("2001-06-30").cast("date").alias("sell_date")
    )
    priced = b.prices.filter("commodity <> 'Brand#3'")
    return lt.preview_warnings(asked, lt.preview_lots(asked, b.lots, b.accounts, priced), b.accounts, priced)


# ---- corporate actions and transfers ----


def _actions(b: Binding, dated: bool) -> DataFrame:
    """Per brand a split by 2, and for large parts a bonus or a reverse split by 4."""
    brands = b.table("part").groupBy(F.col("p_brand").alias("commodity")).agg(F.max("p_size").alias("size"), F.min("p_partkey").alias("key"))
    second = F.when(F.col("key") % 2 == 0, "bonus").otherwise("reverse_split")
    rows = brands.select("commodity", F.explode(F.array(
        F.struct((F.col("key") * 2).alias("action_id"), F.lit("split").alias("action_type"), F.lit(2).alias("ratio"), F.lit("1998-07-01").alias("on")),
        F.struct((F.col("key") * 2 + 1).alias("action_id"), second.alias("action_type"), F.lit(4).alias("ratio"), F.lit("2000-01-01").alias("on")),
    )).alias("a")).select("commodity", "a.action_id", "a.action_type", "a.ratio", F.col("a.on").cast("date").alias("effective_date"))
    return rows if dated else rows.drop("effective_date")


_FACTORS = """
    brands AS (SELECT p_brand AS commodity, min(p_partkey) AS key FROM part GROUP BY 1),
    factors AS (SELECT commodity, 2.0 AS first, CASE WHEN key % 2 = 0 THEN 4.0 ELSE 0.25 END AS second FROM brands)"""


@query("M8", f"""
    WITH {_FACTORS}
    SELECT id, commodity, (quantity * first * second)::DECIMAL(18,4) AS quantity,
           (cost_price / (first * second))::DECIMAL(18,6) AS cost_price FROM lots JOIN factors USING (commodity)""",
    quantity="decimal(18,4)", cost_price="decimal(18,6)")
def corporate_actions(b: Binding) -> DataFrame:
    """Undated actions: every open lot, all actions composed."""
    return lt.apply_corporate_actions(b.lots, _actions(b, False)).select("id", "commodity", "quantity", "cost_price")


@query("M8", f"""
    WITH {_FACTORS}
    SELECT id, commodity, acquired_date,
           (quantity * CASE WHEN acquired_date < DATE '1998-07-01' THEN first ELSE 1 END
                     * CASE WHEN acquired_date < DATE '2000-01-01' THEN second ELSE 1 END)::DECIMAL(18,4) AS quantity
    FROM lots JOIN factors USING (commodity)""", quantity="decimal(18,4)")
def dated_corporate_actions(b: Binding) -> DataFrame:
    return lt.apply_corporate_actions(b.lots, _actions(b, True)).select("id", "commodity", "acquired_date", "quantity")


@query("M8", "SELECT commodity, count(*)::BIGINT AS affected_lots FROM lots GROUP BY 1")
def affected_lots(b: Binding) -> DataFrame:
    return lt.affected_lot_counts(b.lots, _actions(b, False))


@query("M9 W4", f"""
    WITH {_HALF}, moves AS (SELECT l.*, t.used, (account_id - 2) / 10 AS nation FROM lots l LEFT JOIN
         (SELECT id, used FROM taken) t USING (id))
    SELECT CASE WHEN used = quantity THEN account_id + 1000 ELSE account_id END AS account_id, commodity, acquired_date, cost_price,
           CASE WHEN used IS NULL OR used = quantity THEN quantity ELSE quantity - used END::DECIMAL(18,2) AS quantity,
           CASE WHEN used IS NULL OR used = quantity THEN quantity ELSE quantity - used END::DECIMAL(18,2) AS original_quantity,
           id::VARCHAR AS lot FROM moves UNION ALL
    SELECT account_id + 1000, commodity, acquired_date, cost_price, used, used, 'new' FROM moves WHERE used < quantity""",
    quantity=_QTY, original_quantity=_QTY, cost_price=_QTY)
def transferred_lots(b: Binding) -> DataFrame:
    """Half of every holding moved to another account in its booking order."""
    transfers = _half_sales(b).select(
        F.col("id").alias("transfer_id"), F.col("account_id").alias("from_account_id"),
        (F.col("account_id") + 1000).alias("to_account_id"), "commodity", "quantity", "booking_method",
    )
    return lt.transfer_lots(b.lots, transfers).select(
        "account_id", "commodity", "acquired_date", "cost_price", "quantity", "original_quantity",
        F.when(F.col("id") < 0, "new").otherwise(F.col("id").cast("string")).alias("lot"),
    )


# ---- history ----


@query("J18 M6 X9 X11", """
    SELECT account_id, commodity, lot_id, sale_id, quantity::DECIMAL(18,2) AS quantity, gain_loss::DECIMAL(28,4) AS gain_loss, term FROM dispositions""",
    quantity=_QTY, gain_loss="decimal(28,4)")
def fifo_history(b: Binding) -> DataFrame:
    return lot_history.dispose_history(b.lots, b.sales, b.fifo_accounts).select("account_id", "commodity", "lot_id", "sale_id", "quantity", "gain_loss", "term")


# One step books one event, or takes from one lot what a sale still wants; the first lot of ``open`` is sold next.
_BOOKED = """
    WITH RECURSIVE steps AS (
        SELECT e.*, w.refused, t.date, CASE booking_method WHEN 'HIFO' THEN -t.price ELSE
               date_diff('day', DATE '1990-01-01', t.date) * CASE booking_method WHEN 'LIFO' THEN -1 ELSE 1 END END::DECIMAL(18,2) AS k1,
               CASE booking_method WHEN 'LIFO' THEN -e.id ELSE e.id END AS k2
        FROM holding_events e JOIN walk w USING (account_id, commodity, n) JOIN custody USING (account_id) JOIN trades t ON t.id = e.id),
    booked AS (
        SELECT account_id, commodity, 0::BIGINT AS n, NULL::BIGINT AS sale_id, 0::DECIMAL(18,2) AS rest,
               []::STRUCT(k1 DECIMAL(18,2), k2 BIGINT, id BIGINT, here DECIMAL(18,2))[] AS open, NULL::BIGINT AS lot_id, 0::DECIMAL(18,2) AS used
        FROM (SELECT DISTINCT account_id, commodity FROM steps)
        UNION ALL
        SELECT b.account_id, b.commodity, CASE WHEN rest > 0 THEN b.n ELSE e.n END, CASE WHEN rest > 0 THEN b.sale_id ELSE e.id END,
               CASE WHEN rest > 0 THEN rest - least(rest, open[1].here) WHEN sale AND NOT refused THEN quantity ELSE 0 END::DECIMAL(18,2),
               CASE WHEN rest > 0 AND open[1].here <= rest THEN open[2:]
                    WHEN rest > 0 THEN list_prepend({'k1': open[1].k1, 'k2': open[1].k2, 'id': open[1].id, 'here': (open[1].here - rest)::DECIMAL(18,2)}, open[2:])
                    WHEN NOT sale THEN list_sort(list_append(open, {'k1': e.k1, 'k2': e.k2, 'id': e.id, 'here': quantity})) ELSE open END,
               CASE WHEN rest > 0 THEN open[1].id END, CASE WHEN rest > 0 THEN least(rest, open[1].here) ELSE 0 END::DECIMAL(18,2)
        FROM booked b LEFT JOIN steps e ON e.account_id = b.account_id AND e.commodity = b.commodity AND e.n = b.n + 1 AND rest = 0
        WHERE rest > 0 OR e.n IS NOT NULL)"""


@query("J18 M6 X9", f"""{_BOOKED}
    SELECT b.account_id, b.commodity, lot_id, sale_id, used AS quantity, ((s.price - l.price) * used)::DECIMAL(28,4) AS gain_loss,
           CASE WHEN date_diff('day', l.date, s.date)
                     > CASE jurisdiction || '.' || asset_class WHEN 'IN.debt' THEN 1095 WHEN 'IN.elss' THEN 1095 ELSE 365 END
                THEN 'long' ELSE 'short' END AS term,
           s.price < l.price AND EXISTS (SELECT 1 FROM lots p WHERE p.account_id = b.account_id AND p.commodity = b.commodity
               AND p.acquired_date BETWEEN s.date - 30 AND s.date - 1) AS wash_sale
    FROM booked b JOIN trades l ON l.id = lot_id JOIN trades s ON s.id = sale_id JOIN custody c ON c.account_id = b.account_id
    WHERE used > 0""", quantity=_QTY, gain_loss="decimal(28,4)")
def booked_history(b: Binding) -> DataFrame:
    """Each account by its own booking method, with sales beyond the holding."""
    return lot_history.dispose_history(b.lots, b.sales, b.accounts).select(
        "account_id", "commodity", "lot_id", "sale_id", "quantity", "gain_loss", "term", "wash_sale"
    )


@query("M6", "SELECT id AS sale_id FROM walk WHERE refused")
def refused_sales(b: Binding) -> DataFrame:
    return lot_history.refused_sales(b.lots, b.sales)


@query("M6", """
    SELECT id AS sale_id, CASE WHEN ((account_id - 2) // 10) % 5 >= 3 THEN 'unknown_method' ELSE 'insufficient_lots' END AS rule
    FROM walk WHERE id IN (SELECT id FROM sales) AND (refused OR ((account_id - 2) // 10) % 5 >= 3)""")
def unbooked_sales(b: Binding) -> DataFrame:
    """Two nations in five book by methods that nobody knows: every sale of theirs comes back, and all refused ones."""
    nation = ((F.col("id") - 2) / 10).cast("long") % 5
    method = F.when(nation == 3, F.lit(None).cast("string")).when(nation == 4, F.lit("average")).otherwise(F.col("booking_method"))
    return lot_history.unbooked_sales(b.lots, b.sales, b.accounts.withColumn("booking_method", method))


@query("M6", """
    WITH asked AS (SELECT account_id, commodity, min(id) AS first, floor(sum(quantity) / 2) AS half FROM lots GROUP BY 1, 2)
    SELECT first * 2 + 1 AS demand_id, 'second_demand' AS rule FROM asked""")
def rejected_second_sales(b: Binding) -> DataFrame:
    """Two sales of half of every holding at once: the first is met, the second comes back."""
    half = b.lots.groupBy("account_id", "commodity").agg(F.min("id").alias("first"), F.floor(F.sum("quantity") / 2).alias("half"))
    methods = b.custody_accounts.select(F.col("id").alias("account_id"), "booking_method")
    demands = half.join(methods, "account_id").select(
        "account_id", "commodity", F.col("half").cast("decimal(18,8)").alias("demand"), "booking_method",
        F.explode(F.array(F.col("first") * 2, F.col("first") * 2 + 1)).alias("demand_id"),
    )
    return lt.rejected(b.lots, demands).select("demand_id", "rule")


def _fine(lots: DataFrame) -> DataFrame:
    """Lots with quantities of eight decimals."""
    return lots.withColumns({c: F.col(c).cast("decimal(18,8)") for c in ("quantity", "original_quantity")})


@query("M8", """
    SELECT id, commodity, round(quantity::DECIMAL(18,8) * 1.23456789::DECIMAL(18,8), 8)::DECIMAL(18,8) AS quantity FROM lots""")
def finely_scaled_lots(b: Binding) -> DataFrame:
    """Splits of a ratio with eight decimals."""
    actions = b.lots.groupBy("commodity").agg(F.min("id").alias("action_id")).select(
        "action_id", "commodity", F.lit("split").alias("action_type"), F.lit("1.23456789").cast("decimal(18,8)").alias("ratio")
    )
    return lt.apply_corporate_actions(_fine(b.lots), actions).select("id", "commodity", "quantity")


@query("M8", """
    SELECT id, commodity, (((quantity * 200000000)::HUGEINT // 3 + 1) // 2)::BIGINT AS hundred_millionths FROM lots""")
def reverse_split_by_three(b: Binding) -> DataFrame:
    """Thirds are rounded at the eighth decimal."""
    actions = b.lots.groupBy("commodity").agg(F.min("id").alias("action_id")).select(
        "action_id", "commodity", F.lit("reverse_split").alias("action_type"), F.lit(3).alias("ratio")
    )
    quantity = F.col("quantity") * 100000000
    return lt.apply_corporate_actions(_fine(b.lots), actions).select("id", "commodity", quantity.cast("long").alias("hundred_millionths"))


@query("M10 F6", """
    SELECT l.id, l.account_id, l.commodity, (l.quantity - coalesce(gone, 0))::DECIMAL(18,2) AS quantity
    FROM lots l LEFT JOIN (SELECT lot_id, sum(quantity) AS gone FROM fifo GROUP BY 1) f ON f.lot_id = l.id
    WHERE l.quantity > coalesce(gone, 0)""", quantity=_QTY)
def open_lots(b: Binding) -> DataFrame:
    """Lot state replayed from dispositions, what can still be sold."""
    ledger = b.custody_ledger
    return lt.open_lots(lt.replay_lots(ledger.lots, ledger.lot_dispositions)).select("id", "account_id", "commodity", "quantity")


@query("F6", "SELECT id, quantity, acquired_date FROM lots WHERE account_id = 32 AND commodity = 'Brand#5'", quantity=_QTY)
def lots_of_holding(b: Binding) -> DataFrame:
    return lt.lots_of(b.lots, 32, "Brand#5", include_disposed=True).select("id", "quantity", "acquired_date")


@query("F7", """
    SELECT lot_id, sale_id AS sell_transaction_id, quantity::DECIMAL(18,2) AS quantity FROM fifo
    WHERE sale_id = (SELECT max(sale_id) FROM fifo)""", quantity=_QTY)
def dispositions_of_sale(b: Binding) -> DataFrame:
    held = b.custody_ledger.lot_dispositions
    newest = held.agg(F.max("sell_transaction_id")).first()[0]
    return lt.dispositions_of(held, sell_transaction_id=newest).select("lot_id", "sell_transaction_id", "quantity")


_REMAINING = """
    remaining AS (SELECT l.*, l.quantity - coalesce(gone, 0) AS kept
                  FROM lots l LEFT JOIN (SELECT lot_id, sum(quantity) AS gone FROM fifo GROUP BY 1) f ON f.lot_id = l.id),
    newest AS (SELECT commodity, arg_max(price, date) AS latest_price, max(date) AS latest_price_date FROM commodity_prices GROUP BY 1),
    holdings AS (SELECT account_id, commodity, sum(kept) AS quantity, sum(kept * cost_price) AS cost, latest_price, latest_price_date
                 FROM remaining JOIN newest USING (commodity) WHERE kept > 0 GROUP BY 1, 2, latest_price, latest_price_date)"""


def _holdings(b: Binding) -> tuple[Ledger, DataFrame]:
    ledger = b.custody_ledger
    return ledger, summaries.registry.rebuild_all(ledger)["s_portfolio_holdings"]


@query("A9 J7 M14 M10 E1", f"""
    WITH {_REMAINING}
    SELECT account_id, commodity, 'USD' AS cost_currency, quantity::DECIMAL(18,2) AS total_quantity, cost::DECIMAL(28,4) AS total_cost_basis,
           latest_price::DECIMAL(18,2) AS latest_price, latest_price_date, (quantity * latest_price::DECIMAL(18,2))::DECIMAL(28,4) AS market_value,
           (quantity * latest_price::DECIMAL(18,2) - cost)::DECIMAL(28,4) AS unrealized_gain, asset_class
    FROM holdings JOIN custody USING (account_id)""",
    total_quantity=_QTY, total_cost_basis="decimal(28,4)", latest_price=_QTY, market_value="decimal(28,4)", unrealized_gain="decimal(28,4)")
def portfolio_holdings(b: Binding) -> DataFrame:
    """Rebuilt after lots were replayed, so sales are reflected."""
    return _holdings(b)[1]


@query("A15 O4", f"""
    WITH {_REMAINING}
    SELECT name AS account, commodity, quantity::DECIMAL(18,2) AS total_quantity, cost::DECIMAL(28,4) AS total_cost_basis
    FROM holdings h JOIN accounts a ON a.id = h.account_id""", total_quantity=_QTY, total_cost_basis="decimal(28,4)")
def holdings_report(b: Binding) -> DataFrame:
    ledger, holdings = _holdings(b)
    report = reports.portfolio_report(holdings, summaries.net_worth(b.ledger), ledger.accounts, "USD")
    return report["holdings"].select("account", "commodity", "total_quantity", "total_cost_basis")


@query("A14 W8", f"""
    WITH {_REMAINING}, classes AS (
        SELECT coalesce(asset_class, 'Unclassified') AS asset_class, sum(quantity * latest_price::DECIMAL(18,2))::DECIMAL(28,4) AS value
        FROM holdings JOIN custody USING (account_id) GROUP BY 1)
    SELECT asset_class, value, round_even(value::DOUBLE / sum(value::DOUBLE) OVER () * 100, 2)::DECIMAL(18,2) AS percentage FROM classes""",
    value="decimal(28,4)")
def asset_allocation(b: Binding) -> DataFrame:
    return reports.asset_allocation(_holdings(b)[1])


@query("T1 M14 A9", f"""
    WITH {_REMAINING}
    SELECT account_id, commodity, quantity::DECIMAL(18,2) AS total_quantity, cost::DECIMAL(28,4) AS total_cost_basis,
           (quantity * latest_price::DECIMAL(18,2))::DECIMAL(28,4) AS market_value FROM holdings""",
    total_quantity=_QTY, total_cost_basis="decimal(28,4)", market_value="decimal(28,4)")
def refreshed_holdings(b: Binding) -> DataFrame:
    """From holdings before any sale, refreshed for the accounts that sold."""
    ledger = b.custody_ledger
    after = ledger.with_tables(lots=lt.replay_lots(ledger.lots, ledger.lot_dispositions))
    sellers = summaries.Affected(b.sales.select("account_id").distinct(), b.sales.select("commodity").limit(0))
    before = summaries.portfolio_holdings(ledger)
    return summaries.refresh_portfolio_holdings(before, after, sellers).select(
        "account_id", "commodity", "total_quantity", "total_cost_basis", "market_value"
    )


# ---- gains ----

_YEARLY = """
    SELECT year(sell_date)::INTEGER AS year, term, 'USD' AS currency, sum(proceeds * quantity)::DECIMAL(28,4) AS total_proceeds,
           sum(cost_price * quantity)::DECIMAL(28,4) AS total_cost_basis, sum(gain_loss)::DECIMAL(28,4) AS total_gain_loss,
           count(*)::BIGINT AS disposition_count
    FROM dispositions GROUP BY 1, 2"""
_SUMS = dict.fromkeys(["total_proceeds", "total_cost_basis", "total_gain_loss"], "decimal(28,4)")


@query("A12 X7", _YEARLY, year="int", **_SUMS)
def yearly_capital_gains(b: Binding) -> DataFrame:
    return summaries.yearly_capital_gains(b.custody_ledger)


@query("T1 A12", _YEARLY, year="int", **_SUMS)
def refreshed_capital_gains(b: Binding) -> DataFrame:
    """The sales of 2000 arrive late."""
    ledger = b.custody_ledger
    late = b.trade_transactions.filter(F.year("date") == 2000)
    ids = late.select(F.col("id").alias("sell_transaction_id"))
    before = ledger.with_tables(lot_dispositions=ledger.lot_dispositions.join(ids, "sell_transaction_id", "left_anti"))
    late_postings = b.trade_postings.join(late.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
    affected = summaries.affected_by(late, late_postings)
    return summaries.refresh_yearly_capital_gains(summaries.yearly_capital_gains(before), ledger, affected)


_DETAIL = """
    SELECT lot_id, sale_id AS sell_transaction_id, a.name AS account, d.commodity, d.quantity::DECIMAL(18,2) AS quantity,
           d.acquired_date, d.sell_date, d.gain_loss::DECIMAL(28,4) AS gain_loss, d.term, d.jurisdiction,
           d.gain_loss < 0 AND EXISTS (SELECT 1 FROM lots l WHERE l.account_id = d.account_id AND l.commodity = d.commodity
               AND l.acquired_date BETWEEN d.sell_date - 30 AND d.sell_date - 1) AS wash_sale
    FROM dispositions d JOIN accounts a ON a.id = d.account_id WHERE year(d.sell_date) = 1999"""


def _detail(b: Binding, part: str) -> DataFrame:
    ledger = b.custody_ledger
    ids = ledger.lot_dispositions.select(F.col("id").alias("disposition_id"), "sell_transaction_id")
    report = reports.capital_gains_report(ledger, summaries.yearly_capital_gains(ledger), 1999, "USD")
    return report[part].join(ids, "disposition_id").select(
        "lot_id", "sell_transaction_id", "account", "commodity", "quantity", "acquired_date", "sell_date", "gain_loss", "term",
        "jurisdiction", "wash_sale",
    )


@query("A13 J2 O4", _DETAIL, quantity=_QTY, gain_loss="decimal(28,4)")
def capital_gains_detail(b: Binding) -> DataFrame:
    return _detail(b, "detail")


@query("A13 J11", f"SELECT * FROM ({_DETAIL}) WHERE wash_sale", quantity=_QTY, gain_loss="decimal(28,4)")
def wash_sales(b: Binding) -> DataFrame:
    return _detail(b, "wash_sales")


@query("A13", """
    SELECT jurisdiction, term, 'USD' AS currency, sum(gain_loss)::DECIMAL(28,4) AS total_gain_loss, count(*)::BIGINT AS disposition_count
    FROM dispositions GROUP BY 1, 2""", total_gain_loss="decimal(28,4)")
def gains_by_jurisdiction(b: Binding) -> DataFrame:
    return reports.gains_by_jurisdiction(reports.capital_gains_detail(b.custody_ledger))


# ---- changes to holdings with transfers on record ----


def _replay(day: str, kept: str, final: str) -> str:
    """Trades (their day, and which are kept) and transfers replayed one by one, a pair of accounts and a
    commodity at a time. A step books one event or takes from one lot; ``open`` has the lots of both accounts."""
    own = "list_filter(open, lambda x: x.acct = who)"
    first = """list_aggregate(list_transform({own}, lambda x: {{'k1': CASE how WHEN 'HIFO' THEN -x.cost WHEN 'LIFO' THEN -x.day ELSE x.day END,
                   'k2': CASE how WHEN 'LIFO' THEN -x.id ELSE x.id END, 'id': x.id, 'here': x.here, 'day': x.day, 'cost': x.cost}}), 'min')""".format(own=own)
    lot = "STRUCT(id BIGINT, acct BIGINT, day DECIMAL(18,2), cost DECIMAL(18,2), here DECIMAL(18,2))"
    return f"""
    WITH RECURSIVE moves AS (
        SELECT (((account_id - 2) // 10) * 100 + split_part(commodity, '#', 2)::BIGINT) * 10 + ((account_id - 2) // 10) % 2 AS id, account_id,
               CASE ((account_id - 2) // 10) % 2 WHEN 0 THEN account_id + 10 ELSE account_id - 10 END AS to_id, commodity,
               floor(sum(quantity) / 4)::DECIMAL(18,2) AS quantity,
               CASE ((account_id - 2) // 10) % 2 WHEN 0 THEN DATE '1998-01-01' ELSE DATE '1999-06-01' END AS date
        FROM lots WHERE acquired_date < DATE '1998-01-01' AND account_id < 240 GROUP BY account_id, commodity HAVING sum(quantity) >= 4),
    happened AS (
        SELECT id, account_id, 0::BIGINT AS to_id, commodity, quantity, price, {day} AS date, CASE WHEN sale THEN 2 ELSE 0 END AS kind FROM trades WHERE {kept} UNION ALL
        SELECT id, account_id, to_id, commodity, quantity, 0, date, 1 FROM moves),
    steps AS (
        SELECT h.*, booking_method, ((account_id - 2) // 20) AS pair, date_diff('day', DATE '1990-01-01', date)::DECIMAL(18,2) AS day,
               row_number() OVER (PARTITION BY (account_id - 2) // 20, commodity ORDER BY date, kind, id) AS n
        FROM happened h JOIN custody USING (account_id)),
    held AS (
        SELECT pair, commodity, 0::BIGINT AS n, 0::INTEGER AS kind, 0::BIGINT AS event, 0::BIGINT AS who, 0::BIGINT AS to_id, '' AS how, 0::DECIMAL(18,2) AS rest,
               []::{lot}[] AS open, NULL::BIGINT AS lot_id, 0::DECIMAL(18,2) AS day, 0::DECIMAL(18,2) AS cost, 0::DECIMAL(18,2) AS used
        FROM (SELECT DISTINCT pair, commodity FROM steps)
        UNION ALL
        SELECT pair, commodity, n, kind, event, who, to_id, how, (rest - used)::DECIMAL(18,2),
               CASE WHEN used = 0 THEN open
                    WHEN kind = 2 THEN list_filter(list_transform(open, lambda x: {{'id': x.id, 'acct': x.acct, 'day': x.day, 'cost': x.cost,
                         'here': (x.here - CASE WHEN x.id = lot_id THEN used ELSE 0 END)::DECIMAL(18,2)}}), lambda x: x.here > 0)
                    WHEN used = here THEN list_transform(open, lambda x: {{'id': x.id, 'acct': CASE WHEN x.id = lot_id THEN to_id ELSE x.acct END,
                         'day': x.day, 'cost': x.cost, 'here': x.here}})
                    ELSE list_append(list_transform(open, lambda x: {{'id': x.id, 'acct': x.acct, 'day': x.day, 'cost': x.cost,
                         'here': (x.here - CASE WHEN x.id = lot_id THEN used ELSE 0 END)::DECIMAL(18,2)}}),
                         {{'id': -('0x' || substr(sha256(lot_id || ':' || event), 1, 15))::BIGINT, 'acct': to_id, 'day': day, 'cost': cost, 'here': used}}) END,
               lot_id, day, cost, used
        FROM (
            SELECT pair, commodity, n, kind, event, who, to_id, how, rest, open, f.id AS lot_id, f.day AS day, f.cost AS cost, f.here AS here,
                   CASE WHEN rest > 0 THEN least(rest, f.here) ELSE 0 END::DECIMAL(18,2) AS used
            FROM (
                SELECT pair, commodity, n, kind, event, who, to_id, how, open, CASE WHEN rest > 0 THEN {first} END AS f,
                       CASE WHEN rest > 0 AND fresh AND coalesce(list_sum(list_transform({own}, lambda x: x.here)), 0) < rest THEN 0 ELSE rest END::DECIMAL(18,2) AS rest
                FROM (
                    SELECT h.pair, h.commodity, CASE WHEN h.rest > 0 THEN h.n ELSE e.n END AS n, CASE WHEN h.rest > 0 THEN h.kind ELSE e.kind END AS kind,
                           CASE WHEN h.rest > 0 THEN h.event ELSE e.id END AS event, CASE WHEN h.rest > 0 THEN h.who ELSE e.account_id END AS who,
                           CASE WHEN h.rest > 0 THEN h.to_id ELSE e.to_id END AS to_id, CASE WHEN h.rest > 0 THEN h.how ELSE e.booking_method END AS how,
                           h.rest = 0 AS fresh, CASE WHEN h.rest > 0 THEN h.rest WHEN e.kind = 0 THEN 0 ELSE e.quantity END::DECIMAL(18,2) AS rest,
                           CASE WHEN h.rest = 0 AND e.kind = 0 THEN list_append(h.open, {{'id': e.id, 'acct': e.account_id, 'day': e.day,
                                'cost': e.price::DECIMAL(18,2), 'here': e.quantity::DECIMAL(18,2)}}) ELSE h.open END AS open
                    FROM held h LEFT JOIN steps e ON e.pair = h.pair AND e.commodity = h.commodity AND e.n = h.n + 1 AND h.rest = 0
                    WHERE h.rest > 0 OR e.n IS NOT NULL))))
    {final}"""


def _traded(b: Binding) -> Ledger:
    """Trades by month of their file, with transfers between each even nation's account and
    the next one's on record: a quarter of what the one bought before 1998 goes over in
    1998, and likewise back in 1999."""
    nation = F.floor((F.col("account_id") - 2) / 10).cast("long")
    even = nation % 2 == 0
    bought = b.lots.filter((F.col("acquired_date") < F.lit("1998-01-01").cast("date")) & (F.col("account_id") < 240))
    moves = bought.groupBy("account_id", "commodity").agg(F.floor(F.sum("quantity") / 4).cast("decimal(18,8)").alias("quantity")).filter("quantity >= 1").select(
        ((nation * 100 + F.split_part(F.col("commodity"), F.lit("#"), F.lit(2)).cast("long")) * 10 + nation % 2).alias("transfer_id"),
        F.col("account_id").alias("from_account_id"), F.when(even, F.col("account_id") + 10).otherwise(F.col("account_id") - 10).alias("to_account_id"),
        "commodity", "quantity", F.lit(None).cast("string").alias("booking_method"),
        F.when(even, "1998-01-01").otherwise("1999-06-01").cast("date").alias("date"),
    )
    named = b.trade_transactions.select(
        "id", F.md5(F.col("id").cast("string")).alias("uuid"), "date", (F.year("date") * 100 + F.month("date")).cast("long").alias("source_file_id")
    )
    typed = {"transactions": named, "postings": b.trade_postings, "transfers": moves}
    return b.books.with_tables(**{n: changes._as(t, b.empty_table(n)) for n, t in typed.items()})


@query("M4 M9 M10", _replay("CASE WHEN id % 3 = 0 THEN date + 1 ELSE date END", "id % 7 <> 0", """
    , last AS (SELECT pair, commodity, arg_max(open, n * 1000000 - rest) AS open FROM held GROUP BY 1, 2)
    SELECT o.acct AS account_id, commodity, DATE '1990-01-01' + o.day::INTEGER AS acquired_date, o.cost AS cost_price, sum(o.here)::DECIMAL(18,2) AS quantity
    FROM (SELECT commodity, unnest(open) AS o FROM last) GROUP BY 1, 2, 3, 4"""), cost_price=_QTY, quantity=_QTY)
def amended_after_transfer(b: Binding) -> DataFrame:
    """All trades amended, a third moved by a day and a seventh deleted, with transfers on record; what is held after."""
    start = _traded(b)
    updates = start.transactions.select(
        "uuid", (F.col("id") % 7 == 0).alias("delete"), F.when(F.col("id") % 3 == 0, F.date_add("date", 1)).alias("date")
    )
    after = changes.amend_transactions(start, updates).ledger
    return after.lots.filter("quantity > 0").groupBy("account_id", "commodity", "acquired_date", "cost_price").agg(F.sum("quantity").alias("quantity"))


@query("M11 M9", _replay("date", "year(date) <> 1997", """
    SELECT event AS sell_transaction_id, DATE '1990-01-01' + day::INTEGER AS acquired_date, cost AS cost_price, sum(used)::DECIMAL(18,2) AS quantity
    FROM held WHERE kind = 2 AND used > 0 AND (who, commodity) IN (SELECT (account_id, commodity) FROM trades WHERE year(date) = 1997) GROUP BY 1, 2, 3"""),
    cost_price=_QTY, quantity=_QTY)
def undone_with_lots(b: Binding) -> DataFrame:
    """The files of 1997 undone with transfers on record; what the holdings they touch sold of which lots."""
    start = _traded(b)
    months = start.transactions.select("source_file_id").distinct().filter(F.col("source_file_id").between(199701, 199712))
    after = changes.undo_imports(start, months).ledger
    lots = after.lots.select(F.col("id").alias("lot_id"), "acquired_date", "cost_price")
    touched = b.trades.filter(F.year("date") == 1997).select("account_id", "commodity").distinct()
    sold = b.trades.join(touched, ["account_id", "commodity"], "left_semi").select(F.col("id").alias("sell_transaction_id"))
    return after.lot_dispositions.join(lots, "lot_id").join(sold, "sell_transaction_id", "left_semi").groupBy("sell_transaction_id", "acquired_date", "cost_price").agg(F.sum("quantity").alias("quantity"))
