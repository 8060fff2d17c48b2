"""The binding as SQL: each oracle text reads the same derived ledger tables."""

from __future__ import annotations

import re

from tallybook.catalog.binding import FX
from tallybook.schemas import SEED_TOLERANCES

_FX_ROWS = ", ".join(f"('{c}', '{q}', DATE '{d}', {p})" for c, q, d, p in FX)
_TOLERANCE_ROWS = ", ".join(f"('{c}', {t})" for c, t in SEED_TOLERANCES.items())

_EXPENSE_ID = "('0x' || substr(md5(p_type), 1, 8))::BIGINT * 10 + 3"

CTES: dict[str, str] = {
    "nations": """
        SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' WHEN 2 THEN 'EUR'
               WHEN 3 THEN 'GBP' WHEN 4 THEN 'BTC' END AS currency FROM nation""",
    "accounts": f"""
        SELECT c_custkey * 10 + 1 AS id,
               CASE WHEN c_acctbal < 0 THEN 'Liabilities' ELSE 'Assets' END || ':' || n_name || ':' || c_name AS name,
               CASE WHEN c_acctbal < 0 THEN 'Liabilities' ELSE 'Assets' END AS type, currency,
               NULL::VARCHAR AS booking_method, c_mktsegment AS institution,
               CASE WHEN currency = 'BTC' THEN 'crypto' WHEN c_mktsegment = 'BUILDING' THEN 'cash'
                    WHEN c_mktsegment = 'FURNITURE' THEN 'equity' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'debt'
                    WHEN c_mktsegment = 'MACHINERY' THEN 'real_estate' END AS asset_class,
               NULL::VARCHAR AS jurisdiction,
               CASE WHEN c_acctbal < -900 THEN DATE '2000-01-01' END AS closed_at
        FROM customer JOIN nations ON c_nationkey = n_nationkey
        UNION ALL
        SELECT n_nationkey::BIGINT * 10 + 2, 'Assets:Custody:' || n_name, 'Assets', 'USD',
               CASE n_nationkey % 3 WHEN 0 THEN 'FIFO' WHEN 1 THEN 'LIFO' ELSE 'HIFO' END, NULL,
               CASE n_nationkey % 5 WHEN 0 THEN 'equity' WHEN 1 THEN 'debt' WHEN 2 THEN 'elss' WHEN 3 THEN 'crypto' END,
               CASE WHEN n_nationkey % 2 = 0 THEN 'US' ELSE 'IN' END, NULL
        FROM nations
        UNION ALL
        SELECT DISTINCT {_EXPENSE_ID}, 'Expenses:' || p_type, 'Expenses', 'USD', NULL, NULL, NULL, NULL, NULL::DATE
        FROM part""",
    "transactions": """
        SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR) AS uuid, o_orderdate::DATE AS date, c_name AS payee,
               o_orderpriority AS narration,
               CASE o_orderstatus WHEN 'F' THEN 'cleared' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'reconciled' END AS status,
               (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS source_file_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "order_sums": """
        SELECT l_orderkey AS o_orderkey, p_type,
               sum((l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,2))::DECIMAL(18,2) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "order_currencies": """
        SELECT o_orderkey, o_custkey, o_totalprice, currency
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = n_nationkey""",
    "expense_legs": f"""
        SELECT o_orderkey * 100 + row_number() OVER (PARTITION BY o_orderkey ORDER BY p_type) AS id,
               o_orderkey AS transaction_id, {_EXPENSE_ID} AS account_id, amount, currency
        FROM order_sums JOIN order_currencies USING (o_orderkey)""",
    "spent": "SELECT o_orderkey, sum(amount) AS spent FROM order_sums GROUP BY 1",
    "postings": """
        SELECT * FROM expense_legs UNION ALL
        SELECT o_orderkey * 100, o_orderkey, o_custkey * 10 + 1, (-spent)::DECIMAL(18,2), currency
        FROM spent JOIN order_currencies USING (o_orderkey)""",
    "quoted_postings": """
        SELECT * FROM expense_legs UNION ALL
        SELECT o_orderkey * 100, o_orderkey, o_custkey * 10 + 1, -(o_totalprice::DECIMAL(18,2)), currency
        FROM spent JOIN order_currencies USING (o_orderkey)""",
    "dated": "SELECT p.*, t.date FROM postings p JOIN transactions t ON t.id = p.transaction_id",
    "transaction_tags": """
        SELECT o_orderkey AS transaction_id, o_orderpriority AS tag FROM orders UNION ALL
        SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""",
    "commodity_prices": """
        SELECT p_brand AS commodity, 'USD' AS currency, l_shipdate::DATE AS date,
               max(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,8) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "fx": f"SELECT commodity, currency, date, price::DECIMAL(18,8) AS price FROM (VALUES {_FX_ROWS}) v(commodity, currency, date, price)",
    "prices": """
        SELECT commodity, currency, date, price, 'market' AS source FROM commodity_prices UNION ALL
        SELECT commodity, currency, date, price, 'forex' FROM fx""",
    "trades": """
        SELECT ((l_orderkey * 100 + split_part(p_brand, '#', 2)::BIGINT) * 10000
                + date_diff('day', DATE '1995-01-01', date)) * 2 + sale::INT AS id,
               c_nationkey::BIGINT * 10 + 2 AS account_id, p_brand AS commodity, date, sale, quantity, price
        FROM (SELECT c_nationkey, p_brand, l_shipdate::DATE AS date, l_orderkey, l_returnflag = 'R' AS sale,
                     sum(l_quantity::DECIMAL(18,2))::DECIMAL(18,2) AS quantity,
                     max(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS price
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5)""",
    "custody": "SELECT id AS account_id, booking_method, jurisdiction, asset_class FROM accounts WHERE booking_method IS NOT NULL",
    "lots": """
        SELECT id, account_id, commodity, quantity, price AS cost_price, date AS acquired_date,
               CASE WHEN month(date) <= 3 THEN date + 200 END AS lock_until
        FROM trades WHERE NOT sale""",
    "sales": """
        SELECT id, account_id, commodity, quantity, price AS proceeds, date AS sell_date, booking_method
        FROM trades JOIN custody USING (account_id) WHERE sale""",
    "tolerances": f"SELECT * FROM (VALUES {_TOLERANCE_ROWS}) v(currency, tolerance)",
    "budgets": f"""
        SELECT {_EXPENSE_ID} AS account_id, year_month, 'USD' AS currency, (shipped * 0.9)::DECIMAL(18,2) AS amount
        FROM (SELECT p_type, strftime(l_shipdate, '%Y-%m') AS year_month, sum(l_extendedprice::DECIMAL(18,2)) AS shipped
              FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' GROUP BY 1, 2)""",
    "daily": """
        SELECT account_id, currency, date, sum(day_total) OVER (PARTITION BY account_id, currency ORDER BY date) AS balance,
               transaction_count
        FROM (SELECT account_id, currency, date, sum(amount) AS day_total, count(DISTINCT transaction_id) AS transaction_count
              FROM dated GROUP BY 1, 2, 3)""",
    "monthly": """
        SELECT account_id, currency, year_month,
               sum(total) OVER (PARTITION BY account_id, currency ORDER BY year_month)::DECIMAL(28,2) AS closing_balance
        FROM (SELECT account_id, currency, strftime(date, '%Y-%m') AS year_month, sum(amount) AS total
              FROM dated GROUP BY 1, 2, 3)""",
    "spending": """
        SELECT account_id, strftime(date, '%Y-%m') AS year_month, d.currency, sum(amount)::DECIMAL(28,2) AS total,
               count(DISTINCT transaction_id) AS transaction_count
        FROM dated d JOIN accounts a ON a.id = d.account_id WHERE a.type IN ('Expenses', 'Income') GROUP BY 1, 2, 3""",
    "net_worth": """
        SELECT year_month, m.currency,
               sum(CASE WHEN type = 'Assets' THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS total_assets,
               sum(CASE WHEN type <> 'Assets' THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS total_liabilities,
               sum(closing_balance)::DECIMAL(28,2) AS net_worth,
               sum(CASE WHEN type = 'Assets' AND (asset_class IS NULL OR asset_class = 'cash') THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS assets_cash,
               sum(CASE WHEN type = 'Assets' AND asset_class = 'equity' THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS assets_equity,
               sum(CASE WHEN type = 'Assets' AND asset_class = 'debt' THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS assets_debt,
               sum(CASE WHEN type = 'Assets' AND asset_class = 'crypto' THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS assets_crypto,
               sum(CASE WHEN type = 'Assets' AND asset_class NOT IN ('cash', 'equity', 'debt', 'crypto') THEN closing_balance ELSE 0 END)::DECIMAL(28,2) AS assets_other
        FROM monthly m JOIN accounts a ON a.id = m.account_id WHERE type IN ('Assets', 'Liabilities') GROUP BY 1, 2""",
    # A sale beyond what is held at its time is refused whole.
    "holding_events": """
        SELECT account_id, commodity, row_number() OVER (PARTITION BY account_id, commodity ORDER BY date, sale, id) AS n,
               id, sale, quantity FROM trades""",
    "walk": """
        SELECT account_id, commodity, n, id, sale AS refused, CASE WHEN sale THEN 0 ELSE quantity END::DECIMAL(18,2) AS held
        FROM holding_events WHERE n = 1
        UNION ALL
        SELECT e.account_id, e.commodity, e.n, e.id, e.sale AND e.quantity > w.held,
               CASE WHEN NOT e.sale THEN w.held + e.quantity WHEN e.quantity > w.held THEN w.held ELSE w.held - e.quantity END::DECIMAL(18,2)
        FROM walk w JOIN holding_events e ON e.account_id = w.account_id AND e.commodity = w.commodity AND e.n = w.n + 1""",
    "accepted": "SELECT * FROM sales WHERE id NOT IN (SELECT id FROM walk WHERE refused)",
    # First-in-first-out matches of accepted sales, by overlap of cumulative quantities.
    "lot_axis": """
        SELECT *, sum(quantity) OVER w - quantity AS lo, sum(quantity) OVER w AS hi FROM lots
        WINDOW w AS (PARTITION BY account_id, commodity ORDER BY acquired_date, id)""",
    "sale_axis": """
        SELECT *, sum(quantity) OVER w - quantity AS lo, sum(quantity) OVER w AS hi FROM accepted
        WINDOW w AS (PARTITION BY account_id, commodity ORDER BY sell_date, id)""",
    "fifo": """
        SELECT l.account_id, l.commodity, l.id AS lot_id, s.id AS sale_id,
               least(l.hi, s.hi) - greatest(l.lo, s.lo) AS quantity, acquired_date, sell_date, cost_price, proceeds
        FROM lot_axis l JOIN sale_axis s ON s.account_id = l.account_id AND s.commodity = l.commodity
             AND l.lo < s.hi AND s.lo < l.hi""",
    "dispositions": """
        SELECT f.*, ((proceeds - cost_price) * quantity)::DECIMAL(37,8) AS gain_loss,
               CASE WHEN date_diff('day', acquired_date, sell_date)
                         > CASE jurisdiction || '.' || asset_class WHEN 'IN.debt' THEN 1095 WHEN 'IN.elss' THEN 1095 ELSE 365 END
                    THEN 'long' ELSE 'short' END AS term, jurisdiction
        FROM fifo f JOIN custody USING (account_id)""",
}

_ORDER = list(CTES)


def _used(text: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b{name}\b", text)}


def with_ledger(sql: str) -> str:
    """Prefix a query with the ledger tables it needs."""
    needed, todo = set(), _used(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= _used(CTES[name]) - {name}
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in _ORDER if name in needed)
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"WITH RECURSIVE {ctes},\n{body[len(opening):]}"
    return f"WITH RECURSIVE {ctes}\n{body}"
