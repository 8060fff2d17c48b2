"""Balances, search and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.catalog.binding import Binding
from tallybook.catalog.registry import query
from tallybook.operators import accounts as acc
from tallybook.operators import balances as bal
from tallybook.operators import search, validation
from tallybook.plans import summaries
from tallybook.schemas import TABLES
from tallybook.session import scratch_path
from tallybook.sources import tables

_ACCOUNT_COLUMNS = "id, name, type, currency, booking_method, institution, asset_class, jurisdiction, closed_at"
_ACCOUNT_LIST = _ACCOUNT_COLUMNS.split(", ")


@query("S1", f"SELECT {_ACCOUNT_COLUMNS} FROM accounts")
def core_tables(b: Binding) -> DataFrame:
    """Written as stored tables, read back with the declared schema."""
    root = scratch_path(b.spark, "core")
    b.accounts.select(*[f.name for f in TABLES["accounts"]]).write.parquet(f"{root}/accounts")
    return tables.load_table(b.spark, root, "accounts").select(*_ACCOUNT_LIST)


@query("S12", """
    SELECT a.type, p.currency, count(*)::BIGINT AS postings, sum(p.amount)::DECIMAL(28,2) AS total
    FROM postings p JOIN accounts a ON a.id = p.account_id
    WHERE abs(p.amount) >= 1000 GROUP BY 1, 2""", total="decimal(28,2)")
def adhoc_sql(b: Binding) -> DataFrame:
    return tables.run_query(
        b.spark,
        """SELECT a.type, p.currency, count(*) AS postings, sum(p.amount) AS total
           FROM postings p JOIN accounts a ON a.id = p.account_id
           WHERE abs(p.amount) >= :least GROUP BY a.type, p.currency""",
        {"postings": b.postings, "accounts": b.accounts}, {"least": 1000},
    )


@query("F5 O4", f"SELECT {_ACCOUNT_COLUMNS} FROM accounts WHERE type = 'Liabilities'")
def accounts_by_type(b: Binding) -> DataFrame:
    return acc.list_accounts(b.accounts, "Liabilities").select(*_ACCOUNT_LIST)


@query("F5", "SELECT id, name, type FROM accounts WHERE name = 'Expenses:PROMO'")
def account_by_name(b: Binding) -> DataFrame:
    return acc.get_account(b.accounts, name="Expenses:PROMO").select("id", "name", "type")


@query("X12", """
    WITH opened AS (
        SELECT name, type FROM accounts UNION ALL
        SELECT s_name, 'Assets' FROM supplier UNION ALL
        SELECT 'Liabilities:' || s_name, 'Assets' FROM supplier UNION ALL
        SELECT 'Expenses:' || p_type, 'Expenses' FROM (SELECT DISTINCT p_type FROM part))
    SELECT name, 'too_few_segments' AS rule FROM opened WHERE position(':' IN name) = 0 UNION ALL
    SELECT name, 'unknown_root' FROM opened
    WHERE split_part(name, ':', 1) NOT IN ('Assets', 'Liabilities', 'Income', 'Expenses', 'Equity') UNION ALL
    SELECT name, 'type_differs_from_root' FROM opened WHERE split_part(name, ':', 1) <> type UNION ALL
    SELECT name, 'duplicate_name' FROM opened GROUP BY name HAVING count(*) > 1""")
def account_name_checks(b: Binding) -> DataFrame:
    """Accounts to open: the ledger's, bad supplier names, and existing ones again."""
    suppliers = b.table("supplier")
    opened = (
        b.accounts.select("name", "type")
        .unionByName(suppliers.select(F.col("s_name").alias("name"), F.lit("Assets").alias("type")))
        .unionByName(suppliers.select(F.concat(F.lit("Liabilities:"), "s_name").alias("name"), F.lit("Assets").alias("type")))
        .unionByName(b.expense_accounts.select("name", "type"))
    )
    return acc.account_name_violations(opened)


# ---- balances ----


@query("A1 J1", "SELECT account_id, currency, sum(amount)::DECIMAL(28,2) AS balance FROM dated GROUP BY 1, 2", balance="decimal(28,2)")
def account_balances(b: Binding) -> DataFrame:
    return bal.account_balances(b.postings, b.transactions)


@query("A1 F3", """
    SELECT account_id, currency, sum(amount)::DECIMAL(28,2) AS balance
    FROM dated WHERE date <= DATE '1997-06-30' GROUP BY 1, 2""", balance="decimal(28,2)")
def account_balances_as_of(b: Binding) -> DataFrame:
    return bal.account_balances(b.postings, b.transactions, as_of="1997-06-30")


@query("A2 F4", """
    SELECT p.currency, sum(amount)::DECIMAL(28,2) AS balance FROM dated p JOIN accounts a ON a.id = p.account_id
    WHERE (a.name = 'Assets:NATION_1' OR starts_with(a.name, 'Assets:NATION_1:')) AND date <= DATE '2000-12-31'
    GROUP BY 1""", balance="decimal(28,2)")
def subtree_balance(b: Binding) -> DataFrame:
    return bal.subtree_balance(b.postings, b.transactions, b.accounts, "Assets:NATION_1", "2000-12-31")


@query("A2", """
    SELECT node, currency, sum(amount)::DECIMAL(28,2) AS balance FROM (
        SELECT p.currency, p.amount, unnest([split_part(name, ':', 1),
               CASE WHEN name LIKE '%:%' THEN split_part(name, ':', 1) || ':' || split_part(name, ':', 2) END,
               CASE WHEN name LIKE '%:%:%' THEN name END]) AS node
        FROM postings p JOIN accounts a ON a.id = p.account_id) WHERE node IS NOT NULL GROUP BY 1, 2""", balance="decimal(28,2)")
def tree_balances(b: Binding) -> DataFrame:
    return bal.tree_balances(b.postings, b.transactions, b.accounts)


@query("A3", """
    SELECT account_id, d.currency, sum(amount)::DECIMAL(28,2) AS balance
    FROM dated d JOIN accounts a ON a.id = d.account_id
    WHERE a.type = 'Liabilities' AND date <= DATE '1999-12-31' GROUP BY 1, 2""", balance="decimal(28,2)")
def all_balances_of_type(b: Binding) -> DataFrame:
    return bal.account_balances(b.postings, b.transactions, b.accounts, "Liabilities", "1999-12-31")


@query("A4 O3", """
    SELECT a.name AS account, d.currency, sum(amount)::DECIMAL(28,2) AS balance
    FROM dated d JOIN accounts a ON a.id = d.account_id
    WHERE date <= DATE '1999-12-31' GROUP BY 1, 2""", balance="decimal(28,2)")
def balances_report(b: Binding) -> DataFrame:
    """The stored summary only knows expense accounts; others are computed."""
    expenses = b.postings.join(b.expense_accounts.select(F.col("id").alias("account_id")), "account_id", "left_semi")
    stored = bal.daily_balances(expenses, b.transactions)
    return bal.balances_report(stored, b.postings, b.transactions, b.accounts, as_of="1999-12-31")


@query("A5", """
    WITH asserted AS (
        SELECT c_custkey * 10 + 1 AS account_id, currency, DATE '1999-06-30' AS date, c_acctbal::DECIMAL(18,2) AS expected_amount
        FROM customer JOIN nations ON c_nationkey = n_nationkey)
    SELECT s.account_id, s.currency, s.date, expected_amount, coalesce(sum(d.amount), 0)::DECIMAL(28,2) AS actual_amount,
           (coalesce(sum(d.amount), 0) - expected_amount)::DECIMAL(28,2) AS difference,
           abs(coalesce(sum(d.amount), 0) - expected_amount) <= coalesce(max(tolerance), 0.01) AS matches
    FROM asserted s LEFT JOIN dated d ON d.account_id = s.account_id AND d.currency = s.currency AND d.date <= s.date
    LEFT JOIN tolerances t ON t.currency = s.currency GROUP BY 1, 2, 3, 4""",
    actual_amount="decimal(28,2)", difference="decimal(28,2)")
def balance_assertions(b: Binding) -> DataFrame:
    """Every customer's quoted balance asserted against the ledger."""
    asserted = b.table("customer").join(b.nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("c_custkey") * 10 + 1).alias("account_id"), "currency", F.lit("1999-06-30").cast("date").alias("date"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("expected_amount"),
    )
    return bal.check_assertions(asserted, b.postings, b.transactions, b.tolerances)


@query("A6", """
    SELECT account_id, currency, date, sum(amount)::DECIMAL(28,2) AS day_total,
           count(DISTINCT transaction_id)::BIGINT AS transaction_count FROM dated GROUP BY 1, 2, 3""", day_total="decimal(28,2)")
def daily_totals(b: Binding) -> DataFrame:
    return bal.daily_totals(b.postings, b.transactions)


@query("W1 A6 J1", "SELECT account_id, currency, date, balance::DECIMAL(28,2) AS balance, transaction_count::BIGINT AS transaction_count FROM daily", balance="decimal(28,2)")
def daily_balances(b: Binding) -> DataFrame:
    return bal.daily_balances(b.postings, b.transactions)


@query("W2 A8 X7", "SELECT account_id, currency, year_month, closing_balance FROM monthly", closing_balance="decimal(28,2)")
def monthly_balances(b: Binding) -> DataFrame:
    return bal.monthly_balances(b.postings, b.transactions)


@query("A7 X7", "SELECT account_id, year_month, currency, total, transaction_count::BIGINT AS transaction_count FROM spending", total="decimal(28,2)")
def monthly_spending(b: Binding) -> DataFrame:
    return summaries.monthly_spending(b.ledger)


# ---- search ----

_FOUND = """
    SELECT id, uuid, date, payee, narration, status FROM transactions t
    WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND contains(lower(payee), 'customer#0')
      AND status = 'cleared'
      AND EXISTS (SELECT 1 FROM postings p WHERE p.transaction_id = t.id AND abs(p.amount) BETWEEN 100000 AND 200000)
      AND 2 = (SELECT count(DISTINCT tag) FROM transaction_tags g WHERE g.transaction_id = t.id AND tag IN ('1-URGENT', 'BUILDING'))"""
_HEADER = ["id", "uuid", "date", "payee", "narration", "status"]


def _found(b: Binding) -> DataFrame:
    return search.find_transactions(
        b.transactions, b.postings, b.transaction_tags, date_from="1996-01-01", date_to="1999-12-31", payee="CUSTOMER#0",
        tags=["1-URGENT", "BUILDING"], amount_min="100000", amount_max="200000", status="cleared",
    ).select(*_HEADER)


@query("F1 F2 J8 J9 U1", _FOUND)
def transaction_search(b: Binding) -> DataFrame:
    return _found(b)


@query("F1 F2 J8", """
    SELECT id, uuid, date, payee, narration, status FROM transactions t
    WHERE EXISTS (SELECT 1 FROM postings p JOIN accounts a ON a.id = p.account_id
                  WHERE p.transaction_id = t.id AND a.name = 'Expenses:PROMO' AND abs(p.amount) >= 250000)""")
def transactions_of_account(b: Binding) -> DataFrame:
    """Account and amount on the same posting."""
    account = acc.get_account(b.accounts, name="Expenses:PROMO").select("id").first()[0]
    return search.find_transactions(
        b.transactions, b.postings, account_id=account, amount_min="250000"
    ).select(*_HEADER)


@query("O1", f"SELECT * FROM ({_FOUND}) ORDER BY date DESC, id DESC LIMIT 20 OFFSET 10")
def newest_page(b: Binding) -> DataFrame:
    return search.newest_page(_found(b), 20, 10)


@query("J9", """
    SELECT transaction_id FROM transaction_tags WHERE tag IN ('5-LOW', 'MACHINERY')
    GROUP BY 1 HAVING count(DISTINCT tag) = 2""")
def transactions_with_all_tags(b: Binding) -> DataFrame:
    return search.carrying_tags(b.transaction_tags, ["5-LOW", "MACHINERY"])


@query("X15 O1", """
    WITH page AS (SELECT * FROM transactions ORDER BY date DESC, id DESC LIMIT 100)
    SELECT t.id, t.date, t.payee,
           (SELECT string_agg(a.name || '=' || p.amount::VARCHAR, ';' ORDER BY p.id)
            FROM postings p JOIN accounts a ON a.id = p.account_id WHERE p.transaction_id = t.id) AS postings,
           (SELECT string_agg(tag, ';' ORDER BY tag) FROM transaction_tags g WHERE g.transaction_id = t.id) AS tags
    FROM page t""")
def nested_transactions(b: Binding) -> DataFrame:
    """The newest page with its postings and tags, shown as text."""
    page = search.newest_page(b.transactions)
    nested = search.with_postings_and_tags(page, b.postings, b.accounts, b.transaction_tags)
    shown = F.transform("postings", lambda p: F.concat(p["account_name"], F.lit("="), p["amount"].cast("string")))
    return nested.select(
        "id", "date", "payee", F.nullif(F.array_join(shown, ";"), F.lit("")).alias("postings"),
        F.array_join("tags", ";").alias("tags"),
    )


# ---- validation ----


@query("X1 A21", """
    SELECT transaction_id, currency, sum(amount)::DECIMAL(28,2) AS residual FROM quoted_postings GROUP BY 1, 2
    HAVING abs(sum(amount)) > CASE WHEN currency = 'BTC' THEN 0.00000001 ELSE 0.01 END""",
    residual="decimal(28,2)")
def unbalanced_transactions(b: Binding) -> DataFrame:
    return validation.unbalanced(b.quoted_postings, b.tolerances)


@query("X1 A21 M5", """
    SELECT id AS transaction_id, 'USD' AS currency, ((CASE WHEN sale THEN -quantity ELSE quantity END) * price)::DECIMAL(38,8) AS residual
    FROM trades""", residual="decimal(38,8)")
def posting_weights(b: Binding) -> DataFrame:
    """Priced postings weigh amount * price in the price's currency."""
    return validation.balance_residuals(b.trade_postings)


_BROKEN = """
    SELECT t.id AS transaction_id, 'no_postings' AS rule, NULL::VARCHAR AS detail FROM transactions t
    WHERE NOT EXISTS (SELECT 1 FROM quoted_postings p WHERE p.transaction_id = t.id) UNION ALL
    SELECT transaction_id, 'unbalanced', currency FROM quoted_postings
    GROUP BY transaction_id, currency
    HAVING abs(sum(amount)) > CASE WHEN currency = 'BTC' THEN 0.00000001 ELSE 0.01 END UNION ALL
    SELECT DISTINCT transaction_id, 'account_not_found', account_id::VARCHAR FROM quoted_postings
    WHERE account_id NOT IN (SELECT id FROM known) UNION ALL
    SELECT DISTINCT p.transaction_id, 'account_closed', a.name FROM quoted_postings p JOIN known a ON a.id = p.account_id
    JOIN transactions t ON t.id = p.transaction_id WHERE t.date >= a.closed_at UNION ALL
    SELECT DISTINCT p.transaction_id, 'currency_mismatch', a.name FROM quoted_postings p JOIN known a ON a.id = p.account_id
    WHERE a.booking_method IS NULL AND a.currency <> p.currency"""
_KNOWN = "known AS (SELECT * FROM accounts WHERE name <> 'Expenses:SMALL')"


def _violations(b: Binding, postings: DataFrame) -> DataFrame:
    known = b.accounts.filter("name <> 'Expenses:SMALL'")
    return validation.violations(b.transactions, postings, known, b.tolerances)


@query("A22 J19", f"WITH {_KNOWN} {_BROKEN}")
def transaction_violations(b: Binding) -> DataFrame:
    """One expense account is missing on purpose."""
    return _violations(b, b.quoted_postings)


@query("A22 U3", f"""
    WITH {_KNOWN}, broken AS ({_BROKEN.replace("quoted_postings", "postings")})
    SELECT id, date FROM transactions WHERE id NOT IN (SELECT transaction_id FROM broken)""")
def valid_transactions(b: Binding) -> DataFrame:
    return validation.valid_transactions(b.transactions, _violations(b, b.postings)).select("id", "date")


@query("J19", f"""
    WITH {_KNOWN} SELECT id, transaction_id, account_id FROM postings WHERE account_id NOT IN (SELECT id FROM known)""")
def orphan_postings(b: Binding) -> DataFrame:
    known = b.accounts.filter("name <> 'Expenses:SMALL'")
    return validation.orphan_postings(b.postings, known).select("id", "transaction_id", "account_id")
