"""Golden cases of balances, prices, validation, reports and search."""

import random
import re

from conftest import rows
from pyspark.sql import functions as F

from tallybook import Ledger
from tallybook.functions.amounts import parse_amount, parse_date, percent
from tallybook.operators import accounts as acc
from tallybook.operators import balances as bal
from tallybook.operators import dedup, matching, prices, rules, search, validation
from tallybook.plans import reports, summaries

POSTINGS = "id long, transaction_id long, account_id long, amount decimal(18,8), currency string, cost_amount decimal(18,8), cost_currency string, price decimal(18,8), price_currency string"
TXNS = "id long, date date"
ACCOUNTS = "id long, name string, type string, currency string, booking_method string, asset_class string, jurisdiction string, closed_at date"


def posting(i, txn, account, amount, currency="USD", price=None, price_currency=None):
    return (i, txn, account, amount, currency, None, None, price, price_currency)


def book(make, spark, entries):
    """entries: (txn, date, from, to, amount); accounts 1 bank, 2 groceries, 3 salary."""
    accounts = make(ACCOUNTS, [
        (1, "Assets:Bank", "Assets", "USD", None, None, None, None), (2, "Expenses:Food:Groceries", "Expenses", "USD", None, None, None, None),
        (3, "Income:Salary", "Income", "USD", None, None, None, None), (4, "Expenses:Rent", "Expenses", "USD", None, None, None, None),
    ])
    postings, headers = [], []
    for txn, date, source, target, amount in entries:
        headers.append((txn, date))
        postings += [posting(txn * 2, txn, source, -amount), posting(txn * 2 + 1, txn, target, amount)]
    return Ledger.empty(spark).with_tables(accounts=accounts, transactions=make(TXNS, headers), postings=make(POSTINGS, postings))


def test_running_balance(make, spark):
    ledger = book(make, spark, [(1, "2024-01-15", 1, 2, 50), (2, "2024-01-20", 1, 2, 30)])
    daily = bal.daily_balances(ledger.postings, ledger.transactions).filter("account_id = 1")
    assert rows(daily, "date", "balance", "transaction_count") == [("2024-01-15", -50, 1), ("2024-01-20", -80, 1)]
    assert rows(bal.subtree_balance(ledger.postings, ledger.transactions, ledger.accounts, "Expenses:Food")) == [("USD", 80)]
    assert rows(bal.subtree_balance(ledger.postings, ledger.transactions, ledger.accounts, "Expenses:F")) == []
    assert rows(bal.account_balances(ledger.postings, ledger.transactions, as_of="2024-01-16"), "account_id", "balance") == [(1, -50), (2, 50)]
    tree = bal.tree_balances(ledger.postings, ledger.transactions, ledger.accounts)
    assert ("Expenses", "USD", 80) in rows(tree) and ("Expenses:Food", "USD", 80) in rows(tree)


def test_refresh_equals_rebuild(make, spark):
    rng = random.Random(5)
    entries = [(i, f"2024-{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d}", rng.choice([1, 3]), rng.choice([2, 4]), rng.randrange(1, 90)) for i in range(60)]
    late = [(100, "2024-02-10", 1, 2, 25), (101, "2024-03-05", 3, 1, 15)]
    before, after, change = book(make, spark, entries), book(make, spark, entries + late), book(make, spark, late)
    affected = summaries.affected_by(change.transactions, change.postings)
    stored = summaries.registry.rebuild_all(before)
    fresh = summaries.registry.refresh_all(stored, after, affected)
    rebuilt = summaries.registry.rebuild_all(after)
    assert summaries.registry.names() == list(fresh)
    for name in fresh:
        assert rows(fresh[name], *rebuilt[name].columns) == rows(rebuilt[name]), name
    total = bal.account_balances(after.postings, after.transactions).agg(F.sum("balance")).first()[0]
    assert total == 0


def test_spending_reports(make, spark):
    ledger = book(make, spark, [(1, "2024-02-01", 1, 2, 100), (2, "2024-02-03", 1, 4, 50), (3, "2024-02-09", 3, 1, 30)])
    spending = summaries.monthly_spending(ledger)
    found = reports.spending_rows(spending, ledger.accounts, reports.latest_month(spending, "USD"))
    assert rows(reports.spending_totals(found)) == [(150, -30, -180, -120)]
    trend = reports.spending_trend(found, "2024-02")
    assert rows(trend, "year_month", "expenses")[0] == ("2023-09", 0) and trend.count() == 6
    # one month against five empty ones is the largest deviation possible, 2.04
    assert rows(reports.spending_anomalies(trend), "year_month") == [("2024-02",)]
    assert reports.spending_anomalies(reports.spending_trend(found, "2024-02", 5)).count() == 0
    only = reports.spending_rows(spending, ledger.accounts, "2024-02", category="GROC")
    assert rows(reports.spending_by_category(only)) == [("Expenses:Food:Groceries", 100)]
    budgets = make("account_id long, year_month string, currency string, amount decimal(18,8)", [(2, "2024-02", "USD", 500), (1, "2024-02", "USD", 0)])
    assert rows(reports.compare_budget(budgets, spending, ledger.accounts, "2024-02")) == [
        ("Assets:Bank", 0, 0, 0, 0), ("Expenses:Food:Groceries", 500, 100, 400, 20)]
    assert {r[0]: r[3] for r in rows(reports.budget_vs_actual(budgets, spending, ledger.accounts, "2024-02"))} == {
        "Assets:Bank": 0, "Expenses:Food:Groceries": 400, "Expenses:Rent": -50, "Income:Salary": 30}


def test_percent_rounds_half_even(spark):
    got = spark.sql("select cast(0.125 as decimal(18,3)) p, cast(100 as decimal(18,2)) w, cast(0 as decimal(18,2)) z").select(
        percent(F.col("p"), F.col("w")), percent(F.col("p"), F.col("z"))).first()
    assert [float(v) for v in got] == [0.12, 0.0]


PRICES = "commodity string, currency string, date date, price decimal(18,8), source string"


def test_prices(make):
    table = make(PRICES, [("A", "USD", "2024-06-10", 180, "m"), ("A", "USD", "2024-06-15", 185.5, "m"), ("A", "USD", "2024-06-20", 190, "m"), ("USD", "INR", "2024-06-01", 83.5, "m")])
    asked = make("commodity string, currency string, date date", [("A", "USD", "2024-06-17"), ("A", "USD", "2024-06-09"), ("INR", "USD", "2024-06-17"), ("USD", "JPY", "2024-06-17")])
    got = {r[:3]: r[3] for r in rows(prices.asof_prices(asked, table, True), "commodity", "currency", "date", "price")}
    assert got[("A", "USD", "2024-06-17")] == 185.5 and got[("A", "USD", "2024-06-09")] is None
    assert got[("INR", "USD", "2024-06-17")] == round(1 / 83.5, 8) and got[("USD", "JPY", "2024-06-17")] is None
    money = make("amount decimal(18,8), currency string, date date", [(1000, "USD", "2024-06-15"), (5, "EUR", "2024-06-15")])
    assert rows(prices.convert_amounts(money, table, "INR"), "currency", "converted") == [("EUR", None), ("USD", 83500)]
    assert rows(prices.convert_amounts(money, table, "USD"), "currency", "converted") == [("EUR", None), ("USD", 1000)]
    assert prices.price_history(table, "A", "USD", "2024-06-11", "2024-06-20").count() == 2
    new = make("commodity string, currency string, date date, price decimal(18,8), source string, seq long", [("A", "USD", "2024-06-20", 1, "x", 1), ("A", "USD", "2024-06-20", 2, "y", 2)])
    assert ("A", "USD", "2024-06-20", 2, "y") in rows(prices.upsert_prices(table, new))


def test_direct_rate_wins_even_when_older(make):
    table = make(PRICES, [("A", "B", "2024-01-01", 2, "m"), ("B", "A", "2024-02-01", 0.1, "m")])
    asked = make("commodity string, currency string, date date", [("A", "B", "2024-03-01")])
    assert rows(prices.asof_prices(asked, table, True), "price") == [(2,)]


def test_asof_equals_brute_force(make):
    rng = random.Random(3)
    quotes = {(f"C{rng.randrange(3)}", "USD", f"2024-01-{rng.randrange(1, 29):02d}"): rng.randrange(1, 99) for _ in range(30)}
    asked = [(f"C{rng.randrange(4)}", "USD", f"2024-01-{rng.randrange(1, 29):02d}") for _ in range(60)]
    got = prices.asof_prices(make("commodity string, currency string, date date", asked), make(PRICES, [(*k, v, "m") for k, v in quotes.items()]).repartition(5))
    for c, q, d, p in rows(got, "commodity", "currency", "date", "price"):
        earlier = [(k[2], v) for k, v in quotes.items() if k[0] == c and k[2] <= d]
        assert p == (max(earlier)[1] if earlier else None)


def test_balance_check(make, spark):
    tolerances = make("currency string, tolerance decimal(18,8)", [("USD", 0.01)])
    cases = {
        1: [(-50, "USD"), (45, "USD")], 2: [(-50, "USD"), (49.995, "USD")], 3: [(-50, "USD"), (49.97, "USD")],
        4: [(1, "BTC"), ("-0.999999995", "BTC")], 5: [(1, "BTC"), ("-0.9999999", "BTC")],
        6: [(-1000, "USD", 83.5, "INR"), (83500, "INR")], 7: [(-1000, "USD", 83.5, "INR"), (80000, "INR")],
    }
    found = [posting(t * 10 + i, t, 1, *p) for t, ps in cases.items() for i, p in enumerate(ps)]
    got = validation.unbalanced(make(POSTINGS, found), tolerances)
    assert {(r[0], r[1]) for r in rows(got)} == {(1, "USD"), (3, "USD"), (5, "BTC"), (7, "INR")}


def test_violations(make):
    accounts = make(ACCOUNTS, [
        (1, "Assets:Old", "Assets", "USD", None, None, None, "2024-01-01"), (2, "Assets:Broker", "Assets", "USD", "FIFO", None, None, None),
        (3, "Assets:Bank", "Assets", "USD", None, None, None, None),
    ])
    txns = make(TXNS, [(1, "2024-01-01"), (2, "2023-12-31"), (3, "2024-01-01"), (4, "2024-01-01"), (5, "2024-01-01")])
    ps = make(POSTINGS, [
        posting(1, 1, 1, 5), posting(2, 1, 3, -5), posting(3, 2, 1, 5), posting(4, 2, 3, -5), posting(5, 3, 2, 1, "X"), posting(6, 3, 3, -1, "X"),
        posting(7, 4, 9, 1), posting(8, 4, 3, -1),
    ])
    tolerances = make("currency string, tolerance decimal(18,8)", [])
    got = validation.violations(txns, ps, accounts, tolerances)
    assert rows(got) == [
        (1, "account_closed", "Assets:Old"), (3, "currency_mismatch", "Assets:Bank"), (4, "account_not_found", "9"), (5, "no_postings", None)]
    assert rows(validation.valid_transactions(txns, got), "id") == [(2,)]


def test_account_and_amount_on_the_same_posting(make, spark):
    ledger = book(make, spark, [(1, "2024-01-15", 1, 2, 50), (2, "2024-01-16", 1, 2, 70)])
    ps = ledger.postings.withColumn("amount", F.when(F.col("id") == 3, F.lit(5).cast("decimal(18,8)")).otherwise(F.col("amount")))
    assert search.find_transactions(ledger.transactions, ps, account_id=2, amount_min=40).count() == 1
    page = search.newest_page(ledger.transactions, 1, 1)
    assert rows(page, "id") == [(1,)]
    tags = make("transaction_id long, tag string", [(1, "b"), (1, "a")])
    nested = search.with_postings_and_tags(ledger.transactions, ps, ledger.accounts, tags).orderBy("id").collect()
    assert nested[0]["tags"] == ["a", "b"] and nested[1]["tags"] == [] and [p["id"] for p in nested[0]["postings"]] == [2, 3]


def test_name_rules(make):
    new = make("name string, type string", [("Assets:A", "Assets"), ("Assets", "Assets"), ("Cash:A", "Cash"), ("Income:A", "Assets"), ("Assets:A", "Assets")])
    assert set(rows(acc.account_name_violations(new))) == {
        ("Assets", "too_few_segments"), ("Cash:A", "unknown_root"), ("Income:A", "type_differs_from_root"), ("Assets:A", "duplicate_name")}


def test_parsing(spark):
    def amounts(option, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_amount(F.col("t"), option))
        return [None if r[0] is None else float(r[0]) for r in df.collect()]

    assert amounts(False, "$1,234.50", "(45.00)", "-", "", "₹-7", "abc", " 2 ") == [1234.5, 45, 0, 0, -7, None, 2]
    assert amounts(True, "(45.00)", "45.00", "($1,000)") == [-45, 45, -1000]

    def dates(fmt, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t"), fmt))
        return [str(r[0]) for r in df.collect()]

    assert dates(None, "01/02/2024", "13/01/2024", "2024-1-5", "2/30/2024", "1/2/24", "1/2/70", "x") == [
        "2024-01-02", "2024-01-13", "2024-01-05", "None", "2024-01-02", "1970-01-02", "None"]
    assert dates("%d/%m/%Y", "01/02/2024", "05 Jan 2024") == ["2024-02-01", "None"]
    assert dates("%d %b %Y", "05 Jan 2024") == ["2024-01-05"]


RULES = "id long, pattern string, pattern_type string, target_account string, institution string, priority int"


def test_first_rule(make):
    table = make(RULES, [
        (1, "AMAZON", "substring", "Expenses:Shopping", None, 1), (2, "^AMZ", "regex", "Expenses:Web", None, 5), (3, "amazon prime", "exact", "Expenses:Video", None, 9),
        (4, "shell", "substring", "Expenses:Fuel", "x", 1), (5, "she", "substring", "Expenses:Other", None, 1), (6, "amz", "regex", "Expenses:Never", None, 99),
    ])
    texts = make("text string", [("Amazon.com",), ("AMZ amazon",), ("AMAZON PRIME",), ("Shell 12",), ("nothing",)])
    assert dict(rows(rules.first_rule(texts, table))) == {
        "Amazon.com": "Expenses:Shopping", "AMZ amazon": "Expenses:Web", "AMAZON PRIME": "Expenses:Video", "Shell 12": "Expenses:Fuel"}
    visible = rules.visible_rules(table, "y")
    assert dict(rows(rules.first_rule(texts, visible)))["Shell 12"] == "Expenses:Other"


def test_required_literals():
    cases = {
        "^(VIEW|CLICK) [0-4]": None, "AMZN.*MKTP": "AMZN", "^UBER +EATS$": "UBER ", "ab?cd": "cd", "abc{2}de": "ab", "ab+c": "ab", r"a\.b": "a.b", r"\d+xy": "xy",
        "one|other": None, "(one|other) way": " way", "(?i)abc": None, "(?:x)abc": "abc", r"\Qabc": None, r"\x41bc": None, "[abc]def[^]x]gh": "def", "a": None, "": None,
        "x(ab[)])*yz": "yz", "[[a]b]cc": None, "abc*": "ab", "(?=ab)cd": "cd",
    }
    assert {p: rules.required_literal(p) for p in cases} == cases


def test_many_regexes_are_met_by_their_literals(make, spark):
    rng = random.Random(6)
    table = [(i, f"^{'SHOP' if i % 2 else 'CAFE'} N{i}[0-9]? (A|B).*$", "regex", f"Expenses:E{i}", None, i % 7) for i in range(10_000)]
    texts = [f"{rng.choice(['SHOP', 'CAFE'])} N{rng.randrange(12_000)} {rng.choice('ABC')} x" for _ in range(400)] + ["", "SHOP", "N77 A"]
    first = {}
    for i, pattern, _, target, _, priority in table:
        first.setdefault(pattern.split(" ")[0][1:] + " " + pattern.split(" ")[1].split("[")[0], (priority, i, target, re.compile(pattern)))
    want = {}
    for text in set(texts):
        name = text[: text.rfind(" ", 0, -2)] if text.count(" ") == 3 else ""
        near = [first[k] for k in (name, name[:-1]) if k in first]
        hits = sorted((-p, i, t) for p, i, t, pattern in near if pattern.search(text))
        if hits:
            want[text] = hits[0][2]
    found = rules.first_rule(make("text string", [(t,) for t in set(texts)]), spark.createDataFrame(table, RULES))
    assert dict(rows(found)) == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan  # no list of regexes that every text tries


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_many_names_with_one_beginning(make, spark):
    names = [f"Assets:Bank:{c}{i:05d}" for i in range(20_000) for c in "xX"[i % 2]] + ["assets:bank:x00001", "ASSETS:BANK:X00003"]
    found = matching.match_accounts(make("query string", [("assets:bank:",), ("Assets:Bank:X00001",)]), make("name string", [(n,) for n in names]))
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r["query"], {})[r["rank"]] = (r["name"], r["score"])
    assert [by_query["assets:bank:"][k] for k in range(1, 6)] == [(n, 0.95) for n in sorted(names)[:5]]
    assert [by_query["Assets:Bank:X00001"][k] for k in (1, 2)] == [("Assets:Bank:X00001", 1.0), ("assets:bank:x00001", 1.0)]


def test_account_match_equals_brute_force(make, monkeypatch):
    monkeypatch.setattr(matching, "SHARE", 2)
    rng = random.Random(11)
    names = sorted({f"{rng.choice(['Assets', 'Expenses'])}:{rng.choice(['Bank', 'Food', 'Broker'])}:{rng.choice('abc')}{rng.randrange(40)}" for _ in range(60)} | {"Income:Salary"})
    queries = set()
    for name in names:
        text = list(name)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text[at:at + 1] = rng.choice([[], ["x"], [text[at], "y"], [text[at].upper()]])
        queries.add("".join(text))
    queries |= {"bank", "assets:", "Salary", "zzz", "expenses:food:a1"}
    got = {}
    for q, n, s, _ in rows(matching.match_accounts(make("query string", [(q,) for q in queries]), make("id long, name string", list(enumerate(names))), 0.8), "query", "name", "score", "rank"):
        got.setdefault(q, set()).add((n, round(s, 9)))

    def score(q, n):
        q, n = q.lower(), n.lower()
        if q == n:
            return 1.0
        if n.startswith(q):
            return 0.95
        if any(q in part for part in n.split(":")):
            return 0.9
        s = 1 - _distance(q, n) / max(len(q), len(n))
        return s if s >= 0.8 else None

    for q in queries:
        best = sorted(((-score(q, n), n) for n in names if score(q, n) is not None))[:5]
        assert got.get(q, set()) == {(n, round(-s, 9)) for s, n in best}, q


def test_match_lists_are_not_broadcast(make):
    """Listed variants and pieces are hundreds of times the rows Spark expects of them."""
    queries = make("query_key string", [("liabilities:bank:00012",)])
    names = make("name_key string, low string", [(f"liabilities:bank:{i:05d}", f"Liabilities:Bank:{i:05d}") for i in range(50)])
    for pairs in (
        matching._near_candidates(queries, names, 0.85, 1), matching._near_candidates(queries, names, 0.85, 2), matching._edit_candidates(queries, names, 0.85),
    ):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() > 0


def test_dense_names_are_matched_in_full(make):
    """Numbers of which many are two and three edits apart."""
    rng = random.Random(5)
    names = sorted({f"liabilities:nation_{rng.randrange(25)}:customer#{rng.randrange(10_000):09d}" for _ in range(150)})
    queries = [n[:-2] + n[-1] for n in names[::10]] + ["liabilities:nation_1:customer#00000"]
    got = {}
    for q, n, s, _ in rows(matching.match_accounts(make("query string", [(q,) for q in queries]), make("name string", [(n,) for n in names])), "query", "name", "score", "rank"):
        got.setdefault(q, set()).add((n, round(s, 9)))
    for q in queries:
        scored = [(0.95 if n.startswith(q) else 1 - _distance(q, n) / max(len(q), len(n)), n) for n in names]
        best = sorted((-s, n) for s, n in scored if s >= 0.85)[:5]
        assert got.get(q, set()) == {(n, round(-s, 9)) for s, n in best}, q


def test_resolve(make):
    accounts = make("id long, name string", [(1, "Assets:Bank:Checking"), (2, "Assets:Bank:Savings")])
    got = matching.resolve_accounts(make("query string", [("Assets:Bank:Savings",), ("Assets:Bank:Chekcing",), ("savings",), ("nope",)]), accounts)
    assert dict(rows(got)) == {"Assets:Bank:Savings": 2, "Assets:Bank:Chekcing": 1, "savings": 2, "nope": None}


def test_near_duplicates(make):
    ledger = make("account_id long, amount decimal(18,8), payee string, date date", [(1, -5, "shop", "2024-01-10"), (1, 7, None, "2024-01-10")])
    incoming = make("row_id long, account_id long, amount decimal(18,8), payee string, date date", [
        (1, 1, "-5.00", "shop", "2024-01-13"), (2, 1, -5, "shop", "2024-01-14"), (3, 1, -5, "other", "2024-01-10"), (4, 1, 7, None, "2024-01-07"),
        (5, 2, -5, "shop", "2024-01-10"), (6, 1, -5, "shop", "2024-01-15"),
    ])
    assert rows(dedup.drop_near_duplicates(incoming, ledger), "row_id") == [(2,), (3,), (5,), (6,)]
    assert rows(dedup.drop_near_duplicates(incoming, ledger, within_batch=True), "row_id") == [(2,), (3,), (5,)]


def test_net_worth_carry_forward_and_missing_rate(make, spark):
    ledger = book(make, spark, [(1, "2024-01-15", 3, 1, 100), (2, "2024-04-02", 3, 1, 50)])
    monthly = summaries.monthly_balances(ledger)
    carried = summaries.net_worth_by_currency(monthly, ledger.accounts, carry_forward=True)
    assert rows(carried, "year_month", "net_worth") == [("2024-01", 100), ("2024-02", 100), ("2024-03", 100), ("2024-04", 150)]
    assert rows(summaries.net_worth_by_currency(monthly, ledger.accounts), "year_month", "net_worth") == [("2024-01", 100), ("2024-04", 150)]
    priced = summaries.consolidated_net_worth(carried.withColumn("currency", F.lit("XYZ")), ledger.prices)
    assert rows(priced.filter("rate_missing"), "year_month", "net_worth")[0] == ("2024-01", 100)


def test_assertions(make, spark):
    ledger = book(make, spark, [(1, "2024-01-15", 1, 2, 50), (2, "2024-01-20", 1, 2, 30)])
    asked = make("account_id long, date date, expected_amount decimal(18,8), currency string", [
        (1, "2024-01-19", -50, "USD"), (1, "2024-01-20", -79.98, "USD"), (1, "2024-01-01", 0, "USD"), (9, "2024-01-01", 1, "EUR")])
    got = bal.check_assertions(asked, ledger.postings, ledger.transactions, make("currency string, tolerance decimal(18,8)", [("USD", 0.01)]))
    assert {r[:3] for r in rows(got, "account_id", "date", "matches")} == {(1, "2024-01-19", True), (1, "2024-01-20", False), (1, "2024-01-01", True), (9, "2024-01-01", False)}


def test_sound_postings_do_not_move_for_their_accounts(make):
    from tallybook.operators.validation import violations

    accounts = make("id long, name string, currency string, booking_method string, closed_at date", [(1, "A", "USD", None, None), (2, "B", "USD", "FIFO", None)])
    transactions = make("id long, date date", [(7, "2024-01-01")])
    postings = make("transaction_id long, account_id long, account_name string, amount decimal(18,8), currency string, price decimal(18,8), price_currency string", [
        (7, 1, "A", 5, "USD", None, None), (7, None, "B", -5, "USD", None, None), (7, None, "C", 0, "USD", None, None), (8, None, "C", 0, "USD", None, None)])
    found = violations(transactions, postings, accounts, make("currency string, tolerance decimal(18,8)", []))
    assert rows(found) == [(7, "account_not_found", "C")]
    # No account is looked up for each posting: they meet what was told once per named account.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_by_id" not in plan and "_by_name" not in plan
