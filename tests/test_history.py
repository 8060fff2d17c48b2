"""Lot matching over a history against a plain sequential loop."""

import datetime as dt
import random

import pytest
from conftest import rows

from tallybook.functions.running import maxima_before, sums_before
from tallybook.operators import lot_history as lh
from tallybook.operators import lots as lt

LOTS = "id long, account_id long, commodity string, original_quantity decimal(18,8), cost_price decimal(18,8), cost_currency string, acquired_date date"
LOTS_ALL = "id long, account_id long, commodity string, quantity decimal(18,8), original_quantity decimal(18,8), cost_price decimal(18,8), cost_currency string, acquired_date date, label string, lock_until date, source_transaction_id long, disposed boolean"
SALES = "id long, account_id long, commodity string, quantity decimal(18,8), proceeds_per_unit decimal(18,8), proceeds_currency string, sell_date date, sell_transaction_id long"


def history(seed, n, holdings, oversell):
    rng = random.Random(seed)
    lots, sales = [], []
    for i in range(n):
        account, commodity = 1 + rng.randrange(holdings) % 3, f"C{rng.randrange(max(1, holdings // 3))}"
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(25))
        quantity = rng.choice([1, 2, 3, 5, 8, 0.5, 40 if rng.random() < 0.1 else 1])
        if rng.random() < (0.55 if oversell else 0.75):
            lots.append((i, account, commodity, quantity, rng.randrange(5, 15), "USD", day))
        else:
            sales.append((i, account, commodity, quantity, 10, "USD", day, i))
    return lots, sales


def sequential(lots, sales, method):
    """(refused ids, {(lot, sale): quantity}) by the plain loop."""
    events = sorted([(x[6], 0, x[0], x) for x in lots] + [(x[6], 1, x[0], x) for x in sales], key=lambda e: e[:3])
    open_, refused, used = {}, set(), {}
    order = {"FIFO": lambda x: (x[1], x[0]), "LIFO": lambda x: (-x[1].toordinal(), -x[0]), "HIFO": lambda x: (-x[2], x[0])}[method]
    for day, side, _, e in events:
        held = open_.setdefault((e[1], e[2]), [])
        if side == 0:
            held.append([e[0], day, e[4], e[3]])
            continue
        if sum(x[3] for x in held) < e[3]:
            refused.add(e[0])
            continue
        left = e[3]
        for x in sorted(held, key=order):
            take = min(x[3], left)
            if take > 0:
                used[(x[0], e[0])] = take
                x[3] -= take
                left -= take
    return refused, used


@pytest.mark.parametrize("seed,holdings,oversell,bits", [(1, 1, True, 2), (2, 1, False, 3), (3, 6, True, 20)])
def test_history_equals_loop(make, seed, holdings, oversell, bits):
    lots, sales = history(seed, 260, holdings, oversell)
    lot_df, sale_df = make(LOTS, lots).repartition(7), make(SALES, sales).repartition(5)
    refused = sequential(lots, sales, "FIFO")[0]
    assert {r[0] for r in lh.refused_sales(lot_df, sale_df, bits).collect()} == refused
    if oversell:
        assert refused
    accepted = make(SALES, [s for s in sales if s[0] not in refused])
    for method, match in (
        ("FIFO", lambda: lh.match_fifo(lot_df, accepted, bits)), ("LIFO", lambda: lh.match_lifo(lot_df, accepted, bits)),
        ("HIFO", lambda: lh.match_hifo(lot_df, accepted, max(bits, 5))),
    ):
        got = {}
        for lot, sale, quantity in rows(match(), "lot_id", "sale_id", "quantity"):
            got[(lot, sale)] = got.get((lot, sale), 0) + quantity
        assert got == sequential(lots, sales, method)[1], method


def test_dispose_history_by_account_method(make):
    lots, sales = history(9, 150, 9, True)
    accounts = make(
        "id long, booking_method string, jurisdiction string, asset_class string",
        [(1, "FIFO", "US", "equity"), (2, "LIFO", "IN", "debt"), (3, "HIFO", None, None)],
    )
    got = lh.dispose_history(make(LOTS, lots), make(SALES, sales), accounts, block_bits=4)
    found = {(r[0], r[1]): r[2] for r in rows(got.groupBy("lot_id", "sale_id").agg({"quantity": "sum"}))}
    expected = {}
    for account, method in ((1, "FIFO"), (2, "LIFO"), (3, "HIFO")):
        expected |= sequential([x for x in lots if x[1] == account], [x for x in sales if x[1] == account], method)[1]
    assert found == expected
    # nothing is sold twice
    bought = {x[0]: x[3] for x in lots}
    sold = {}
    for (lot, _), q in found.items():
        sold[lot] = sold.get(lot, 0) + q
    assert all(q <= bought[lot] for lot, q in sold.items())


def test_golden_fifo_history(make):
    lots = make(LOTS, [(1, 1, "X", 10, 100, "USD", "2024-01-10"), (2, 1, "X", 10, 105, "USD", "2024-02-10"), (3, 1, "X", 10, 110, "USD", "2024-03-10")])
    sales = make(SALES, [(9, 1, "X", 15, 120, "USD", "2024-06-01", 9)])
    accounts = make("id long, booking_method string, jurisdiction string, asset_class string", [(1, "FIFO", "US", "equity")])
    got = lh.dispose_history(lots, sales, accounts)
    assert rows(got, "lot_id", "quantity", "gain_loss", "term") == [(1, 10, 200, "short"), (2, 5, 75, "short")]


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_sums_before(make, bits):
    rng = random.Random(bits)
    data = [(i, rng.randrange(2), rng.randrange(4), rng.randrange(-3, 9)) for i in rng.sample(range(-60, 300), 120)]
    got = sums_before(make("id long, k long, d long, v long", data), ["k"], "d", "id", ["v"], bits)
    expected = {i: sum(w for j, k2, d2, w in data if k2 == k and (d2, j) < (d, i)) for i, k, d, v in data}
    assert {r["id"]: r["v_before"] for r in got.collect()} == expected


@pytest.mark.parametrize("bits", [1, 20])
def test_maxima_before(make, bits):
    rng = random.Random(bits)
    data = [(i, rng.randrange(2), rng.randrange(4), rng.randrange(-3, 9)) for i in rng.sample(range(-60, 300), 80)]
    got = maxima_before(make("id long, k long, d long, v long", data), ["k"], "d", "id", ["v"], bits)
    expected = {i: max((w for j, k2, d2, w in data if k2 == k and (d2, j) < (d, i)), default=None) for i, k, d, v in data}
    assert {r["id"]: r["v_before"] for r in got.collect()} == expected


# ---- a snapshot ----

SNAPSHOT = "id long, account_id long, commodity string, quantity decimal(18,8), original_quantity decimal(18,8), cost_price decimal(18,8), cost_currency string, acquired_date date, label string, lock_until date, source_transaction_id long, disposed boolean"


def snapshot(make, *lots):
    return make(SNAPSHOT, [(i, 1, "X", q, q, c, "USD", d, None, None, i, False) for i, q, c, d in lots])


THREE = [(1, 10, 100, "2024-01-10"), (2, 10, 130, "2024-02-10"), (3, 10, 120, "2024-03-10")]


@pytest.mark.parametrize("method,gains", [("FIFO", [(1, 600), (2, 150)]), ("LIFO", [(2, 150), (3, 400)]), ("HIFO", [(2, 300), (3, 200)])])
@pytest.mark.parametrize("bits", [0, 20])
def test_golden_booking_methods(make, method, gains, bits):
    accounts = make("id long, booking_method string, jurisdiction string, asset_class string", [(1, method, None, None)])
    sales = make(
        "id long, account_id long, commodity string, quantity decimal(18,8), proceeds_per_unit decimal(18,8), proceeds_currency string, sell_date date, sell_transaction_id long, booking_method string",
        [(9, 1, "X", 15, 160, "USD", "2024-06-01", 9, method)],
    )
    assert rows(lt.book_sales(snapshot(make, *THREE), sales, accounts, block_bits=bits), "lot_id", "gain_loss") == gains


def test_hifo_costs_compare_as_numbers(make):
    demands = make("demand_id long, account_id long, commodity string, demand decimal(18,8), booking_method string", [(1, 1, "X", 1, "HIFO")])
    lots = snapshot(make, (1, 5, 90, "2024-01-01"), (2, 5, 130, "2024-01-02"))
    assert rows(lt.take_lots(lots, demands), "id", "taken") == [(2, 1)]


def test_tie_goes_to_lower_id(make):
    demands = make("demand_id long, account_id long, commodity string, demand decimal(18,8), booking_method string", [(1, 1, "X", 5, "FIFO")])
    lots = snapshot(make, (2, 10, 100, "2024-01-01"), (1, 10, 100, "2024-01-01"))
    assert rows(lt.take_lots(lots, demands), "id", "taken") == [(1, 5)]


def test_terms(make):
    from pyspark.sql import functions as F

    cases = make("a date, s date, j string, c string", [
        ("2024-01-15", "2024-07-15", "US", "equity"), ("2022-01-15", "2024-06-15", "US", "equity"),
        ("2022-01-15", "2024-01-20", "IN", "debt"), ("2021-01-15", "2024-06-15", "IN", "debt"), ("2023-01-01", "2024-01-01", None, None),
    ])
    term = lt.holding_term(F.col("a"), F.col("s"), F.col("j"), F.col("c"))
    with_edge = lt.holding_term(F.col("a"), F.col("s"), F.col("j"), F.col("c"), inclusive=True)
    got = rows(cases.select("a", "s", term.alias("t"), with_edge.alias("i")))
    assert [r[2] for r in got] == ["long", "short", "long", "short", "short"]
    # held exactly 365 days: short when selling, long in the preview
    assert got[3][:2] == ("2023-01-01", "2024-01-01") and got[3][3] == "long"


def test_wash_sale(make):
    lots = snapshot(make, (1, 10, 100, "2024-06-01"), (2, 10, 100, "2024-06-20"))
    gone = make(
        "account_id long, commodity string, sell_date date, gain_loss decimal(18,8)",
        [(1, "X", "2024-06-15", -100), (1, "X", "2024-06-14", 100), (1, "X", "2024-09-01", -50), (1, "X", "2024-05-25", -5)],
    )
    got = rows(lt.with_wash_sales(gone, lots), "sell_date", "wash_sale", "wash_sale_adjustment")
    assert got == [("2024-05-25", True, 5), ("2024-06-14", False, None), ("2024-06-15", True, 100), ("2024-09-01", False, None)]
    recorded = rows(lt.with_wash_sales(gone, lots, "recorded").filter("wash_sale"), "sell_date")
    assert recorded == [("2024-06-15",)]


def test_split_then_transfer_and_replay(make):
    lots = snapshot(make, (1, 10, 400, "2024-01-01"), (2, 20, 150, "2024-02-01"))
    actions = make("action_id long, commodity string, action_type string, ratio decimal(18,8)", [(1, "X", "split", 4), (2, "X", "split", 0), (3, "X", "merge", 2)])
    assert {r["action_id"] for r in lt.action_violations(actions).collect()} == {2, 3}
    assert rows(lt.apply_corporate_actions(lots, actions), "id", "quantity", "original_quantity", "cost_price") == [(1, 40, 40, 100), (2, 80, 80, 37.5)]

    transfers = make(
        "transfer_id long, from_account_id long, to_account_id long, commodity string, quantity decimal(18,8), booking_method string",
        [(7, 1, 2, "X", 15, "FIFO"), (8, 5, 2, "X", 1, "FIFO")],
    )
    moved = lt.transfer_lots(lots, transfers)
    assert rows(moved, "account_id", "quantity", "original_quantity", "cost_price") == [(1, 15, 15, 150), (2, 10, 10, 400), (2, 5, 5, 150)]
    assert rows(lt.shortfalls(lots, lt.transfer_demands(transfers)), "demand_id") == [(8,)]

    gone = make("lot_id long, sell_transaction_id long, quantity decimal(18,8)", [(1, 50, 10), (2, 51, 5)])
    state = lt.replay_lots(lots, gone)
    assert rows(state, "id", "quantity", "disposed") == [(1, 0, True), (2, 15, False)]
    assert rows(lt.replay_lots(state, gone), "id", "quantity") == rows(state, "id", "quantity")


def test_replay_scales_sales_before_a_split(make):
    split = make("action_id long, commodity string, action_type string, ratio decimal(18,8), effective_date date", [(1, "X", "split", 4, "2024-05-01")])
    lots = lt.apply_corporate_actions(snapshot(make, (1, 10, 400, "2024-01-01")), split)
    gone = make("lot_id long, sell_transaction_id long, quantity decimal(18,8)", [(1, 50, 2), (1, 51, 8)])
    days = make("id long, date date", [(50, "2024-03-01"), (51, "2024-06-01")])
    assert rows(lt.replay_lots(lots, gone, days, split), "quantity") == [(24,)]


def test_many_demands_of_one_holding(make, spark):
    """What demands take is as much work as there are rows of it."""
    rng = random.Random(11)
    held = [(i, 1, "X", q, q, rng.randrange(1, 9) * 10, "USD", f"2024-01-{rng.randrange(1, 29):02d}", None, None, i, False) for i, q in ((i, rng.randrange(1, 6)) for i in range(1, 301))]
    lots = make(LOTS_ALL, held)
    demands = [(1000 + k, 1, "X", rng.randrange(1, 12), rng.choice(["FIFO", "LIFO", "HIFO"])) for k in range(400)] + [(5000, 1, "X", 100_000, "FIFO"), (5001, 1, "X", 5, "OTHER"), (5002, 9, "X", 5, "FIFO")]
    asked = make("demand_id long, account_id long, commodity string, demand decimal(18,8), booking_method string", demands)
    for bits in (20, 3):
        got = rows(lt.take_lots(lots, asked, bits), "demand_id", "id", "taken")
        keys = {"FIFO": lambda r: (r[7], r[0]), "LIFO": lambda r: (-int(r[7][-2:]), -r[0]), "HIFO": lambda r: (-r[5], r[0])}
        want = []
        for number, account, _, wanted, method in demands:
            for row in sorted(held, key=keys[method]) if account == 1 and method in keys else ():
                used = min(wanted, row[3])
                if used:
                    want.append((number, row[0], used))
                wanted -= used
        assert [tuple(map(int, r)) for r in got] == sorted(want, key=lambda r: tuple(str(v) for v in r))


def test_shuffles_are_dealt_by_bytes(spark):
    """Few partitions are set here; what a task gets is bounded all the same."""
    dealt = spark.range(6_000_000).repartition("id").groupBy("id").count()
    assert dealt.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fifo_moves_rows_once(make):
    lots, sales = make(LOTS, [(1, 2, "X", 5, 5, "USD", "2024-01-01")]), make(SALES, [(2, 2, "X", 3, 2, "USD", "2024-02-01", 2)])
    plan = lh.match_fifo(lots, sales)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fifo_passes_over_lots_of_nothing(make):
    lots = make(LOTS, [(1, 2, "X", 3, 5, "USD", "2024-01-01"), (2, 2, "X", 0, 5, "USD", "2024-01-02"), (3, 2, "X", 4, 6, "USD", "2024-01-03")])
    sales = make(SALES, [(4, 2, "X", 3, 2, "USD", "2024-02-01", 4), (5, 2, "X", 2, 2, "USD", "2024-02-02", 5)])
    for bits in (1, 20):
        assert rows(lh.match_fifo(lots, sales, bits), "lot_id", "sale_id", "quantity") == [(1, 4, 3.0), (3, 5, 2.0)]


def test_custody_side_derives_no_orders(spark):
    from tallybook.catalog import binding

    root = "/root/testdata/../testdata/sf0.001"
    assert binding.Binding(spark, root).books.postings.isEmpty()
    assert {key[2] for key in binding._written if key[1] == root} == {"accounts", "commodity_prices"}


def test_nothing_is_derived_for_no_holdings(spark, make):
    from tallybook.ledger import Ledger
    from tallybook.plans import changes

    ledger = Ledger.empty(spark)
    after, short = changes.derive_lots(ledger, changes.holdings_of(ledger.postings, ledger.accounts))
    assert after is ledger and short.isEmpty()
