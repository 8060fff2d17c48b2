"""What stays on disk: shuffled rows and frames stored on the way go when nothing reads them any more."""

import datetime as dt
import os

import pytest

from tallybook.operators import lot_history as lh
from tallybook.plans import changes
from tallybook.session import passing, stored, stored_parts

LOTS = "id long, account_id long, commodity string, original_quantity decimal(18,8), cost_price decimal(18,8), cost_currency string, acquired_date date"
SALES = "id long, account_id long, commodity string, quantity decimal(18,8), proceeds_per_unit decimal(18,8), proceeds_currency string, sell_date date, sell_transaction_id long"


@pytest.fixture()
def left(spark, tmp_path, monkeypatch):
    """The labels of what is stored in a folder of its own."""
    monkeypatch.setattr("tallybook.session.shared_dir", lambda spark: str(tmp_path))
    return lambda: sorted(name.split("-")[1] for name in os.listdir(tmp_path))


def test_frames_outlast_the_blocks_that_keep_them(spark, left):
    with passing() as keep:
        a = stored(spark.range(3), "a")
        with passing() as hold:
            b, c = hold(stored(a.join(stored(spark.range(2), "x"), "id"), "b")), hold(stored(spark.range(1), "c"))
        keep(b)
        assert left() == ["a", "b", "c"]
    assert left() == ["b"] and b.count() == 2


def test_parts_are_written_one_after_the_other(spark, left):
    seen = []

    def parts():
        for i in range(3):
            seen.append(left())
            yield spark.range(i, i + 2)

    assert sorted(r[0] for r in stored_parts(parts(), "parts").collect()) == [0, 1, 1, 2, 2, 3]
    assert seen == [[], ["parts"], ["parts"]]


def test_only_dispositions_and_lots_of_a_history_stay(make, left):
    accounts = make("id long, booking_method string, jurisdiction string, asset_class string", [(1, "FIFO", None, None), (2, "LIFO", None, None), (3, "HIFO", None, None)])
    lots = make(LOTS, [(10 * a + i, a, "X", 2, 10 + i, "USD", dt.date(2024, 1, 1 + i)) for a in (1, 2, 3) for i in range(2)])
    sales = make(SALES, [(100 + a, a, "X", 3, 20, "USD", dt.date(2024, 2, 1), 100 + a) for a in (1, 2, 3)])
    gone = lh.dispose_accepted(lots, sales, accounts)
    assert left() == ["dispositions", "lots"]
    assert sorted((r.lot_id, r.sale_id, int(r.quantity)) for r in gone.collect()) == [
        (10, 101, 2), (11, 101, 1), (20, 102, 1), (21, 102, 2), (30, 103, 1), (31, 103, 2)
    ]


def test_shuffled_rows_go_with_their_query(spark, left):
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(1 for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(place.getAllFiles()) if f.getName().startswith("shuffle_"))
    before = count()
    frame = stored(spark.range(1000).repartition(7, "id").groupBy("id").count(), "counts")
    assert frame.count() == 1000 and count() <= before


def test_postings_without_their_transaction_are_left_out(spark, make, left):
    from tallybook.ledger import Ledger

    start = Ledger.empty(spark).with_tables(accounts=make("id long, name string, type string, currency string, booking_method string, closed_at date", [(1, "A", "Assets", "USD", None, None), (2, "B", "Assets", "USD", None, None)]))
    start = start.with_tables(accounts=Ledger.empty(spark).accounts.unionByName(start.accounts, allowMissingColumns=True))
    transactions = make("id long, date date", [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")])
    postings = make("id long, transaction_id long, account_id long, amount decimal(18,8), currency string, price decimal(18,8), price_currency string", [
        (1, 1, 1, 5, "USD", None, None), (2, 1, 2, -5, "USD", None, None), (3, 2, 1, 5, "USD", None, None), (4, 2, 2, -4, "USD", None, None),
        (5, 9, 1, 1, "USD", None, None), (6, 9, 2, -1, "USD", None, None), (7, None, 1, 0, "USD", None, None),
    ])
    done = changes.submit_transactions(start, transactions, postings)
    assert sorted(r.id for r in done.ledger.postings.collect()) == [1, 2]
    assert sorted(r.id for r in done.ledger.transactions.collect()) == [1]
    assert "left_out" not in left() and "posted" in left()
