"""Statement files, imports, ledger changes, quotes and streams."""

import csv
import datetime as dt
import random
import shutil
from functools import reduce

import pytest
from conftest import rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook import Ledger
from tallybook.operators.dedup import first_copies, new_contents
from tallybook.plans import changes, ingest, summaries
from tallybook.schemas import TABLES
from tallybook.sources import exports, files, quotes, statements, tables
from tallybook.streaming import refresh as sr
from tallybook.streaming import statements as ss

CHECKING = """Posting Date,Description,Amount,Type,Balance
01/15/2024,"SHOP, ONLINE",-45.99,DEBIT,954.01
01/16/2024,COFFEE BAR,-4.50,DEBIT,949.51

01/17/2024,EMPLOYER INC,"5,000.00",CREDIT,5949.51
13/45/2024,BROKEN,-1.00,DEBIT,0
01/18/2024,NOTHING,0.00,DEBIT,0
"""
SAVINGS = """Bank of Somewhere
Statement;for;2023
Date;Narration;Withdrawal Amt.;Deposit Amt.
01/02/2023;SALARY;;150000.00
05/02/2023;"RENT ""FLAT"" 2; FEB";2500.00;0.00
total;;2500.00;150000.00
"""
MAPPING = {"date_col": "Posting Date", "date_format": "%m/%d/%Y", "payee_col": "Description", "amount_col": "Amount", "amount_sign": "negative_is_debit", "default_currency": "USD"}
SAVINGS_MAPPING = {"date_col": "Date", "date_format": "%d/%m/%Y", "narration_col": "Narration", "amount_sign": "separate_columns", "debit_col": "Withdrawal Amt.", "credit_col": "Deposit Amt.", "default_currency": "INR"}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "checking.csv").write_text(CHECKING)
    (tmp_path / "in" / "sub" / "copy.csv").write_text(CHECKING)
    (tmp_path / "in" / "savings.txt").write_text(SAVINGS)
    return tmp_path / "in"


def test_read_and_map(spark, folder):
    raw = statements.read_statements(spark, str(folder), recursive=False)
    got = rows(ingest.map_rows(raw, MAPPING), "row_index", "date", "payee", "amount")
    assert got == [(0, "2024-01-15", "SHOP, ONLINE", -45.99), (1, "2024-01-16", "COFFEE BAR", -4.5), (3, "2024-01-17", "EMPLOYER INC", 5000)]
    flipped = ingest.map_rows(raw, {**MAPPING, "amount_sign": "positive_is_debit"})
    assert rows(flipped, "amount")[0] == (-5000,)
    legs = rows(ingest.two_legs(ingest.map_rows(raw, MAPPING), "Assets:Bank"), "row_index", "leg", "account_name", "amount")
    assert legs[:2] == [(0, 0, "Assets:Bank", -45.99), (0, 1, "Expenses:Uncategorized", 45.99)]
    assert legs[-1] == (3, 1, "Income:Uncategorized", -5000)


def test_header_and_footer(spark, folder):
    lines = statements.read_lines(spark, str(folder), "*.txt")
    raw = statements.statement_rows(lines, 2, 1)
    got = rows(ingest.map_rows(raw, SAVINGS_MAPPING), "date", "narration", "currency", "amount")
    assert got == [("2023-02-01", "SALARY", "INR", 150000), ("2023-02-05", 'RENT "FLAT" 2; FEB', "INR", -2500)]
    assert rows(statements.file_formats(lines, 2), "file_type", "delimiter") == [("txt", ";")]
    modified = lines.select("file").distinct().withColumn("modified_at", F.lit("2001-05-05").cast("timestamp"))
    assert rows(statements.statement_years(lines, modified), "year") == [(2023,)]
    none = statements.statement_years(lines.filter("line_no < 2"), modified)
    assert rows(none, "year") == [(2001,)]
    assert statements.statement_rows(lines, 2, 99).count() == 0


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"user={i}").mkdir()
        (tmp_path / f"user={i}" / "a.csv").write_text("a,b\n1,2\n")
    context = spark.sparkContext
    context.setJobGroup("many-folders", "")
    try:
        lines = statements.read_lines(spark, str(tmp_path))
        tracker = context.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("many-folders") for s in tracker.getJobInfo(j).stageIds]
        assert max(tracker.getStageInfo(s).numTasks for s in stages) <= 64
        assert lines.count() == 200
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_lines_of_one_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "big"
    path.mkdir()
    (path / "big.csv").write_text("n,twice\n" + "".join(f"{i},{2 * i}\n" for i in range(5000)) + "end,end\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = statements.read_statements(spark, str(path), skip_footer_rows=1)
        assert raw.rdd.getNumPartitions() >= 1
        got = raw.select("row_index", F.col("data")["n"].cast("long").alias("n"), F.col("data")["twice"].cast("long").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_index"], r["n"], r["t"]) for r in got) == [(i, i, 2 * i) for i in range(5000)]


def _csv_rows(text, header_row, footer):
    """What a plain reader makes of a file, without blank records."""
    lines = text.splitlines(keepends=True)[header_row:]
    lines = lines[:-footer] if footer else lines
    return [{k: v for k, v in row.items()} for row in csv.DictReader(lines)]


def _random_value(rng):
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(["", "plain", "5'' pipe", 'inch 5"', "a b"])
    inner = "".join(rng.choice(["x", " ", ",", "\n", '""', "y"]) for _ in range(rng.randint(0, 9)))
    return f'"{inner}"' + rng.choice(["", "", "", "tail"])


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_quoted_line_breaks_over_splits(spark, tmp_path, split):
    rng = random.Random(split)
    folder = tmp_path / "quoted"
    folder.mkdir()
    texts = {}
    for k in range(6):
        head = ['title "with a quote'] * (k % 3) + ["id,one,two"]
        body = [f"{i},{_random_value(rng)},{_random_value(rng)}" for i in range(60)]
        feet = ['"open end'] * (k % 2)
        texts[f"f{k}.csv"] = (k % 3, k % 2, "\n".join([*head, *body, *feet]) + "\n")
        (folder / f"f{k}.csv").write_text(texts[f"f{k}.csv"][2])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        for name, (header, footer, text) in texts.items():
            got = statements.read_statements(spark, str(folder), header, footer, glob=name)
            found = [r["data"] for r in sorted(got.collect(), key=lambda r: r["row_index"])]
            assert found == _csv_rows(text, header, footer)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_outcomes_of_a_folder(spark, tmp_path):
    ledger, rules = Ledger.empty(spark), spark.createDataFrame(RULES, TABLES["categorization_rules"])
    head, day = "Posting Date,Description,Amount,Type,Balance\n", "01/15/2024"
    texts = {
        "a.csv": f'{head}{day},"two\nlines",-5.00,Sale,\n{day},zero,0,Sale,\n', "b.csv": f'{head}{day},"two\nlines",-5.00,Sale,\n{day},zero,0,Sale,\n',
        "c.csv": f'{head}{day},fine,-6.00,Sale,\n{day},"open,-7.00,Sale,\n', "d.csv": "", "e.csv": head, "f.pdf": "%PDF", "g.csv.gz": "no archive",
        "h.csv": f"{head}{day},other,-8.00,Sale,\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)

    def run(ledger, **options):
        done = ingest.import_folder(spark, ledger, str(tmp_path), MAPPING, "Assets:Bank", rules, glob=None, **options)
        found = {r["file"].rsplit("/", 1)[1]: (r["status"], r["reason"], r["total"], r["imported"]) for r in done.outcomes.collect()}
        return done, found

    done, found = run(ledger)
    assert found == {
        "a.csv": ("imported", None, 2, 1), "b.csv": ("skipped", "same content as another file", 0, 0), "c.csv": ("failed", "unclosed quote", 0, 0),
        "e.csv": ("imported", None, 0, 0), "f.pdf": ("failed", "unsupported type", 0, 0),
        "g.csv.gz": ("failed", "unreadable", 0, 0), "h.csv": ("imported", None, 1, 1),
    }
    assert tuple(done.result().first())[:3] == (3, 4, 2)  # Spark lists no empty files
    assert done.result().first()["errors"] == {"unclosed quote": 1, "unreadable": 1, "unsupported type": 1}
    after = done.ledger.stored()
    assert {r[0] for r in after.transactions.select("payee").collect()} == {"two\nlines", "other"}
    # A failed file is no source: mended, it is imported; the others are known by then.
    (tmp_path / "c.csv").write_text(f'{head}{day},fine,-6.00,Sale,\n{day},"closed",-7.00,Sale,\n')
    before = {name: summaries.registry.rebuild_one(name, after) for name in summaries.registry.names()}
    again, found = run(after, summaries=before)
    assert found["c.csv"] == ("imported", None, 2, 2) and found["a.csv"][:2] == ("skipped", "known content")
    assert again.ledger.transactions.count() == 4
    for name, df in again.summaries.items():
        assert rows(df) == rows(summaries.registry.rebuild_one(name, again.ledger), *df.columns), name


def test_summaries_know_what_they_are_derived_from():
    registry = summaries.Registry()
    one = lambda reads=(), **inputs: summaries.Summary(None, None, None, frozenset(reads), inputs)
    registry.register("top", one(["prices"], low="middle"))
    registry.register("middle", one(low="low"))
    registry.register("low", one(["postings"]))
    registry.register("other", one(["lots"]))
    order = registry.ordered()
    assert order.index("low") < order.index("middle") < order.index("top")
    assert registry.due(["postings"]) == ["low", "middle", "top"] and registry.due(["prices"]) == ["top"] and registry.due(["middle"]) == ["top"]
    registry.register("low", one(["postings"], high="top"))
    with pytest.raises(ValueError, match="derived from each other"):
        registry.ordered()


def test_contents_and_stream_lines_agree(spark, folder):
    path = str(folder)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.col("path").alias("file"), "content")
    assert rows(statements.lines_of(whole), "line_no", "line", "file_lines") == rows(statements.read_lines(spark, path, "*.txt"), "line_no", "line", "file_lines")
    found = files.read_files(spark, path)
    assert found.count() == 2 and first_copies(found, "sha256", "path").collect()[0]["copies"] == 2
    assert new_contents(found, files.source_file_rows(found)).count() == 0


def test_file_types(spark):
    df = spark.createDataFrame([("a/b.CSV",), ("a.b/c",), ("x.ofx",), ("x.dat",)], "p string")
    assert [r[0] for r in df.select(statements.file_type(F.col("p"))).collect()] == ["csv", "unknown", "ofx", "dat"]


RULES = [(1, "coffee", "substring", "Expenses:Coffee", None, 1), (2, "EMPLOYER", "regex", "Income:Salary", None, 1)]


def test_import(spark, folder):
    ledger = Ledger.empty(spark)
    rules = spark.createDataFrame(RULES, TABLES["categorization_rules"])
    raw = statements.read_statements(spark, str(folder), recursive=False).withColumn("source_file_id", F.lit(5).cast("long"))
    done = ingest.import_rows(ledger, raw, MAPPING, "Assets:Bank", rules)
    done = ingest.Imported(done.ledger.stored(), done.stats, done.affected)
    assert rows(done.stats, "total", "imported", "skipped") == [(5, 3, 2)]
    assert rows(done.ledger.accounts, "name", "type") == [
        ("Assets:Bank", "Assets"), ("Expenses:Coffee", "Expenses"), ("Expenses:Uncategorized", "Expenses"), ("Income:Salary", "Income")]
    assert done.ledger.postings.agg(F.sum("amount")).first()[0] == 0 and done.ledger.raw_extractions.count() == 5
    assert (done.affected.date_from.isoformat(), done.affected.date_to.isoformat()) == ("2024-01-15", "2024-01-17")
    # the same rows from another file are all near duplicates
    again = ingest.import_rows(done.ledger, raw.withColumn("source_file_id", F.lit(6).cast("long")), MAPPING, "Assets:Bank", rules)
    after = again.ledger.stored()
    assert rows(again.stats, "imported", "skipped") == [(0, 5)] and after.postings.count() == 6
    undone = changes.undo_imports(after, spark.createDataFrame([(5,)], "source_file_id long"))
    assert undone.ledger.postings.count() == 0 and undone.ledger.raw_extractions.count() == 5
    kept = ingest.import_rows(ledger, raw, None, "Assets:Bank", rules)
    assert kept.ledger.raw_extractions.count() == 5 and rows(kept.stats, "needs_mapping", "skipped") == [(True, 5)]


def _broker(spark, make):
    accounts = spark.createDataFrame([(1, "Assets:Broker:Main", "Assets", "USD", "FIFO"), (2, "Assets:Bank:Main", "Assets", "USD", None)],
                                     "id long, name string, type string, currency string, booking_method string")
    empty = Ledger.empty(spark)
    return empty.with_tables(accounts=empty.accounts.unionByName(accounts, allowMissingColumns=True))


HEAD = "id long, uuid string, date date, payee string"
LEGS = "id long, transaction_id long, account string, amount decimal(18,8), currency string, price decimal(18,8), price_currency string"


def _batch(make):
    heads = make(HEAD, [(1, "a", "2024-01-02", "buy"), (2, "b", "2024-02-02", "sell"), (3, "c", "2024-02-03", "bad"), (4, "d", "2024-02-04", "short")])
    legs = make(LEGS, [
        (10, 1, "Assets:Broker:Main", 10, "X", 100, "USD"), (11, 1, "Assets:Bank:Main", -1000, "USD", None, None),
        (20, 2, "assets:broker:mian", -4, "X", 120, "USD"), (21, 2, "Assets:Bank:Main", 480, "USD", None, None),
        (30, 3, "Assets:Bank:Main", 5, "USD", None, None),
        (40, 4, "Assets:Broker:Main", -7, "X", 130, "USD"), (41, 4, "Assets:Bank:Main", 910, "USD", None, None),
    ])
    return heads, legs


def test_submit_and_amend(spark, make):
    start = _broker(spark, make)
    done = changes.submit_transactions(start, *_batch(make))
    assert rows(done.exceptions, "transaction_id", "rule") == [(3, "unbalanced"), (4, "insufficient_lots")]
    ledger = done.ledger.stored()
    assert rows(ledger.lots, "id", "quantity", "cost_price") == [(10, 6, 100)]
    assert rows(ledger.lot_dispositions, "lot_id", "quantity", "gain_loss", "term") == [(10, 4, 80, "short")]
    assert rows(ledger.prices, "commodity", "date", "price")[0] == ("X", "2024-01-02", 100)

    updates = make("uuid string, delete boolean, date date", [("b", True, None), ("a", False, "2024-01-05"), ("zz", True, None)])
    after = changes.amend_transactions(ledger, updates)
    # the deleted sale frees what the later one needs
    assert rows(after.ledger.lots, "quantity", "acquired_date") == [(3, "2024-01-05")]
    assert rows(after.exceptions, "rule", "detail") == [("unknown_uuid", "zz")]
    assert rows(after.ledger.transactions, "id", "date") == [(1, "2024-01-05"), (4, "2024-02-04")]

    new = make("uuid string, " + LEGS.replace("transaction_id long, account string", "account_id long"), [
        ("a", 12, 1, 20, "X", 50, "USD"), ("a", 13, 2, -1000, "USD", None, None)])
    replaced = changes.amend_transactions(ledger, make("uuid string, delete boolean", [("a", False)]), new)
    assert rows(replaced.ledger.lots, "id", "quantity", "cost_price") == [(12, 9, 50)]
    bad = changes.amend_transactions(ledger, make("uuid string, delete boolean", [("a", False)]), new.filter("id = 12"))
    assert rows(bad.exceptions, "rule") == [("unbalanced",)] and bad.ledger.lots.count() == 1


def test_quotes(spark):
    stock = spark.createDataFrame([("abc", 0.0, 5.5, 1.0, "eur", None), ("DEF", None, None, 2.0, None, None), ("g", None, None, None, None, None)],
                                  "symbol string, regularMarketPrice double, previousClose double, lastClose double, currency string, date date")
    good, bad = quotes.stock_prices(stock)
    assert rows(good, "commodity", "currency", "price") == [("ABC", "EUR", 5.5), ("DEF", "USD", 2)] and rows(bad, "item") == [("g",)]
    coins = spark.createDataFrame([(None, {"bitcoin": {"usd": 9.5}, "ether": {"eur": 1.0}})], quotes.COIN_SCHEMA)
    good, bad = quotes.coin_prices(coins, spark.createDataFrame([("Bitcoin",), ("ether",), ("none",)], "coin string"))
    assert rows(good, "commodity", "price") == [("BITCOIN", 9.5)]
    assert rows(bad) == [("ether", "price in USD not available"), ("none", "not found")]
    rates = spark.createDataFrame([(None, "usd", {"INR": 83.5})], quotes.FOREX_SCHEMA)
    good, bad = quotes.forex_rates(rates, spark.createDataFrame([("usd", "inr"), ("USD", "JPY")], "base string, quote string"))
    assert rows(good, "commodity", "currency", "price") == [("USD", "INR", 83.5)] and rows(bad, "item") == [("USD/JPY",)]


def test_mappings_and_exports(spark, tmp_path):
    def saved(name, body):
        return spark.createDataFrame([(name, None, body)], TABLES["column_mappings"])

    table = tables.save_mappings(tables.save_mappings(saved("a", '{"date_col": "x"}'), saved("b", "{}")), saved("a", '{"date_col": "y", "header_row": 2}'))
    assert rows(tables.load_mapping(table, "a"), "date_col", "header_row") == [("y", 2)] and table.count() == 2
    df = spark.sql("select 1 id, cast(1.50 as decimal(10,2)) v, cast(null as string) n")
    assert exports.json_rows(df, pretty=False).first()[0] == '{"id":1,"v":"1.50","n":null}'
    exports.export_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["v"] == "1.50"


def test_statement_stream(spark, folder, tmp_path):
    rules = spark.createDataFrame(RULES, TABLES["categorization_rules"])
    root, start = str(tmp_path / "out"), Ledger.empty(spark)

    def run():
        watched = ss.watch_folder(spark, str(folder))
        q = ss.import_stream(watched, root, start, MAPPING, "Assets:Bank", rules).trigger(availableNow=True).start()
        q.awaitTermination()
        return ss.read_state(spark, root, q.lastProgress["batchId"], start)

    first = run()  # the copy in the sub-folder adds nothing
    assert first.transactions.count() == 3 and first.source_files.count() == 1
    shutil.copy(folder / "checking.csv", folder / "third.csv")
    (folder / "more.csv").write_text("Posting Date,Description,Amount\n03/01/2024,COFFEE BAR,-6.00\n")
    (folder / "odd name.csv").write_text('Posting Date,Description,Amount\n03/02/2024,"open,-6.00\n')
    second = run()
    assert second.transactions.count() == 4 and second.source_files.count() == 2
    assert rows(ss.read_outcomes(spark, root, 9), "reason", "total") == [("unclosed quote", 0), (None, 1), (None, 5)]
    # What the first batch wrote is not written again, and a batch that is tried twice changes nothing.
    new = [p for p in (tmp_path / "out" / "transactions" / "batch=1").rglob("*.parquet")]
    assert spark.read.parquet(*map(str, new)).count() == 1
    files = spark.createDataFrame([(f"file:{folder}/later.csv", f"file:{folder}/later.csv", 0, "f0" * 32)], "path string, file string, length long, sha256 string").withColumn("modified_at", F.current_timestamp())
    (folder / "later.csv").write_text("Posting Date,Description,Amount\n01/18/2024,COFFEE BAR,-4.50\n04/01/2024,COFFEE BAR,-7.00\n")
    for _ in range(2):
        ss.import_batch(files, 2, root, start, MAPPING, "Assets:Bank", rules)
    third = ss.read_state(spark, root, 2, start)
    # One of the two rows has been there two days before; only months around the batch's days are looked at.
    assert third.transactions.count() == 5 and third.postings.count() == 10 and third.source_files.count() == 3
    assert third.accounts.groupBy("name").count().filter("count > 1").count() == 0
    empty = files.limit(0)
    ss.import_batch(empty, 3, root, start, MAPPING, "Assets:Bank", rules)
    assert ss.read_state(spark, root, 3, start).transactions.count() == 5


def test_streamed_statements_derive_accounts_alone(spark, tmp_path):
    from tallybook.catalog.binding import Binding
    from tallybook.catalog.ingest_queries import streamed_statements

    for name in ("customer", "nation", "part", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 3").write.parquet(str(tmp_path / "events.parquet"))
    found = rows(streamed_statements(Binding(spark, str(tmp_path))), "account", "n")  # there are no orders here to derive
    n = spark.read.parquet(str(tmp_path / "events.parquet")).filter("round(value, 2) <> 0").count()
    assert dict(found)["Assets:Bank:Checking"] == n and sum(k for _, k in found) == 2 * n


def test_near_duplicates_read_the_months_around_a_batch(spark, folder, tmp_path):
    ledger, rules = Ledger.empty(spark), spark.createDataFrame(RULES, TABLES["categorization_rules"])
    raw = statements.read_statements(spark, str(folder), recursive=False).withColumn("source_file_id", F.lit(5).cast("long"))
    first = ingest.import_rows(ledger, raw, MAPPING, "Assets:Bank", rules).ledger.laid_out(str(tmp_path / "laid"))
    own = first.accounts.filter("name = 'Assets:Bank'").select(F.col("id").alias("account_id"))
    day = dt.date(2024, 1, 16)
    near = ingest.near_ledger_rows(first, own, day, day, 3)
    assert near.count() == 3 and ingest.near_ledger_rows(first, own, dt.date(2024, 3, 16), day.replace(month=4), 3).count() == 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(ledger_month") == 2 and "GreaterThanOrEqual(date,2024-01-13)" in plan
    again = ingest.import_rows(first, raw.withColumn("source_file_id", F.lit(6).cast("long")), MAPPING, "Assets:Bank", rules)
    assert rows(again.stats, "imported", "skipped") == [(0, 5)] and again.ledger.postings.count() == 6


def test_refresh_stream_retry(spark, make, tmp_path):
    root = str(tmp_path / "s")
    base = Ledger.empty(spark)
    accounts = spark.createDataFrame([(1, "Assets:A", "Assets", "USD"), (2, "Expenses:B", "Expenses", "USD")], "id long, name string, type string, currency string")
    base = base.with_tables(accounts=base.accounts.unionByName(accounts, allowMissingColumns=True))
    posted = "id long, transaction_id long, account_id long, amount decimal(18,8), currency string, date date"

    def part(*entries):
        out = [r for i, (d, v) in entries for r in ((2 * i, i, 1, -v, "USD", d), (2 * i + 1, i, 2, v, "USD", d))]
        return make(posted, out).withColumn("amount", F.col("amount").cast("decimal(18,2)"))

    names = ["s_daily_balances", "s_monthly_spending", "s_account_monthly_balances", "s_net_worth"]
    batches = [
        part((1, ("2024-03-01", 5)), (2, ("2024-05-01", 7)), (5, ("2024-05-01", 1))), part((9, ("2024-01-01", 1))).limit(0),
        part((3, ("2024-02-01", 2)), (4, ("2024-03-09", 3))), part((6, ("2024-06-01", 4)), (7, ("2024-06-01", 4))),
    ]
    versions = {}
    for i in (0, 1, 2, 2, 3):  # the third batch is tried twice
        sr.refresh_batch(batches[i], i, root, buckets=2)
        versions[i] = {(r.year_month, r.bucket): r.version for r in sr._versions(spark, root, i).collect()}
    every = reduce(DataFrame.unionByName, batches)
    whole = base.with_tables(transactions=every.selectExpr("transaction_id id", "date").distinct(), postings=every.drop("date"))
    for name in names:
        expected = summaries.registry.rebuild_one(name, whole)
        assert rows(sr.read_summary(spark, root, name, 3, base), *expected.columns) == rows(expected), name
    # A batch writes the months and buckets it touches and no others; an empty one writes none.
    assert versions[1] == versions[0] and {k[0] for k, v in versions[0].items() if v == 0} == {"2024-03", "2024-05"}
    assert {k[0] for k, v in versions[2].items() if v == 2} == {"2024-02", "2024-03"} and {k[0] for k, v in versions[3].items() if v == 3} == {"2024-06"}
    written = {p.parent.parent.name for p in (tmp_path / "s" / "days" / "version=3").rglob("*.parquet")}
    assert written == {"year_month=2024-06"}
    # An earlier batch can still be read, until it is cleared away.
    early = summaries.registry.rebuild_one("s_daily_balances", base.with_tables(transactions=batches[0].selectExpr("transaction_id id", "date").distinct(), postings=batches[0].drop("date")))
    assert rows(sr.read_summary(spark, root, "s_daily_balances", 1, base), *early.columns) == rows(early)
    before = rows(sr.read_summary(spark, root, "s_daily_balances", 3, base))
    sr.vacuum(spark, root, 3)
    assert rows(sr.read_summary(spark, root, "s_daily_balances", 3, base)) == before
    assert not list((tmp_path / "s" / "days" / "version=0" / "year_month=2024-03").rglob("*.parquet"))
    with pytest.raises(KeyError):
        sr.read_summary(spark, root, "s_portfolio_holdings", 3, base)


def test_adhoc_sql_only_queries(spark, make):
    mine = make("id long", [(7,)])
    mine.createOrReplaceTempView("t")
    table = make("id long", [(1,), (2,)])
    got = tables.run_query(spark, "WITH x AS (SELECT * FROM t) SELECT id FROM x WHERE id > :least ORDER BY id;", {"t": table}, {"least": 1})
    assert rows(got) == [(2,)]
    assert rows(spark.table("t")) == [(7,)]  # the session's own view is back
    for text in ("CREATE TABLE u AS SELECT 1 AS a", "DROP TABLE t", "CREATE TEMP VIEW u AS SELECT 1 AS a", "INSERT INTO t SELECT 3", "SELECT 1) x; DROP TABLE t"):
        with pytest.raises(Exception):
            tables.run_query(spark, text, {"t": table})
    spark.catalog.dropTempView("t")


def test_one_mapping_of_a_name_per_batch(make):
    new = make("name string, mapping string", [("a", '{"date_col": "y"}'), ("a", '{"date_col": "z"}'), ("b", "{}")])
    assert rows(tables.save_mappings(new.limit(0), new), "name", "mapping") == [("a", '{"date_col": "z"}'), ("b", "{}")]


def test_unbooked_and_rejected_sales(make):
    from tallybook.operators import lot_history, lots

    methods = ["FIFO", "LIFO", "HIFO", None, "Average", "NONE", "AVG", "SPEC", "lifo"]
    accounts = make("id long, booking_method string, jurisdiction string, asset_class string", [(i, m, None, None) for i, m in enumerate(methods)])
    lot = "id long, account_id long, commodity string, original_quantity decimal(18,8), quantity decimal(18,8), cost_price decimal(18,8), cost_currency string, acquired_date date, disposed boolean"
    held = make(lot, [(i, i, "X", 10, 10, 1, "USD", "2024-01-01", False) for i in range(9)]).withColumn("disposed", F.lit(False))
    sale = "id long, account_id long, commodity string, quantity decimal(18,8), proceeds_per_unit decimal(18,8), proceeds_currency string, sell_date date, sell_transaction_id long"
    sales = make(sale, [(100 + i, i, "X", 7 if i else 11, 2, "USD", "2024-02-01", i) for i in range(9)])
    done = rows(lot_history.dispose_history(held, sales, accounts), "sale_id")
    left = rows(lot_history.unbooked_sales(held, sales, accounts), "sale_id", "rule")
    assert done == [(101,), (102,)]
    assert left == [(100, "insufficient_lots"), *[(100 + i, "unknown_method") for i in range(3, 9)]]

    demands = sales.filter("account_id = 1").unionByName(sales.filter("account_id = 1").withColumn("id", F.lit(200).cast("long"))).withColumn("booking_method", F.lit("LIFO"))
    booked = lots.book_sales(held, demands, accounts)
    assert rows(booked, "sale_id", "quantity") == [(101, 7)]
    asked = demands.select(F.col("id").alias("demand_id"), "account_id", "commodity", F.col("quantity").alias("demand"), "booking_method")
    assert rows(lots.rejected(held, asked), "demand_id", "rule") == [(200, "second_demand")]


def test_splits_and_transfers_survive_later_changes(spark, make):
    start = Ledger.empty(spark).with_tables(
        accounts=make("id long, name string, type string, currency string, booking_method string", [
            (1, "Assets:A", "Assets", "USD", "FIFO"), (2, "Assets:B", "Assets", "USD", "FIFO"), (3, "Assets:Cash", "Assets", "USD", None)]),
        currency_tolerances=make("currency string, tolerance decimal(18,8)", [("USD", 0.01)]),
    )
    start = Ledger(**{n: changes._as(t, start.empty(spark).tables()[n]) for n, t in start.tables().items()})
    legs = "id long, transaction_id long, account_id long, amount decimal(18,8), currency string, price decimal(18,8), price_currency string"

    def post(ledger, number, day, account, amount, price):
        headers = make("id long, uuid string, date date, status string", [(number, str(number), day, "cleared")])
        units = make(legs, [(number * 10, number, account, amount, "X", price, "USD"), (number * 10 + 1, number, 3, -amount * price, "USD", None, None)])
        done = changes.submit_transactions(ledger, headers, units)
        return done.ledger.stored(), rows(done.exceptions, "transaction_id", "rule")

    ledger, _ = post(start, 1, "2024-01-10", 1, 10, 100)
    split = make("action_id long, commodity string, action_type string, ratio decimal(18,8), effective_date date", [(1, "X", "split", 2, "2024-03-01"), (2, "X", "merge", 2, "2024-03-01")])
    done = changes.record_actions(ledger, split)
    assert rows(done.exceptions, "rule") == [("unsound_action",)]
    ledger = done.ledger.stored()
    assert rows(ledger.lots, "quantity", "cost_price") == [(20, 50)]
    # a later purchase leaves the split lot as it is; selling all of it gains 20 * (70 - 50)
    bought, bad = post(ledger, 2, "2024-04-01", 1, 1, 60)
    assert rows(bought.lots, "quantity", "cost_price") == [(1, 60), (20, 50)] and bad == []
    sold, bad = post(bought, 3, "2024-05-01", 1, -20, 70)
    assert bad == [] and rows(sold.lot_dispositions, "quantity", "gain_loss") == [(20, 400)]
    assert rows(sold.lots.filter("not disposed"), "quantity", "cost_price") == [(1, 60)]

    move = make("transfer_id long, from_account_id long, to_account_id long, commodity string, quantity decimal(18,8), booking_method string, date date", [(5, 1, 2, "X", 8, "FIFO", "2024-06-01")])
    moved = changes.record_transfers(bought, move).ledger.stored()
    held = [(1, 1, 60), (1, 12, 50), (2, 8, 50)]
    assert rows(moved.lots, "account_id", "quantity", "cost_price") == held
    more, bad = post(moved, 6, "2024-07-01", 2, -3, 80)
    assert bad == [] and rows(more.lot_dispositions, "quantity", "gain_loss") == [(3, 90)]
    assert rows(more.lots, "account_id", "quantity", "cost_price") == [*held[:2], (2, 5, 50)]
    # A sale dated before the transfer is sold from what was there then; deleting the later sale gives its lots back.
    early, bad = post(more, 8, "2024-05-15", 1, -1, 90)
    assert bad == [] and rows(early.lot_dispositions, "quantity", "gain_loss") == [(1, 40), (3, 90)]
    assert rows(early.lots, "account_id", "quantity", "cost_price") == [(1, 1, 60), (1, 11, 50), (2, 5, 50)]
    gone = changes.amend_transactions(early, make("uuid string, delete boolean", [("6", True)])).ledger.stored()
    assert rows(gone.lots, "account_id", "quantity", "cost_price") == [(1, 1, 60), (1, 11, 50), (2, 8, 50)]
    # Without the purchase there is nothing to transfer, which is reported; the sale takes the later lot.
    none = changes.amend_transactions(gone, make("uuid string, delete boolean", [("1", True)]))
    assert rows(none.exceptions, "rule", "detail") == [("transfer_insufficient_lots", "5")]
    assert rows(none.ledger.lots, "account_id", "quantity", "cost_price") == [(1, 0, 60)]
    undated = changes.record_transfers(gone, move.withColumn("date", F.lit(None).cast("date")))
    assert rows(undated.exceptions, "rule", "detail") == [("transfer_undated", "5")] and undated.ledger.transfers.count() == 1
