"""Statement ingestion, matching, deduplication, changes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.catalog.binding import Binding
from tallybook.catalog.registry import query
from tallybook.functions.amounts import parse_amount, parse_date
from tallybook.ledger import Ledger
from tallybook.operators import dedup, matching, rules
from tallybook.operators.accounts import missing_accounts
from tallybook.operators.prices import upsert_prices
from tallybook.plans import changes, ingest, summaries
from tallybook.schemas import TABLES
from tallybook.session import scratch_path, stored
from tallybook.sources import exports, files, quotes, statements, tables
from tallybook.streaming import refresh as stream_refresh
from tallybook.streaming import statements as stream_statements

# The statement rows as the oracle sees them.
_ROWS = """
    rows AS (SELECT event_id AS row_index, ts::DATE AS date, upper(event_type) || ' ' || user_id AS payee,
                    ((CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END) * value::DECIMAL(18,2) * 10)::DECIMAL(18,2) AS amount
             FROM events)"""

# ---- parsing ----

_DATES = """
    WITH texts AS (
        SELECT event_id, CASE event_type
               WHEN 'click' THEN strftime(ts, '%m/%d/%Y') WHEN 'view' THEN strftime(ts, '%-d-%-m-%Y') WHEN 'error' THEN strftime(ts, '%Y/%m/%d')
               WHEN 'purchase' THEN strftime(ts, '%m/%d/%y') ELSE strftime(ts, '%d %b %Y') END AS text FROM events)
    SELECT event_id, text, CASE WHEN text LIKE '% %' THEN NULL
           WHEN regexp_matches(text, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$') THEN try_strptime(text, ['%m/%d/%y', '%d/%m/%y'])::DATE
           ELSE try_strptime(text, ['%m/%d/%Y', '%m-%d-%Y', '%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%d-%m-%Y'])::DATE END AS date
    FROM texts"""


@query("X3", _DATES)
def parsed_dates(b: Binding) -> DataFrame:
    """Dates in five spellings; day-first ones are read month-first where they can be."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.date_format("ts", "MM/dd/yyyy")).when(kind == "view", F.date_format("ts", "d-M-yyyy"))
        .when(kind == "error", F.date_format("ts", "yyyy/MM/dd")).when(kind == "purchase", F.date_format("ts", "MM/dd/yy"))
        .otherwise(F.date_format("ts", "dd MMM yyyy"))
    )
    return b.table("events").select("event_id", text.alias("text")).withColumn("date", parse_date(F.col("text")))


@query("X2", """
    SELECT event_id, CASE event_type WHEN 'click' THEN value::DECIMAL(18,2) * 1000 WHEN 'view' THEN value::DECIMAL(18,2)
           WHEN 'error' THEN NULL WHEN 'purchase' THEN 0 ELSE -value::DECIMAL(18,2) END::DECIMAL(18,2) AS amount FROM events""",
    amount="decimal(18,2)")
def parsed_amounts(b: Binding) -> DataFrame:
    """Thousands separators, currency signs, parentheses (dropped), junk and a lone minus."""
    value, kind = F.col("value").cast("decimal(18,2)"), F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit(" $"), F.format_number(value * 1000, 2)))
        .when(kind == "view", F.concat(F.lit("("), value.cast("string"), F.lit(")")))
        .when(kind == "error", F.concat(value.cast("string"), F.lit(" approx"))).when(kind == "purchase", F.lit("-"))
        .otherwise(F.concat(F.lit("-₹"), value.cast("string")))
    )
    return b.table("events").select("event_id", parse_amount(text).alias("amount"))


@query("X5 X4 X2 X3", f"""
    WITH {_ROWS}
    SELECT row_index, date, payee, 'USD' AS currency, 0::INTEGER AS leg, 'Assets:Bank:Checking' AS account_name, amount FROM rows WHERE amount <> 0 UNION ALL
    SELECT row_index, date, payee, 'USD', 1, CASE WHEN amount < 0 THEN 'Expenses:Uncategorized' ELSE 'Income:Uncategorized' END, -amount
    FROM rows WHERE amount <> 0""", amount="decimal(18,2)")
def mapped_statement(b: Binding) -> DataFrame:
    """Every event as a statement row, mapped to its two postings."""
    rows = ingest.map_rows(b.statement_rows, b.MAPPING)
    return ingest.two_legs(rows, "Assets:Bank:Checking").select("row_index", "date", "payee", "currency", "leg", "account_name", "amount")


@query("X4 X5", """
    SELECT event_id AS row_index, ts::DATE AS date, event_type AS narration, 'INR' AS currency,
           (CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END)::DECIMAL(18,2) AS amount
    FROM events WHERE event_type <> 'error' AND value <> 0""", amount="decimal(18,2)")
def separate_columns_statement(b: Binding) -> DataFrame:
    """Withdrawals and deposits in two columns; errors have a plain zero."""
    credit = F.col("event_type").isin("purchase", "signup")
    text = F.format_number("value", 2)
    raw = b.table("events").select(
        F.col("event_id").alias("row_index"),
        F.create_map(
            F.lit("Date"), F.date_format("ts", "dd/MM/yyyy"), F.lit("Narration"), F.concat(F.lit(" "), "event_type"),
            F.lit("Withdrawal Amt."), F.when(F.col("event_type") == "error", "0.00").when(~credit, text).otherwise(""),
            F.lit("Deposit Amt."), F.when(credit, text),
        ).alias("data"),
    )
    mapping = {
        "date_col": "Date", "date_format": "%d/%m/%Y", "narration_col": "Narration", "amount_sign": "separate_columns",
        "debit_col": "Withdrawal Amt.", "credit_col": "Deposit Amt.", "default_currency": "INR",
    }
    return ingest.map_rows(raw, mapping).select("row_index", "date", "narration", "currency", "amount")


@query("S8 X14", """
    SELECT 1::BIGINT AS source_file_id, event_id AS row_index, 'Posting Date' AS key, strftime(ts, '%m/%d/%Y') AS value FROM events UNION ALL
    SELECT 1, event_id, 'Description', upper(event_type) || ' ' || user_id FROM events UNION ALL
    SELECT 1, event_id, 'Balance', NULL FROM events""")
def raw_rows_as_json(b: Binding) -> DataFrame:
    """Raw rows kept as JSON, read back key by key; NULLs survive."""
    data = F.map_filter(F.transform_values("data", lambda k, v: F.nullif(v, F.lit(""))), lambda k, v: k != "Amount")
    kept = ingest.raw_extraction_rows(b.statement_rows.withColumn("data", data))
    parsed = F.from_json("raw_data", "map<string,string>")
    return kept.select("source_file_id", "row_index", F.explode(parsed).alias("key", "value"))


# ---- statement files ----


def _statement_files(b: Binding, broken: bool = False, faulty: bool = False) -> str:
    """The events as one CSV per user, in folders by the beginning of the user's number
    so that none holds all of them, with a title line above the header and a footer
    line below the rows.

    ``broken``: descriptions are quoted and hold a line break, a separator and quotes.
    ``faulty``: in every tenth user's file the last value's quote is not closed.
    """
    amount = F.concat(F.when(F.col("event_type").isin("purchase", "signup"), "").otherwise("-"), F.lit("$"), F.format_number(F.col("value") * 10, 2))
    payee = F.concat_ws(" ", F.upper("event_type"), F.col("user_id").cast("string"))
    if broken:
        payee = F.concat(F.lit('"'), F.upper("event_type"), F.lit(' ""No.""\n'), F.col("user_id").cast("string"), F.lit(', end"'))
    line = F.concat_ws(
        ",", F.date_format("ts", "MM/dd/yyyy"), payee, F.concat(F.lit('"'), amount, F.lit('"')), F.col("event_id").cast("string"),
    )
    events = b.table("events").select("user_id", F.col("event_id").alias("at"), line.alias("value"))
    users = events.select("user_id").distinct()
    first = users.select("user_id", F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("at"), F.lit("Account activity").alias("value")),
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit("Posting Date,Description,Amount,Ref").alias("value")),
        F.struct(F.lit(1 << 62).alias("at"), F.lit("End of statement").alias("value")),
    )).alias("l")).select("user_id", "l.at", "l.value")
    rows = events.unionByName(first)
    if faulty:
        rows = rows.unionByName(users.filter("user_id % 10 = 3").select(
            "user_id", F.lit((1 << 62) - 1).alias("at"), F.lit('01/31/2024,"never closed,1.00,0').alias("value")
        ))
    root = scratch_path(b.spark, "statements")
    # One small file a user: a matter of how many are written, not of bytes, so tasks aren't put together by bytes.
    shelved = rows.repartition(2 * b.spark.sparkContext.defaultParallelism, "user_id").withColumn("users", F.substring(F.col("user_id").cast("string"), 1, 3))
    ordered = shelved.sortWithinPartitions("users", "user_id", "at")
    ordered.select("users", "user_id", "value").write.partitionBy("users", "user_id").text(root)
    return root


@query("S2 S3 S5", """
    SELECT user_id::VARCHAR AS folder, event_id::VARCHAR AS ref, strftime(ts, '%m/%d/%Y') AS date, upper(event_type) || ' ' || user_id AS description
    FROM events""")
def statement_file_rows(b: Binding) -> DataFrame:
    """One file per user below a folder, read recursively with a title line and a footer."""
    rows = statements.read_statements(b.spark, _statement_files(b), header_row=1, skip_footer_rows=1, glob="*.txt")
    return rows.select(
        F.regexp_extract("file", r"user_id=(\d+)", 1).alias("folder"), F.col("data")["Ref"].alias("ref"),
        F.col("data")["Posting Date"].alias("date"), F.col("data")["Description"].alias("description"),
    )


@query("S2", """
    SELECT user_id::VARCHAR AS folder, event_id::VARCHAR AS ref, strftime(ts, '%m/%d/%Y') AS date,
           upper(event_type) || ' "No."' || chr(10) || user_id || ', end' AS description
    FROM events""")
def quoted_line_breaks(b: Binding) -> DataFrame:
    """The same files with line breaks, separators and quotes inside quoted values."""
    rows = statements.read_statements(b.spark, _statement_files(b, broken=True), header_row=1, skip_footer_rows=1, glob="*.txt")
    return rows.select(
        F.regexp_extract("file", r"user_id=(\d+)", 1).alias("folder"), F.col("data")["Ref"].alias("ref"),
        F.col("data")["Posting Date"].alias("date"), F.col("data")["Description"].alias("description"),
    )


@query("S3 S4 S7 S5 A23", """
    SELECT user_id::VARCHAR AS folder, 'txt' AS file_type, ',' AS delimiter, 4::BIGINT AS columns, count(*)::BIGINT AS total, 2024::INTEGER AS year
    FROM events GROUP BY user_id""", year="int")
def statement_file_formats(b: Binding) -> DataFrame:
    """Type, delimiter, width, row count and year per file."""
    lines = statements.read_lines(b.spark, _statement_files(b), glob="*.txt")
    formats = statements.file_formats(lines, 1).select("file", "file_type", "delimiter", F.size("header").cast("long").alias("columns"))
    counts = statements.statement_rows(lines, 1, 1).groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    touched = lines.select("file").distinct().withColumn("modified_at", F.lit("1999-01-01").cast("timestamp"))
    years = statements.statement_years(lines, touched)
    return formats.join(counts, "file").join(years, "file").select(
        F.regexp_extract("file", r"user_id=(\d+)", 1).alias("folder"), "file_type", "delimiter", "columns", "total", "year"
    )


@query("S6 U3", """
    SELECT count(*)::BIGINT AS files, (SELECT count(DISTINCT user_id) FROM events WHERE user_id >= 50)::BIGINT AS new_files
    FROM (SELECT DISTINCT user_id FROM events)""")
def new_statement_files(b: Binding) -> DataFrame:
    """Files hashed by content; those of users below 50 were loaded before."""
    found = files.read_files(b.spark, _statement_files(b), glob="*.txt")
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long")
    loaded = files.source_file_rows(found.filter(user < 50))
    fresh = dedup.new_contents(found, loaded)
    return found.agg(F.count(F.lit(1)).alias("files")).join(fresh.agg(F.count(F.lit(1)).alias("new_files")))


@query("S6 X14 U3", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def first_copies(b: Binding) -> DataFrame:
    """Documents by content hash, the first of equal ones kept."""
    hashed = dedup.with_content_hash(b.table("documents"), "text").select("sha256", "doc_id")
    return dedup.first_copies(hashed, "sha256", "doc_id")


# ---- near duplicates ----


def _event_rows(b: Binding) -> DataFrame:
    """Account (kind of event), payee (user; none for every seventh day), amount, date."""
    day = F.col("ts").cast("date")
    return b.table("events").select(
        F.col("event_id").alias("row_id"), F.ascii("event_type").cast("long").alias("account_id"),
        F.round(F.col("value")).cast("decimal(18,2)").alias("amount"),
        F.when(F.dayofmonth(day) % 7 != 0, F.concat(F.lit("user "), (F.col("user_id") / 10).cast("int").cast("string"))).alias("payee"), day.alias("date"),
    )


_EVENT_ROWS = """
    rows AS (SELECT event_id AS row_id, ascii(event_type)::BIGINT AS account_id, round(value)::DECIMAL(18,2) AS amount,
                    CASE WHEN day(ts) % 7 <> 0 THEN 'user ' || (user_id // 10) END AS payee, ts::DATE AS date FROM events)"""


@query("J12 U3", f"""
    WITH {_EVENT_ROWS}
    SELECT row_id, account_id, amount, payee, date FROM rows r WHERE date > DATE '2024-01-15' AND NOT EXISTS (
        SELECT 1 FROM rows l WHERE l.date <= DATE '2024-01-15' AND l.account_id = r.account_id AND l.amount = r.amount
               AND l.payee IS NOT DISTINCT FROM r.payee AND l.date BETWEEN r.date - 3 AND r.date + 3)""")
def near_duplicates_dropped(b: Binding) -> DataFrame:
    """The second half of January against a ledger of the first."""
    rows, cut = _event_rows(b), F.lit("2024-01-15").cast("date")
    ledger = rows.filter(F.col("date") <= cut).drop("row_id")
    return dedup.drop_near_duplicates(rows.filter(F.col("date") > cut), ledger).select("row_id", "account_id", "amount", "payee", "date")


@query("J12", f"""
    WITH {_EVENT_ROWS},
    days AS (SELECT account_id, amount, payee, date, min(row_id) AS row_id FROM rows GROUP BY 1, 2, 3, 4),
    gaps AS (SELECT row_id, date - lag(date) OVER (PARTITION BY account_id, amount, payee ORDER BY date) AS gap FROM days)
    SELECT row_id FROM gaps WHERE gap IS NULL OR gap > 3""")
def near_duplicates_within_batch(b: Binding) -> DataFrame:
    rows = _event_rows(b)
    return dedup.drop_near_duplicates(rows, rows.limit(0).drop("row_id"), within_batch=True).select("row_id")


# ---- rules ----

# Fixed values: (id, pattern, type, target, institution, priority).
_RULES = [
    (1, "error", "substring", "Expenses:Fees", None, 5),
    (2, "PURCHASE 1", "substring", "Expenses:Shopping", None, 3),
    (3, "^(VIEW|CLICK) [0-4]", "regex", "Expenses:Media", None, 4),
    (4, "click 77", "exact", "Expenses:Gifts", None, 9),
    (5, "view", "substring", "Expenses:Streaming", None, 1),
    (6, "signup", "substring", "Income:Bonus", "other bank", 8),
    (7, "SIGNUP", "substring", "Income:Referral", "my bank", 2),
    (8, "view 1", "substring", "Expenses:Screens", None, 4),
]
_RULE_ROWS = ", ".join(
    f"({i}, '{p}', '{t}', '{a}', {'NULL' if n is None else repr(n)}, {q})" for i, p, t, a, n, q in _RULES
)


def _rules(b: Binding) -> DataFrame:
    return b.spark.createDataFrame(_RULES, TABLES["categorization_rules"])


_CATEGORISED = f"""
    {_ROWS}, rule AS (SELECT * FROM (VALUES {_RULE_ROWS}) v(id, pattern, pattern_type, target, institution, priority)
                     WHERE institution = 'my bank' OR institution IS NULL),
    texts AS (SELECT DISTINCT payee FROM rows),
    hits AS (SELECT payee, arg_min(target, -priority * 1000 + id) AS target FROM texts JOIN rule ON
             (pattern_type = 'substring' AND contains(lower(payee), lower(pattern))) OR
             (pattern_type = 'exact' AND lower(payee) = lower(pattern)) OR
             (pattern_type = 'regex' AND regexp_matches(payee, pattern)) GROUP BY 1),
    categorised AS (SELECT row_index, date, payee, amount, coalesce(target, CASE WHEN amount < 0 THEN 'Expenses:Uncategorized' ELSE 'Income:Uncategorized' END) AS account_name
             FROM rows LEFT JOIN hits USING (payee) WHERE amount <> 0)"""


@query("J13 W7 X16 F8 F11 O4", f"WITH {_CATEGORISED} SELECT row_index, payee, account_name FROM categorised")
def categorised_rows(b: Binding) -> DataFrame:
    mapped = ingest.map_rows(b.statement_rows, b.MAPPING)
    rows = mapped.withColumn("account_name", ingest.counter_account(F.col("amount")))
    return rules.categorise(rows, _rules(b), "my bank").select("row_index", "payee", "account_name")


@query("M13 F11", f"""
    WITH {_ROWS}, hits AS (SELECT payee, CASE WHEN contains(lower(payee), 'view 1') THEN 'Expenses:Screens'
        WHEN regexp_matches(payee, '^(VIEW|CLICK) [0-4]') THEN 'Expenses:Media' WHEN contains(lower(payee), 'view') THEN 'Expenses:Streaming' END AS target
        FROM (SELECT DISTINCT payee FROM rows))
    SELECT payee AS text, target AS target_account FROM hits WHERE target IS NOT NULL""")
def first_rules(b: Binding) -> DataFrame:
    """One rule raised, the rules that are not about views and clicks removed."""
    kept = rules.remove_rules(_rules(b), b.spark.createDataFrame([(i,) for i in (1, 2, 4, 6, 7, 8)], "id long"))
    raised = b.spark.createDataFrame([(9, "View 1", "substring", "Expenses:Screens", None, 7)], TABLES["categorization_rules"])
    mapped = ingest.map_rows(b.statement_rows, b.MAPPING)
    texts = mapped.select(F.col("payee").alias("text")).distinct()
    return rules.first_rule(texts, rules.visible_rules(rules.add_rules(kept, raised), "my bank"))


# ---- account matching ----

_QUERIES = """
    queries AS (
        SELECT upper(substr(name, 1, length(name) - 2)) || substr(name, length(name)) AS query FROM accounts WHERE type = 'Liabilities' UNION
        SELECT name FROM accounts WHERE type = 'Expenses' UNION
        SELECT lower(substr(name, 1, 12)) FROM accounts WHERE type = 'Expenses' UNION
        SELECT lower(substr(s_name, 10)) FROM supplier UNION
        SELECT 'nobody ' || n_name FROM nation)"""
_SCORED = """
    scored AS (SELECT q.query, a.id, a.name, CASE WHEN lower(a.name) = lower(q.query) THEN 1.0
        WHEN starts_with(lower(a.name), lower(q.query)) THEN 0.95
        WHEN len(list_filter(string_split(lower(a.name), ':'), lambda x: contains(x, lower(q.query)))) > 0 THEN 0.9
        ELSE 1.0 - levenshtein(lower(q.query), lower(a.name))::DOUBLE / greatest(length(q.query), length(a.name))::DOUBLE END::DOUBLE AS score
        FROM queries q, accounts a),
    ranked AS (SELECT query, id, name, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS rank
               FROM scored WHERE score >= 0.85)"""


def _queries(b: Binding) -> DataFrame:
    """Typed account names: liabilities with a digit left out and in capitals,
    exact expense names, their beginnings, customer numbers, and unknown names."""
    name = F.col("name")
    liabilities, expenses = b.accounts.filter("type = 'Liabilities'"), b.accounts.filter("type = 'Expenses'")
    typed = F.concat(F.upper(F.substring(name, F.lit(1), F.length(name) - 2)), F.substring(name, F.length(name), F.lit(1)))
    return (
        liabilities.select(typed.alias("query")).unionByName(expenses.select(name.alias("query")))
        .unionByName(expenses.select(F.lower(F.substring(name, 1, 12)).alias("query")))
        .unionByName(b.table("supplier").select(F.lower(F.substring("s_name", 10, 100)).alias("query")))
        .unionByName(b.table("nation").select(F.concat(F.lit("nobody "), "n_name").alias("query"))).distinct()
    )


@query("J14 W5 X8", f"WITH {_QUERIES}, {_SCORED} SELECT query, name, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5")
def matched_accounts(b: Binding) -> DataFrame:
    return matching.match_accounts(_queries(b), b.accounts).withColumn("score", F.round("score", 6))


@query("J15 W5", f"""
    WITH {_QUERIES}, {_SCORED}
    SELECT q.query, coalesce(e.id, r.id) AS account_id FROM queries q LEFT JOIN accounts e ON e.name = q.query
    LEFT JOIN ranked r ON r.query = q.query AND r.rank = 1""")
def resolved_accounts(b: Binding) -> DataFrame:
    return matching.resolve_accounts(_queries(b), b.accounts)


@query("X13", """
    SELECT s_name AS name, s_name AS type, min(currency) AS currency
    FROM supplier JOIN nations ON s_nationkey = n_nationkey GROUP BY 1""")
def missing_accounts_created(b: Binding) -> DataFrame:
    """Names seen: every supplier (new) and every ledger account (known)."""
    seen = b.table("supplier").join(b.nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("account_name"), "currency"
    ).unionByName(b.accounts.select(F.col("name").alias("account_name"), "currency"))
    return missing_accounts(seen, b.accounts).select("name", "type", "currency")


# ---- import and changes ----


def _bank(b: Binding) -> ingest.Imported:
    return ingest.import_rows(b.ledger, b.statement_rows, b.MAPPING, "Assets:Bank:Checking", _rules(b), "my bank")


@query("M12 X13 S8", f"""
    WITH {_CATEGORISED}
    SELECT 'Assets:Bank:Checking' AS account, 'USD' AS currency, date, sum(amount)::DECIMAL(18,2) AS total, count(*)::BIGINT AS n FROM categorised GROUP BY date
    UNION ALL SELECT account_name, 'USD', date, (-sum(amount))::DECIMAL(18,2), count(*) FROM categorised GROUP BY account_name, date""", total="decimal(18,2)")
def imported_statement(b: Binding) -> DataFrame:
    """Daily totals of the accounts an import touched."""
    after = _bank(b).ledger
    new = after.transactions.filter(F.col("source_file_id") == 1).select(F.col("id").alias("transaction_id"), "date")
    names = after.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account"))
    return after.postings.join(new, "transaction_id").join(names, "account_id").groupBy("account", "currency", "date").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n")
    )


@query("A23 M12", f"""
    WITH {_ROWS} SELECT 1::BIGINT AS source_file_id, count(*)::BIGINT AS total, count(*) FILTER (amount <> 0)::BIGINT AS imported,
           count(*) FILTER (amount = 0)::BIGINT AS skipped, FALSE AS needs_mapping FROM rows""")
def import_statistics(b: Binding) -> DataFrame:
    return _bank(b).stats


def _folder(b: Binding, **options) -> ingest.ImportedFolder:
    """A folder in which files of users below 50 were loaded before and some are faulty."""
    root = _statement_files(b, faulty=True)
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long")
    loaded = files.source_file_rows(files.stored_files(b.spark, root, "*.txt").filter(user < 50))
    before = b.ledger.with_tables(source_files=b.empty_table("source_files").unionByName(loaded, allowMissingColumns=True))
    mapping = {**b.MAPPING, "header_row": 1, "skip_footer_rows": 1}
    return ingest.import_folder(b.spark, before, root, mapping, "Assets:Bank:Checking", _rules(b), "my bank", "*.txt", **options)


_OUTCOMES = f"""
    {_ROWS}, outcomes AS (
        SELECT user_id, CASE WHEN user_id < 50 THEN 'skipped' WHEN user_id % 10 = 3 THEN 'failed' ELSE 'imported' END AS status,
               CASE WHEN user_id < 50 THEN 'known content' WHEN user_id % 10 = 3 THEN 'unclosed quote' END AS reason,
               CASE WHEN user_id < 50 OR user_id % 10 = 3 THEN 0 ELSE count(*) END AS total,
               CASE WHEN user_id < 50 OR user_id % 10 = 3 THEN 0 ELSE count(*) FILTER (amount <> 0) END AS imported
        FROM rows JOIN events ON event_id = row_index GROUP BY user_id)"""


@query("S5 S6 A23", f"WITH {_OUTCOMES} SELECT user_id::VARCHAR AS folder, status, reason, total, imported FROM outcomes")
def folder_outcomes(b: Binding) -> DataFrame:
    """What became of each file of a folder."""
    return _folder(b).outcomes.select(F.regexp_extract("file", r"user_id=(\d+)", 1).alias("folder"), "status", "reason", "total", "imported")


@query("S5 A23 M12", f"""
    WITH {_OUTCOMES}
    SELECT count(*) FILTER (status = 'imported')::BIGINT AS imported_files, count(*) FILTER (status <> 'imported')::BIGINT AS skipped_files,
           sum(imported)::BIGINT AS total_transactions, count(*) FILTER (status = 'failed')::BIGINT AS failed_files FROM outcomes""")
def folder_result(b: Binding) -> DataFrame:
    return _folder(b).result().select(
        "imported_files", "skipped_files", "total_transactions", F.col("errors")["unclosed quote"].alias("failed_files")
    )


@query("M12 E1 T1", f"""
    WITH {_CATEGORISED}, kept AS (SELECT c.* FROM categorised c JOIN events ON event_id = row_index WHERE user_id >= 50 AND user_id % 10 <> 3),
    added AS (SELECT 'Assets:Bank:Checking' AS account, amount FROM kept UNION ALL SELECT account_name, -amount FROM kept)
    SELECT a.name AS account, year_month, m.currency, closing_balance FROM monthly m JOIN accounts a ON a.id = m.account_id
    UNION ALL SELECT account, '2024-01', 'USD', sum(amount)::DECIMAL(28,2) FROM added GROUP BY account""", closing_balance="decimal(28,2)")
def summaries_after_import(b: Binding) -> DataFrame:
    """Monthly balances and net worth stored before a folder is imported, refreshed by
    the import; the balances by account."""
    names = ["s_net_worth", "s_account_monthly_balances"]
    before = {name: stored(summaries.registry.rebuild_one(name, b.ledger), name) for name in names}
    done = _folder(b, summaries=before)
    accounts = done.ledger.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account"))
    monthly = done.summaries["s_account_monthly_balances"]
    return monthly.join(accounts, "account_id").select("account", "year_month", "currency", "closing_balance")


@query("M11", """
    SELECT account_id, currency, sum(amount)::DECIMAL(28,2) AS balance
    FROM dated WHERE strftime(date, '%Y') <> '1998' GROUP BY 1, 2""", balance="decimal(28,2)")
def undone_imports(b: Binding) -> DataFrame:
    """The monthly files of 1998 undone; balances of what remains."""
    months = b.transactions.select("source_file_id").distinct().filter(F.col("source_file_id").between(199801, 199812))
    after = changes.undo_imports(b.ledger, months).ledger
    return after.postings.groupBy("account_id", "currency").agg(F.sum("amount").alias("balance"))


@query("M4", """
    SELECT id, CASE WHEN status = 'reconciled' THEN date + 1 ELSE date END AS date, payee,
           CASE WHEN status = 'reconciled' THEN 'amended' ELSE narration END AS narration, status
    FROM transactions WHERE status <> 'pending'""")
def amended_transactions(b: Binding) -> DataFrame:
    """Pending orders deleted, reconciled ones moved by a day and renamed."""
    updates = b.transactions.filter("status in ('pending', 'reconciled')").select(
        "uuid", (F.col("status") == "pending").alias("delete"), F.date_add("date", 1).alias("date"), F.lit("amended").alias("narration")
    )
    after = changes.amend_transactions(b.ledger, updates).ledger
    return after.transactions.select("id", "date", "payee", "narration", "status")


@query("M1 A22 M5 M3", """
    SELECT account_id, commodity, (sum(CASE WHEN sale THEN -t.quantity ELSE t.quantity END))::DECIMAL(18,2) AS held
    FROM trades t JOIN walk USING (account_id, commodity, id) WHERE NOT refused GROUP BY 1, 2 HAVING held > 0""", held="decimal(18,2)")
def submitted_trades(b: Binding) -> DataFrame:
    """All trades posted in one batch against cash; what is held afterwards."""
    units = b.trade_postings
    cash = units.select(
        (F.col("id") * 2 + 1).alias("id"), "transaction_id", F.lit("Equity:OpeningBalances").alias("account"),
        (-F.col("amount") * F.col("price")).cast("decimal(20,8)").alias("amount"), F.lit("USD").alias("currency"),
    )
    names = b.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account"))
    batch = units.withColumn("id", F.col("id") * 2).join(names, "account_id").drop("account_id").unionByName(cash, allowMissingColumns=True)
    equity = b.spark.createDataFrame([(5, "Equity:OpeningBalances", "Equity", "USD")], "id long, name string, type string, currency string")
    start = b.books.with_tables(accounts=b.accounts.unionByName(equity, allowMissingColumns=True), prices=b.empty_table("prices"))
    after = changes.submit_transactions(start, b.trade_transactions, batch).ledger
    return after.lots.filter("not disposed").groupBy("account_id", "commodity").agg(F.sum("quantity").alias("held"))


# ---- quotes, exports, mappings ----


@query("S9 M2", """
    SELECT p_brand AS commodity, 'USD' AS currency, DATE '2002-01-01' AS date,
           CASE WHEN max(p_size) % 3 = 0 THEN min(p_retailprice) ELSE max(p_retailprice) END::DECIMAL(18,2) AS price, 'stock' AS source
    FROM part GROUP BY 1""", price="decimal(18,2)")
def landed_quotes(b: Binding) -> DataFrame:
    """Quotes landed as JSON, some only with a previous close, written into an empty price table."""
    landed = b.table("part").groupBy(F.lower("p_brand").alias("symbol")).agg(
        F.when(F.max("p_size") % 3 == 0, F.lit(0.0)).otherwise(F.max("p_retailprice")).alias("regularMarketPrice"),
        F.min("p_retailprice").alias("previousClose"),
    ).withColumn("date", F.lit("2002-01-01"))
    path = scratch_path(b.spark, "quotes")
    landed.write.json(path)
    good, _ = quotes.stock_prices(b.spark.read.schema(quotes.STOCK_SCHEMA).json(path))
    arrived = good.withColumn("commodity", F.initcap("commodity")).withColumn("seq", F.lit(1).cast("long"))
    return upsert_prices(b.empty_table("prices"), arrived)


@query("S9", """
    SELECT p_brand AS item, CASE WHEN max(p_size) % 3 <> 0 THEN max(p_retailprice)::DECIMAL(18,2) END AS price,
           CASE max(p_size) % 3 WHEN 0 THEN CASE WHEN max(p_size) % 2 = 0 THEN 'not found' ELSE 'price in USD not available' END END AS error
    FROM part GROUP BY 1""", price="decimal(18,2)")
def landed_coins(b: Binding) -> DataFrame:
    """Brands as coins, some not listed and some listed without a price in dollars; prices and errors together."""
    size = F.max("p_size")
    brands = b.table("part").groupBy("p_brand").agg(size.alias("size"), F.max("p_retailprice").alias("top"))
    listed = brands.filter("size % 3 <> 0 or size % 2 <> 0").select(
        F.lower("p_brand").alias("coin"), F.when(F.col("size") % 3 == 0, "eur").otherwise("usd").alias("currency"), "top"
    )
    quoted = listed.groupBy(F.lit("2002-01-01").alias("date")).agg(
        F.map_from_entries(F.collect_list(F.struct("coin", F.create_map("currency", "top")))).alias("quotes")
    )
    path = scratch_path(b.spark, "coins")
    quoted.write.json(path)
    good, bad = quotes.coin_prices(b.spark.read.schema(quotes.COIN_SCHEMA).json(path), brands.select(F.col("p_brand").alias("coin")))
    priced = good.select(F.initcap(F.lower("commodity")).alias("item"), "price", F.lit(None).cast("string").alias("error"))
    return priced.unionByName(bad.select("item", F.lit(None).cast("decimal(18,8)").alias("price"), "error"))


@query("S9 M2", """
    SELECT 'USD/' || upper(n_name) AS item, CASE WHEN n_regionkey <> 3 THEN (1 + n_nationkey * 0.25)::DECIMAL(18,2) END AS price,
           CASE WHEN n_regionkey = 3 THEN 'rate not available' END AS error FROM nation""", price="decimal(18,2)")
def landed_rates(b: Binding) -> DataFrame:
    """A rate per nation as if it had a currency of its own; none for one region."""
    rates = b.table("nation").filter("n_regionkey <> 3").groupBy(F.lit("2002-01-01").alias("date"), F.lit("usd").alias("base_code")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.upper("n_name").alias("c"), (1 + F.col("n_nationkey") * 0.25).alias("r")))).alias("conversion_rates")
    )
    path = scratch_path(b.spark, "rates")
    rates.write.json(path)
    wanted = b.table("nation").select(F.lit("usd").alias("base"), F.col("n_name").alias("quote"))
    good, bad = quotes.forex_rates(b.spark.read.schema(quotes.FOREX_SCHEMA).json(path), wanted)
    rated = good.select(F.concat_ws("/", "commodity", "currency").alias("item"), "price", F.lit(None).cast("string").alias("error"))
    return rated.unionByName(bad.select("item", F.lit(None).cast("decimal(18,8)").alias("price"), "error"))


@query("S9 M2", """
    SELECT commodity, date, CASE WHEN day(date) = 1 THEN price + 1 ELSE price END::DECIMAL(18,8) AS price,
           CASE WHEN day(date) = 1 THEN 'manual' ELSE 'market' END AS source FROM commodity_prices""")
def manual_prices(b: Binding) -> DataFrame:
    """Prices of every month's first day entered by hand over the market's."""
    typed = b.commodity_prices.filter(F.dayofmonth("date") == 1).select("commodity", "currency", "date", (F.col("price") + 1).alias("price"))
    entered = quotes.manual_prices(typed).withColumn("seq", F.lit(1).cast("long"))
    return upsert_prices(b.commodity_prices, entered).select("commodity", "date", "price", "source")


@query("S10", "SELECT id::VARCHAR AS id, account_id::VARCHAR AS account_id, amount::VARCHAR AS amount, currency FROM postings")
def exported_csv(b: Binding) -> DataFrame:
    path = scratch_path(b.spark, "csv")
    exports.export_csv(b.postings.select("id", "account_id", "amount", "currency"), path)
    return b.spark.read.csv(path, header=True)


@query("S11", "SELECT id, amount::VARCHAR AS amount, currency FROM postings")
def exported_json(b: Binding) -> DataFrame:
    path = scratch_path(b.spark, "json")
    exports.export_json(b.postings.select("id", "amount", "currency", "price"), path)
    return b.spark.read.schema("id long, amount string, currency string").json(path)


@query("S13", "SELECT p_type AS name, 'Col ' || max(p_size) AS date_col, 3::INTEGER AS header_row FROM part GROUP BY 1")
def saved_mappings(b: Binding) -> DataFrame:
    """A mapping per part type saved twice; the later one counts."""
    sizes = b.table("part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))

    def version(size: str) -> DataFrame:
        body = F.struct(F.concat(F.lit("Col "), size).alias("date_col"), F.lit(3).alias("header_row"))
        return sizes.select("name", F.lit(None).cast("string").alias("institution"), F.to_json(body).alias("mapping"))

    saved = tables.save_mappings(tables.save_mappings(b.empty_table("column_mappings"), version("lo")), version("hi"))
    from_json = F.from_json("mapping", "date_col string, header_row int")
    return saved.select("name", from_json.alias("m")).select("name", "m.date_col", "m.header_row")


@query("S14 T1", "SELECT account_id, year_month, currency, total, transaction_count::BIGINT AS transaction_count FROM spending", total="decimal(28,2)")
def partition_overwrites(b: Binding) -> DataFrame:
    """Stored by month without 1999; then only the months of 1999 are overwritten."""
    path = scratch_path(b.spark, "spending")
    whole = stored(summaries.monthly_spending(b.ledger), "spending")
    late = F.col("year_month").startswith("1999")
    exports.write_summary(whole.filter(~late).unionByName(whole.filter(late).withColumn("total", (F.col("total") * 0).cast(whole.schema["total"].dataType))), path, "year_month")
    exports.write_summary(whole.filter(late), path, "year_month")
    return b.spark.read.schema(whole.schema).parquet(path)


# ---- streams ----


@query("T1 W1 W2", "SELECT account_id, year_month, currency, closing_balance FROM monthly", closing_balance="decimal(28,2)")
def streamed_monthly_balances(b: Binding) -> DataFrame:
    """Postings arriving in parts, the later dates first: the last batch is back-dated."""
    root = scratch_path(b.spark, "stream")
    headers = b.transactions.select(F.col("id").alias("transaction_id"), "date")
    posted = b.postings.select("id", "transaction_id", "account_id", "amount", "currency").join(headers, "transaction_id")
    order = ["id", "transaction_id", "account_id", "amount", "currency", "date"]
    later = F.col("date") >= F.lit("1998-06-01").cast("date")
    for part in (posted.filter(later), posted.limit(0), posted.filter(~later)):
        part.select(*order).write.mode("append").parquet(f"{root}/in")
        arriving = b.spark.readStream.schema(stream_refresh.POSTED).parquet(f"{root}/in")
        running = stream_refresh.refresh_stream(arriving, f"{root}/out").trigger(availableNow=True).start()
        running.awaitTermination()
    last = running.lastProgress["batchId"]
    return stream_refresh.read_summary(b.spark, f"{root}/out", "s_account_monthly_balances", last, b.ledger)


@query("T2 M12 S6", f"""
    WITH {_CATEGORISED}, pairs AS (SELECT row_index, date, payee, amount, account_name FROM categorised)
    SELECT account_name AS account, (-sum(amount))::DECIMAL(18,2) AS balance, count(*)::BIGINT AS n FROM pairs GROUP BY 1
    UNION ALL SELECT 'Assets:Bank:Checking', sum(amount)::DECIMAL(18,2), count(*)::BIGINT FROM pairs""", balance="decimal(18,2)")
def streamed_statements(b: Binding) -> DataFrame:
    """All statement files of a folder imported by a stream."""
    folder, root = _statement_files(b), scratch_path(b.spark, "import")
    mapping = {**b.MAPPING, "header_row": 1, "skip_footer_rows": 1}
    # Accounts alone are read: orders, their postings and prices aren't derived for it.
    start = Ledger.empty(b.spark).with_tables(accounts=b.accounts)
    watched = stream_statements.watch_folder(b.spark, folder, "*.txt")
    running = stream_statements.import_stream(watched, root, start, mapping, "Assets:Bank:Checking", _rules(b), "my bank")
    running = running.trigger(availableNow=True).start()
    running.awaitTermination()
    after = stream_statements.read_state(b.spark, root, running.lastProgress["batchId"], start)
    names = after.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account"))
    return after.postings.join(names, "account_id").groupBy("account").agg(F.sum("amount").alias("balance"), F.count(F.lit(1)).alias("n"))
