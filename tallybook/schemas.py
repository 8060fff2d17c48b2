"""Table schemas, decimal widths and fixed value lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Widths are chosen so that one product of two of them fits decimal(38) without
# losing scale: (18,2)*(18,8) -> (37,10), (18,8)*(18,8) -> (37,16).
MONEY = T.DecimalType(18, 2)
QUANTITY = T.DecimalType(18, 8)
RATE = T.DecimalType(18, 8)
AMOUNT = T.DecimalType(20, 8)
TOTAL = T.DecimalType(28, 2)

_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DateType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "accounts": _schema(
        ("id", _L), ("name", _S), ("type", _S), ("currency", _S), ("booking_method", _S),
        ("institution", _S), ("asset_class", _S), ("jurisdiction", _S),
        ("opened_at", _TS), ("closed_at", _D),
    ),
    "transactions": _schema(
        ("id", _L), ("uuid", _S), ("date", _D), ("payee", _S), ("narration", _S), ("status", _S),
        ("source_file_id", _L), ("raw_extraction_id", _L), ("created_at", _TS), ("modified_at", _TS),
    ),
    "postings": _schema(
        ("id", _L), ("transaction_id", _L), ("account_id", _L), ("amount", AMOUNT), ("currency", _S),
        ("cost_amount", QUANTITY), ("cost_currency", _S), ("cost_date", _D),
        ("price", RATE), ("price_currency", _S), ("lot_id", _L),
    ),
    "transaction_tags": _schema(("transaction_id", _L), ("tag", _S)),
    "lots": _schema(
        ("id", _L), ("account_id", _L), ("commodity", _S), ("quantity", QUANTITY),
        ("original_quantity", QUANTITY), ("cost_price", RATE), ("cost_currency", _S),
        ("acquired_date", _D), ("label", _S), ("lock_until", _D),
        ("source_transaction_id", _L), ("disposed", _B),
    ),
    "lot_dispositions": _schema(
        ("id", _L), ("lot_id", _L), ("sell_transaction_id", _L), ("quantity", QUANTITY),
        ("proceeds_per_unit", RATE), ("proceeds_currency", _S), ("gain_loss", T.DecimalType(37, 16)),
        ("gain_loss_currency", _S), ("term", _S), ("wash_sale", _B),
        ("wash_sale_adjustment", T.DecimalType(37, 16)),
    ),
    "corporate_actions": _schema(
        ("action_id", _L), ("commodity", _S), ("action_type", _S), ("ratio", QUANTITY), ("effective_date", _D),
    ),
    "transfers": _schema(
        ("transfer_id", _L), ("from_account_id", _L), ("to_account_id", _L), ("commodity", _S), ("quantity", QUANTITY),
        ("booking_method", _S), ("date", _D),
    ),
    "prices": _schema(("commodity", _S), ("currency", _S), ("date", _D), ("price", RATE), ("source", _S)),
    "categorization_rules": _schema(
        ("id", _L), ("pattern", _S), ("pattern_type", _S), ("target_account", _S),
        ("institution", _S), ("priority", _I),
    ),
    "balance_assertions": _schema(
        ("id", _L), ("account_id", _L), ("date", _D), ("expected_amount", AMOUNT), ("currency", _S),
    ),
    "column_mappings": _schema(("name", _S), ("institution", _S), ("mapping", _S)),
    "currency_tolerances": _schema(("currency", _S), ("tolerance", QUANTITY)),
    "source_files": _schema(
        ("id", _L), ("path", _S), ("sha256", _S), ("institution", _S), ("file_type", _S), ("imported_at", _TS),
    ),
    "raw_extractions": _schema(("source_file_id", _L), ("row_index", _L), ("raw_data", _S)),
    "budgets": _schema(("account_id", _L), ("year_month", _S), ("currency", _S), ("amount", MONEY)),
}

MAPPING_SCHEMA = _schema(
    ("date_col", _S), ("date_format", _S), ("payee_col", _S), ("narration_col", _S), ("amount_col", _S),
    ("amount_sign", _S), ("debit_col", _S), ("credit_col", _S), ("currency_col", _S),
    ("default_currency", _S), ("header_row", _I), ("skip_footer_rows", _I),
)

# ---- fixed values -----------------------------------------------------------

ROOT_TYPES = ["Assets", "Liabilities", "Income", "Expenses", "Equity"]

SEED_TOLERANCES = {
    "USD": "0.01",
    "INR": "0.01",
    "EUR": "0.01",
    "GBP": "0.01",
    "BTC": "0.00000001",
    "ETH": "0.00000001",
}

DEFAULT_TOLERANCE = "0.01"
CRYPTO_TOLERANCE = "0.00000001"
CRYPTO_CURRENCIES = ["BTC", "ETH", "SOL", "DOGE", "ADA", "XRP", "DOT", "AVAX", "MATIC", "LINK"]

# Days a position must be held before a gain is long term.
HOLDING_DAYS = {
    "US.equity": 365,
    "US.crypto": 365,
    "IN.equity": 365,
    "IN.debt": 1095,
    "IN.elss": 1095,
}
DEFAULT_HOLDING_DAYS = 365

NET_WORTH_BUCKETS = ["cash", "equity", "debt", "crypto", "other"]

FILE_TYPES = {
    "csv": "csv",
    "xlsx": "xlsx",
    "xls": "xls",
    "pdf": "pdf",
    "ofx": "ofx",
    "qfx": "qfx",
    "json": "json",
    "tsv": "tsv",
}

BOOKING_METHODS = ["FIFO", "LIFO", "HIFO"]

OPENING_ACCOUNT = "Equity:OpeningBalances"
UNCATEGORISED_EXPENSE = "Expenses:Uncategorized"
UNCATEGORISED_INCOME = "Income:Uncategorized"
