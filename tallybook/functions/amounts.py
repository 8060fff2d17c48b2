"""Parsing of statement text and posting arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.schemas import AMOUNT

# Strptime directive -> datetime pattern letters. Single letters
# accept one or two digits.
_DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "M",
    "%d": "d",
    "%b": "MMM",
    "%B": "MMMM",
    "%H": "H",
    "%M": "m",
    "%S": "s",
}

# Tried in this order, month first before day first.
FALLBACK_DATE_FORMATS = [
    "%m/%d/%Y", "%m-%d-%Y",
    "%Y-%m-%d", "%Y/%m/%d",
    "%d/%m/%Y", "%d-%m-%Y",
    "%m/%d/%y", "%d/%m/%y",
]


def spark_date_pattern(strptime_format: str) -> str:
    """Datetime pattern for a strptime format; other letters become literals."""

    def convert(match: re.Match) -> str:
        directive = match.group(0)
        if directive.startswith("%"):
            return _DIRECTIVES[directive]
        return f"'{directive}'"

    return re.sub(r"%.|[A-Za-z]+", convert, strptime_format)


def parse_date(value: Column, date_format: str | None = None) -> Column:
    """First format that fits, the given one before the fallbacks; else NULL.

    Two-digit years 69-99 are 1969-1999.
    """
    text = F.trim(value)

    def attempt(fmt: str) -> Column:
        day = F.try_to_date(text, spark_date_pattern(fmt))
        if "%y" in fmt:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        return day

    formats = ([date_format] if date_format else []) + FALLBACK_DATE_FORMATS
    return F.coalesce(*[attempt(fmt) for fmt in formats])


def parse_amount(value: Column, accounting_negative: bool = False) -> Column:
    """Decimal from statement text; empty or a lone minus is 0, other text that is
    no number is NULL.

    By default parentheses are dropped, so ``(45.00)`` is 45.00. With
    ``accounting_negative`` a parenthesised amount is negative.
    """
    bare = F.regexp_replace(F.trim(value), "[,$₹]", "")
    stripped = F.regexp_replace(bare, r"^[()]+|[()]+$", "")
    number = F.when(stripped.isin("", "-"), F.lit(0).cast(AMOUNT)).otherwise(stripped.try_cast(AMOUNT))
    if accounting_negative:
        number = F.when(bare.rlike(r"^\(.*\)$"), -F.abs(number)).otherwise(number)
    return number.cast(AMOUNT)


def signed_amount(
    rule: str,
    amount: Column | None = None,
    debit: Column | None = None,
    credit: Column | None = None,
    accounting_negative: bool = False,
) -> Column:
    """Amount from the bank account's side: negative when money leaves.

    ``separate_columns`` reads the first of debit, credit that is neither blank
    nor a plain zero; NULL when neither is.
    """
    if rule == "separate_columns":
        def filled(column: Column | None) -> Column:
            if column is None:
                return F.lit(False)
            return F.coalesce(~F.trim(column).isin("", "0", "0.00"), F.lit(False))

        debit_text = F.lit(None).cast("string") if debit is None else debit
        credit_text = F.lit(None).cast("string") if credit is None else credit
        return F.when(filled(debit), -F.abs(parse_amount(debit_text, accounting_negative))).when(
            filled(credit), F.abs(parse_amount(credit_text, accounting_negative))
        )
    parsed = F.when(F.trim(amount) != "", parse_amount(amount, accounting_negative))
    return -parsed if rule == "positive_is_debit" else parsed


def weight(amount: Column, price: Column, price_currency: Column) -> Column:
    """What a posting adds to its transaction's balance."""
    return F.when(price.isNotNull() & price_currency.isNotNull(), amount * price).otherwise(amount)


def weight_currency(currency: Column, price: Column, price_currency: Column) -> Column:
    return F.when(price.isNotNull() & price_currency.isNotNull(), price_currency).otherwise(currency)


def gain(proceeds_per_unit: Column, cost_price: Column, quantity: Column) -> Column:
    """(proceeds - cost) * quantity, exact."""
    return (proceeds_per_unit - cost_price) * quantity


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded half-even to 2 places; 0 when whole is 0."""
    ratio = F.try_divide(part.cast("decimal(28,4)"), whole.cast("decimal(28,4)")) * F.lit(100)
    return F.coalesce(F.bround(ratio, 2), F.lit(0)).cast("decimal(18,2)")
