"""Transaction search and the nested transaction view."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_transactions(
    transactions: DataFrame,
    postings: DataFrame | None = None,
    transaction_tags: DataFrame | None = None,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
    payee: str | None = None,
    account_id: int | None = None,
    tags: Sequence[str] = (),
    amount_min: Decimal | str | None = None,
    amount_max: Decimal | str | None = None,
    uuid: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Headers that satisfy every given predicate.

    Account and amount must hold on the same posting; all tags must be present.
    Both are semi joins, so no header is repeated and no DISTINCT is needed.
    """
    found = transactions
    if date_from is not None:
        found = found.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        found = found.filter(F.col("date") <= F.lit(date_to).cast("date"))
    if payee is not None:
        found = found.filter(F.lower("payee").contains(payee.lower()))
    if uuid is not None:
        found = found.filter(F.col("uuid") == uuid)
    if status is not None:
        found = found.filter(F.col("status") == status)
    if account_id is not None or amount_min is not None or amount_max is not None:
        hits = postings
        if account_id is not None:
            hits = hits.filter(F.col("account_id") == account_id)
        if amount_min is not None:
            hits = hits.filter(F.abs("amount") >= F.lit(str(amount_min)).cast("decimal(28,8)"))
        if amount_max is not None:
            hits = hits.filter(F.abs("amount") <= F.lit(str(amount_max)).cast("decimal(28,8)"))
        found = found.join(hits.select(F.col("transaction_id").alias("id")), "id", "left_semi")
    if tags:
        found = found.join(carrying_tags(transaction_tags, tags).withColumnRenamed("transaction_id", "id"), "id", "left_semi")
    return found


def carrying_tags(transaction_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Transactions that carry all of ``tags``."""
    wanted = sorted(set(tags))
    return (
        transaction_tags.filter(F.col("tag").isin(wanted))
        .groupBy("transaction_id").agg(F.countDistinct("tag").alias("n"))
        .filter(F.col("n") == len(wanted)).select("transaction_id")
    )


def newest_page(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, newest first. Planned as a per-partition top-k, not a full sort."""
    page = found.orderBy(F.col("date").desc(), F.col("id").desc())
    return (page.offset(offset) if offset else page).limit(limit)


def with_postings_and_tags(
    found: DataFrame, postings: DataFrame, accounts: DataFrame, transaction_tags: DataFrame
) -> DataFrame:
    """Headers with ``postings[]`` (by id) and ``tags[]`` (by name) nested.

    Meant for a page of headers: only their own postings and tags are gathered.
    """
    ids = found.select(F.col("id").alias("transaction_id"))
    names = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    fields = ["id", "account_id", "account_name", *[
        c for c in postings.columns if c not in ("id", "transaction_id", "account_id")
    ]]
    nested = (
        postings.join(ids, "transaction_id", "left_semi").join(names, "account_id")
        .groupBy("transaction_id")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("postings"))
    )
    tagged = (
        transaction_tags.join(ids, "transaction_id", "left_semi")
        .groupBy("transaction_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    )
    return (
        found.join(nested.withColumnRenamed("transaction_id", "id"), "id", "left")
        .join(tagged.withColumnRenamed("transaction_id", "id"), "id", "left")
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    )
