"""Registry of checked queries."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.catalog.binding import Binding
from tallybook.catalog.oracle import with_ledger


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Binding], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, **types: str) -> Callable:
    """Register a function of a Binding under its own name.

    ``covers`` lists the survey's operator ids. ``types`` casts result columns
    to the type the SQL text gives them.
    """

    def register(fn: Callable[[Binding], DataFrame]) -> Callable[[Binding], DataFrame]:
        @functools.wraps(fn)
        def build(binding: Binding) -> DataFrame:
            df = fn(binding)
            return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}) if types else df

        text = with_ledger(sql) if sql else None
        QUERIES[fn.__name__] = Query(fn.__name__, covers, build, text)
        return build

    return register


def runner(build: Callable[[Binding], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Binding(spark, sf_dir))
