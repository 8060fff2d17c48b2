import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tallybook import configure

    session = (
        SparkSession.builder.master("local[8]").appName("tallybook-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture()
def make(spark):
    """Build a table: make('id long, ...', rows), text cast to dates and decimals."""

    def build(schema, rows):
        fields = [f.strip().split(" ", 1) for f in schema.replace("decimal(18,8)", "qty").split(",")]
        plain = ", ".join(f"{n} {'string' if t in ('date', 'qty') else t}" for n, t in fields)
        df = spark.createDataFrame([tuple(None if v is None else str(v) if t in ("date", "qty") else v for v, (_, t) in zip(r, fields)) for r in rows], plain)
        return df.selectExpr(*[f"cast({n} as {'decimal(18,8)' if t == 'qty' else t}) as {n}" for n, t in fields])

    return build


def rows(df, *columns):
    """Rows as sorted tuples, decimals as floats, dates as text."""
    import datetime
    import decimal

    def plain(v):
        if isinstance(v, decimal.Decimal):
            return round(float(v), 8)
        return v.isoformat() if isinstance(v, datetime.date) else v

    out = [tuple(plain(v) for v in r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))
