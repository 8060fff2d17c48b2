"""Compare queries with their oracle SQL: python tests/compare.py <sf> [names...]

Not collected by pytest; it runs for several minutes over all queries.
"""

import decimal
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return str(value)
    return repr(value) if isinstance(value, (list, dict)) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = f"/root/testdata/sf{sf}"
    oracle = duckdb.connect()
    for table in TABLES:
        oracle.execute(f"create view {table} as select * from '{root}/{table}.parquet'")
    queries, texts, bad = entry.queries(), entry.oracle_sql(), []
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, root)
            columns = sorted(df.columns)
            got = ordered(tuple(plain(row[c]) for c in columns) for row in df.collect())
            seconds = time.time() - started
            if name not in texts:
                print(f"{name}: {len(got)} rows, {seconds:.1f}s, no oracle", flush=True)
                continue
            cursor = oracle.execute(texts[name])
            order = [d[0] for d in cursor.description]
            want = ordered(tuple(plain(row[order.index(c)]) for c in columns) for row in cursor.fetchall())
            same = got == want and sorted(order) == columns
        except Exception as error:  # report and go on with the next query
            print(f"{name}: ERROR {str(error)[:300]}", flush=True)
            bad.append(name)
            continue
        print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got)}/{len(want)} rows, {seconds:.1f}s", flush=True)
        if not same:
            bad.append(name)
            ours, theirs = set(got), set(want)
            print("  spark only", [r for r in got if r not in theirs][:3], "oracle only", [r for r in want if r not in ours][:3], flush=True)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
