"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text are one window, known by 96 bits of hash.
Of windows that come up more than once in the corpus, the first occurrence stays
and all lines that a later one covers are removed; the first is the one in the
smallest document number (null behind all others; of texts that share a number the
one with the smallest hash), and in that document the earliest.

A window's later occurrences within its own document are found there, in the
sorted array of its windows. Across documents only each document's first
occurrence is shuffled: counted by hash, with partial aggregation before the
shuffle, and joined back to the repeated hashes by equality, which adaptive
execution splits where one window is hot. No group of a window is ever gathered.
Positions come together per document, texts move once.

Defined cases: a null text stays null and has no lines; texts of fewer than three
lines have no window and stay; empty lines count like others; a text of which
every line is covered becomes empty. Rows of the same number and text share
their fate and are never later occurrences of each other; different texts of one
number, null included, are. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3


def _windows(lines: Column) -> Column:
    """Windows sorted by hash and position: (h, g, pos, first), the last telling
    whether it is the document's first of that hash."""
    count = F.size(lines) - WINDOW + 1
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    found = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.get(lines, i + k) for k in range(WINDOW)]).alias("h"),
        F.hash(*[F.get(lines, i + k) for k in range(WINDOW)]).alias("g"),
        i.alias("pos"),
    )))
    return found


def _with_first(windows: Column) -> Column:
    def marked(w: Column, i: Column) -> Column:
        ahead = F.get(windows, i - 1)
        again = F.coalesce((ahead["h"] == w["h"]) & (ahead["g"] == w["g"]), F.lit(False))
        return F.struct(w["h"].alias("h"), w["g"].alias("g"), w["pos"].alias("pos"), (~again).alias("first"))

    return F.transform(windows, marked)


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that later occurrences cover, and with
    ``n_lines``, ``n_removed`` and ``n_spans`` (runs of removed lines) behind."""
    own = "_" * (1 + max(map(len, docs.columns)))  # in front of a name, it makes one that docs can't have
    key, digest, lines, windows = F.col(doc_id), F.xxhash64(text), F.col(f"{own}lines"), F.col(f"{own}windows")
    split = F.split(F.col(text), "\n", -1)

    rows = docs.select(key.alias("doc_id"), digest.alias("digest"), split.alias(f"{own}lines")).withColumn(
        f"{own}windows", _windows(lines)
    ).select("doc_id", "digest", F.explode(_with_first(windows)).alias("w")).filter("w.first").select("doc_id", "digest", "w.h", "w.g", "w.pos")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    repeated = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").select(
        "h", "g", F.col("first.doc_id").alias("first_doc"), F.col("first.digest").alias("first_digest")
    )
    later = rows.join(repeated, ["h", "g"]).filter(
        ~F.col("doc_id").eqNullSafe(F.col("first_doc")) | (F.col("digest") != F.col("first_digest"))
    )
    hits = later.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias(f"{own}hits")).select(
        F.col("doc_id").alias(f"{own}id"), F.col("digest").alias(f"{own}digest"), f"{own}hits"
    )

    same = key.eqNullSafe(F.col(f"{own}id")) & (digest == F.col(f"{own}digest"))
    found = docs.join(hits, same, "left").withColumn(f"{own}lines", split).withColumn(f"{own}windows", _windows(lines))
    within = F.transform(F.filter(_with_first(windows), lambda w: ~w["first"]), lambda w: w["pos"])
    starts = F.array_union(F.coalesce(F.col(f"{own}hits"), F.array().cast("array<int>")), within)
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(*[p + k for k in range(WINDOW)])))))
    found = found.withColumn(f"{own}covered", covered)
    covered, every = F.col(f"{own}covered"), F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(every, covered), lambda i: F.get(lines, i))
    heads = F.filter(covered, lambda p, i: F.coalesce(F.get(covered, i - 1) != p - 1, F.lit(True)))
    results = {
        text: F.when(F.size(covered) == 0, F.col(text)).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
        "n_spans": F.coalesce(F.size(heads), F.lit(0)).cast("long"),
    }
    named = [results.get(c, F.col(c)).alias(c) for c in docs.columns]
    return found.select(*named, *[v.alias(c) for c, v in results.items() if c not in docs.columns])
