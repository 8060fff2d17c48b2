"""Quality rules and robust multivariate outliers of document statistics.

Every text is counted (words, symbols, repeated lines and windows, capitals,
marks). Two fixed rules reject very short and self-repeating texts. What is left
to judge is done per language and source: the counts become smoothed rates on a
stabilising scale, a minimum-covariance-determinant estimate gives their centre
and scatter, and a text whose Mahalanobis distance is beyond a high quantile is
rejected.

The estimate starts from medians and quartiles and takes concentration steps:
distances of all documents, then mean and covariance of the nearest share of each
group. One aggregation per step does both: moments are summed per group and
narrow distance class, nearest classes first count in full and the one in which
the share ends counts in part. Groups are pulled towards their language's mean
estimate by a fixed number of documents, so small groups need no rule of their
own, and no rate may vary less than its floor. A hot group is one row per task
and class after partial aggregation; only the table of estimates is joined back,
by size if it is small.

Defined cases: a null text has no words and fails the rules; a null language or
source is a value like any other; repeated rows and document numbers are judged
row by row; texts of any length are read whole; an empty table gives an empty
result. Columns besides those named play no part and are kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import stored

#: Words of a window that counts as repeated when found again in its text.
WINDOW = 5
#: Of the contract's base rules: fewest words, and percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words by which rates of short texts are smoothed.
SMOOTH = 50
#: Share of a group that the estimate rests on, and steps towards it.
SHARE, STEPS = 0.75, 4
#: Documents' worth of its language's estimate that a group's is mixed with.
PRIOR = 50
#: Chance of a clean text beyond the cutoff, were rates normal.
REJECT = 1e-12
#: Distance classes per doubling of the squared distance.
CLASSES = 8
#: Characters of text read at a time by a task.
SLICE = 4_000_000

SYMBOLS = b"#*$%&|<>"
#: Least standard deviation of each rate, on the scale that it is judged on.
FLOORS = {"length": 0.05, "symbols": 0.06, "capitals": 0.05, "marks": 0.06, "repeats": 0.06, "lines": 0.06}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def _repeat_words(split: list[list[bytes]]) -> np.ndarray:
    """Of each text's words, how many lie in a window found twice or more in it."""
    lengths = np.array([len(words) for words in split], np.int64)
    out = np.zeros(len(split), np.int64)
    total, seen = int(lengths.sum()), {}
    if total < WINDOW:
        return out
    number = seen.setdefault
    words = np.fromiter((number(w, len(seen)) for text in split for w in text), np.uint64, total)
    texts = np.repeat(np.arange(len(split), dtype=np.uint64), lengths)
    starts = np.flatnonzero(texts[WINDOW - 1 :] == texts[: total - WINDOW + 1])
    mixed = texts[starts] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        mixed = (mixed ^ words[starts + k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.searchsorted(twice, mixed)
    starts = starts[twice[np.minimum(at, len(twice) - 1)] == mixed]
    # Windows of one mixed value are compared word by word.
    exact = np.stack([texts[starts], *[words[starts + k] for k in range(WINDOW)]], axis=1)
    _, which, count = np.unique(exact, axis=0, return_inverse=True, return_counts=True)
    starts = starts[count[which.reshape(-1)] > 1]
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    np.add.at(out, texts[np.cumsum(steps[:-1]) > 0].astype(np.int64), 1)
    return out


def _counts(texts: list[str | None]) -> list[np.ndarray]:
    """The columns of COUNTS for some texts."""
    raw = [(t or "").encode("utf-8") for t in texts]
    split = [b.split() for b in raw]
    out = np.zeros((len(COUNTS), len(raw)), np.int64)
    for i, (b, words) in enumerate(zip(raw, split, strict=True)):
        solid = b"".join(words)
        lines = [line for line in b.split(b"\n") if line.strip()]
        text = solid.decode("utf-8")
        out[0, i], out[1, i] = len(words), len(text)
        out[2, i] = len(solid) - len(solid.translate(None, SYMBOLS))
        out[3, i], out[5, i] = len(lines) - len(set(lines)), len(lines)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out[6, i] = np.count_nonzero((points - 0x41 < 26) | (points - 0xC0 < 31))  # A to Z, À to Þ
        out[7, i] = len(solid) - len(solid.translate(None, MARKS))
    out[4] = _repeat_words(split)
    return list(out)


#: Other ASCII marks than those of plain sentences and of addresses.
MARKS = b"!?;\"'()[]{}=_^~`\\"


def counted(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns of COUNTS added, named with the prefix."""
    names = [prefix + c for c in COUNTS]
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, texts = 0, 0, []
            column = batch.column(batch.schema.get_field_index(text))
            for i, value in enumerate(column):
                texts.append(value.as_py())
                held += len(texts[-1] or "")
                if held >= SLICE or i + 1 == len(column):
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*map(part.column, kept), *map(pa.array, _counts(texts))], [*kept, *names])
                    start, held, texts = i + 1, 0, []

    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    """The fixed rules on columns of COUNTS."""
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def rates(prefix: str = "") -> list[Column]:
    """The judged vector: smoothed rates, logarithm or square root taken."""
    c = {name: F.col(prefix + name).cast("double") for name in COUNTS}
    words, chars = c["n_words"] + SMOOTH, c["word_chars"] + 6.0 * SMOOTH
    return [
        F.log(chars / words), F.sqrt(c["n_symbols"] / words), F.sqrt(c["n_capitals"] / chars), F.sqrt(c["n_marks"] / words),
        F.sqrt(c["n_repeat_words"] / words), F.sqrt(c["n_dup_lines"] / (c["n_lines"] + 10.0)),
    ]


D = len(FLOORS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(d: int, above: float) -> float:
    """The value that a chi-square variable exceeds with the given chance."""
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _gamma_p(d / 2, mid / 2) > above else (low, mid)
    return high


def _consistency() -> float:
    """What the covariance of the nearest share falls short of the whole's, for normal vectors."""
    q = chi2_quantile(D, 1 - SHARE)
    return SHARE / _gamma_p(D / 2 + 1, q / 2)


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's centre and inverse scatter from its weighted moments and its language's."""
    factor, floors = _consistency(), np.array(list(FLOORS.values()))

    def moments(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, full = sums / n, np.zeros((D, D))
        for (i, j), p in zip(PAIRS, products, strict=True):
            full[i, j] = full[j, i] = p / n - mean[i] * mean[j]
        return mean, full * factor

    for frame in frames:
        centres, inverses = [], []
        for row in frame.itertuples():
            mean, scatter = moments(row.n, np.array(row.sums), np.array(row.products))
            # The language's scatter is the mean of its groups', not that of its rows about one centre.
            prior, prior_scatter = np.array(row.mean_of), np.array(row.scatter_of)
            wide = np.zeros((D, D))
            for (i, j), p in zip(PAIRS, prior_scatter, strict=True):
                wide[i, j] = wide[j, i] = p * factor
            own = row.n / (row.n + PRIOR)
            mean, scatter = own * mean + (1 - own) * prior, own * scatter + (1 - own) * wide
            scale = np.sqrt(np.maximum(np.diag(scatter), floors**2))
            correlation = scatter / np.outer(scale, scale)
            np.fill_diagonal(correlation, 1.0)
            values, vectors = np.linalg.eigh(correlation)
            inverse = (vectors / np.maximum(values, 0.05)) @ vectors.T / np.outer(scale, scale)
            centres.append(mean.tolist())
            inverses.append([float(inverse[i, j]) for i, j in PAIRS])
        frame = frame.assign(centre=centres, inverse=inverses)
        yield frame[["lang_", "source_", "centre", "inverse"]]


def _distance(x: Column, prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the vector ``x`` to its row's ``centre`` by ``inverse``."""
    off = [x[i] - F.col(f"{prefix}centre")[i] for i in range(D)]
    terms = [(1.0 if i == j else 2.0) * F.col(f"{prefix}inverse")[k] * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


def _joined(rows: DataFrame, found: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    found = found.toDF(*[prefix + c for c in found.columns])
    same = rows[lang].eqNullSafe(found[f"{prefix}lang_"]) & rows[source].eqNullSafe(found[f"{prefix}source_"])
    return rows.join(found, same, "left")


def estimates(vectors: DataFrame) -> DataFrame:
    """Centre and inverse scatter for each (``lang``, ``source``) of stored
    vectors ``x``: the minimum-covariance-determinant estimate."""
    keys = ["lang", "source"]
    quartiles = vectors.groupBy(*keys).agg(
        *[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(D)]
    )
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floor)) for i, floor in enumerate(FLOORS.values())]
    found = stored(
        quartiles.select(
            F.col("lang").alias("lang_"), F.col("source").alias("source_"),
            F.array(*[F.col(f"q{i}")[1] for i in range(D)]).alias("centre"),
            F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"),
        ),
        "mcd",
    )
    for _ in range(STEPS):
        found = stored(_concentrated(vectors, found), "mcd")
    return found


def _concentrated(vectors: DataFrame, found: DataFrame) -> DataFrame:
    """One concentration step."""
    from pyspark.sql import Window

    x, keys = F.col("x"), ["lang", "source"]
    near = F.floor(CLASSES * F.log2(_distance(x) + 2.0**-10)).cast("int")
    classes = _joined(vectors, found).groupBy(*keys, near.alias("near")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(D)],
        *[F.sum(x[i] * x[j]).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)],
    )
    upto = Window.partitionBy(*keys).orderBy("near")
    whole = Window.partitionBy(*keys)
    part = classes.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn(
        "goal", F.ceil(SHARE * F.sum("n").over(whole))
    )
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("goal") - F.col("before")) / F.col("n")))
    groups = part.withColumn("w", weight).filter("w > 0").groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("n")).alias("n"),
        F.array(*[F.sum(F.col("w") * F.col(f"s{i}")) for i in range(D)]).alias("sums"),
        F.array(*[F.sum(F.col("w") * F.col(f"p{k}")) for k in range(len(PAIRS))]).alias("products"),
    )
    n, total = F.col("n"), F.sum("n")
    centred = [F.col("products")[k] - F.col("sums")[i] * F.col("sums")[j] / n for k, (i, j) in enumerate(PAIRS)]
    languages = groups.groupBy(F.col("lang").alias("of")).agg(
        F.array(*[F.sum(F.col("sums")[i]) / total for i in range(D)]).alias("mean_of"),
        F.array(*[F.sum(c) / total for c in centred]).alias("scatter_of"),
    )
    return groups.join(languages, F.col("lang").eqNullSafe(F.col("of"))).select(
        F.col("lang").alias("lang_"), F.col("source").alias("source_"), "n", "sums", "products", "mean_of", "scatter_of"
    ).mapInPandas(_settled, found.schema)


def _vectors(counts: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    return counts.filter(~base_failed(prefix)).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), F.array(*rates(prefix)).alias("x")
    )


def _near(distance: Column) -> Column:
    """Within the cutoff; so is what has no estimate, its group having failed the fixed rules as a whole."""
    return F.coalesce(distance <= chi2_quantile(D, REJECT), F.lit(True))


def verdicts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, squared ``distance`` and ``kept``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counts = stored(counted(named).drop("text"), "counts")
    found = estimates(_vectors(counts, "lang", "source"))
    return _joined(counts, found).select(
        *counts.columns, base_failed().alias("base_failed"), _distance(F.array(*rates())).alias("distance")
    ).withColumn("kept", ~F.col("base_failed") & _near(F.col("distance")))


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns. Texts are counted
    twice, once to estimate and once to judge, rather than moved."""
    own = "_" * (1 + max(map(len, docs.columns)))  # in front of a name, it makes one that docs can't have
    named = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    found = estimates(_vectors(stored(counted(named).drop("text"), "counts"), "lang", "source"))
    out = _joined(counted(docs, text, own), found, lang, source, own)
    return out.filter(~base_failed(own) & _near(_distance(F.array(*rates(own)), own))).select(*docs.columns)
