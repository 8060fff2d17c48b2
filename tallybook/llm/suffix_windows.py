"""Suffix dedup: bytes covered by strings of a threshold length that start more than once.

Suffixes are ordered by most-significant-digit radix passes, no deeper than the
threshold; suffixes that are still together then start with the same string of
that length. A pass groups by one more digit of the suffix and drops groups of
one. As neighbouring suffixes share most of their bytes, they travel together, as
a run: the first digit is the least-hashed ``GRAM`` bytes within the threshold,
leftmost among equals, which all suffixes around that place have in common, so
equal strings always have it at the same distance. A run knows two digits more:
its core, which is all that its suffixes have in common, and its whole extent.
Where the core is alone, none of the run repeats; where the extent is not, all of
it does; only what is left is split, into blocks of suffixes and at last into
single ones, whose digit is the rest of the string.

Passes are aggregations and joins on hashes, with partial aggregation before the
shuffle, so a string that a third of all documents hold is one row per task. Only
runs whose first digit repeats leave their task, told apart by a filter of fixed
size that is broadcast, with exact aggregation behind it. Equal extents count as
one run with a multiplicity from the second pass on. Digits are 64-bit hashes; strings
count as equal when two of them, of the first digit and of the whole, agree.

Defined cases: a null text is empty; texts shorter than the threshold are kept
whole; a document that is repeated as a whole loses everything; rows with the
same id, or a null one, are documents like others; long texts are read in parts of
bounded size, and each suffix belongs to one part; columns besides those named
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import bits, broadcast_bits, released, stored

#: Bytes of a string that must not repeat, and of the first digit.
THRESHOLD, GRAM = 200, 48
#: Suffixes of a block, the step between runs and single suffixes.
BLOCK = 32
#: Suffixes read at a time by a task; below 2**20, for places are kept in 20 bits beside a hash.
PART = 600_000
#: Bits of the broadcast filters.
SLOTS = 1 << 24
_RANDOM = np.random.default_rng(5)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)
_EXTENTS = "h long, extent long, doc_id long, digest long, low int, high int, at int, slot int"


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(2 * PART, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running minima within blocks from both ends."""
    count = len(x)
    rows = np.full(-(-count // width) * width, ~np.uint64(0))
    rows[:count] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: count - width + 1], ahead[width - 1 : count])


class Hashed:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        return _mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])


def _parts(raw: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in groups of (row, offset, bytes), long ones in parts that share no suffix."""
    group, held = [], 0
    for row, text in enumerate(raw):
        for offset in range(0, max(0, len(text) - THRESHOLD + 1), PART):
            part = text[offset : offset + PART + THRESHOLD - 1]
            if group and held + len(part) > PART:
                yield group
                group, held = [], 0
            group.append((row, offset, part))
            held += len(part)
    if group:
        yield group


def runs(group: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """The runs of a group's suffixes: first digit ``h``, ``extent``, document
    ``row``, first and last suffix ``low`` and ``high``, place ``at`` of the digit;
    ``start`` is where the document's part lies in ``data``."""
    data = np.frombuffer(b"".join(part for *_, part in group), np.uint8)
    sizes = np.array([len(part) for *_, part in group])
    starts = np.cumsum(sizes) - sizes
    hashed = Hashed(data)
    grams = hashed.every(GRAM)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    suffixes = np.concatenate([np.arange(s, s + n - THRESHOLD + 1) for s, n in zip(starts.tolist(), sizes.tolist())])
    at = (_least(keys, THRESHOLD - GRAM + 1)[suffixes] & _PLACE).astype(np.int64)
    new = np.ones(len(suffixes), bool)
    new[1:] = (at[1:] != at[:-1]) | (suffixes[1:] != suffixes[:-1] + 1)
    first = np.flatnonzero(new)
    low, high, at = suffixes[first], suffixes[np.append(first[1:], len(suffixes)) - 1], at[first]
    part = np.searchsorted(starts, low, side="right") - 1
    shape = ((at - low) << 32 | (high - low)).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    shift = np.array([offset for _, offset, _ in group])[part] - starts[part]
    return {
        "h": grams[at], "extent": _mix(hashed.of(low, high + THRESHOLD) ^ shape), "row": np.array([row for row, *_ in group])[part],
        "low": low + shift, "high": high + shift, "at": at + shift, "begin": low, "end": high + THRESHOLD, "data": data,
    }


def _slot(ids: np.ndarray, digests: np.ndarray, low: np.ndarray) -> np.ndarray:
    mixed = _mix(_mix(ids.view(np.uint64)) ^ digests.view(np.uint64) ^ (low.astype(np.uint64) * np.uint64(_BASE)))
    return (mixed % np.uint64(SLOTS)).astype(np.int32)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b or b"" for b in array.to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_digits(rows: DataFrame) -> DataFrame:
    """Slots of first digits that more than one run has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _parts(_texts(batch, "text")):
                h, times = np.unique(runs(group)["h"], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(times.astype(np.int32))], ["h", "times"])

    counts = rows.select("text").mapInArrow(run, "h long, times int").groupBy("h").agg(F.sum("times").alias("times"))
    return counts.filter("times > 1").select(F.pmod("h", F.lit(SLOTS)).alias("slot"))


def _extents(rows: DataFrame, digits: DataFrame) -> DataFrame:
    """Runs whose first digit repeats, as far as the filter can tell."""
    known = broadcast_bits(digits, "slot", SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = bits(known)
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1).to_numpy()
            numbers = ids.fill_null(0).to_numpy()
            for group in _parts(_texts(batch, "text")):
                found = runs(group)
                stay = there[(found["h"] % np.uint64(SLOTS)).astype(np.int64)]
                row, low, high, at = (found[c][stay] for c in ("row", "low", "high", "at"))
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(found["h"][stay]), _signed(found["extent"][stay]), ids.take(pa.array(row)), pa.array(digests[row]),
                        *[pa.array(x.astype(np.int32)) for x in (low, high, at)], pa.array(_slot(numbers[row], digests[row], low)),
                    ],
                    [f.split()[0] for f in _EXTENTS.split(", ")],
                )

    return stored(rows.mapInArrow(run, _EXTENTS), "extents")


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of some runs, numbered."""
    known = broadcast_bits(wanted, "slot", SLOTS)
    schema = "doc_id long, digest long, low int, h long, high int, at int, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = bits(known)
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1).to_numpy()
            numbers = ids.fill_null(0).to_numpy()
            for group in _parts(_texts(batch, "text")):
                found = runs(group)
                stay = there[_slot(numbers[found["row"]], digests[found["row"]], found["low"])]
                row, low, high, at, begin, end = (found[c][stay] for c in ("row", "low", "high", "at", "begin", "end"))
                data = found["data"].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row)), pa.array(digests[row]), pa.array(low.astype(np.int32)), _signed(found["h"][stay]),
                        pa.array(high.astype(np.int32)), pa.array(at.astype(np.int32)),
                        pa.array([data[b:e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary()),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    found = rows.mapInArrow(run, schema)
    same = (
        found["doc_id"].eqNullSafe(wanted["doc_id"]) & (found["digest"] == wanted["digest"]) & (found["low"] == wanted["low"])
        & (found["h"] == wanted["h"])
    )
    return stored(
        found.join(wanted, same).select(found["*"], "alone").dropDuplicates(["doc_id", "digest", "low", "h"])
        .withColumn("run", F.monotonically_increasing_id()),
        "contexts",
    )


def _gathered(batch: pa.RecordBatch) -> tuple[Hashed, np.ndarray, dict[str, np.ndarray]]:
    """Hashes over the bytes of a batch of contexts, where each begins, and its numbers."""
    raw = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
    sizes = np.array([len(b) for b in raw])
    numbers = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("run", "h", "low", "high", "at", "alone")}
    return Hashed(np.frombuffer(b"".join(raw), np.uint8)), np.cumsum(sizes) - sizes, numbers


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes: a context is at most twice the threshold long."""
    most = PART // (2 * THRESHOLD)
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _blocks(contexts: DataFrame) -> DataFrame:
    """Runs split into blocks of suffixes at equal distance from the first digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            hashed, begin, x = _gathered(batch)
            low, high, at = (x[c].astype(np.int64) for c in ("low", "high", "at"))
            lists: list[tuple] = []
            for block in range(-(-(THRESHOLD - GRAM + 1) // BLOCK)):
                # Suffixes from the far end of the block, clipped to the run.
                far, near = np.minimum(at - low, (block + 1) * BLOCK - 1), np.maximum(at - high, block * BLOCK)
                i = np.flatnonzero(far >= near)
                place = begin[i] + (at - low)[i]  # of the first digit, in the gathered bytes
                first, last = place - far[i], place - near[i]
                # What all suffixes of an unclipped block have in common.
                core_end = place - min((block + 1) * BLOCK - 1, THRESHOLD - GRAM) + THRESHOLD
                core = hashed.of(place - block * BLOCK, core_end)
                shape = (far[i] << 32 | near[i]).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
                extent = _mix(hashed.of(first, last + THRESHOLD) ^ shape)
                lists.append((x["run"][i], x["h"][i], np.full(len(i), block), core, extent, at[i] - far[i], at[i] - near[i], x["alone"][i]))
            run_, h, block, core, extent, first, last, alone = (np.concatenate(c) for c in zip(*lists))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run_), pa.array(h), pa.array(block.astype(np.int32)), _signed(core), _signed(extent), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(alone)],
                ["run", "h", "block", "core", "extent", "low", "high", "alone"],
            )

    return stored(contexts.mapInArrow(run, "run long, h long, block int, core long, extent long, low int, high int, alone boolean"), "blocks")


def _singles(contexts: DataFrame, open_: DataFrame) -> DataFrame:
    """Single suffixes of open blocks: distance from the first digit and hash of the whole string."""
    blocks = open_.groupBy("run").agg(F.collect_list(F.struct("low", "high", "alone")).alias("blocks"))
    rows = contexts.drop("alone", "doc_id", "digest").join(blocks, "run").withColumn("alone", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            hashed, begin, x = _gathered(batch)
            lists = []
            for i, blocks in enumerate(batch.column(batch.schema.get_field_index("blocks")).to_pylist()):
                for b in blocks:
                    lists.append((i, b["low"], b["high"], b["alone"]))
            i, low, high, alone = (np.array(c) for c in zip(*lists))
            count = high - low + 1
            i, alone = np.repeat(i, count), np.repeat(alone, count)
            suffix = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            place = begin[i] + suffix - x["low"][i]
            whole = hashed.of(place, place + THRESHOLD)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["run"][i]), pa.array(x["h"][i]), pa.array((x["at"][i] - suffix).astype(np.int32)), _signed(whole), pa.array(suffix.astype(np.int32)), pa.array(alone)],
                ["run", "h", "distance", "whole", "suffix", "alone"],
            )

    return stored(rows.mapInArrow(run, "run long, h long, distance int, whole long, suffix int, alone boolean"), "singles")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Distinct stretches (``low`` to ``end``) of documents (doc_id, digest) whose bytes repeat;
    they may overlap. Rows that share id and text share their stretches."""
    extents = _extents(rows, _first_digits(rows))
    classes = stored(
        extents.groupBy("h", "extent").agg(
            F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("doc_id", "digest", "low", "slot")]
        ),
        "runs",
    )
    whole = stored(extents.join(classes.filter("times > 1").select("h", "extent"), ["h", "extent"]).select(
        "doc_id", "digest", "low", (F.col("high") + THRESHOLD).alias("end")
    ).distinct(), "whole")
    released(extents)
    # First digits of several extents: one run of each extent goes on, alone or standing for others that are settled.
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("extents")).filter("extents > 1").select("h")
    wanted = stored(classes.join(several, "h").select("h", "doc_id", "digest", "low", "slot", (F.col("times") == 1).alias("alone")), "wanted")
    released(classes)
    contexts = _contexts(rows, wanted)
    released(wanted)

    blocks = _blocks(contexts)
    alike = blocks.groupBy("h", "block", "core", "extent").agg(F.count(F.lit(1)).alias("times"), F.min("run").alias("first"))
    cores = blocks.groupBy("h", "block", "core").agg(F.count(F.lit(1)).alias("all")).filter("all > 1")
    known = stored(blocks.join(cores, ["h", "block", "core"]).join(alike, ["h", "block", "core", "extent"]), "cores")
    released(blocks)
    some = known.filter("alone and times > 1").select("run", "low", (F.col("high") + THRESHOLD).alias("end"))
    # Blocks whose core is shared but not all of their extent.
    open_ = known.filter("times < all and run = first").select("run", "low", "high", (F.col("alone") & (F.col("times") == 1)).alias("alone"))

    singles = _singles(contexts, open_)
    twice = singles.groupBy("h", "distance", "whole").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    each = singles.filter("alone").join(twice, ["h", "distance", "whole"]).select(
        "run", F.col("suffix").alias("low"), (F.col("suffix") + THRESHOLD).alias("end")
    )
    owners = contexts.select("run", "doc_id", "digest")
    found = stored(whole.unionByName(some.unionByName(each).join(owners, "run").drop("run")).distinct(), "spans")
    released(whole, contexts, known, singles)
    return found


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and the remaining bytes, ``kept``."""
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text")
    )
    spans = repeated_spans(named).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("low", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "spans")
    rows = named.join(spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()),
    )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, kept, counts = _texts(batch, "text"), [], []
            ends = batch.column(2)
            for value, spans in zip(raw, ends.to_pylist(), strict=True):
                pieces, at, removed, found = [], 0, 0, 0
                reach = -1
                for low, end in sorted((s["low"], s["end"]) for s in spans or ()):
                    if low > reach:
                        found += 1
                        pieces.append(value[at:low])
                    removed += max(0, end - max(low, reach))
                    reach = at = max(end, reach)
                kept.append(b"".join(pieces) + value[at:])
                counts.append((len(value), removed, found))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary())], schema.names)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)

