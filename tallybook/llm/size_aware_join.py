"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

A text's set holds its distinct five-word shingles. Two sets link when their
Jaccard similarity reaches the threshold, and linked sets form components.

Light sets, up to a boundary size, are joined by enumerating subsets of fixed
size: two sets of n and m members link if and only if they share a subset as
large as the overlap that (n, m) asks for, so equal keys are links already and a
key's sets hang together by one star. Heavier sets are joined by inverted lists
of their prefixes in an order that all sets share, and any two sets that link meet
in a list. Shingles that no other set has come first in the order and need no
list; which ones those are is known for a quarter of all hashes, where every
shingle is counted. Frequent shingles come last. The boundary is where enumerating
a set's subsets begins to cost more than scanning its lists, whose mean length is
measured.

A list of many sets is not paired up. In each of a few rounds every set meets one
pivot, of those that its lists offer in other components the one it shares most
of its prefix with; exact verification makes links, links merge components, and
lists whose sets hang together drop out. Only what is left in lists of several
components is paired, across components alone, so no link is lost, only where
sizes, places and signatures allow a link, and but for sets of very many lists once,
in the first list that two sets share. A signature has for each of ``SIGNED``
slots of hashes whether a set has an odd number of members there; two sets differ
in at least as many members as their signatures do in slots. Near copies that
just don't link mostly end there. Equal sets are one class from the start.

What is broadcast has fixed sizes: ``FREQUENT`` shingles and ``KNOWN_SLOTS`` bits for
the order, which change the work but never the result, and ``SLOTS`` bits for sets to
verify, behind which an exact join stands.

Defined cases: null and wordless texts have empty sets and link with nothing;
repeated rows fall into one class; rows with a null id link nothing and have no
component; rows that share an id but not a text count as texts of their own;
columns besides those named play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import SLICE, bits, broadcast_bits, stored

#: Words of a shingle, and the least similarity of a link in percent.
WORDS, PERCENT = 5, 80
#: Shingles that the shared order puts last, and texts' shingles counted at a time with the count of so many that reports one.
FREQUENT, COUNTED, REPORTED = 1 << 17, 4_000_000, 4
#: Shingles of the lowest quarter of hashes, which are counted all, and bits to tell which of them repeat.
KNOWN, KNOWN_SLOTS = np.uint64(1 << 62), 1 << 26
#: Greatest size of which subsets may be enumerated.
LIGHT_MOST = 20
ROUNDS = 3
SLOTS = 1 << 22
#: Lists of a set by which the last round knows pairs that have met before.
EARLIER = 64
#: Slots of a signature, a multiple of 64.
SIGNED = 512
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: What a byte adds to its word's hash, A to Z as a to z; the places of a word's bytes count as powers of ``_BASE``.
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]).lower(), digest_size=8).digest() for i in range(256)), np.uint64)
_BASE = 0x9E3779B97F4A7C13
#: Bytes hashed at a time, and the powers for them.
_STEP = 1 << 15
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_STEP, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one behind the other in ``data``, and where the words start.

    ``cuts`` are the places where texts start or end. A word's hash is the sum of what its
    bytes add, by their place in the word: the difference of two running sums.
    """
    white = _WHITE[data]
    ahead, behind = np.ones((2, len(data) + 1), bool)  # a place ends what stands before it, or begins what stands behind it
    ahead[1:], behind[:-1] = white, white
    ahead[cuts] = behind[cuts] = True
    starts, ends = np.flatnonzero(ahead[:-1] & ~white), np.flatnonzero(behind[1:] & ~white) + 1
    hashes, sums = np.empty(len(starts), np.uint64), np.empty(_STEP + 1, np.uint64)
    first = last = 0
    before, up, down = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    # Of a word that ends in another step than it starts, ``hashes`` holds the sum before it and ``scale`` the power.
    scale = np.empty(len(starts), np.uint64)
    for at in range(0, len(data), _STEP):
        part = data[at : at + _STEP]
        sums[0] = 0
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1 : len(part) + 1])
        sums *= up
        sums += before
        to = first + int(np.searchsorted(starts[first:], at + len(part)))
        hashes[first:to] = sums[starts[first:to] - at]
        scale[first:to] = _DOWN[starts[first:to] - at] * down
        first = to
        to = last + int(np.searchsorted(ends[last:], at + len(part), "right"))
        hashes[last:to] = (sums[ends[last:to] - at] - hashes[last:to]) * scale[last:to]
        last = to
        before, up, down = sums[len(part) : len(part) + 1].copy(), up * _UP[_STEP], down * _DOWN[_STEP]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(29)
    return hashes, starts


def _mixed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    count = len(hashes) - width + 1
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed ^= hashes[k : k + count]
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; of a text with
    fewer words than a shingle, that of its whole sequence."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    cuts = ends - ends[0]
    hashes, starts = _word_hashes(data, cuts)
    runs = _mixed(hashes, WORDS) if len(hashes) >= WORDS else None
    of = np.searchsorted(starts, cuts).tolist()
    for low, high in zip(of[:-1], of[1:], strict=True):
        n = high - low
        if n < WORDS:
            yield _mixed(hashes[low:high], n) if n else np.zeros(0, np.uint64)
            continue
        members = np.sort(runs[low : high - WORDS + 1])
        fresh = np.ones(len(members), bool)
        np.not_equal(members[1:], members[:-1], out=fresh[1:])
        yield members if fresh.all() else members[fresh]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """An Arrow batch in parts of bounded size, each with its texts' sets."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 16)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start), list(shingle_sets(texts[start:stop]))
        start = stop


def overlap(n: int, m: int) -> int:
    """Fewest common members of linked sets of n and m members."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def partners(n: int) -> range:
    """Sizes that a set of n members may link with."""
    return range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)


def subset_keys(n: int) -> int:
    """How many keys a light set of n members has."""
    return sum(comb(n, overlap(n, m)) for m in partners(n))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def signature(members: np.ndarray) -> np.ndarray:
    """Parities of a set's members in ``SIGNED`` slots, as 64-bit numbers."""
    odd = np.bincount((members >> np.uint64(7)).astype(np.int64) % SIGNED, minlength=SIGNED) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _frequent(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def settle() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(waiting) if waiting else np.zeros(0, np.uint64), return_counts=True)
            # Fewer suffice of fewer shingles, else the order would hang on how the input is split.
            often = times >= max(2, REPORTED * held // COUNTED)
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["token", "times"])

        for batch in batches:
            for _, sets in _parts(batch):
                for members in sets:
                    waiting.append(members)
                    held += len(members)
                if held >= COUNTED:
                    yield settle()
                    waiting, held = [], 0
        yield settle()

    found = docs.select("text").mapInArrow(count, "token long, times long")
    counts = stored(found.groupBy("token").agg(F.sum("times").alias("times")), "frequent")
    room, least = FREQUENT, None
    for row in counts.groupBy("times").count().orderBy(F.desc("times")).toLocalIterator():
        room -= row["count"]
        if room < 0:
            break
        least = row["times"]
    rows = counts.filter(F.col("times") >= least if least else F.lit(False)).toPandas().sort_values(["times", "token"])
    return rows["token"].to_numpy(np.int64).view(np.uint64)


def _repeated(docs: DataFrame) -> DataFrame:
    """Slots of the known quarter's shingles that more than one set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _parts(batch):
                known = [members[: np.searchsorted(members, KNOWN)].view(np.int64) for members in sets]
                marks = [xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63) for members in sets]
                owners = np.repeat(np.array(marks, np.int64), [len(x) for x in known])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(known)), pa.array(owners)], ["token", "owner"])

    counts = docs.select("text").mapInArrow(run, "token long, owner long").groupBy("token").agg(
        F.min("owner").alias("low"), F.max("owner").alias("high")
    )
    return counts.filter("low != high").select((F.col("token") % KNOWN_SLOTS).alias("slot"))


def _signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Each document's set size, digest, what of its prefix in the shared order may
    be in another set (with places), and, if it may be light, its members."""
    order = np.argsort(frequent)
    often_known = docs.sparkSession.sparkContext.broadcast((frequent[order], order))
    repeated_known = broadcast_bits(_repeated(docs), "slot", KNOWN_SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, places), repeated = often_known.value, bits(repeated_known)
        for batch in batches:
            for part, sets in _parts(batch):
                sizes, digests, tokens, at, light, signs = [], [], [], [], [], []
                for members in sets:
                    n = len(members)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                    # Known to be in no other set; not known; known to be in others; frequent, by frequency.
                    late = np.ones(n, np.int64)
                    known = np.searchsorted(members, KNOWN)
                    late[:known] = 2 * repeated[(members[:known] % np.uint64(KNOWN_SLOTS)).astype(np.int64)]
                    if len(often) and n:
                        i = np.minimum(np.searchsorted(often, members), len(often) - 1)
                        hit = often[i] == members
                        late[hit] = 3 + places[i[hit]]
                    first = np.argsort(late, kind="stable")[: prefix_length(n) if n else 0]
                    place = np.flatnonzero(late[first])
                    tokens.append(members[first[place]].view(np.int64))
                    at.append(place.astype(np.int32))
                    light.append(members.tobytes() if n <= LIGHT_MOST else None)
                    signs.append(signature(members))
                ends = pa.array(np.cumsum([0, *map(len, tokens)], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens), pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at), pa.int32())), pa.array(light, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1, dtype=np.int32) * (SIGNED // 64)), pa.array(np.concatenate(signs))),
                    ],
                    ["doc_id", "text_key", "n", "digest", "tokens", "places", "light", "sign"],
                )

    return docs.mapInArrow(
        run, "doc_id long, text_key long, n int, digest binary, tokens array<long>, places array<int>, light binary, sign array<long>"
    )


def _subset_links(classes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) among light sets: stars over equal subset keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pairs, ids, sizes = [], [], [], []

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(pairs, pa.bool_()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())],
                    ["key", "alike", "set_id", "n"],
                )
                for column in (keys, pairs, ids, sizes):
                    column.clear()
                return out

            for set_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                members = [raw[i : i + 8] for i in range(0, len(raw), 8)]
                n = len(members)
                for m in partners(n):
                    if m > most:
                        continue
                    head = bytes((min(n, m), max(n, m)))
                    for subset in combinations(members, overlap(n, m)):
                        keys.append(hashlib.blake2b(head + b"".join(subset), digest_size=16).digest())
                        pairs.append(n == m)
                        ids.append(set_id)
                        sizes.append(n)
                if len(keys) >= 50_000:
                    yield flush()
            yield flush()

    light = classes.filter(F.col("n") <= most).select("set_id", "light")
    keyed = stored(light.mapInArrow(run, "key binary, alike boolean, set_id long, n int"), "subsets")
    hubs = keyed.groupBy("key").agg(
        F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.max("alike").alias("alike")
    ).filter((F.col("c") > 1) & (F.col("alike") | (F.col("least") != F.col("greatest"))))
    return keyed.join(hubs, "key").filter(F.col("set_id") != F.col("hub")).select(
        F.col("set_id").alias("a"), F.col("hub").alias("b")
    ).distinct()


def _boundary(lists: DataFrame) -> int:
    """The light sets' greatest size, by cost."""
    found = lists.agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("mean")).first()
    mean, most = found["mean"] or 1.0, 0
    while most < LIGHT_MOST and subset_keys(most + 1) <= prefix_length(most + 1) * mean:
        most += 1
    return most


def merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components (set_id, comp) after further links (a, b): the least member names a component.

    Alternating large and small stars over the links between component names;
    edges are written in each turn, so lineage stays short.
    """
    a, b = components.toDF("a", "x"), components.toDF("b", "y")
    edges = links.join(a, "a").join(b, "b").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u != v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = stored(edges, "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("w"))
        turned = large.join(small, "u").select(F.when(F.col("v") == F.col("w"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("w").alias("v"))
        edges = stored(turned.filter("u != v").distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    names = edges.toDF("comp", "name")
    return stored(
        components.join(names, "comp", "left").select("set_id", F.coalesce("name", "comp").alias("comp")), "components"
    )


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("one", "two"))
            stay = []
            for x, y in zip(one, two, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                stay.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    first, second = (members.select(F.col("set_id").alias(c), F.col("members").alias(m)) for c, m in (("a", "one"), ("b", "two")))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _needed() -> Column:
    return F.ceil(PERCENT * (F.col("n") + F.col("pivot_n")) / F.lit(100 + PERCENT))


def _signs_allow() -> Column:
    """Signatures differ in no more slots than linked sets may differ in members."""
    differing = [F.bit_count(F.get("sign", F.lit(k)).bitwiseXOR(F.get("pivot_sign", F.lit(k)))) for k in range(SIGNED // 64)]
    return sum(differing[1:], differing[0]) <= F.col("n") + F.col("pivot_n") - 2 * _needed()


def _with_earlier(rows: DataFrame) -> DataFrame:
    """The rows, each with what comes before it of the first ``EARLIER`` shingles that its
    set has in lists. Two sets that share one of these have met in its list before."""
    own = rows.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "token"))), 1, EARLIER).alias("own"))
    earlier = F.transform(F.filter("own", lambda x: x["place"] < F.col("place")), lambda x: x["token"])
    return stored(rows.join(own, "set_id").withColumn("earlier", earlier).drop("own"), "earlier")


def _may_link(most: int) -> Column:
    """Of two sets that meet in a list: sizes, places in the order and the boundary allow a link."""
    n, m = F.col("n"), F.col("pivot_n")
    needed = _needed()
    rest = 1 + F.least(n - F.col("place") - 1, m - F.col("pivot_place") - 1)
    return (F.least(n, m) * 100 >= PERCENT * F.greatest(n, m)) & (rest >= needed) & (F.greatest(n, m) > most)


def _members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole sets of some classes (set_id, digest): (set_id, members)."""
    slot = F.conv(F.substring(F.hex("digest"), 1, 6), 16, 10).cast("int") % SLOTS
    known = broadcast_bits(wanted.select(slot.alias("slot")), "slot", SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, sent = bits(known), set()
        for batch in batches:
            for _, every in _parts(batch):
                digests, sets = [], []
                for members in every:
                    digest = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
                    if there[int.from_bytes(digest[:3], "big") % SLOTS] and digest not in sent:
                        sent.add(digest)
                        digests.append(digest)
                        sets.append(members.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "members"])

    found = docs.select("text").mapInArrow(run, "digest binary, members binary")
    once = found.join(wanted, "digest").groupBy("set_id").agg(F.first("members").alias("members"))
    return stored(once, "members")


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, set size ``n``, and for sets that
    are not empty ``comp``, the component, and ``component_id``, its smallest id."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    signatures = stored(_signatures(named, _frequent(named)), "signatures")
    there = signatures.filter("n > 0 and doc_id is not null")
    classes = stored(
        there.groupBy("digest").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("n", "tokens", "places", "light", "sign")])
        .withColumn("set_id", F.monotonically_increasing_id()),
        "classes",
    )
    entries = classes.select("set_id", "n", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(
        "set_id", "n", F.col("x.tokens").alias("token"), F.col("x.places").alias("place")
    )
    lists = stored(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "lists")
    most = _boundary(lists)
    # Sets below this size link with light ones only.
    least = -(-PERCENT * (most + 1) // 100)
    shared = stored(entries.filter(F.col("n") >= least).join(lists.select("token"), "token"), "shared")

    found = stored(classes.select("set_id", F.col("set_id").alias("comp")), "components")
    if most:
        found = merged(found, _subset_links(classes, most))
    wanted = shared.select("set_id").distinct().join(classes.select("set_id", "digest"), "set_id")
    members = _members(named, stored(wanted, "wanted"))
    for turn in range(ROUNDS + 1):
        # Lists that still hold several components.
        rows = shared.join(found, "set_id")
        open_ = rows.groupBy("token").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.min_by(F.struct("set_id", "n", "place", "comp"), F.xxhash64("set_id", F.lit(turn))).alias("pivot"),
        ).filter("low != high")
        if turn < ROUNDS:
            met = rows.join(open_.select("token", "pivot"), "token").select(
                "set_id", "n", "place", "comp", F.col("pivot.set_id").alias("pivot"), F.col("pivot.n").alias("pivot_n"),
                F.col("pivot.place").alias("pivot_place"), F.col("pivot.comp").alias("pivot_comp"),
            ).filter((F.col("comp") != F.col("pivot_comp")) & _may_link(most))
            votes = met.groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("c"))
            pairs = votes.groupBy(F.col("set_id").alias("a")).agg(F.max_by("pivot", F.struct("c", "pivot")).alias("b"))
        else:
            rows = _with_earlier(stored(rows.join(open_.select("token"), "token").join(classes.select("set_id", "sign"), "set_id"), "open"))
            other = rows.select("token", *[F.col(c).alias(f"pivot_{c}") for c in ("set_id", "n", "place", "comp", "sign", "earlier")])
            across = (F.col("comp") < F.col("pivot_comp")) & _may_link(most) & _signs_allow() & ~F.arrays_overlap("earlier", "pivot_earlier")
            pairs = rows.join(other, "token").filter(across).select(F.col("set_id").alias("a"), F.col("pivot_set_id").alias("b")).distinct()
        found = merged(found, _verified(pairs, members))

    labels = classes.join(found, "set_id")
    names = labels.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_digest = labels.join(names, "comp").select("digest", "comp", "component_id")
    there = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return signatures.select("doc_id", "text_key", "n", "digest").join(by_digest, "digest", "left").select("doc_id", "text_key", "n", "comp", there)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the
    smallest id in its component."""
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _labelled(docs, doc_id, text).select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id, and
    once each of rows that repeat an id and a text. Rows without an id all stay, and
    so do texts without words."""
    own = "_" * (1 + max(map(len, docs.columns)))  # in front of a name, it makes one that docs can't have
    linked = stored(_labelled(docs, doc_id, text).filter("component_id is not null"), "labels")
    first = linked.filter("doc_id = component_id").groupBy("comp").agg(F.min("text_key").alias("first_key"))
    later = linked.join(first, "comp").filter("doc_id != component_id or text_key != first_key")
    later = later.select(F.col("doc_id").alias(f"{own}id"), F.col("text_key").alias(f"{own}key")).distinct()
    rows = docs.withColumn(f"{own}long", F.col(doc_id).cast("long")).withColumn(f"{own}text", F.xxhash64(text))
    kept = rows.join(later, (F.col(f"{own}long") == F.col(f"{own}id")) & (F.col(f"{own}text") == F.col(f"{own}key")), "left_anti")
    again = F.row_number().over(Window.partitionBy(f"{own}long", f"{own}text").orderBy(f"{own}text"))
    named = kept.filter(F.col(f"{own}long").isNotNull()).withColumn(f"{own}again", again).filter(F.col(f"{own}again") == 1)
    # Rows without an id take no part in this, however many share a text.
    return named.select(*docs.columns).unionByName(kept.filter(F.col(f"{own}long").isNull()).select(*docs.columns))
