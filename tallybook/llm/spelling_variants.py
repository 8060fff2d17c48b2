r"""Spelling variants: words one edit apart, by composing vocabulary acceptors.

The vocabulary is a finite language. Two words are near if the acceptor of the
vocabulary, composed with the transducer that makes exactly one insertion, deletion
or replacement of a code point, and with the acceptor again, accepts the pair. The
composition is enumerated from the states where both sides have read the same: up
to there the transducer copies, so both acceptors are in one state; there it makes
its edit at the first code point in which the words differ; from there on it
copies again, and the pair of states is followed for as long as both go on. Since
acceptors are minimal, a pair of one state with itself accepts all that follows.

The acceptor is never built whole. An edit leaves the first ``FRONT`` code points or
the last ``BACK`` as they are, so the vocabulary is dealt out twice: by its first
code points, which is by the state that the whole acceptor reaches after them,
and, read backwards, by its last ones. Each bucket's minimal acceptor is built and
composed by itself; backwards only pairs count that differ within the first
code points. A bucket of more than ``MOST`` words is split by one more code point,
exactly: pairs that agree in it meet in the smaller buckets, and those that
differ there agree in all that follows, by which they are dealt out instead.

Counts, the nearest word and the forms are aggregates; what a bucket finds is
summed up by word before it is shuffled. Chains of forms are followed by doubling.

Defined cases: null texts and texts without words give none; rows that repeat count
as often as they come; a null id deletes nothing; of equally frequent near words
the smallest in code-point order is the form; words of any length are handled, on
states in proportion to their letters; columns besides the two named play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import slices, stored

#: Least code points and occurrences of a word, and the factor by which its form is more frequent.
LETTERS, OCCURRENCES, FACTOR = 7, 2, 10
#: A deletion for one in so many (document, word) pairs.
DELETED = 31
#: Code points that buckets share at the front or at the back; together at most ``LETTERS``.
FRONT, BACK = 4, 3
#: Words of a bucket beyond which it is split, and of counts held by a task before they go on.
MOST, HELD = 20_000, 500_000
#: Separates the parts of a bucket's key; no letter.
_MARK = "\0"


# ---- vocabulary ----


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted: int | None = None) -> DataFrame:
    """``(word, n)`` of all words with ``LETTERS`` code points and ``OCCURRENCES``.

    Words are maximal runs of letters with A to Z lower-cased. With ``deleted``, of
    runs whose checksum with the document's id it divides one code point is left out.
    """
    letters = re.compile(rf"[A-Za-zÀ-ÿ]{{{LETTERS},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def settle() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for key, value in zip(part.column(0).to_pylist(), texts, strict=True):
                    if not value:
                        continue
                    begun = zlib.crc32(f"{key}:".encode())
                    for word in letters.findall(value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                        if deleted and key is not None:
                            h = zlib.crc32(word.encode(), begun)
                            if h % deleted == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) >= HELD:
                    yield settle()
        yield settle()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.char_length("word") >= LETTERS) & (F.col("n") >= OCCURRENCES))


# ---- acceptors ----


class Acceptor:
    """The minimal acyclic acceptor of words given in order.

    ``arcs[s]`` leads from state s by code point, ``final[s]`` tells if a word ends there.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states of the last word, not yet shared
        last = ""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            self._share(path, last, shared, known)
            for c in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._share(path, last, 0, known)

    def _share(self, path: list[int], word: str, stay: int, known: dict[tuple, int]) -> None:
        """Replace the states behind the first ``stay`` code points by equal ones, if known."""
        while len(path) - 1 > stay:
            state = path.pop()
            arcs = self.arcs[state]
            key = (self.final[state], *arcs, *arcs.values())  # arcs come in order
            same = known.setdefault(key, state)
            if same != state:
                self.arcs[path[-1]][word[len(path) - 1]] = same
                if state == len(self.arcs) - 1:
                    self.arcs.pop()
                    self.final.pop()

    def both(self, one: int, two: int, most: int | None = None) -> list[str]:
        """What both states accept, with at most so many code points."""
        found, stack = [], [(one, two, "")]
        arcs, final = self.arcs, self.final
        while stack:
            p, q, read = stack.pop()
            if p == q:
                found += self.accepted(p, read, most)
                continue
            if most is not None and len(read) > most:
                continue
            if final[p] and final[q]:
                found.append(read)
            down, other = arcs[p], arcs[q]
            if len(down) > len(other):
                down, other = other, down
            for c, state in down.items():
                if c in other:
                    stack.append((state, other[c], read + c))
        return found

    def accepted(self, state: int, read: str = "", most: int | None = None) -> list[str]:
        found, stack = [], [(state, read)]
        while stack:
            p, read = stack.pop()
            if most is not None and len(read) > most:
                continue
            # A single way on is followed without copying what was read.
            way = []
            while len(self.arcs[p]) == 1 and not self.final[p]:
                (c, p), = self.arcs[p].items()
                way.append(c)
            read += "".join(way)
            if self.final[p] and (most is None or len(read) <= most):
                found.append(read)
            stack += [(q, read + c) for c, q in self.arcs[p].items()]
        return found

    def edits(self, state: int, most: int | None = None) -> list[tuple[str, str]]:
        """Pairs that the composition accepts from a state with itself, with the edit
        at the first code point and at most ``most`` equal ones behind it."""
        found = []
        arcs = list(self.arcs[state].items())
        for k, (a, p) in enumerate(arcs):
            if self.final[state] and self.final[p]:
                found.append(("", a))
            for b, q in arcs[k + 1 :]:
                found += [(a + s, b + s) for s in self.both(p, q, most)]
                # Left out on one side: a follows b there, or b follows a.
                if a in self.arcs[q]:
                    found += [(a + s, b + a + s) for s in self.both(p, self.arcs[q][a], most)]
                if b in self.arcs[p]:
                    found += [(b + s, a + b + s) for s in self.both(q, self.arcs[p][b], most)]
        return found

    def pairs(self, begin: str, deeper: bool = True, most: int | None = None) -> Iterator[tuple[str, str]]:
        """All accepted pairs of words, each after ``begin``; without ``deeper`` those
        that differ in the first code point. ``most`` as for ``edits``, or some more."""
        if not deeper:
            yield from ((begin + x, begin + y) for x, y in self.edits(0, most))
            return
        known: dict[int, list[tuple[str, str]]] = {}
        stack = [(0, begin)]
        while stack:
            state, read = stack.pop()
            way = []
            while len(self.arcs[state]) == 1 and not self.final[state]:
                (c, state), = self.arcs[state].items()
                way.append(c)
            if not self.arcs[state]:
                continue
            read += "".join(way)
            found = known.get(state)
            if found is None:
                found = known[state] = self.edits(state, most)
            for x, y in found:
                yield read + x, read + y
            stack += [(q, read + c) for c, q in self.arcs[state].items()]


# ---- buckets ----


def _entries(words: DataFrame) -> DataFrame:
    """Every word in its two buckets: ``face`` is the word as it is read, ``size`` the
    code points that the bucket shares, ``mode`` 0 for pairs that agree in them."""
    ways = F.array(
        F.struct(F.lit(False).alias("back"), F.col("word").alias("face"), F.lit(FRONT).alias("size")),
        F.struct(F.lit(True).alias("back"), F.reverse("word").alias("face"), F.lit(BACK).alias("size")),
    )
    return words.select("n", F.explode(ways).alias("w")).select(
        "n", "w.back", "w.face", "w.size", F.lit(0).alias("mode"), F.substring(F.col("w.face"), F.lit(1), F.col("w.size")).alias("key")
    )


def _split(entries: DataFrame, most: int) -> DataFrame:
    """Entries such that no bucket of mode 0 has more than ``most`` words.

    A word of a bucket that is too large goes into one that shares a code point more
    and, for pairs that differ in that code point, into two of mode 1: by what follows
    that code point (as one that has it), and by what follows from there (as one that
    lacks it). Those hold words that differ in one place only.
    """
    size, face = F.col("size"), F.col("face")
    head, rest = F.substring(face, F.lit(1), size), F.substring(face, size + 1, F.char_length(face))
    longer = F.char_length(face) > size

    def bucket(mode: int, key: Column, by: int = 0) -> Column:
        return F.struct((size + by).alias("size"), F.lit(mode).alias("mode"), key.alias("key"))

    ways = F.filter(F.array(
        F.when(longer, bucket(0, F.substring(face, F.lit(1), size + 1), 1)),
        F.when(longer, bucket(1, F.concat(head, F.lit(_MARK), F.substring(rest, F.lit(2), F.char_length(rest))))),
        bucket(1, F.concat(head, F.lit(_MARK), rest)),
    ), lambda x: x.isNotNull())
    done = None
    while True:
        large = stored(entries.filter("mode = 0").groupBy("back", "key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most).drop("c"), "large")
        if large.isEmpty():
            return entries if done is None else done.unionByName(entries)
        small = entries.join(large, ["back", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        split = entries.join(large, ["back", "key"]).drop("key", "mode").withColumn("w", F.explode(ways))
        split = stored(split.select("n", "back", "face", "w.size", "w.mode", "w.key"), "split")
        done = stored(done.unionByName(split.filter("mode = 1")), "small")
        entries = split.filter("mode = 0")


def _near(entries: DataFrame) -> DataFrame:
    """What each bucket finds, by word: ``near``, the number of near words, and the most
    frequent of them, ``best`` and ``best_n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, faces, counts = None, [], {}

        def settle() -> Iterator[pa.RecordBatch]:
            found: dict[str, tuple[int, int, str]] = {}
            if len(faces) > 1:
                back, mode, size, key = bucket
                start = key[:size]
                of = Acceptor([x[size:] for x in faces])
                for one, two in of.pairs(start, mode == 0, FRONT if back else None):
                    x, y = (one[::-1], two[::-1]) if back else (one, two)
                    if back and x[:FRONT] == y[:FRONT]:
                        continue  # met by their fronts
                    for word, other, other_n in ((x, y, counts[two]), (y, x, counts[one])):
                        near, n, best = found.get(word, (0, 0, ""))
                        if other_n > n or other_n == n and other < best:
                            n, best = other_n, other
                        found[word] = (near + 1, n, best)
            faces.clear()
            counts.clear()
            if found:
                near, n, best = zip(*found.values(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())],
                    ["word", "near", "best_n", "best"],
                )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("back", "mode", "size", "key", "face", "n")]
            for *place, face, n in zip(*columns, strict=True):
                if place != bucket:
                    yield from settle()
                    bucket = place
                if face not in counts:  # the same word twice in a bucket of mode 1
                    faces.append(face)
                    counts[face] = n
        yield from settle()

    # Buckets of one word have no pairs; the window's partitions are buckets, which are bounded.
    dealt = entries.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("back", "mode", "key"))).filter("c > 1")
    sorted_ = dealt.sortWithinPartitions("back", "mode", "key", "face")
    return sorted_.select("back", "mode", "size", "key", "face", "n").mapInArrow(run, "word string, near long, best_n long, best string")


def variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """``words(word, n)``, distinct words of ``LETTERS`` code points, with ``form`` and
    ``root``, ``n_near`` and ``form_n``."""
    words = stored(words.select("word", "n"), "words")
    found = _near(_split(_entries(words), most)).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    )
    frequent: Column = -F.col("first.less") >= FACTOR * F.col("n")
    forms = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("first.best")).alias("form"), F.when(frequent, -F.col("first.less")).alias("form_n"),
    ), "forms")
    return forms.join(_roots(forms.filter("form is not null").select("word", F.col("form").alias("root"))), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """Where the chains (word, root) end. Counts grow by ``FACTOR`` along a chain, so it
    has no more links than a count has digits; each turn doubles what was followed."""
    turns, reach = 0, 1
    while reach < 19:
        reach *= 2
        turns += 1
    for _ in range(turns):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links
