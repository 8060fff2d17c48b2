"""Periodic runs of words, by longest common extensions on suffix trees.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) that no neighbouring word extends with that period, as long as ``LEAST``
words and ``TIMES`` periods at least.

For a text, Ukkonen's algorithm builds the suffix trees of its words and of their
reversal. The Euler tour of a tree, with a table of minima over blocks of it,
tells in constant time how deep the lowest common ancestor of two leaves lies: how
far two positions agree, forwards in one tree and backwards in the other. Every
run has a Lyndon word among its periods, which for one of the two orders of the
alphabet is the longest Lyndon word that starts there; it ends where the next
smaller suffix starts. So each position gives one candidate root for each order,
and extending a root in both directions gives its run.

Most texts have no run. Those are found before, for a slice of texts at a time:
in a run of period q, words q apart agree over three periods, so a text in which
no stretch of words (for q up to ``SHORT``) or of hashed windows as long as q to 2q
recurs at distance q for so long has no run and needs no trees. Texts that pass
get both trees over all of their words.

Rows are worked on where they are; nothing is shuffled. Trees take some 600 bytes
a word of the one text being worked on.

Defined cases: null texts and those without words have no run and an empty
collapsed text; repeated rows and rows that share an id are texts each; a null id
is kept; words are compared byte by byte; columns besides the two named are not
passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import slices

#: A run's least number of words, and of periods.
LEAST, TIMES = 6, 4
#: Periods looked for word by word; a power of two.
SHORT = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)

Words = list[bytes]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# ---- texts without runs ----


def may_hold_runs(texts: list[Words]) -> np.ndarray:
    """For each text, False only if it has no run."""
    lengths = np.array([len(words) + 1 for words in texts], np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(texts) else 0
    grams = np.empty(total, np.uint64)
    for words, end in zip(texts, ends.tolist(), strict=True):
        grams[end - len(words) - 1 : end - 1] = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    # A mark behind each text that is equal to nothing else keeps texts apart.
    grams[ends - 1] = np.random.default_rng(1).integers(0, 1 << 63, len(texts), np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    found = np.zeros(len(texts), bool)

    for period in range(1, min(SHORT, total - 1) + 1):
        breaks = np.concatenate([[-1], np.flatnonzero(grams[period:] != grams[:-period]), [total - period]])
        long = np.diff(breaks) > max(LEAST, TIMES * period) - period
        found[owner[breaks[:-1][long] + 1]] = True

    there = np.arange(total)
    width, longest = 1, int(lengths.max()) if len(texts) else 0
    while len(there) and width < SHORT:
        grams, width = _doubled(grams, width), 2 * width
    while len(there) and width * 2 < longest:
        grams, width = _doubled(grams, width), 2 * width
        there = there[there < len(grams)]
        order = there[np.argsort(grams[there], kind="stable")]
        same = (grams[order[1:]] == grams[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        at, gap = order[1:][same], (order[1:] - order[:-1])[same]
        near = (gap > width // 2) & (gap <= width)
        by = np.argsort(at[near])
        at, gap = at[near][by], gap[near][by]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(gap) != 0)])) if len(at) else np.zeros(0, np.int64)
        stretch = np.diff(np.concatenate([new, [len(at)]]))
        found[owner[at[new[stretch > (TIMES - 1) * gap[new] - width]]]] = True
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        there = np.sort(order[again & ~found[owner[order]]])
    return found


def _doubled(grams: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows twice as wide."""
    mixed = (grams[:-width] ^ (grams[:-width] >> np.uint64(31))) * _MIX + grams[width:]
    mixed *= _MIX
    return mixed ^ (mixed >> np.uint64(29))


# ---- suffix trees ----


class SuffixTree:
    """Ukkonen's suffix tree of numbers above 0, to which an end mark 0 is added.

    ``kids`` has for each inner node its children by first number: an inner node,
    or ``~j`` for the leaf of the suffix at j. ``depth`` is a node's string depth.
    """

    def __init__(self, numbers: list[int]):
        s = self.numbers = [*numbers, 0]
        kids: list[dict[int, int]] = [{}]
        depth, place, link = [0], [0], [0]
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            waiting = 0
            while rest:
                if not length:
                    edge = i
                down, first = kids[node], s[edge]
                child = down.get(first)
                if child is None:
                    down[first] = ~(i - rest + 1)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    if child >= 0:
                        span = depth[child] - depth[node]
                        if length >= span:
                            edge += span
                            length -= span
                            node = child
                            continue
                        at = place[child]
                    else:
                        at = ~child
                    met = s[at + depth[node] + length]
                    if met == c:
                        if waiting:
                            link[waiting] = node
                        length += 1
                        break
                    new = len(kids)
                    kids.append({met: child, c: ~(i - rest + 1)})
                    depth.append(depth[node] + length)
                    place.append(at)
                    link.append(0)
                    down[first] = new
                    if waiting:
                        link[waiting] = new
                    waiting = new
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.kids, self.depth = kids, depth

    def leaves(self, descending: bool = False) -> list[int]:
        """Suffixes in order; the end mark counts as least in either order of numbers."""
        found, stack, kids = [], [0], self.kids
        while stack:
            x = stack.pop()
            if x < 0:
                found.append(~x)
                continue
            down = kids[x]
            if descending:
                stack += [down[c] for c in sorted(down) if c]
                if 0 in down:
                    stack.append(down[0])
            else:
                stack += [down[c] for c in sorted(down, reverse=True)]
        return found

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The depths of an Euler tour, and each leaf's place in it."""
        n, kids, depth = len(self.numbers), self.kids, self.depth
        depths, places = [], [0] * n
        stack = [(0, iter(kids[0].values()))]
        while stack:
            node, rest = stack[-1]
            own = depth[node]
            for child in rest:
                depths.append(own)
                if child < 0:
                    places[~child] = len(depths)
                    depths.append(n - ~child)
                else:
                    stack.append((child, iter(kids[child].values())))
                    break
            else:
                stack.pop()
        return np.array(depths, np.int32), np.array(places, np.int64)


class Extensions:
    """How far the suffixes at two places agree, for arrays of places at a time."""

    BLOCK = 16

    def __init__(self, tree: SuffixTree):
        depths, self.places = tree.tour()
        b = self.BLOCK
        padded = np.full(-(-len(depths) // b) * b, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        self.rows = padded.reshape(-1, b)
        self.before = np.minimum.accumulate(self.rows, axis=1).reshape(-1)
        self.after = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.tables = [self.rows.min(axis=1)]
        while len(self.tables[-1]) > 1 << (len(self.tables) - 1):
            step, last = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Lengths for two different places each."""
        b = self.BLOCK
        low, high = np.minimum(self.places[one], self.places[two]), np.maximum(self.places[one], self.places[two])
        first, last = low // b, high // b
        found = np.minimum(self.after[low], self.before[high])
        inside = np.flatnonzero(first == last)
        if len(inside):
            at = np.arange(b)
            within = (at >= low[inside, None] % b) & (at <= high[inside, None] % b)
            found[inside] = np.where(within, self.rows[first[inside]], np.iinfo(np.int32).max).min(axis=1)
        between = last - first - 1
        apart = np.flatnonzero(between > 0)
        level = np.frexp(between[apart])[1] - 1
        for k in np.unique(level).tolist():
            some = apart[level == k]
            table = self.tables[k]
            found[some] = np.minimum(found[some], np.minimum(table[first[some] + 1], table[last[some] - (1 << k)]))
        return found


def _next_smaller(leaves: list[int]) -> np.ndarray:
    """For each place but the end mark's, the next place whose suffix is smaller."""
    ranks = [0] * len(leaves)
    for rank, place in enumerate(leaves):
        ranks[place] = rank
    n = len(leaves) - 1
    found, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        rank = ranks[i]
        while ranks[stack[-1]] > rank:
            stack.pop()
        found[i] = stack[-1]
        stack.append(i)
    return np.array(found, np.int64)


def runs_of(words: Words) -> np.ndarray:
    """The runs of a text's words as rows (start, length, period), by start and period."""
    n = len(words)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    names: dict[bytes, int] = {}
    numbers = [names.setdefault(word, len(names) + 1) for word in words]
    tree = SuffixTree(numbers)
    ends = [_next_smaller(tree.leaves(down)) for down in (False, True)]
    forwards, backwards = Extensions(tree), Extensions(SuffixTree(numbers[::-1]))
    found = []
    for j in ends:
        i = np.flatnonzero(TIMES * (j - np.arange(n)) <= n)
        j = j[i]
        start = i - backwards(n - i, n - j)
        length = j + forwards(i, j) - start
        long = length >= np.maximum(LEAST, TIMES * (j - i))
        found.append(np.stack([start, length, j - i], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(words: Words, runs: np.ndarray) -> Words:
    """The words that no run has behind its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def find(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Callable[[int | None, Words], Words] | None = None
) -> DataFrame:
    """Every row's id, ``runs`` (an array of start, length and period by start, then
    period) and ``collapsed``, its words joined by one space without those that a
    run has behind its first period. ``change`` turns an id and its words into the
    words to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = part.column(0)
                every = [(value or "").encode("utf-8", "surrogatepass").split() for value in texts]
                if change:
                    every = [change(key, words) for key, words in zip(ids.to_pylist(), every, strict=True)]
                found, offsets, collapsed = [], [0], []
                for words, may in zip(every, may_hold_runs(every).tolist(), strict=True):
                    rows = runs_of(words) if may else ()
                    if len(rows):
                        found.append(rows)
                        words = collapse(words, rows)
                    offsets.append(offsets[-1] + len(rows))
                    collapsed.append(b" ".join(words))
                columns = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                values = pa.StructArray.from_arrays([pa.array(c) for c in columns.T], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
