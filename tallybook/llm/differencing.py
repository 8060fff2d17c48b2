"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents become ids, and ids become pieces: whole windows first, the rest in
parts of at most ``part`` ids. Whole windows are sequences of their own. All
other pieces are packed in groups of about ``group`` windows: each piece starts
as a partial partition of its group into as many windows as its ids need, with
one window filled and the others empty; the two partial partitions of largest
difference are merged, the fullest window of one with the emptiest of the other
and so on, until one partition is left, whose windows are nearly equal. When its
fullest window exceeds the capacity, the group gets one window more and starts
again.

A group is a run of pieces within one input partition, so nothing is shuffled
and a task holds one group at a time. Sequence numbers are made of the partition
and the place in it: unique, the same when a lost task is run again, not dense.

Defined cases: a null text is empty, and an empty one is the end id alone; null
and repeated document numbers are packed like any other, row by row; texts of
any length are cut as they come; an empty table has no pieces. Columns besides
the two named ones play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallybook.llm.common import slices

CAPACITY = 2048
#: New words encoded as one text.
JOINED = 64
#: Longest part that what is left of a document is cut to.
PART = 256
#: Windows of a group.
GROUP = 256
#: Words of a generation: when a worker has met so many, those not met again by the time that there
#: are as many new ones are forgotten.
REMEMBERED = 500_000
#: Bits of a sequence number below the partition's.
PLACE_BITS = 40

PIECES = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


#: Marks that the tokenizer never joins to a letter (A to Z, or of U+00C0 to U+00FF) before them, and such letters beyond A to Z.
_MARKS, _ACCENTED = b".,#$%&*", re.compile(rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]")
#: A word of such letters alone, which the tokenizer keeps in one.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _words(text: str | None) -> list[bytes]:
    """A text's words, in fewer forms than it has them, with the same ids.

    The tokenizer lower-cases, so capitals can go. They stay where they may
    matter: beside combining marks, which compose before lower-casing, and where
    a special token's brackets occur.
    """
    raw = (text or "").encode("utf-8")
    if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    return raw.split()


class WordIds:
    """Ids of texts by a tokenizer that drops white space; words are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.met: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # A special token is cut out of a text before all else, so it can stand between words.
        special = self.tokenizer.get_added_tokens_decoder()
        self.number, self.between = next((i, t.content.encode("utf-8")) for i, t in sorted(special.items()))
        # Ids that end a run of letters, where the tokenizer marks them.
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocab.values()) + 1, bool)
        self.ending[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def _ids(self, words: list[bytes], between: bytes, behind: list[int] = []) -> np.ndarray:
        """The words' ids, ``JOINED`` of them in one text, with ``behind`` after each text."""
        lines = [between.join(words[i : i + JOINED]).decode("utf-8") for i in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) if lines else []
        return np.fromiter(chain.from_iterable(chain(e.ids, behind) for e in found), "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        data = ids.tobytes()
        self.met.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, starts[: len(words)], ends, strict=True))

    def _meet(self, words: set[bytes]) -> None:
        """Encode new words, many in one text; a word with marks is made of two."""
        marked, plain, special = [], set(), self.between in b" ".join(words)
        for word in words:
            stem = word.rstrip(_MARKS)
            if special and self.between in word:
                self.met[word] = np.asarray(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
            elif len(stem) < len(word) and (stem[-1:].isalpha() or _ACCENTED.fullmatch(stem[-2:])):
                marks = word[len(stem) :]
                marked.append((word, stem, marks))
                if stem not in self.met:
                    plain.add(stem)
                if marks not in self.met:
                    plain.add(marks)
            else:
                plain.add(word)
        letters = list(filter(_LETTERS.fullmatch, plain)) if self.ending.any() else []
        ids = self._ids(letters, b" ")
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) == len(letters):
            self._keep(letters, ids, [0, *ends[:-1].tolist()], ends.tolist())
            plain.difference_update(letters)
        plain = list(plain)
        ids = self._ids(plain, self.between, [self.number])
        ends = np.flatnonzero(ids == self.number)
        self._keep(plain, ids, [0, *(ends[:-1] + 1).tolist()], ends.tolist())
        self.met.update((word, self.met[stem] + self.met[marks]) for word, stem, marks in marked)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. No token
        reaches over ASCII white space, so words can be encoded by themselves."""
        split = [_words(t) for t in texts]
        words = list(chain.from_iterable(split))
        found = list(map(self.met.get, words))
        fresh = {word for word, ids in zip(words, found) if ids is None}
        if fresh:
            if len(self.met) + len(fresh) > REMEMBERED:
                self.older, self.met, fresh = self.met, {}, set(words)
            known = fresh.intersection(self.older)
            self.met.update(zip(known, map(self.older.__getitem__, known)))
            self._meet(fresh.difference(known))
            take = self.met.__getitem__
            found = [take(word) if ids is None else ids for word, ids in zip(words, found)]
        ids = iter(found)
        return [b"".join(islice(ids, len(words))) for words in split]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of so many windows, with nearly equal sums."""
    # A partial partition: its filled windows, fullest first, each with its sum, negated, and the tree of items behind it.
    nodes: list[tuple[int, int] | None] = [None] * len(sizes)  # of merged trees, behind the items themselves
    partial = {i: [(-size, i)] for i, size in enumerate(sizes)}
    agenda = [(-size if windows > 1 else 0, i) for i, size in enumerate(sizes)]
    heapify(agenda)
    number = len(sizes)
    while len(agenda) > 1:
        a, b = partial.pop(heappop(agenda)[1]), partial.pop(heappop(agenda)[1])
        # The fullest windows of the one meet the other's empty ones, where it has enough.
        apart, over = windows - len(b), len(a) + len(b) - windows
        merged = a + b if over <= 0 else a[:apart] + b[: windows - len(a)]
        for (one, left), (two, right) in zip(a[apart:], reversed(b)) if over > 0 else ():
            merged.append((one + two, len(nodes)))
            nodes.append((left, right))
        merged.sort()
        partial[number] = merged
        heappush(agenda, (merged[0][0] - (merged[-1][0] if len(merged) == windows else 0), number))
        number += 1
    out = []
    for _, tree in partial[agenda[0][1]] if agenda else []:
        items, open_ = [], [tree]
        while open_:
            node = open_.pop()
            if nodes[node] is None:
                items.append(node)
            else:
                open_.extend(nodes[node])
        out.append(sorted(items))
    return out


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of windows that hold at most the capacity, with as few windows as differencing manages."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in found):
            return [items for items in found if items]
        windows += 1


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1,
    capacity: int = CAPACITY, part: int = PART, group: int = GROUP, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: its ids, where it starts in its document and where it
    lies in which sequence. ``with_ids`` leaves out the ids themselves."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = word_ids(tokenizer)
        for rows, texts in (x for batch in batches for x in slices(batch, batch.schema.names[1])):
            for key, ids in zip(rows.column(0).to_pylist(), own.encode(texts), strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                while start < total:
                    length = capacity if total - start >= capacity else min(part, total - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    yield key, start, length, piece if with_ids else None, zlib.crc32(piece), total
                    start += length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << PLACE_BITS
        columns = [[] for _ in range(8)]

        def emit(piece: tuple, offset: int) -> None:
            for column, value in zip(columns, (*piece, sequence, offset)):
                column.append(value)

        def settle(waiting: list[tuple]) -> None:
            nonlocal sequence
            for items in packed([p[2] for p in waiting], capacity):
                offset = 0
                for i in items:
                    emit(waiting[i], offset)
                    offset += waiting[i][2]
                sequence += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PIECES.split(", ")]
            )
            for column in columns:
                column.clear()
            return out

        waiting, held = [], 0
        for piece in cut(batches):
            if piece[2] == capacity:
                emit(piece, 0)
                sequence += 1
            else:
                waiting.append(piece)
                held += piece[2]
                if held >= group * capacity:
                    settle(waiting)
                    waiting, held = [], 0
            if len(columns[0]) >= 4096:
                yield flush()
        if waiting:
            settle(waiting)
        yield flush()

    found = docs.select(doc_id, text).mapInArrow(run, PIECES)
    return found if with_ids else found.drop("ids")
