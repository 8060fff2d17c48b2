"""SentencePiece encoding and decoding with a score-ordered agenda of adjacent symbol pairs.

A merge-type ("BPE") vocabulary is applied by keeping every adjacent pair of
symbols that spells a piece on an agenda, best score first and leftmost among
equal scores, and merging until the agenda is empty. A text is cut before each
run of word marks first: no piece has a word mark behind another character, so
no merge can cross such a cut, and the pieces of a segment depend on nothing
around it. Segments repeat, so a task keeps the pieces of those it has met.

Nulls count as empty texts, which have no pieces (the end id alone, where asked
for). Repeated rows are encoded alike. Of pairs with equal scores the leftmost
goes first. Texts of any length are cut into segments; one longer than
``LONG_SEGMENT`` has a heap of its own and is not remembered. Any other columns are
kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.common import slices

MARK = "▁"
#: Segments of a generation: when a worker has met so many, those not met again by the time that there
#: are as many new ones are forgotten.
REMEMBERED = 400_000
#: Longer segments are encoded without being remembered.
LONG_SEGMENT = 64
#: Segments held against the library in one text.
CHECKED = 32
#: Stands where a symbol has been merged into the one before it.
GONE = -1


class PairTable:
    """Place in the order and merged symbol of a pair of symbols, looked up for whole arrays.

    A hash table of a few levels: what does not find its slot free goes to the
    next level, so a lookup is one comparison per level.
    """

    def __init__(self, splits: np.ndarray, none: int):
        self.none, self.levels = none, []
        keys = splits[:, 0] << 32 | splits[:, 1]
        left = np.arange(len(keys))
        while len(left) or not self.levels:
            bits = max(10, int(len(left)).bit_length() + 2)
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            slots = self._slots(keys[left], factor, bits)
            here = np.full(1 << bits, -1, np.int64)
            here[slots] = left
            won = here[slots] == left
            held = np.full(1 << bits, -1, np.int64)
            held[slots[won]] = keys[left[won]]
            self.levels.append((factor, bits, held, here))
            left = left[~won]
        self.places = np.append(splits[:, 2], none).astype(np.int32)
        self.products = np.append(splits[:, 3], GONE).astype(np.int32)

    @staticmethod
    def _slots(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * factor
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order, ``none`` for pairs that spell nothing, and merged symbols."""
        keys = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        found = np.full(keys.shape, len(self.places) - 1, np.int32)
        for factor, bits, held, here in self.levels:
            slots = self._slots(keys, factor, bits)
            hit = held[slots] == keys
            found[hit] = here[slots[hit]]
        return self.places[found], self.products[found]


class Agenda:
    """Encoder and decoder of one merge-type vocabulary."""

    def __init__(self, model: str):
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(library.get_piece_size())
        self.spelled = [library.id_to_piece(i) for i in ids]
        self.control = {i for i in ids if library.is_control(i)}
        self.end = library.eos_id()
        self.byte_of = {i: int(self.spelled[i][3:5], 16) for i in ids if library.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no piece for each byte")
        # What an id says by itself; bytes from 0x80 on need their neighbours.
        self.high_bytes = {i for i, b in self.byte_of.items() if b >= 0x80}
        self.decoded = ["" if i in self.control else chr(self.byte_of[i]) if i in self.byte_of else self.spelled[i] for i in ids]
        usual = [i for i in ids if i not in self.control and i not in self.byte_of and i != library.unk_id()]
        self.id_of = {self.spelled[i]: i for i in usual}
        # The agenda's order: place among the scores, best first.
        places = {s: n for n, s in enumerate(sorted({library.get_score(i) for i in usual}, reverse=True))}
        self.order = {self.spelled[i]: places[library.get_score(i)] for i in usual if len(self.spelled[i]) > 1}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes on over a word mark; texts can't be cut there")
        # Line ends stand in no piece, so they too are cut off.
        cut = "" if any("\n" in p for p in self.id_of) else "\n"
        self.segments = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + "|\n" * bool(cut)).findall
        # Symbols as numbers: pieces by their ids, then characters that only occur within pieces.
        symbols = dict(self.id_of)
        for piece in self.id_of:
            for c in piece:
                symbols.setdefault(c, len(self.spelled) + len(symbols))
        self.none = np.int32(len(places))
        self.symbol_of_point = np.full(0x110000, GONE - 1, np.int32)
        for c, n in symbols.items():
            if len(c) == 1:
                self.symbol_of_point[ord(c)] = n
        size = max(symbols.values()) + 1
        self.id_of_symbol = np.full(size - GONE + 1, -1, np.int32)  # negative symbols look at its end
        self.id_of_symbol[: len(self.spelled)] = np.arange(len(self.spelled))
        splits = [
            (symbols[piece[:k]], symbols[piece[k:]], self.order[piece], symbols[piece])
            for piece in self.order
            for k in range(1, len(piece))
            if piece[:k] in symbols and piece[k:] in symbols
        ]
        self.pairs = PairTable(np.array(splits, np.int64), int(self.none))
        self.met: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: What the ids of a segment say by themselves; bytes from 0x80 on need their neighbours.
        self.said: dict[bytes, str] = {}
        #: Segments encoded since the last check().
        self.fresh: list[tuple[str, bytes]] = []

    def symbols(self, segment: str) -> list[str]:
        """The segment's symbols when no pair is left on its agenda, a heap;
        pairs merged away meanwhile are passed over."""
        order = self.order.get
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        agenda = [(p, i, i + 1, a + b) for i, (a, b) in enumerate(zip(segment, segment[1:])) if (p := order(a + b)) is not None]
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, right, pair = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or a + b != pair:
                continue
            symbols[left], symbols[right] = pair, None
            follows = after[left] = after[right]
            if follows < n:
                before[follows] = left
                wider = pair + symbols[follows]
                if (p := order(wider)) is not None:
                    heappush(agenda, (p, left, follows, wider))
            leads = before[left]
            if leads >= 0:
                wider = symbols[leads] + pair
                if (p := order(wider)) is not None:
                    heappush(agenda, (p, leads, left, wider))
        return [s for s in symbols if s is not None]

    def segment_ids(self, segment: str) -> bytes:
        """A segment's ids as 32-bit numbers."""
        ids: list[int] = []
        for symbol in self.symbols(segment):
            known = self.id_of.get(symbol)
            if known is not None:
                ids.append(known)
            else:
                ids.extend(self.byte_id[b] for b in symbol.encode("utf-8"))
        found = np.array(ids, np.int32).tobytes()
        self.fresh.append((segment, found))
        if len(segment) <= LONG_SEGMENT:
            self.met[segment] = found
        return found

    def meet(self, segments: set[str]) -> None:
        """Have the ids of segments that this generation lacks: from the older one, or by
        encoding them, those of one length at a time."""
        if len(self.met) + len(segments) > REMEMBERED:
            self.older, self.met = self.met, {}
        if len(self.said) > 2 * REMEMBERED:
            self.said = {}
        known = segments.intersection(self.older)
        self.met.update(zip(known, map(self.older.__getitem__, known)))
        segments = segments.difference(known)
        lengths: dict[int, list[str]] = {}
        for segment in segments:
            lengths.setdefault(len(segment), []).append(segment)
        for length, alike in lengths.items():
            if length > LONG_SEGMENT:
                continue
            for at in range(0, len(alike), 50_000):
                self._meet_alike(alike[at : at + 50_000], length)

    def _meet_alike(self, segments: list[str], length: int) -> None:
        """The agendas of segments of one length as rows of a matrix.

        A row holds the place in the order of the pair that begins at each
        symbol; each round merges every row's first pair and looks up the two
        pairs that it makes.
        """
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").reshape(-1, length)
        symbols = self.symbol_of_point[points]
        agenda = np.full((len(segments), length), self.none, np.int32)
        merged = np.full((len(segments), length), GONE, np.int32)
        agenda[:, :-1], merged[:, :-1] = self.pairs.find(symbols[:, :-1], symbols[:, 1:])
        after = np.tile(np.arange(1, length + 1, dtype=np.int32), (len(segments), 1))
        before = after - 2
        rows = np.arange(len(segments))
        while True:
            left = agenda[rows].argmin(1)
            open_ = agenda[rows, left] < self.none
            rows, left = rows[open_], left[open_]
            if not len(rows):
                break
            right = after[rows, left]
            symbols[rows, left] = wider = merged[rows, left]
            symbols[rows, right], agenda[rows, right] = GONE, self.none
            follows = after[rows, left] = after[rows, right]
            inner = follows < length
            agenda[rows, left] = self.none
            r, l, f = rows[inner], left[inner], follows[inner]
            before[r, f] = l
            agenda[r, l], merged[r, l] = self.pairs.find(wider[inner], symbols[r, f])
            leads = before[rows, left]
            inner = leads >= 0
            r, l = rows[inner], leads[inner]
            agenda[r, l], merged[r, l] = self.pairs.find(symbols[r, l], wider[inner])
        stay = symbols != GONE
        ids = self.id_of_symbol[symbols]
        odd = (stay & (ids < 0)).any(1)
        ends = 4 * np.cumsum(stay.sum(1))
        ids = ids[stay].tobytes()
        found = [ids[start:end] for start, end in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero(odd).tolist():  # characters without a piece
            self.segment_ids(segments[i])
        if odd.any():
            segments, found = ([x for x, o in zip(xs, odd.tolist()) if not o] for xs in (segments, found))
        self.met.update(zip(segments, found))
        self.fresh.extend(zip(segments, found))

    def _segment_ids(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text, the ids of its segments."""
        split = [self.segments(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.met.get, segments)) for segments in split]
        fresh = {x for segments, ids in zip(split, found, strict=True) if None in ids for x, i in zip(segments, ids, strict=True) if i is None}
        if fresh:
            self.meet(fresh)
            take, long = self.met.get, self.segment_ids
            for k, (segments, ids) in enumerate(zip(split, found, strict=True)):
                if None in ids:  # segments too long to be remembered are encoded by themselves
                    found[k] = [(take(x) or long(x)) if i is None else i for x, i in zip(segments, ids, strict=True)]
        return found

    def encode_batch(self, texts: list[str | None], add_end: bool = False) -> list[bytes]:
        """Each text's ids as 32-bit numbers; the end id behind them if asked for. Nulls are empty texts."""
        end = np.array([self.end] if add_end else [], np.int32).tobytes()
        return [b"".join(found) + end for found in self._segment_ids(texts)]

    def code_batch(self, texts: list[str | None], add_end: bool = False) -> tuple[list[bytes], list[str]]:
        """The same, and the texts that the ids decode to. Ids of a segment say the same
        wherever they stand, but for bytes that their neighbours complete."""
        end = np.array([self.end] if add_end else [], np.int32).tobytes()
        coded, decoded = [], []
        for found in self._segment_ids(texts):
            coded.append(b"".join(found) + end)
            parts = list(map(self.said.get, found))
            if None in parts:
                parts = [self._says(ids) if part is None else part for ids, part in zip(found, parts, strict=True)]
            if None in parts:
                decoded.append(self.decode(np.frombuffer(coded[-1], np.int32).tolist()))
            else:
                decoded.append(self._shown("".join(parts)))
        return coded, decoded

    def _says(self, ids: bytes) -> str | None:
        numbers = np.frombuffer(ids, np.int32).tolist()
        if not self.high_bytes.isdisjoint(numbers):
            return None
        self.said[ids] = found = "".join(map(self.decoded.__getitem__, numbers))
        return found

    def encode(self, text: str | None, add_end: bool = False) -> list[int]:
        return np.frombuffer(self.encode_batch([text], add_end)[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, bytes are read as UTF-8, one leading space goes."""
        if self.high_bytes.isdisjoint(ids):
            text = "".join(map(self.decoded.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(self.decoded[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return self._shown(text)

    @staticmethod
    def _shown(text: str) -> str:
        return (text[1:] if text[:1] == MARK else text).replace(MARK, " ")

    def check(self) -> None:
        """Hold what was encoded since the last check against the library, in one batch.

        The library puts a word mark before a text; behind a line end, where texts
        are cut, a segment stands as it does within a text.
        """
        start, line_end = self.library.encode("\n")
        for at in range(0, len(self.fresh), CHECKED):
            some = self.fresh[at : at + CHECKED]
            own = np.frombuffer(np.int32(line_end).tobytes().join([np.int32(start).tobytes(), *(ids for _, ids in some)]), np.int32)
            if own.tolist() != self.library.encode("\n" + "\n".join([segment for segment, _ in some])):
                raise AssertionError("the agenda and the library differ")
        self.fresh.clear()


@lru_cache(maxsize=2)
def agenda(model: str) -> Agenda:
    """One encoder for each worker and vocabulary."""
    return Agenda(model)


def _with(df: DataFrame, added: dict[str, T.DataType], source: str, make) -> DataFrame:
    """``df`` with columns that ``make`` fills from the values of another; ones of those names are replaced."""
    kept = [f.name for f in df.schema if f.name not in added]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, kind) for c, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch, source):
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *make(values)], schema.names)

    return df.mapInArrow(run, schema)


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(ids) // 4 for ids in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _checked(own: Agenda, check: bool) -> None:
    if check:
        own.check()
    own.fresh.clear()


def encode(
    df: DataFrame, model: str, text: str = "text", out: str = "ids", add_end: bool = True, check: bool = True
) -> DataFrame:
    """Add the ids of a text column. ``check`` holds every segment that comes up
    for the first time against the sentencepiece library, a batch at a time, and
    fails on any difference."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        own = agenda(model)
        found = own.encode_batch(texts, add_end)
        _checked(own, check)
        return [_lists(found)]

    return _with(df, {out: T.ArrayType(T.IntegerType())}, text, make)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids give an empty text."""

    def make(lists: list[list[int] | None]) -> list[pa.Array]:
        own = agenda(model)
        return [pa.array([own.decode(x or []) for x in lists], pa.string())]

    return _with(df, {out: T.StringType()}, ids, make)


def code(
    df: DataFrame, model: str, text: str = "text", ids: str = "ids", out: str = "decoded", add_end: bool = True, check: bool = True
) -> DataFrame:
    """Add the ids of a text column and the text that they decode to, in one pass."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        own = agenda(model)
        found, decoded = own.code_batch(texts, add_end)
        _checked(own, check)
        return [_lists(found), pa.array(decoded, pa.string())]

    return _with(df, {ids: T.ArrayType(T.IntegerType()), out: T.StringType()}, text, make)
