"""Language of texts by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum over all its segmentations into pieces of
the product of their probabilities, which a forward pass over its characters
gives; a text is the words' product times the language's share of the training
texts, and the likeliest language wins. The probabilities are fitted by
expectation maximisation over the same segmentations.

Words are runs of letters, lower-cased, behind a word mark; runs beyond
``LONGEST`` characters are scored in parts of that length. The fit reads the whole
texts of a bounded sample: about ``SAMPLE`` documents per language, those of the
smallest hashes. Prediction reads every text whole.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
so is every text when there is nothing to learn from; characters that no piece
has count alike in all languages; ties go to the language first in order;
repeated rows are judged alike. Columns besides those named play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import slices, stored
from tallybook.llm.piece_agenda import MARK, PairTable, agenda

#: Documents per language that the probabilities are fitted on, about.
SAMPLE = 600
#: Passes of expectation maximisation.
PASSES = 5
#: Expected count that every piece starts from.
SMOOTHING = 0.05
#: Probability of a character that no piece has.
UNKNOWN = 1e-7
LONGEST = 32
UNDETERMINED = "und"
#: Words a worker remembers; when they are so many, it starts afresh.
REMEMBERED = 500_000

runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Letter runs, lower-cased, in parts of bounded length; none for a text without a letter."""
    found = runs(text.lower()) if text else []
    if not any(c.isalpha() for run in found for c in run):
        return []
    return [run[i : i + LONGEST] for run in found for i in range(0, len(run), LONGEST)]


class Segmentations:
    """All ways to spell words with the pieces of a vocabulary."""

    def __init__(self, model: str):
        pieces = agenda(model).id_of
        self.size = max(pieces.values()) + 1
        #: Behind the pieces: a character that no piece has, and no piece at all.
        self.unknown, self.nothing = self.size, self.size + 1
        self.characters = {c: i for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        # A tree of the pieces' beginnings; node 0 is the root, -1 is nowhere.
        nodes, steps, ends = {"": 0}, [], [self.nothing]
        for piece in sorted(pieces):
            for k, c in enumerate(piece):
                if piece[: k + 1] not in nodes:
                    nodes[piece[: k + 1]] = len(nodes)
                    ends.append(self.nothing)
                    steps.append((nodes[piece[:k]], self.characters[c], nodes[piece[: k + 1]], 0))
            ends[nodes[piece]] = pieces[piece]
        self.steps, self.ends = PairTable(np.array(steps, np.int64), -1), np.array(ends, np.int32)
        self.longest = max(map(len, pieces))
        self.number = np.full(0x110000, len(self.characters), np.int32)
        for c, i in self.characters.items():
            self.number[ord(c)] = i

    def spelled(self, words: list[str], length: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length, behind their marks: (start, end, rows, pieces) of
        all pieces found in them, by start."""
        points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), "<u4").reshape(len(words), length + 1)
        numbers = self.number[points]
        found = []
        for start in range(length + 1):
            rows, nodes = np.arange(len(words)), np.zeros(len(words), np.int32)
            for end in range(start + 1, min(length + 1, start + self.longest) + 1):
                nodes = self.steps.find(nodes, numbers[rows, end - 1])[0]
                rows, nodes = rows[nodes >= 0], nodes[nodes >= 0]
                if not len(rows):
                    break
                pieces = self.ends[nodes]
                if end == start + 1:
                    # A character spelled by no piece of its own still has to be passed.
                    alone = np.full(len(words), self.unknown, np.int32)
                    known = pieces != self.nothing
                    alone[rows[known]] = pieces[known]
                    found.append((start, end, np.arange(len(words)), alone))
                else:
                    known = pieces != self.nothing
                    if known.any():
                        found.append((start, end, rows[known], pieces[known]))
            if not found or found[-1][0] != start:
                found.append((start, start + 1, np.arange(len(words)), np.full(len(words), self.unknown, np.int32)))
        return found

    def forward(self, spelled: list, words: int, length: int, weights: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each beginning: (words, length + 2, languages)."""
        sums = np.zeros((words, length + 2, weights.shape[1]))
        sums[:, 0] = 1.0
        for start, end, rows, pieces in spelled:
            sums[rows, end] += sums[rows, start] * weights[pieces]
        return sums

    def expected(self, spelled: list, counts: np.ndarray, length: int, weights: np.ndarray) -> np.ndarray:
        """Expected piece counts of words that come up so often, for one language."""
        ahead = self.forward(spelled, len(counts), length, weights)[:, :, 0]
        behind = np.zeros_like(ahead)
        behind[:, -1] = counts / np.maximum(ahead[:, -1], 1e-300)
        out = np.zeros(self.nothing + 1)
        for start, end, rows, pieces in reversed(spelled):
            share = weights[pieces, 0] * behind[rows, end]
            behind[rows, start] += share
            out += np.bincount(pieces, ahead[rows, start] * share, minlength=len(out))
        return out


@lru_cache(maxsize=1)
def segmentations(model: str) -> Segmentations:
    return Segmentations(model)


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[int, list[int]]]:
    """Indices of words of one length, in parts of bounded size."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    for length, alike in lengths.items():
        for at in range(0, len(alike), most):
            yield length, alike[at : at + most]


def _weights(counts: np.ndarray, size: int) -> np.ndarray:
    """Probabilities of pieces, of an unknown character, and of nothing."""
    smooth = counts[:size] + SMOOTHING
    return np.concatenate([smooth / smooth.sum(), [UNKNOWN, 0.0]])


def fitted(words: list[str], counts: np.ndarray, model: str) -> np.ndarray:
    """A language's probabilities from its words' counts."""
    own = segmentations(model)
    parts = []
    for length, at in by_length(words):
        parts.append((own.spelled([words[i] for i in at], length), counts[at].astype(float), length))
    weights = _weights(np.ones(own.nothing + 1), own.size)
    for _ in range(PASSES):
        weights = _weights(sum(own.expected(s, c, n, weights[:, None]) for s, c, n in parts), own.size)
    return weights


def learned(docs: DataFrame, model: str, text: str = "text", lang: str = "lang", order: str = "doc_id") -> DataFrame:
    """Each language's number of training texts and piece probabilities, from rows
    with a text and a language. The sample is drawn among different pairs of id and
    text, so rows without an id, or with one id, are drawn like others, and rows that
    repeat both count as one."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(order, text).alias("hash")).dropna(subset=["text", "lang"])
    shares = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.approx_count_distinct("hash", 0.02).alias("different")), "languages")
    # A hash is below this with the chance SAMPLE / different.
    within = (F.col("hash") / 2.0**64 + 0.5) * F.col("different") < SAMPLE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(
                (l, w) for l, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) for w in words_of(t)
            )
            yield pa.RecordBatch.from_pydict(
                {"lang": [l for l, _ in found], "word": [w for _, w in found], "times": list(found.values())},
                schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("times", pa.int64())]),
            )

    sample = rows.join(shares, "lang").filter(within).dropDuplicates(["lang", "hash"]).select("lang", "text").mapInArrow(count, "lang string, word string, times long")

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        weights = fitted(frame["word"].tolist(), frame["times"].to_numpy(), model)
        return pd.DataFrame({"lang": [key[0]], "weights": [weights.tolist()]})

    counted = sample.groupBy("lang", "word").agg(F.sum("times").alias("times"))
    models = counted.groupBy("lang").applyInPandas(fit, "lang string, weights array<double>")
    return stored(models.join(shares.drop("different"), "lang"), "unigrams")


class Judge:
    """Log-likelihoods of words in all learned languages, remembered by a worker."""

    def __init__(self, model: str, names: list[str], texts: np.ndarray, weights: np.ndarray):
        self.own, self.names = segmentations(model), names
        self.weights = weights  # pieces in rows, languages in columns
        self.prior = np.log(texts / texts.sum())
        self.met: dict[str, int] = {}
        self.scores = np.zeros((0, len(names)))

    def meet(self, words: list[str]) -> None:
        if len(self.met) + len(words) > REMEMBERED:
            self.met, self.scores = {}, np.zeros((0, len(self.names)))
        first = len(self.scores)
        scores = np.empty((len(words), len(self.names)))
        for length, at in by_length(words):
            spelled = self.own.spelled([words[i] for i in at], length)
            sums = self.own.forward(spelled, len(at), length, self.weights)[:, -1]
            scores[at] = np.log(np.maximum(sums, 1e-300))
        self.met.update((w, first + i) for i, w in enumerate(words))
        self.scores = np.concatenate([self.scores, scores])

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        wanted = {w for words in split for w in words}
        if len(self.met) + len(wanted) > REMEMBERED:  # then all of them are met again
            self.met, self.scores = {}, np.zeros((0, len(self.names)))
        self.meet([w for w in wanted if w not in self.met])
        place, out = self.met.__getitem__, []
        for words in split:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.prior + self.scores[np.fromiter(map(place, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            out.append((self.names[best], float(1 / np.exp(total - total[best]).sum())))
        return out


_judges: dict[str, Judge] = {}


def predict(docs: DataFrame, languages: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added.

    The learned probabilities reach the tasks as one broadcast, bounded by the
    vocabulary's pieces times the learned languages.
    """
    found = languages.orderBy("lang").toPandas()
    names = found["lang"].tolist()
    weights = np.array(found["weights"].tolist()).T if names else np.zeros((0, 0))
    known = docs.sparkSession.sparkContext.broadcast((names, found["texts"].to_numpy(float), weights))
    added = ["lang_pred", "score"]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    key = f"{model}:{known._jbroadcast.id() if hasattr(known, '_jbroadcast') and known._jbroadcast else id(known)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None
        if names:
            if key not in _judges:
                _judges.clear()
                _judges[key] = Judge(model, *known.value)
            judge = _judges[key]
        for batch in batches:
            for part, texts in slices(batch, text):
                verdict = judge.judge(texts) if judge else [(UNDETERMINED, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, kept), pa.array([v for v, _ in verdict], pa.string()), pa.array([s for _, s in verdict], pa.float64())],
                    [*kept, *added],
                )

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
