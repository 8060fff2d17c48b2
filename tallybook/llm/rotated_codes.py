"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length one, rotated by one fixed random rotation and
kept as the signs of its coordinates, packed into bits, with one correction
scalar: the inner product of the rotated vector with its own sign vector. A
query's inner product with the sign vector, divided by that scalar, estimates its
cosine with the vector, and the scalar bounds the error. Candidates whose upper
bound reaches the lower bound of the k-th best, or the k-th best cosine found so
far, are reranked by their exact cosine.

All rows are encoded and all are scanned for every query. Queries come in waves of
about ``WAVE`` by hash, each broadcast to a scan of the codes; a scan keeps the
best k of each query per task, and a window over those settles the rest. The
only thing sampled is the rotation; its seed is fixed.

Defined cases: null, zero and empty vectors and those with null or non-finite
components take no part; vectors are compared with those of their own dimension
only; rows with a null id are no candidates and no queries; a query id that
repeats is one query, by its least vector; repeated candidate rows are candidates
each; ties go to the smaller id; with fewer than k candidates all are returned.
Columns besides those named play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import stored

#: Queries of a wave, on average.
WAVE = 2048
#: Candidates estimated at a time.
BLOCK = 2048
#: Standard errors that the bounds allow for.
DEVIATIONS = 3.0
SEED = 20
CODES = "vec_id long, embedding array<double>, code binary, correction double"
FOUND = "query_id long, vec_id long, score double"


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random rotation of so many dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each dimension: places, ids and vectors of the rows that take part."""
    there = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    lengths = np.where(there, np.asarray(vectors.value_lengths().fill_null(0)), 0)
    kept = vectors.filter(pa.array(there))
    values = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.zeros(len(vectors), np.int64)
    starts[there] = np.cumsum([0, *lengths[there]])[:-1]
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        matrix = values[starts[at, None] + np.arange(d)]
        fine = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
        if fine.any():
            yield at[fine], numbers[at[fine]], matrix[fine]


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The code and correction of every vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, matrix in _matrices(batch.column(0), batch.column(1)):
                n, d = matrix.shape
                turned = _units(matrix) @ rotation(d)
                bits = np.packbits(turned > 0, axis=1)
                correction = np.abs(turned).sum(1) / np.sqrt(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), matrix.reshape(-1)),
                        pa.array([row.tobytes() for row in bits], pa.binary()), pa.array(correction),
                    ],
                    ["vec_id", "embedding", "code", "correction"],
                )

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, CODES)


def _units(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)  # before squaring, lest that overflow
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Best:
    """The best k candidates so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.turned = (_units(queries) @ rotation(queries.shape[1])).astype(np.float32)
        self.query = self.vec = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, matrix: np.ndarray, codes: np.ndarray, correction: np.ndarray) -> None:
        """Estimate a block of candidates, and rerank those that may be among the best."""
        d = matrix.shape[1]
        bits = np.unpackbits(codes, axis=1, count=d).astype(np.float32)
        signed = (2 * (bits @ self.turned.T) - self.turned.sum(1)) / np.float32(np.sqrt(d))
        estimate = signed / correction[:, None].astype(np.float32)
        error = (DEVIATIONS * np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(max(d - 1, 1)) + 1e-5).astype(np.float32)[:, None]
        own = ids[:, None] == self.ids[None, :]
        lower = np.where(own, -np.inf, estimate - error)
        least = self.least
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(lower, -self.k, axis=0)[-self.k])
        at, query = np.nonzero((estimate + error >= least) & ~own)
        score = np.concatenate([cosines(self.queries[query[i : i + 100_000]], matrix[at[i : i + 100_000]]) for i in range(0, len(at), 100_000)] or [[]])
        self._keep(query, ids[at], score)

    def _keep(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        starts = np.searchsorted(query, query)
        place = np.arange(len(query)) - starts
        stay = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        self.query, self.vec, self.score = query[stay], vec[stay], score[stay]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.query], pa.int64()), pa.array(self.vec, pa.int64()), pa.array(self.score, pa.float64())],
            ["query_id", "vec_id", "score"],
        )


def _scan(codes: DataFrame, wave: list, k: int) -> DataFrame:
    """The best k of each task for one wave of queries."""
    sizes: dict[int, list] = {}
    for row in wave:
        sizes.setdefault(len(row.embedding), []).append(row)
    blocks = {d: (np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])) for d, rows in sizes.items()}
    known = codes.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ids, queries, k) for d, (ids, queries) in known.value.items()}
        for batch in batches:
            code, correction = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for at, ids, matrix in _matrices(batch.column(0), batch.column(1)):
                if matrix.shape[1] not in best:
                    continue
                packed = np.frombuffer(b"".join(code[i] for i in at), np.uint8).reshape(len(at), -1)
                for i in range(0, len(at), BLOCK):
                    part = slice(i, i + BLOCK)
                    best[matrix.shape[1]].meet(ids[part], matrix[part], packed[part], correction[at[part]])
        for found in best.values():
            yield found.rows()

    return codes.mapInArrow(run, FOUND)


def search(
    vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding", wave: int = WAVE
) -> DataFrame:
    """Each query's k nearest: ``query_id``, ``rank``, ``vec_id`` and ``score``. ``is_query`` reads ``vec_id``."""
    codes = stored(encode(vectors, vec_id, embedding), "codes")
    queries = stored(codes.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    waves = max(1, -(-queries.count() // wave))
    found = None
    for n in range(waves):
        # One wave's vectors come to the driver and go out with its scan.
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == n).collect()
        one = _scan(codes, part, k)
        one = one if waves == 1 else stored(one, "nearest")
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
