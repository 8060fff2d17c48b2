"""Near copies of vectors by hierarchical navigable small-world graphs.

Vectors of one label and dimension are dealt by hash into shards of about ``SHARD``
different vectors; equal vectors are one class with a weight. Each shard gets a
graph: a vector's level is drawn from its hash; levels are built from the top, each
vector linking to diverse ones among the nearest that a beam finds from the level
above. On the lowest level a tree besides, with each vector below a near one, keeps
groups of near copies, whose links are not diverse, within reach. Every vector is
searched in its own shard, and for each pair of shards the vectors of the one in the
graph of the other, in blocks that stream past it.

A search keeps a beam of the nearest met so far and opens the best of them until all
are open; then all that is nearer than the bound less ``MARGIN`` is opened too, and
what that leads to, so a large group need not fit into the beam. Of every block, the
vectors that an audit draws by hash are compared with the whole shard; while the
searches have missed a link of theirs, the whole block is searched again with beams
twice as wide. A beam as wide as the shard reads all of it, so this ends. What
is met is verified by its cosine in double precision.

Within a shard links merge into components at once. Across shards a vector's links
become one row per component met, and their weights two sums; so neither equal
vectors nor large groups of near ones are ever listed pair by pair, and what is left
to unite are components.

Every shard is searched for every vector of its label, half of them from the other
side: work grows with the square of a label's vectors, in blocks. A hot label only
has more shards; a shard's searches are dealt out over tasks of ``REACH`` shards.

Defined cases: null, zero and empty vectors and those with null or non-finite
components link with nothing, nor do rows with a null label; rows with a null id link
with nothing, have no component and are kept; rows that repeat an id are vectors
of their own, which link like any others; columns besides those named play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import stored
from tallybook.llm.size_aware_join import merged

#: Least cosine of a link.
LEAST = 0.93
#: Different vectors of a shard, on average, and shards searched by one task.
SHARD, REACH = 4096, 16
#: Links of a vector on the upper levels (twice as many on the lowest), and its places for vectors below it in the tree.
DEGREE, BELOW = 12, 8
#: Beams for building and, at first, for searching, and how far below the bound searches go on.
BUILDING, BEAM, MARGIN = 48, 96, 0.1
#: Vectors searched together, opened at a time (at least, and the part of a beam), and the part of them that audits draw.
BLOCK, OPENED, WIDE, AUDITED = 512, 4, 12, 8
#: What single precision may be off by.
SLACK = 1e-4

_NODE = "label string, size int, target int, part int, own int, kind int, class_id long, n long, comp long, level int, place int, vector binary, links binary"


def units(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)  # before squaring, lest that overflow
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Graph:
    """A navigable small world over the rows of a matrix: ``layers`` from the lowest,
    each with a row of neighbours, -1 for none, per vector. In the lowest layer the
    last ``1 + BELOW`` places are the tree's: the vector above and those below."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors, self.levels = vectors, levels
        self.near = units(vectors).astype(np.float32)
        self.layers: list[np.ndarray] = []
        self.entry = int(np.argmax(levels))

    @classmethod
    def built(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        graph = cls(vectors, levels)
        top = int(levels.max())
        graph.layers = [np.full((len(vectors), _width(k)), -1, np.int32) for k in range(top + 1)]
        order = np.argsort(-levels, kind="stable")
        for k in range(top, -1, -1):
            members = order[: int((levels >= k).sum())]
            done = 1
            while done < len(members):
                new = members[done : done + min(done, BLOCK)]
                graph._insert(k, new)
                done += len(new)
        return graph

    def _insert(self, k: int, new: np.ndarray) -> None:
        """Link some vectors into a layer whose upper layers are complete."""
        ids, sims, _, _ = self._beam(self.near[new], k, [self._descend(self.near[new], k)], BUILDING)
        among = self.near[new] @ self.near[new].T
        np.fill_diagonal(among, -2)
        some = min(BUILDING // 2, len(new) - 1)
        if some:
            best = np.argpartition(-among, some - 1, axis=1)[:, :some]
            ids = np.concatenate([ids, new[best]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, best, 1)], axis=1)
        if not k:
            self._hang(new, ids, sims)
        incoming: dict[int, list[int]] = {}
        for x, found, score in zip(new.tolist(), ids, sims, strict=True):
            there = found >= 0
            kept = self._diverse(found[there], score[there], DEGREE)
            self.layers[k][x, : len(kept)] = kept
            for y in kept.tolist():
                incoming.setdefault(y, []).append(x)
        width = DEGREE if k else 2 * DEGREE
        for y, more in incoming.items():
            row = self.layers[k][y, :width]
            every = np.unique(np.concatenate([row[row >= 0], more]))
            if len(every) > width:
                every = self._diverse(every, self.near[every] @ self.near[y], width)
            row[:] = -1
            row[: len(every)] = every

    def _hang(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Put new vectors below near ones that are in the tree and have room."""
        tree = self.layers[0][:, 2 * DEGREE :]
        later = {x: i for i, x in enumerate(new.tolist())}
        for i, (x, found) in enumerate(zip(new.tolist(), np.take_along_axis(ids, np.argsort(-sims, axis=1), 1).tolist(), strict=True)):
            for y in found:
                if y >= 0 and later.get(y, -1) < i and tree[y, -1] < 0:
                    break
            else:
                # None of those met has room: the nearest of all that are in the tree.
                inside = np.concatenate([np.flatnonzero(tree[:, 0] >= 0), [self.entry]])
                inside = inside[tree[inside, -1] < 0]
                y = int(inside[(self.near[inside] @ self.near[x]).argmax()])
            tree[x, 0] = y
            tree[y, 1 + int((tree[y, 1:] >= 0).sum())] = x

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, those nearer to the vector than to any taken before."""
        order = np.argsort(-sims, kind="stable")
        ids, sims = ids[order], sims[order]
        between = self.near[ids] @ self.near[ids].T
        open_ = np.ones(len(ids), bool)
        taken = []
        for at in range(len(ids)):
            if open_[at]:
                taken.append(at)
                if len(taken) == most:
                    break
                open_ &= between[at] < sims
        return ids[taken]

    def _descend(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Where to enter layer k: the nearest found on the layers above."""
        at = np.full(len(queries), self.entry)
        for layer in range(int(self.levels[self.entry]), k, -1):
            ids, sims, _, _ = self._beam(queries, layer, [at], OPENED)
            at = ids[np.arange(len(queries)), sims.argmax(1)]
        return at

    def _beam(
        self, queries: np.ndarray, k: int, at: list[np.ndarray], beam: int, least: float = 2.0
    ) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The beams' vectors and similarities, all pairs met that reach ``least``, and what was seen."""
        b = len(queries)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2, np.float32)
        shut = np.ones((b, beam), bool)
        seen = np.zeros((b, len(self.near)), bool)
        rows = np.arange(b)
        met = []
        for i, entry in enumerate(at):
            fresh = ~seen[rows, entry]
            sim = (queries * self.near[entry]).sum(1)
            ids[fresh, i], sims[fresh, i], shut[fresh, i] = entry[fresh], sim[fresh], False
            seen[rows, entry] = True
            met.append((rows[fresh & (sim >= least)], entry[fresh & (sim >= least)]))
        live = rows
        opened = min(beam, max(OPENED, beam // WIDE))  # a wide beam in steps as many as a narrow one's
        while len(live):
            waiting = np.where(shut[live], -3, sims[live])
            best = np.argpartition(-waiting, opened - 1, axis=1)[:, :opened]
            is_open = np.take_along_axis(waiting, best, 1) > -3
            more = is_open.any(1)
            live, best, is_open = live[more], best[more], is_open[more]
            if not len(live):
                break
            shut[live[:, None], best] = True
            next_ = np.where(is_open[:, :, None], self.layers[k][ids[live[:, None], best]], -1).reshape(len(live), -1)
            next_.sort(axis=1)  # what several opened vectors link to counts once
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            q, place = np.nonzero((next_ >= 0) & ~seen[live[:, None], next_])
            v = next_[q, place]
            row = live[q]
            seen[row, v] = True
            sim = np.einsum("ij,ij->i", queries[row], self.near[v])
            close = sim >= least
            if close.any():
                met.append((row[close], v[close]))
            fresh = np.full(next_.shape, -2, np.float32)
            fresh[q, place] = sim
            every = np.concatenate([sims[live], fresh], axis=1)
            keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(every, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], next_], axis=1), keep, 1)
            shut[live] = np.take_along_axis(np.concatenate([shut[live], fresh == -2], axis=1), keep, 1)
        return np.where(sims > -2, ids, -1), sims, met, seen

    def links(self, queries: np.ndarray, audited: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) whose cosine reaches ``LEAST``, with beams as wide as the
        audited queries need. Queries from the graph itself are entered at their ``places`` too."""
        turned = units(queries).astype(np.float32)
        bound = LEAST - SLACK
        sample = np.flatnonzero(audited)
        at, vector = np.nonzero(turned[sample] @ self.near.T >= bound)
        n = len(self.near)
        wanted = self._codes(queries, sample[at], vector)
        found = np.zeros(0, np.int64)
        beam = BEAM if places is not None else 2 * BEAM
        while True:
            if beam >= n:
                q, v = np.nonzero(turned @ self.near.T >= bound)
            else:
                q, v = self._flooded(turned, beam, bound, [] if places is None else [places])
            found = np.union1d(found, self._codes(queries, q, v))
            if beam >= n or np.isin(wanted, found, assume_unique=True).all():
                return found // n, found % n
            beam *= 2

    def _flooded(self, queries: np.ndarray, beam: int, bound: float, also: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that reach the bound, of those met by beams and then by opening all
        that come close to it."""
        _, _, pairs, seen = self._beam(queries, 0, [self._descend(queries, 0), *also], beam, bound - MARGIN)
        q, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        waiting, met = [(q, v)], [(q, v)]
        n = len(self.near)
        while waiting:
            q, v = waiting.pop()
            if len(q) > 20_000:
                waiting += [(q[:20_000], v[:20_000]), (q[20_000:], v[20_000:])]
                continue
            next_ = self.layers[0][v]
            at, place = np.nonzero(next_ >= 0)
            codes = q[at] * n + next_[at, place]
            codes = np.unique(codes[~seen.reshape(-1)[codes]])
            seen.reshape(-1)[codes] = True
            q, v = codes // n, codes % n
            close = np.concatenate([[], *[
                np.einsum("ij,ij->i", queries[q[i : i + 50_000]], self.near[v[i : i + 50_000]]) for i in range(0, len(q), 50_000)
            ]]) >= bound - MARGIN
            if close.any():
                waiting.append((q[close], v[close]))
                met.append(waiting[-1])
        return tuple(np.concatenate(x) for x in zip(*met, strict=True))

    def _codes(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The pairs that are links, as numbers."""
        stay = [np.zeros(0, bool)]
        for i in range(0, len(q), 50_000):
            stay.append(cosines(queries[q[i : i + 50_000]], self.vectors[v[i : i + 50_000]]) >= LEAST)
        stay = np.concatenate(stay)
        return q[stay] * len(self.near) + v[stay]


def united(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    name = np.arange(n)
    while True:
        low = np.minimum(name[one], name[two])
        new = name.copy()
        np.minimum.at(new, name[one], low)
        np.minimum.at(new, name[two], low)
        new = new[new]
        if (new == name).all():
            return name
        name = new


def _width(k: int) -> int:
    """Places of a row in layer k."""
    return DEGREE if k else 2 * DEGREE + 1 + BELOW


def _levels(ids: np.ndarray) -> np.ndarray:
    """Levels drawn from the ids: each holds about 1 / DEGREE of the one below."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    drawn = ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(drawn, 1e-18)) / np.log(DEGREE)).astype(np.int32)


def _audited(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    return (mixed >> np.uint64(32)) % np.uint64(AUDITED) == 0


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, dict, bool]]:
    """Runs of rows with equal ``names``, in parts of at most a batch, and whether a run begins."""
    last = None
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = list(zip(*[data[c] for c in names], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], {c: v[start:i] for c, v in data.items()}, keys[start] != last
                last, start = keys[start], i


def _graphs(classes: DataFrame) -> DataFrame:
    """The classes with their place in their shard's graph, the component they have
    there, and the weight of the links found there."""
    schema = "label string, size int, shard int, class_id long, n long, comp long, weight long, level int, place int, vector binary, links binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def settle(key: tuple, held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(held["class_id"], np.int64))
        ids, n = (np.array(held[c], np.int64)[order] for c in ("class_id", "n"))
        vectors = _vectors([held["vector"][i] for i in order.tolist()])
        levels = _levels(ids)
        graph = Graph.built(vectors, levels)
        pairs = [np.zeros(0, np.int64)]
        for i in range(0, len(ids), BLOCK):
            places = np.arange(i, min(i + BLOCK, len(ids)))
            q, v = graph.links(vectors[places], _audited(ids[places]), places)
            q = q + i
            # Found from either side; a class's own link is its weight less the row itself.
            low, high = np.minimum(q, v), np.maximum(q, v)
            pairs.append((low * len(ids) + high)[low != high])
        every = np.unique(np.concatenate(pairs))
        one, two = every // len(ids), every % len(ids)
        weight = n - 1 + np.bincount(one, n[two], len(ids)).astype(np.int64) + np.bincount(two, n[one], len(ids)).astype(np.int64)
        comp = ids[united(len(ids), one, two)]
        for i in range(0, len(ids), 4096):
            part = slice(i, i + 4096)
            place = np.arange(len(ids))[part]
            packed = [b"".join(layer[x].tobytes() for layer in graph.layers[: levels[x] + 1]) for x in place.tolist()]
            m = len(place)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]] * m, pa.string()), pa.array([key[1]] * m, pa.int32()), pa.array([key[2]] * m, pa.int32()),
                    pa.array(ids[part]), pa.array(n[part]), pa.array(comp[part]), pa.array(weight[part]), pa.array(levels[part], pa.int32()),
                    pa.array(place, pa.int32()), pa.array([x.tobytes() for x in vectors[part]], pa.binary()), pa.array(packed, pa.binary()),
                ],
                names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for new, rows, begins in _groups(batches, ["label", "size", "shard"]):
            if begins:
                if held:
                    yield from settle(key, held)
                key, held = new, {c: [] for c in ("class_id", "n", "vector")}
            for c, values in held.items():
                values += rows[c]
        if held:
            yield from settle(key, held)

    dealt = classes.repartition("label", "size", "shard").sortWithinPartitions("label", "size", "shard")
    return dealt.mapInArrow(run, schema)


def _loaded(held: dict[str, list]) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's graph from its rows, with ids, weights and components."""
    order = np.argsort(np.array(held["place"]))
    ids, n, comp = (np.array(held[c], np.int64)[order] for c in ("class_id", "n", "comp"))
    levels = np.array(held["level"], np.int32)[order]
    graph = Graph(_vectors([held["vector"][i] for i in order.tolist()]), levels)
    graph.layers = [np.full((len(ids), _width(k)), -1, np.int32) for k in range(int(levels.max()) + 1)]
    for x, i in enumerate(order.tolist()):
        numbers, at = np.frombuffer(held["links"][i], np.int32), 0
        for k in range(int(levels[x]) + 1):
            graph.layers[k][x] = numbers[at : at + _width(k)]
            at += _width(k)
    return graph, ids, n, comp


def _across(nodes: DataFrame) -> DataFrame:
    """Between different shards of a label: the weight that links give a class, and pairs of components that they unite."""
    last = nodes.groupBy("label", "size").agg(F.max("shard").alias("last"))
    labelled = nodes.join(last, ["label", "size"]).filter("last > 0")
    empty = F.lit(None).cast("binary")
    # A shard's graph goes to the tasks that search it, ahead of the vectors of smaller shards.
    graphs = labelled.filter("shard > 0").withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("shard") - 1) / REACH).cast("int")))).select(
        "label", "size", F.col("shard").alias("target"), "part", F.lit(-1).alias("own"), F.lit(0).alias("kind"), "class_id", "n", "comp", "level", "place", "vector", "links"
    )
    asked = labelled.filter("shard < last").withColumn("target", F.explode(F.sequence(F.col("shard") + 1, F.col("last")))).select(
        "label", "size", "target", (F.col("shard") / REACH).cast("int").alias("part"), F.col("shard").alias("own"), F.lit(1).alias("kind"),
        "class_id", "n", "comp", F.lit(0).alias("level"), F.lit(0).alias("place"), "vector", empty.alias("links"),
    )
    order = ["label", "size", "target", "part", "kind"]
    rows = graphs.unionByName(asked).repartition("label", "size", "target", "part").sortWithinPartitions(*order)

    def search(loaded: tuple, part: dict[str, list], gained: np.ndarray) -> pa.RecordBatch:
        graph, ids, n, comp = loaded
        own, own_n, own_comp = (np.array(part[c], np.int64) for c in ("class_id", "n", "comp"))
        q, v = graph.links(_vectors(part["vector"]), _audited(own))
        gained += np.bincount(v, own_n[q], len(ids)).astype(np.int64)
        weight = np.bincount(q, n[v], len(own)).astype(np.int64)
        some = np.flatnonzero(weight)
        joined = np.unique(np.stack([own_comp[q], comp[v]], axis=1), axis=0)
        return _found(np.concatenate([own[some], joined[:, 0]]), np.concatenate([weight[some], np.zeros(len(joined), np.int64)]), joined, len(some))

    def _found(ids: np.ndarray, weight: np.ndarray, joined: np.ndarray, plain: int) -> pa.RecordBatch:
        none = pa.array([None] * plain, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(weight, pa.int64()), pa.concat_arrays([none, pa.array(joined[:, 1], pa.int64())])], ["class_id", "weight", "other"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, loaded, gained = None, None, None
        none = np.zeros((0, 2), np.int64)
        for key, part, begins in _groups(batches, order):
            if key[-1] == 0:
                if begins:
                    if loaded:
                        yield _found(loaded[1], gained, none, len(gained))
                    loaded, held = None, {c: [] for c in ("class_id", "n", "comp", "level", "place", "vector", "links")}
                for c, values in held.items():
                    values += part[c]
                continue
            if loaded is None:
                loaded, held = _loaded(held), None
                gained = np.zeros(len(loaded[1]), np.int64)
            for i in range(0, len(part["own"]), BLOCK):
                yield search(loaded, {c: values[i : i + BLOCK] for c, values in part.items()}, gained)
        if loaded:
            yield _found(loaded[1], gained, none, len(gained))

    return rows.select(*[x.split()[0] for x in _NODE.split(", ")]).mapInArrow(run, "class_id long, weight long, other long")


def _packed(classes: DataFrame) -> DataFrame:
    """Vectors as bytes, as they go through tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("vector")
            values = batch.column(at)
            numbers, ends = values.flatten().to_numpy(), np.cumsum([0, *np.asarray(values.value_lengths())])
            raw = [numbers[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield batch.set_column(at, "vector", pa.array(raw, pa.binary()))

    fields = ", ".join(f"{c} {'binary' if c == 'vector' else kind}" for c, kind in classes.dtypes)
    return classes.mapInArrow(run, fields)


def components(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard: int = SHARD
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, the number of other vectors that it
    links with, ``component_id``, the smallest id it reaches, and ``kept``."""
    named = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector")
    )
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    fit = F.coalesce(fit, F.lit(False))
    # Two hashes with different seeds stand for the vector.
    keys = [F.when(fit, F.xxhash64("vector")).alias("key"), F.when(fit, F.xxhash64(F.lit(1), "vector")).alias("check")]
    rows = named.select("vec_id", "label", *keys, F.when(fit, v).alias("vector"))
    taking = rows.filter("vector is not null")
    classes = taking.groupBy("label", "key", "check").agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id")
    )
    classes = stored(classes.select(
        F.monotonically_increasing_id().alias("class_id"), "label", "key", "check", F.size("vector").alias("size"), "vector", "n", "least_id"
    ), "vectors")
    shards = classes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "size"]).select(
        "label", "size", F.pmod(F.xxhash64("key", F.lit(2)), F.col("shards")).cast("int").alias("shard"), "class_id", "n", "vector"
    )
    nodes = stored(_graphs(_packed(dealt)), "graphs")
    across = stored(_across(nodes), "across")

    found = nodes.select("class_id", F.col("class_id").alias("set_id"), "comp")
    joined = across.filter("other is not null").select(F.col("class_id").alias("a"), F.col("other").alias("b")).distinct()
    names = merged(found.select("set_id", "comp"), joined).withColumnRenamed("set_id", "class_id")
    weights = nodes.select("class_id", "weight").unionByName(across.select("class_id", "weight")).groupBy("class_id").agg(F.sum("weight").alias("n_links"))
    labelled = classes.select("class_id", "label", "key", "check", "least_id").join(names, "class_id").join(weights, "class_id")
    least = labelled.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    known = labelled.join(least, "comp").select("label", "key", "check", "n_links", "component_id")
    there = rows.select("vec_id", "label", "key", "check").join(known, ["label", "key", "check"], "left")
    component = F.coalesce("component_id", "vec_id")
    return there.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
