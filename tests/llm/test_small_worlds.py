"""Near copies of vectors against all pairs of a label."""

import numpy as np
import pytest

from tallybook.llm import queries, small_worlds

ROOT = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, value string, extra int"


def brute(table):
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = []
    for vec_id, vector, label in table:
        good = vec_id is not None and label is not None and vector and None not in vector
        v = np.array(vector, np.float64) if good else None
        rows.append((vec_id, label, v if good and np.isfinite(v).all() and v.any() else None))
    n = len(rows)
    links = [set() for _ in range(n)]
    for i, (_, label, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][2]
            if v is None or w is None or rows[j][1] != label or len(v) != len(w):
                continue
            if (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())) >= small_worlds.LEAST:
                links[i].add(j)
                links[j].add(i)
    least, out = {}, []
    for i in range(n):
        if i not in least:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            name = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            least.update(dict.fromkeys(seen, name))
        out.append((rows[i][0], len(links[i]), least[i], rows[i][0] is None or rows[i][0] == least[i]))
    return sorted(out, key=str)


def found(spark, table, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1) for i, v, label in table], SCHEMA)
    return sorted((tuple(r) for r in small_worlds.components(df, **options).collect()), key=str)


def clusters(seed, groups, d=16, label=lambda i: i % 2):
    rng, table = np.random.default_rng(seed), []
    for i, (size, noise) in enumerate(groups):
        centre = rng.standard_normal(d)
        table += [(centre + noise * rng.standard_normal(d), label(i)) for _ in range(size)]
    order = rng.permutation(len(table))
    return [(int(k), table[at][0].astype(np.float32).tolist(), table[at][1]) for k, at in enumerate(order)]


@pytest.mark.parametrize("shard", [4096, 60])
def test_groups_of_copies_and_near_copies(spark, shard):
    groups = [(150, 0.05), (40, 0.0), (60, 0.15), (25, 0.24)] + [(2, 0.1)] * 30 + [(1, 0.0)] * 150
    table = clusters(5, groups)
    assert found(spark, table, shard=shard) == brute(table)


def test_one_group_in_many_shards(spark):
    table = clusters(6, [(300, 0.1)], label=lambda i: 7)
    assert found(spark, table, shard=20) == brute(table)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    table = [
        (1, [1, 0], 1), (2, [2, 0], 1), (3, [1, 0], 2), (4, [1, 0], None), (5, None, 1), (6, [], 1), (7, [0, 0], 1),
        (8, [nan, 1], 1), (9, [inf, 1], 1), (10, [None, 1], 1), (None, [1, 0], 1), (11, [1, 0, 0], 1), (2, [1, 0.1], 1), (2, [1, 0], 1), (12, [-1, 0], 1),
    ]
    assert found(spark, table) == brute(table)
    assert found(spark, []) == []


def test_audits_widen_beams():
    rng = np.random.default_rng(2)
    graph = small_worlds.Graph.built(rng.standard_normal((300, 8)), np.zeros(300, np.int32))
    for layer in graph.layers:
        layer[:] = -1  # nothing leads anywhere
    q, v = graph.links(graph.vectors[:50], np.ones(50, bool))
    assert set(zip(range(50), range(50))) <= set(zip(q.tolist(), v.tolist()))


def test_query(spark):
    rows = spark.read.parquet(f"{ROOT}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = queries.QUERIES["op11_small_worlds"](spark, ROOT)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([tuple(r) for r in rows])
