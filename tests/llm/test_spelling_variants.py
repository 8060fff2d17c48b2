"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.llm import queries
from tallybook.llm import spelling_variants as sv

ROOT = "/root/testdata/sf0.01"


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    k = 0
    while k < len(u) and u[k] == v[k]:
        k += 1
    return u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else u[k:] == v[k + 1 :]


def brute(counts, pairs=None):
    """(word, form, root, n, n_near, form_n) of each word; near words by deletions."""
    by = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, []).append(w)
    found = {w: set() for w in counts}
    for group in by.values():
        for i, u in enumerate(group):
            for v in group[:i]:
                if near(u, v):
                    found[u].add(v)
                    found[v].add(u)
    forms = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best and counts[best] >= sv.FACTOR * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, len(found[w]), counts.get(forms[w])))
    return sorted(rows)


def counted(rows, deleted=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if deleted and doc_id is not None and h % deleted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= sv.LETTERS and n >= sv.OCCURRENCES}


def vocabulary(seed, number, letters="abc"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(number)}
    return {w: rng.choice([2, 3, 20, 30, 250, 3000]) for w in words}


def test_acceptor_and_pairs():
    rng = random.Random(3)
    for turn in range(400):
        words = sorted({"".join(rng.choice("ab" if turn % 2 else "abcd") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 40))})
        acceptor = sv.Acceptor(words)
        assert sorted(acceptor.accepted(0)) == words
        got = [frozenset((a[1:], b[1:])) for a, b in acceptor.pairs("x")]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((u, v)) for u in words for v in words if near(u, v)}
        # Minimal: no two states accept the same.
        reached, todo = {0}, [0]
        while todo:
            for state in set(acceptor.arcs[todo.pop()].values()) - reached:
                reached.add(state)
                todo.append(state)
        assert len({tuple(sorted(acceptor.accepted(s))) for s in reached}) == len(reached)


@pytest.mark.parametrize("most", [20_000, 25, 3])
def test_variants_with_split_buckets(spark, most):
    counts = vocabulary(1, 900)
    # A hot beginning, chains of forms, a word that begins another, long words.
    counts |= {f"hotword{c}{d}": 2 for c in "abcdefgh" for d in "xyz"} | {"hotword": 2, "hotwordq": 20, "hotwordqq": 200, "hotworqqq": 2000}
    counts |= {"l" * 3000: 2, "l" * 3001: 20, "l" * 2999 + "m": 5, "élévateur": 40, "elévateur": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in sv.variants(df, most).collect()) == brute(counts)


def test_words_of_rows(spark):
    rows = [
        (1, "Straßen straSSEN ÉTAGEREN Étageren étageren ×÷letters÷× shorter1shorter"), (2, None), (2, ""), (2, "1 2 3"),
        (2, "letters letters LETTERS shorter"), (2, "letters letters LETTERS shorter"), (None, "nullword nullword"), (3, "a" * 5000 + " " + "a" * 5000),
    ]
    df = spark.createDataFrame([(text, i, "x") for i, text in rows], "body string, key long, word string")
    for deleted in (None, 2):
        got = {r.word: r.n for r in sv.word_counts(df, "key", "body", deleted).collect()}
        assert got == counted(rows, deleted)
    assert sv.variants(sv.word_counts(df.limit(0), "key", "body")).collect() == []


def test_query(spark):
    got = queries.QUERIES["op13_spelling_variants"](spark, ROOT)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(counted(rows, sv.DELETED))
    assert got.filter(F.col("form").isNotNull()).count() > 100
