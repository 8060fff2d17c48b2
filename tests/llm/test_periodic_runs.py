"""Runs of words against a search of all periods."""

import hashlib
import random
import zlib

import pytest

from tallybook.llm import periodic_runs, queries

ROOT = "/root/testdata/sf0.01"


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(seed, number):
    rng, out = random.Random(seed), []
    for _ in range(number):
        n = rng.choice([0, 3, 6, 8, 20, 60, 150, 400])
        words = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3 + 1))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n and rng.random() < 0.3:
            words[rng.randrange(n)] = "z"
        out.append(words)
    return out


def test_runs_of_random_words():
    for words in texts(1, 1500):
        coded = [w.encode() for w in words]
        want = brute(words)
        assert [tuple(r) for r in periodic_runs.runs_of(coded).tolist()] == want
        assert not want or periodic_runs.may_hold_runs([[b"q"], coded, coded])[1]


def test_extensions_are_common_prefixes():
    rng = random.Random(4)
    numbers = [rng.randint(1, 2) for _ in range(120)]
    extend = periodic_runs.Extensions(periodic_runs.SuffixTree(numbers))
    pairs = [(i, j) for i in range(121) for j in range(121) if i != j]
    import numpy as np

    got = extend(*np.array(pairs).T)
    for (i, j), length in zip(pairs, got.tolist()):
        want = 0
        while max(i, j) + want < 120 and numbers[i + want] == numbers[j + want]:
            want += 1
        assert length == want


@pytest.mark.parametrize("change", [None, lambda key, words: words[::-1]])
def test_rows(spark, change):
    rows = [(i, " \t".join(words), "x") for i, words in enumerate(texts(2, 200))]
    rows += [(None, "a a a a a a a", "x"), (3, None, "x"), (3, "", "x"), (3, " \n ", "x"), (3, "b a a a a a a a", "x")]
    df = spark.createDataFrame(rows, "key long, body string, runs string")
    got = periodic_runs.find(df, "key", "body", change).collect()
    want = []
    for key, text, _ in rows:
        words = (text or "").encode().split()
        words = change(key, words) if change else words
        found = brute(words)
        want.append((key, found, b" ".join(collapsed(words, found)).decode()))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs.find(df.limit(0), "key", "body").collect() == []


def test_a_very_long_text():
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(5000) for _ in range(60_000)]
    words[20_000:] = [words[20_000 + i % 9000] for i in range(40_000)]
    words[19_999] = b"none"
    assert periodic_runs.may_hold_runs([words]).all()
    assert periodic_runs.runs_of(words).tolist() == [[20_000, 40_000, 9000]]


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, ROOT).collect()}
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda text: hashlib.sha256(text).hexdigest()
    with_runs = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        elif n > 1500:
            continue  # the search of all periods takes too long
        runs = brute(words) if n < 1500 else [tuple(x) for x in periodic_runs.runs_of(words).tolist()]
        with_runs += bool(runs)
        first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = got[doc_id]
        assert row.n_runs == len(runs)
        if first:
            assert (row.start, row.length, row.period, row.exponent_milli) == (*first, 1000 * first[1] // first[2])
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
        assert row.runs_sha256 == sha("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode())
        assert row.collapsed_sha256 == sha(b" ".join(collapsed(words, runs)))
    assert with_runs > 50
