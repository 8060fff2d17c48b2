"""Operators that join and group: host reputation, lines, near copies, repeated strings, neighbours, and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import host_reputation, line_windows, rotated_codes, size_aware_join, suffix_windows

# Columns of names that the operators use themselves.
CLASHING = {"h": 1, "n": 2, "lines": 3, "n_lines": 4, "digest": 5, "set_id": 6, "a": 7, "first_doc": 8, "_x": 9, "text_key": 10}


def with_clashes(df):
    return df.withColumns({c: F.lit(v) for c, v in CLASHING.items()})


# Host reputation

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?q=1": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://x.com": ("x.com", "", None, "allow"), "http://net/es/1#t": ("net", "/es/1", "net/es/", "block"),
        "http://éÀ.net?x://y/": ("éÀ.net", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = with_clashes(spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = host_reputation.judge(pages, labels, RULES).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in rows} == cases
    assert host_reputation.judge(pages.limit(0), labels, RULES).count() == 0


def test_bad_hosts_are_blocked_and_shrunk(spark):
    rng = random.Random(1)
    rows, labels, page = [], [], 0
    for host, rate, count in (("bad.org", 0.95, 60), *((f"h{i}.fine.org", 0.05, 60) for i in range(20)), ("one.org", 1.0, 1), ("new.org", 0, 0)):
        for _ in range(max(count, 1)):
            page += 1
            rows.append((page, f"http://{host}/p"))
            if count:
                labels.append((page, 1, int(rng.random() < rate)))
    labels += [(labels[0][0], None, None), (99999, 0, 1)]
    found = host_reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [])
    verdicts = {r.host: r.verdict for r in found.collect()}
    assert verdicts["bad.org"] == "block" and {v for h, v in verdicts.items() if h != "bad.org"} == {"allow"}
    once = {r.host: r.bound for r in found.collect()}
    assert once["one.org"] < once["bad.org"]  # a single bad page is shrunk to its prior


def test_suffixes_without_labels_and_repeated_pages(spark):
    rows = [(k, f"http://h{k % 5}.bad.org/{k}") for k in range(60)] + [(100, "http://new.site/"), (None, "http://10.1.2.3/"), (None, "http://10.1.2.3/"), (1, "http://h1.bad.org/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    found = host_reputation.judge(pages, labels, []).collect()
    # All labelled pages are bad, so hosts of which nothing else is known are blocked too.
    assert len(found) == len(rows) and {r.verdict for r in found} == {"block"} and all(r.bound > 0.25 for r in found)
    assert {r.verdict for r in host_reputation.judge(pages, labels.limit(0), []).collect()} == {"allow"}


def test_registered_domains(spark):
    rows = [("http://u@a.b.example.co.uk:80/",), ("http://disco.uk/",), ("http://10.0.0.1/",), ("http://localhost/",), ("http://x.y./",)]
    found = host_reputation.with_parts(spark.createDataFrame(rows, "url string")).collect()
    assert [(r.domain, r.suffix) for r in found] == [("example.co.uk", "co.uk"), ("disco.uk", "uk"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost"), ("y.", "")]


# Lines

def brute_lines(docs):
    first, out = {}, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p : p + 3]), (i, p))
    for i, text in docs:
        lines = text.split("\n")
        gone = {p + k for p in range(len(lines) - 2) if first[tuple(lines[p : p + 3])] != (i, p) for k in range(3)}
        spans = sum(1 for p in gone if p - 1 not in gone)
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone), spans))
    return sorted(out)


def test_later_windows_go(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for i in range(150)]
    docs += [(150, ""), (151, "\n\n\n\n"), (152, "x\ny\nz\nx\ny\nz"), (153, "\n".join(map(str, range(4000)))), (154, "\n".join(map(str, range(2000, 3000))))]
    df = with_clashes(spark.createDataFrame([*docs, (200, None)], "doc_id long, text string"))
    found = line_windows.remove_repeated(df)
    assert set(df.columns) <= set(found.columns)
    rows = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.n_spans) for r in found.collect()]
    assert sorted(r for r in rows if r[0] != 200) == brute_lines(docs)
    assert (200, None, 0, 0, 0) in rows and {r._x for r in found.collect()} == {9}
    assert line_windows.remove_repeated(df.limit(0)).count() == 0


def test_repeated_rows_share_their_fate(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (None, "a\nb\nc"), (None, "q\nr\ns"), (None, "q\nr\ns")]
    found = line_windows.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(
        {(1, "a\nb\nc"): 1, (2, "d"): 2, (None, ""): 1, (None, "q\nr\ns"): 2}
    )


def test_texts_of_one_number_or_none_lose_what_they_share(spark):
    rows = [(i, f"{k}\n{line}\nb\nc") for i, line in ((None, "a"), (7, "z")) for k in range(5)]
    rows += [(8, "a\nq\nr\ns"), (None, "a\nq\nr\ns")]
    found = line_windows.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, line in ((None, "a"), (7, "z")):
        own = sorted(r.text for r in found if r.doc_id == i and r.text)
        whole = [t for t in own if t.endswith(f"{line}\nb\nc")]
        assert len(whole) == 1 and sorted([*own, whole[0][0]]) == sorted([*whole, *"01234"])
    assert [r.text for r in found if r.doc_id == 8] == ["a\nq\nr\ns"]


# Near copies

def words_of(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\n", " ").split()


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = words_of(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 7, 8, 9, 12, 16, 20, 26, 40, 120]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(0, len(base) // 40) + 1)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], "more"]])
                copy = copy or ["none"]
            docs.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs += [f"{shared} " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    # A chain whose ends don't link, and many copies with one edit each.
    chain = [f"c{i}" for i in range(60)]
    docs += [" ".join(chain[k : k + 50]) for k in range(0, 10, 2)]
    body = [f"b{i}" for i in range(80)]
    docs += [" ".join([*body[:k], f"edit{k}", *body[k + 1 :]]) for k in range(80)]
    docs += ["", "  \n", "É é", "é É"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_brute_force(spark):
    docs = near_copies()
    df = with_clashes(spark.createDataFrame([*docs, (5000, None)], "doc_id long, text string"))
    expected = brute_components(docs) | {5000: (0, 5000)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in size_aware_join.components(df).collect()} == expected
    stay = size_aware_join.representatives(df)
    assert stay.columns == df.columns
    assert {r.doc_id for r in stay.collect()} == {i for i, (n, c) in expected.items() if n == 0 or c == i}


def test_a_passage_in_a_third_of_all_documents(spark):
    """Documents that are mostly one passage and yet don't link, beside some that do."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(90)]
    docs = []
    for k in range(160):
        own = [f"o{k}x{i}" for i in range(rng.randint(8, 14))]
        docs.append(" ".join(passage + own if k % 2 else own + passage))
    docs += [" ".join([*passage, *(f"s{j}x{i}" for i in range(12)), f"last{k}"]) for j in range(6) for k in range(4)]
    docs += [" ".join(f"r{k}x{i}" for i in range(50)) for k in range(300)]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in size_aware_join.components(df).collect()} == brute_components(rows)


def test_representatives_without_ids(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text)] * 300 + [(None, None)] * 3 + [(4, "")] * 2 + [(4, text)] * 2, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in size_aware_join.representatives(df).collect())
    assert kept == Counter({(None, text): 300, (None, None): 3, (4, ""): 1, (4, text): 1})


def test_light_sets_alone_and_lists_alone_agree(spark, monkeypatch):
    docs = near_copies()
    df, expected = spark.createDataFrame(docs, "doc_id long, text string"), brute_components(docs)
    for most in (0, 12):
        monkeypatch.setattr(size_aware_join, "_boundary", lambda lists, most=most: most)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in size_aware_join.components(df).collect()} == expected


def test_frequent_shingles_do_not_hang_on_the_split(spark):
    """A shingle that each of many small parts has twice comes last in the order."""
    docs = [(i, " ".join(["one two three four five", *(f"x{i}y{k}" for k in range(9))])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(10, "doc_id")
    shared = next(size_aware_join.shingle_sets(pa.array(["One two three four five"])))
    assert size_aware_join._frequent(df).tolist() == shared.tolist()


def test_sets_of_several_lists_meet_once(spark):
    """In the last round two sets are a pair in the first list that they share."""
    rows = [(s, 40, t, place, s) for s in range(3) for place, t in enumerate((7, 5, 90 + s, 6))]
    rows = size_aware_join._with_earlier(spark.createDataFrame(rows, "set_id long, n int, token long, place int, comp long"))
    other = rows.toDF(*[c if c == "token" else f"pivot_{c}" for c in rows.columns])
    met = rows.join(other, "token").filter("set_id < pivot_set_id").filter(~F.arrays_overlap("earlier", "pivot_earlier"))
    assert sorted(met.select("set_id", "pivot_set_id", "token").collect()) == [(0, 1, 7), (0, 2, 7), (1, 2, 7)]


def test_shingles_are_those_of_the_words(monkeypatch):
    """Sets of texts with odd white space, nulls and words that reach over the steps of the hash."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbBé \t\n\x0b\x0c\r\x1c\x00") for _ in range(rng.choice((0, 3, 40, 200)))) for _ in range(300)]
    texts += [None, "", " ", "a b c d", "A B C D", "a b c d e f"]
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()} for w in words]
    for step in (7, 1 << 15):
        monkeypatch.setattr(size_aware_join, "_STEP", step)
        monkeypatch.setattr(size_aware_join, "_UP", size_aware_join._powers(size_aware_join._BASE))
        monkeypatch.setattr(size_aware_join, "_DOWN", size_aware_join._powers(pow(size_aware_join._BASE, -1, 1 << 64)))
        found = list(size_aware_join.shingle_sets(pa.array([None, *texts])[1:]))
        assert [len(x) for x in found] == [len(x) for x in sets]
        assert len(set(np.concatenate(found).tolist())) == len(set().union(*sets))
        for i in range(1, len(sets)):
            assert len(np.intersect1d(found[i - 1], found[i])) == len(sets[i - 1] & sets[i])


def test_copies_without_ids_and_empty_tables(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(7, text), (7, text), (3, text), (None, text), (9, "other"), (9, "words here")], "doc_id long, text string")
    found = size_aware_join.components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter({(7, 2, 3): 2, (3, 2, 3): 1, (None, 2, None): 1, (9, 1, 9): 2})
    kept = Counter((r.doc_id, r.text) for r in size_aware_join.representatives(df).collect())
    assert kept == Counter({(3, text): 1, (None, text): 1, (9, "other"): 1, (9, "words here"): 1})
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert size_aware_join.representatives(twice).count() == 1
    assert size_aware_join.components(df.limit(0)).count() == 0


# Repeated strings

def brute_removed(texts, threshold):
    seen, raw = Counter(), [(t or "").encode() for t in texts]
    for b in raw:
        for p in range(len(b) - threshold + 1):
            seen[b[p : p + threshold]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - threshold + 1):
            if seen[b[p : p + threshold]] > 1:
                gone[p] += 1
                gone[p + threshold] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        heads = int((covered & ~np.append(False, covered[:-1])).sum()) if len(b) else 0
        out.append((len(b), int(covered.sum()), heads, np.frombuffer(b, np.uint8)[~covered].tobytes()))
    return Counter(out)


@pytest.mark.parametrize("part", [600_000, 300])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_windows, "PART", part)
    suffix_windows._powers.cache_clear()
    rng = random.Random(4)

    def w(n):
        return " ".join(rng.choice(["alpha", "beta", "gam", "del", "éta"]) + str(rng.randint(0, 99)) for _ in range(n))

    passage, base = w(60), w(300)
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "a" * 1500, "ab" * 900, "ab" * 900, passage, passage + "x", w(40) + passage + w(40)]
    texts += [w(10) + passage[:250] + w(90), base, base[:700] + "ZZ" + base[702:], base, base[5:], "xyz" * 100 + passage]
    texts += [w(20) + passage + w(20) for _ in range(40)] + [base[rng.randint(0, 300) : rng.randint(600, 1500)] + w(5) for _ in range(30)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    found = suffix_windows.remove_repeated(df).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == brute_removed(texts, 200)
    assert suffix_windows.remove_repeated(df.limit(0)).count() == 0
    suffix_windows._powers.cache_clear()


def test_many_equal_rows_without_ids(spark):
    rng = random.Random(7)
    text = " ".join(str(rng.random()) for _ in range(400))
    df = spark.createDataFrame([(None, text)] * 2000 + [(5, text)] * 500 + [(6, "a" * 199)], "doc_id long, text string").repartition(8)
    spans = suffix_windows.repeated_spans(df.select("doc_id", F.xxhash64("text").alias("digest"), "text"))
    assert spans.count() == spans.filter("doc_id = 5").count() * 2 < 2 * len(text) / 10
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_windows.remove_repeated(df).collect())
    assert found == Counter({(None, len(text), len(text), 1): 2000, (5, len(text), len(text), 1): 500, (6, 199, 0, 0): 1})


# Neighbours

def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((700, 24)).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows[10] = (10, [0.0] * 24, 1)
    rows[20] = (20, None, 1)
    rows[30] = (30, [None, *rows[30][1][1:]], 1)
    rows[40] = (40, [float("nan"), *rows[40][1][1:]], 1)
    rows[100] = (100, rows[101][1], 1)  # ties
    rows[102] = (102, rows[101][1], 1)
    rows += [(None, rows[5][1], 1), (800, [1.0, 2.0], 1), (801, [2.0, 1.0], 1), (900, [], 1)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(4)
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    for wave in (2048, 4):
        found = {}
        for r in rotated_codes.search(df, F.col("vec_id") % 50 == 0, 5, wave=wave).collect():
            found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        hits = total = 0
        for q in (i for i in good if i % 50 == 0):
            others = [(i, v) for i, v in good.items() if i != q and len(v) == len(good[q])]
            score = {i: float(v @ good[q] / (np.linalg.norm(v) * np.linalg.norm(good[q]))) for i, v in others}
            best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
            got = [found[q][k][0] for k in sorted(found.get(q, {}))]
            assert sorted(found.get(q, {})) == list(range(1, len(best) + 1))
            hits, total = hits + len(set(best) & set(got)), total + len(best)
            assert all(abs(found[q][k][1] - score[found[q][k][0]]) < 1e-12 for k in found[q])
        assert hits >= 0.95 * total
        assert [v for v, _ in (found[100][k] for k in (1, 2))] == [101, 102]
        assert set(found) == {i for i in good if i % 50 == 0}
    assert rotated_codes.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


# Pipeline

def test_stages_keep_the_columns_and_end_in_sequences(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)

    def prose(n):
        return "\n".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(8)).capitalize() + "." for _ in range(n))

    texts = [prose(rng.randint(8, 20)) for _ in range(120)]
    block = prose(4)
    texts[5], texts[6] = texts[5] + "\n" + block, texts[6] + "\n" + block
    texts[7] = texts[8].replace("\n", " ")
    texts[9] += "\nwrite to someone@mail.example.com"
    junk = {120: " ".join(w + "%%%" for w in prose(15).split()), 121: "short", 122: None}
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(i, t, "en", "s", None) for i, t in junk.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = start = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("n", F.lit(1)).withColumn("_x", F.lit(2))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == start.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect())
    assert set(seen[0]) == set(range(120))
    assert set(seen[1]) == set(seen[0]) and block not in seen[1][6].text and block in seen[1][5].text
    assert set(seen[2]) == set(range(120)) - {8}
    assert "[EMAIL]" in seen[3][9].text and "@" not in seen[3][9].text
    assert all(r.n_chars == len(r.text) for r in seen[3].values())
    assert {r.doc_id for r in seen[4]} == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
    empty = start.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
