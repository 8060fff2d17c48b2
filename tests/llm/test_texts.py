"""Operators that read texts one by one: pieces, packing, quality, language, personal data."""

import hashlib
import random
import tracemalloc
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm import differencing, piece_agenda, private_spans, robust_outliers, segmentations

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOKENIZER = Tokenizer.from_file(WORDS)
ODD = list(" ▁\n\t\r\x0b\x1c\x85　ab.,éß梦😀<>s/\x00'eth1½́̌JΣİ") + ["<|endoftext|>", "IT'S.", "the ", "x" * 70]
# Columns of names that the operators use themselves.
CLASHING = {"n": 1, "h": 2, "ids": 3, "n_words": 4, "base": 5, "spans": 6, "lines": 7, "centre": 8, "lang_": 9, "_x": 10, "score": 11}


def odd_texts(count, longest=40, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def table(spark, texts, clashing=True):
    rows = [(i if i % 7 else None, t, ["en", "fr", None][i % 3], ["a", "b"][i % 2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(v) for c, v in CLASHING.items()}) if clashing else df


# Pieces

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="".join(c for c in ODD if len(c) == 1), max_size=300))
def test_agenda_equals_library(text):
    own = piece_agenda.agenda(MODEL)
    ids = own.encode(text, True)
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert own.decode(ids) == LIBRARY.decode(ids)
    own.check()


def test_pieces_of_a_table(spark):
    texts = [None, "", " ", *odd_texts(60), "ab" * 4000, "word " * 3000, "same", "same"]
    df = piece_agenda.decode(piece_agenda.encode(table(spark, texts).drop("ids"), MODEL), MODEL)
    rows = df.select("text", "ids", "decoded", "score").collect()
    assert sorted(map(str, (r.text for r in rows))) == sorted(map(str, texts))
    for r in rows:
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        assert (r.ids, r.decoded, r.score) == (ids, LIBRARY.decode(ids), 11)
    assert piece_agenda.encode(table(spark, []), MODEL).count() == 0


def test_a_difference_from_the_library_fails():
    own = piece_agenda.Agenda(MODEL)
    own.fresh.append(("▁the", own.encode_batch(["cat"])[0]))
    with pytest.raises(AssertionError):
        own.check()


# Packing

def test_marks_are_no_new_words():
    """Symbols behind a known word, also one that ends in an accented letter, need no encoding of the whole."""
    words = ["stem", "año", "tué", "×", "a×", "naïf", "ÀÉ", "x'", "e\u0301", "1"]
    texts = [w + m for w in words for m in ("", "###", "%.%", "$,&", "*", "'s#", "<|#")]
    own = differencing.WordIds(WORDS)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in TOKENIZER.encode(text, add_special_tokens=False).ids), text
    assert {b"stem", b"###", "año".encode(), b"%.%"} <= own.met.keys()
    met = differencing.WordIds(WORDS)
    met.encode(["año ###"])
    met._meet = lambda fresh, meet=met._meet: (meet(fresh), seen.update(fresh))
    seen, sent = set(), []
    encode = met.tokenizer.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, lines, **options):
            sent.extend(lines)
            return encode(lines, **options)

    met.tokenizer = Counting()
    met.encode(["año###"])
    assert seen == {"año###".encode()} and sent == []


def test_word_ids_equal_the_tokenizers():
    own, texts = differencing.word_ids(WORDS), [None, "", *odd_texts(3000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        expected = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in expected), repr(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_every_item_is_packed_once_within_capacity(sizes):
    windows = differencing.packed(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows)


def test_partial_partitions_hold_filled_windows_alone():
    """What a merge costs goes by the filled windows, not by all."""
    tracemalloc.start()
    found = differencing.differenced([3] * 500, 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(w for w in found if w) == [[i] for i in range(500)] and peak < 2_000_000


def test_differencing_balances():
    # The classic example: 8, 7, 6, 5, 4 in two windows differ by 2.
    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in w) for w in differencing.differenced(sizes, 2)) == [14, 16]


def test_pieces_are_gapless_and_hold_every_id(spark):
    rng = random.Random(1)
    texts = [None, "", " ".join(rng.choice("abcdefgh") for _ in range(9000)), *[" ".join(["word"] * rng.randint(1, 900)) for _ in range(120)]]
    docs = table(spark, texts)
    rows = differencing.pack(docs.withColumn("doc_id", F.monotonically_increasing_id()), WORDS, group=8).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = []
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert all(r.doc_tokens == sum(p.length for p in pieces) for r in pieces)
        whole.append(b"".join(r.ids for r in pieces))
    one = (1).to_bytes(4, "little")
    assert sorted(whole) == sorted(ids + one for ids in differencing.word_ids(WORDS).encode(texts))
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * total / 2048 + 8
    assert differencing.pack(table(spark, []), WORDS).count() == 0


# Quality

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "\n\n", *odd_texts(80), *[" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)], "l1\nl1\n \nl2\nl1"]
    rows = robust_outliers.verdicts(table(spark, texts).withColumn("doc_id", F.monotonically_increasing_id())).collect()
    found = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == sorted(map(brute_counts, texts))
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows) and all(r.kept is not None for r in rows)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    clean = [prose(rng, rng.randint(60, 300)) for _ in range(300)]
    junk = [" ".join(w + rng.choice(["%%%", "***", "&&&"]) for w in prose(rng, 120).split()) for _ in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    kept = robust_outliers.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300))
    assert robust_outliers.keep(docs.limit(0)).count() == 0
    few = table(spark, [None, "", "one two", prose(rng, 40), prose(rng, 40)])
    assert robust_outliers.keep(few).count() == 2


def test_chi_square_quantiles():
    # Tabled values.
    for d, above, value in ((1, 0.05, 3.841), (6, 0.05, 12.592), (6, 0.001, 22.458), (10, 0.01, 23.209)):
        assert abs(robust_outliers.chi2_quantile(d, above) - value) < 1e-3


# Language

def test_forward_sums_all_segmentations():
    import numpy as np

    own = segmentations.segmentations(MODEL)
    rng = np.random.default_rng(0)
    weights = rng.random((own.nothing + 1, 2))
    weights[own.nothing] = 0
    pieces = piece_agenda.agenda(MODEL).id_of

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            piece = pieces.get(word[:n], own.unknown if n == 1 else None)
            if piece is not None:
                total += weights[piece, k] * brute(word[n:], k)
        return total

    for word in ("the", "étre", "xกy", "information"):
        sums = own.forward(own.spelled([word], len(word)), 1, len(word), weights)[0, -1]
        assert sums == pytest.approx([brute("▁" + word, k) for k in range(2)], rel=1e-9)


def test_languages_are_told_apart(spark):
    rng = random.Random(8)
    sounds = {"one": ["th", "er", "ing", "was"], "two": ["eau", "ille", "où", "ré"], "Zwei": ["sch", "ung", "ä", "keit"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[l]) for _ in range(3)) for _ in range(30)), l) for i, l in enumerate(list(sounds) * 60)]
    rows += [(1000, None, "one"), (1001, "12 ½ _ ²", "two"), (1002, "ok there", None), (None, "sching", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(v) for c, v in CLASHING.items() if c != "score"})
    fold = segmentations.held_out()
    found = segmentations.predict(docs, segmentations.learned(docs.filter(~fold), MODEL), MODEL)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    for r in found.filter("doc_id < 180").collect():
        assert r.lang_pred == r.lang and 0 <= r.score <= 1
    assert {(r.doc_id, r.lang_pred, r.score) for r in found.filter("doc_id in (1000, 1001)").collect()} == {(1000, "und", 0.0), (1001, "und", 0.0)}
    none = segmentations.predict(docs, segmentations.learned(docs.limit(0), MODEL), MODEL)
    assert {r.lang_pred for r in none.collect()} == {"und"}


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_languages_without_ids_or_with_one_id(spark):
    kinds = {"aa": "etaoin", "bb": "vwxyzk", "cc": "bcdfgh"}
    rng = random.Random(12)

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(6))

    rows = [(None, text(kinds["aa"]), "aa") for _ in range(1500)] + [(7, text(kinds["bb"]), "bb") for _ in range(1500)]
    rows += [(9, "bdgf chbd " * 3, "cc")] * 1500 + [(None, None, "dd"), (1, "etaoin", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = segmentations.learned(docs, MODEL)
    assert {r.lang: r.texts for r in learned.collect()} == {"aa": 1500, "bb": 1500, "cc": 1500}
    asked = spark.createDataFrame([(i, text(letters), lang) for i in range(30) for lang, letters in kinds.items()], "doc_id long, text string, want string")
    assert segmentations.predict(asked, learned, MODEL).filter("lang_pred <> want").count() == 0


def luhn(digits):
    return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    bits = list("@.%+-_ ()0123é\n😀a") + ["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (443) 555-5793", "007.01.1.1", "10.0.0.00", "0.0.0.0", "2555.1.1.1", "@", "x.y"]
    texts = [None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(500)]]
    texts += ["a" * 6000, "1" * 6000, "1 " * 9000, "a@b" + ".c" * 9000, "+1" * 3000, "+" + "1-" * 9000 + "x", "1." * 6000, "4111111111111111 " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    rows = {r.doc_id: r for r in private_spans.spans(docs).select(
        "doc_id", private_spans.rendered(F.col("base")).alias("base"), private_spans.rendered(F.col("spans")).alias("spans")).collect()}
    for i, text in enumerate(texts):
        expected = brute_spans(text)
        assert rows[i].base == ",".join(expected), repr(text[:80])
        assert set(expected) <= set(filter(None, rows[i].spans.split(",")))


def test_run_together_numbers_are_added_and_redacted(spark):
    rng = random.Random(4)

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    texts = [f"call me at {phone()} or not, on line {i}" for i in range(400)]
    texts += ["then +1 (269) 555-3296 4524132264652877 came", "order 12345678 of 1234567890123456", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    spans = {r.doc_id: r.s for r in private_spans.spans(docs).select("doc_id", private_spans.rendered(F.col("spans")).alias("s")).collect()}
    assert spans[400] == "phone:5:22" and spans[401] == "" and spans[402] == ""
    clean = private_spans.redact(docs)
    assert clean.columns == docs.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[400] == "then [PHONE] 4524132264652877 came" and out[401] == texts[401] and out[402] is None
    assert out[0] == "call me at [PHONE] or not, on line 0"
    assert private_spans.redact(docs.limit(0)).count() == 0


def numbers(rng):
    """A phone number, and one that a card could have (or not)."""

    def card(valid=True):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return body + next(d for d in "0123456789" if luhn(body + d) == valid)

    return lambda: f"+1 ({rng.randint(0, 999):03}) 555-{rng.randint(1000, 9999)}", card


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = private_spans.spans(docs).select("doc_id", private_spans.rendered(F.col("spans")).alias("s"))
    return {r.doc_id: r.s for r in found.collect()}


def test_numbers_that_half_of_the_rows_run_together_are_added(spark):
    phone, card = numbers(random.Random(8))
    texts = [f"pay {card()} or call {phone()}, on line {i}" if i % 2 else f"then {phone()} {card()} came on line {i}" for i in range(400)]
    texts += [f"both {card()} {card()} came", f"then {phone()} {card(False)} came"]
    spans = spans_of(spark, texts)
    assert all(spans[i] == "card:23:39,phone:5:22" for i in range(0, 400, 2))
    assert spans[400] == "card:5:21,card:22:38" and spans[401] == "phone:5:22"


def test_slices_of_long_numbers_are_not_added(spark):
    rng = random.Random(9)
    _, card = numbers(rng)
    texts = [f"pay {card()} on line {i}" for i in range(100)]
    texts += [f"from {' '.join(str(rng.randint(1000, 9999)) for _ in range(7))} of {i}" for i in range(1000)]
    spans = spans_of(spark, texts)
    assert all(spans[i] == "card:4:20" for i in range(100)) and not any(spans[i] for i in range(100, 1100))


def test_written_out_mails_and_phones_without_a_plus_are_added(spark):
    phone, _ = numbers(random.Random(10))
    texts = [f"call me at {phone()} or at jane{i}@example.com, on line {i}" for i in range(300)]
    planted = ["write to jane (at) example (dot) com. We reply", "or jane [at] mail.example.org now", "call (743) 555-3824 now", "or 743-555-3824 now"]
    other = ["see fig (at) 3.1 there", "parts 100 200 3000 400 500 6000 left", "code 100-200.3000 of it"]
    spans = spans_of(spark, [*texts, *planted, *other])
    assert [spans[i] for i in range(300, 307)] == ["email:9:36", "email:3:29", "phone:5:19", "phone:3:15", "", "", ""]
    assert all(len(spans[i].split(",")) == 2 for i in range(300))
    # Where most of their format are wrong, none are added.
    tables = [f"row {rng} 100 200 3000 400 500 6000 sum 100 200 3000 of it" for rng in range(300)]
    assert not any("phone" in s for i, s in spans_of(spark, [*texts, *tables]).items() if i >= 300)


def test_digests_of_the_query(spark, tmp_path):
    from tallybook.llm.queries import QUERIES

    texts = [None, "a@b.cd and 10.0.0.1", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op7_private_spans"](spark, str(tmp_path)).collect():
        base = ",".join(brute_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 1, 0, 0) if r.doc_id == 1 else (0, 0, 0, 0))
    for r in QUERIES["op9_piece_agenda"](spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
