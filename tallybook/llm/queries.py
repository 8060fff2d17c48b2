"""The operators of this subpackage over the test tables, one query each."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    differencing,
    host_reputation,
    line_windows,
    periodic_runs,
    piece_agenda,
    private_spans,
    robust_outliers,
    rotated_codes,
    segmentations,
    size_aware_join,
    small_worlds,
    spelling_variants,
    suffix_windows,
)
from tallybook.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


#: The rules of the contract: action and host/path.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query
def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    found = host_reputation.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op1_host_reputation"] = r"""
with parts as (
  select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
  from pages),
bare as (select *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') as bare from parts),
suffixes as (
  select *, case when regexp_matches(bare, '^[0-9.]+$') then bare
    else regexp_extract(bare, '(?:^|\.)((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))$', 1) end as suffix from bare),
rows as (
  select *, case when regexp_matches(bare, '^[0-9.]+$') or length(bare) <= length(suffix) then bare
    else regexp_extract(substr(bare, 1, greatest(0, length(bare) - length(suffix) - 1)), '([^.]*)$', 1) || '.' || suffix
    end as domain from suffixes),
once as (select page_id, min(suffix) as suffix, min(domain) as domain, min(host) as host from rows group by page_id),
marked as (select doc_id, max(greatest((quality = 0)::int, (toxic = 1)::int)) as bad from labels group by doc_id),
hosts as (
  select suffix, domain, host, count(*) as n, sum(bad) as b from once join marked on page_id = doc_id
  where bad is not null group by all),
s1 as (
  select suffix, sum(n)::double as n, sum(b)::double as b,
    (select (coalesce(sum(b), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) from hosts)::double as p from hosts group by suffix),
k1 as (
  select 1 / least(0.5, greatest(0.001, coalesce(sum((b - n * p) * (b - n * p) - n * p * (1 - p)) / nullif(sum((n - 1) * (n * p * (1 - p))), 0), 0))) - 1 as k from s1),
m1 as (select suffix, (k * p + b) / (k + n) as mean from s1, k1),
s2 as (select suffix, domain, sum(n)::double as n, sum(b)::double as b, any_value(mean) as p from hosts join m1 using (suffix) group by suffix, domain),
k2 as (
  select 1 / least(0.5, greatest(0.001, coalesce(sum((b - n * p) * (b - n * p) - n * p * (1 - p)) / nullif(sum((n - 1) * (n * p * (1 - p))), 0), 0))) - 1 as k from s2),
m2 as (select suffix, domain, (k * p + b) / (k + n) as mean from s2, k2),
s3 as (select host, n::double as n, b::double as b, mean as p from hosts join m2 using (suffix, domain)),
k3 as (
  select 1 / least(0.5, greatest(0.001, coalesce(sum((b - n * p) * (b - n * p) - n * p * (1 - p)) / nullif(sum((n - 1) * (n * p * (1 - p))), 0), 0))) - 1 as k from s3),
known as (
  select d.host, coalesce(k * s3.p + b, k * coalesce(m2.mean, m1.mean, overall.p)) as alpha,
    coalesce(k * (1 - s3.p) + n - b, k * (1 - coalesce(m2.mean, m1.mean, overall.p))) as beta
  from (select distinct suffix, domain, host from rows) d left join m1 using (suffix) left join m2 using (suffix, domain)
    left join s3 on s3.host = d.host, k3, (select ((sum(b) + 0.5) / (sum(n) + 1.0))::double as p from hosts) overall),
bounds as (
  select host, alpha / (alpha + beta)
    - 1.6448536269514722 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) as bound from known),
ruled as (
  select page_id, host, path, bound, case
    when ends_with('.' || host, '.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when ends_with('.' || host, '.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when ends_with('.' || host, '.net') and starts_with(path, '/es/') then 'net/es/'
    when ends_with('.' || host, '.net') and starts_with(path, '/fr/') then 'net/fr/'
    when ends_with('.' || host, '.com') and starts_with(path, '/') then 'com/' end as rule
  from rows left join bounds using (host))
select page_id, host, path, rule, case
    when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
    when bound > 0.25 then 'block' else 'allow' end as verdict
from ruled
"""


@query
def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of repeated three-line windows."""
    return line_windows.remove_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op2_line_windows"] = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as pos, len(string_split(text, chr(10))) as n
  from documents where text is not null),
windows as (
  select *, lead(line) over w as second, lead(line, 2) over w as third from lines window w as (partition by doc_id order by pos)),
ranked as (
  select doc_id, pos, row_number() over (partition by line, second, third order by doc_id, pos) as place
  from windows where pos + 2 < n),
covered as (select distinct doc_id, pos + k as pos from ranked, range(3) r(k) where place > 1),
marked as (
  select l.*, c.pos is not null as gone, lag(c.pos is not null) over (partition by l.doc_id order by l.pos) as gone_before
  from lines l left join covered c on c.doc_id = l.doc_id and c.pos = l.pos),
found as (
  select doc_id, string_agg(line, chr(10) order by pos) filter (not gone) as text, count(*) as n_lines,
    count(*) filter (gone) as n_removed, count(*) filter (gone and not coalesce(gone_before, false)) as n_spans
  from marked group by doc_id)
select d.doc_id, case when d.text is not null then coalesce(f.text, '') end as text, coalesce(n_lines, 0) as n_lines,
  coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans
from documents d left join found f on f.doc_id = d.doc_id
"""


@query
def op3_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they lie in which sequence."""
    return differencing.pack(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False
    )


@query
def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return robust_outliers.verdicts(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op6_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three folds of four."""
    docs, model = read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    fold = segmentations.held_out()
    languages = segmentations.learned(docs.filter(~fold), model)
    rows = docs.select("doc_id", "text", fold.alias("held_out"))
    return segmentations.predict(rows, languages, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op9_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with an end id, and the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_agenda.code(read(spark, sf_dir, "documents").select("doc_id", "text"), model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of base spans, and all spans."""
    found = private_spans.spans(read(spark, sf_dir, "documents"))
    counts = [private_spans.counted(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(private_spans.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(private_spans.rendered(F.col("base")), 256).alias("base_sha256"),
        private_spans.rendered(F.col("spans")).alias("spans"),
    )


@query
def op10_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return rotated_codes.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op8_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of near copies."""
    return size_aware_join.components(read(spark, sf_dir, "documents"))


@query
def op5_suffix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes of repeated 200-byte strings."""
    found = suffix_windows.remove_repeated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_small_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links to others of its label and its component."""
    return small_worlds.components(read(spark, sf_dir, "embeddings"))


def _repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: the tail of every tenth document repeats with a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs: their number, the longest, and digests of all and of the collapsed text."""
    found = periodic_runs.find(read(spark, sf_dir, "documents"), change=_repeated_tail)
    one = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    first = found.withColumn("one", one)
    start, length, period = -F.col("one.col2"), F.col("one.length"), -F.col("one.col3")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return first.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root."""
    counts = spelling_variants.word_counts(read(spark, sf_dir, "documents"), deleted=spelling_variants.DELETED)
    return spelling_variants.variants(counts)
