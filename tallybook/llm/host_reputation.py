"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix. Each level shrinks its counts through a beta-binomial prior whose mean is
the posterior mean one level up, from all pages to the suffix, from there to the
domain and the host. A level's prior strength comes from the moments of its own
units: how much further than by chance their counts lie from the level above. A
host is blocked when the lower bound of its posterior bad rate is above the
tolerated rate. Fixed rules go before: of the rules that fit, the longest
decides.

Everything is DataFrame aggregation; a hot host is one row per task after partial
aggregation, and pages are joined to hosts by equality, which adaptive execution
broadcasts or splits by size.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
which no rule fits and which is judged like any other host; labels that name no
page, or have no outcome, count nowhere; a page labelled several times counts
once, as bad if any label is; an unlabelled host has its domain's posterior, else
its suffix's, else that of all pages; rows that share a page id, or have none, are
judged each, and as outcomes they count once; repeated pages are judged row by row and count once as outcomes; with no labels
at all, everything that no rule blocks is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rate of bad pages that a host may have, and standard deviations that the lower bound lies below the mean.
TOLERATED, DEVIATIONS = 0.25, 1.6448536269514722
#: Least and greatest correlation of outcomes within a unit that moments may say.
LEAST_RHO, GREATEST_RHO = 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
#: Suffixes: a country below one of these second levels, or else the last label. No public list is
#: at hand, so hosts under other second levels, and sites under a shared domain, count as one domain.
SUFFIX = r"(?:^|\.)((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*))$"
LEVELS = ["suffix", "domain", "host"]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host`` and ``path`` of URLs, and the host's registered ``domain`` and ``suffix``."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER)
    bare = F.regexp_replace(F.col("host"), r"^.*@|:[0-9]*$", "")
    number = F.col("_bare").rlike(r"^[0-9.]+$")
    suffix = F.when(number, F.col("_bare")).otherwise(F.regexp_extract("_bare", SUFFIX, 1))
    above = F.expr("substring(_bare, 1, greatest(0, length(_bare) - length(suffix) - 1))")
    label = F.regexp_extract(above, r"([^.]*)$", 1)
    domain = F.when(number | (F.length("_bare") <= F.length("suffix")), F.col("_bare")).otherwise(
        F.concat(label, F.lit("."), F.col("suffix"))
    )
    return (
        pages.withColumn("path", F.regexp_extract(text, PARTS, 2)).withColumn("host", host)
        .withColumn("_bare", bare).withColumn("suffix", suffix).withColumn("domain", domain).drop("_bare")
    )


def longest_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, both null if none fits; of equally
    long ones a blocking rule goes first. Rules are (action, ``host/path``)."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        host, slash, path = rule.partition("/")
        whole = F.concat(F.lit("."), F.col("host"))
        fits.append((whole.endswith("." + host) & F.col("path").startswith(slash + path), rule, action))
    nothing = F.lit(None).cast("string")

    def first(k: int) -> Column:
        return reduce(lambda rest, fit: F.when(fit[0], F.lit(fit[k])).otherwise(rest), reversed(fits), nothing)

    return first(1), first(2)


def outcomes(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", label_id: str = "doc_id") -> DataFrame:
    """Labelled pages with ``bad`` 0 or 1: low quality or toxic."""
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    labelled = labels.groupBy(F.col(label_id).alias("_label")).agg(F.max(bad).alias("bad")).dropna()
    once = pages.groupBy(page_id).agg(*[F.min(c).alias(c) for c in LEVELS])
    return once.join(labelled, F.col(page_id) == F.col("_label")).select(*LEVELS, F.col("bad").cast("long").alias("bad"))


def posteriors(labelled: DataFrame) -> tuple[float | None, list[tuple[list[str], DataFrame, float]]]:
    """The mean of all pages, None without any, and for each level its keys, its units'
    posteriors (``alpha``, ``beta`` and ``mean``) and its prior's strength in pages."""
    hosts = labelled.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    mean = ((total["b"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    out, above = [], None
    for depth in range(len(LEVELS)):
        keys = LEVELS[: depth + 1]
        units = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        if above is None:
            units = units.withColumn("p", F.lit(mean))
        else:
            units = units.join(above.select(*LEVELS[:depth], F.col("mean").alias("p")), LEVELS[:depth])
        strength = _strength(units)
        alpha, beta = strength * F.col("p") + F.col("b"), strength * (1 - F.col("p")) + F.col("n") - F.col("b")
        above = units.select(*keys, alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean"))
        out.append((keys, above, strength))
    return (mean if total["n"] else None), out


def _strength(units: DataFrame) -> float:
    """Prior pages of a level, by the moments of its units about the level above."""
    n, b, p = F.col("n"), F.col("b"), F.col("p")
    chance = n * p * (1 - p)
    found = units.agg(
        F.sum((b - n * p) * (b - n * p) - chance).alias("extra"), F.sum((n - 1) * chance).alias("most")
    ).first()
    rho = (found["extra"] or 0.0) / found["most"] if found["most"] else 0.0
    return 1 / min(GREATEST_RHO, max(LEAST_RHO, rho)) - 1


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", page_id: str = "page_id",
    tolerated: float = TOLERATED, deviations: float = DEVIATIONS,
) -> DataFrame:
    """Pages (their id and URL) with ``host``, ``path``, the ``rule`` that decided if
    any, the posterior ``bound`` of their host, and the ``verdict``."""
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = with_parts(named)
    found = rows.select(*LEVELS).distinct()
    overall, levels = posteriors(outcomes(rows, labels))
    for keys, units, _ in levels:
        found = found.join(units.select(*keys, *[F.col(c).alias(f"{keys[-1]}_{c}") for c in ("alpha", "beta", "mean")]), keys, "left")
    # A host without outcomes keeps its prior: the nearest level's mean, that of all pages at last,
    # with the host level's strength.
    strength, prior = levels[-1][2], F.coalesce("domain_mean", "suffix_mean", F.lit(overall).cast("double"))
    alpha = F.coalesce("host_alpha", strength * prior)
    beta = F.coalesce("host_beta", strength * (1 - prior))
    size = alpha + beta
    bound = alpha / size - deviations * F.sqrt(alpha * beta / (size * size * (size + 1)))
    found = found.select(F.col("host").alias("_host"), bound.alias("bound"))
    rule, action = longest_rule(rules)
    by_method = F.when(F.col("bound") > tolerated, "block").otherwise("allow")
    return rows.join(found, F.col("host") == F.col("_host"), "left").select(
        "page_id", "url", "host", "path", rule.alias("rule"), "bound", F.coalesce(action, by_method).alias("verdict")
    )
