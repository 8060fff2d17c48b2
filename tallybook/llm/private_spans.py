"""Personal data by candidate gradient boosting.

Base patterns find e-mail and IP addresses, card and phone numbers, each kind
leftmost and without overlaps; matches that fail their check are dropped. They
miss what greedy patterns run together, such as a phone number followed by a card
number. So high-recall generators propose further spans, which may overlap each
other and the base ones. Boosted trees score a proposal by its format and by what
stands around it; they learn, over all proposals of the corpus, which ones are
true. Those that are a whole base match are labelled by its check. Those that are a
part of one (loose) can't be base spans, true or not, so the check of their own
digits counts: of wrong digits a known share passes by chance, so those that fail
tell how many of those that pass are false. Mail addresses with a bracketed "at"
and phone numbers without a plus can't be base spans at all: they are loose, with
checks of their format, and base spans written that way are further true rows.
The threshold of a group of generators is the lowest one above which their proposals
of held out documents reach a given precision; proposals above it are added, unless
a base span or a longer added one of their kind holds them already.

Proposals fall into cells of equal features, of which there are at most
``CELLS``. Only these cells' counts reach the driver, where the trees are grown;
the trees themselves are one SQL expression. Patterns, positions, features and
scores are SQL functions on each row, and nothing is shuffled but the cells.

Positions count code points, ends are exclusive. Patterns are written so that
runs are taken whole: linear on any text, with no recursion.

Defined cases: null texts are empty and have no spans; repeated rows are judged
alike; with no proposals nothing is added; texts of any length are read whole;
columns besides those named are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: Runs of local-part characters are taken whole, from their beginning or where the last match ended.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    EMAIL: _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of proposals: kind and pattern.
GENERATORS = [
    (EMAIL, _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    (EMAIL, _LOCAL + r" ?[(\[] ?(?i:at) ?[)\]] ?[A-Za-z0-9-]++(?:(?:\.| \. | ?[(\[] ?(?i:dot) ?[)\]] ?)[A-Za-z0-9-]++)++"),
    (IP, r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
    (PHONE, r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{3,4}){2}(?![0-9])"),
    (PHONE, r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
#: Generators that share a threshold.
GROUPS = [[0], [1], [2], [3, 4], [5], [6]]
#: Generators whose true rows are base spans of another generator, written their way: that one,
#: and their check, digits class (none: the same) and form classes.
REWRITTEN = {1: (0, 1, None, (0, 1)), 6: (5, 1, 2, (0, 1))}
OCTET = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0++)"
#: Upper ends of the classes of digit counts.
DIGITS = [8, 9, 10, 12, 15]
#: Of each generator with loose proposals, how many wrong ones pass the check for each that fails:
#: one of ten last digits passes Luhn, nine of ten first digits can begin a country code, and of wrong
#: ones without "@" or a plus as many are taken to pass as fail.
CHANCE = {1: 1.0, 3: 1 / 9, 4: 1 / 9, 5: 9.0, 6: 1.0}
#: Classes of each feature: generator, check (of loose proposals, by ``_checked``), digits, left, right, form.
CLASSES = [len(GENERATORS), 2, len(DIGITS) + 1, 3, 3, 2]
CELLS = math.prod(CLASSES)
#: Trees, their depth, how far each goes, and the weight that holds small leaves back.
TREES, DEPTH, RATE, HOLD = 12, 3, 0.5, 1.0
#: Matches gathered at a time.
STRIDE = 128
#: Precision that added proposals of held-out documents must reach.
PRECISION = 0.95


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches: (start, end, m, left, right, part), left and right being the
    characters beside, part whether digits go on behind one space or dash (or dot,
    but no country code, for phones) on either side. A cheap guard spares texts
    without any."""
    if kind != EMAIL:
        guard = text.rlike("[0-9][0-9. ()-]+[0-9]")
    else:
        guard = text.contains("@") if "@" in pattern else text.rlike(r"(?i)[(\[] ?at ?[)\]]")
    marks = " .-" if kind == PHONE else " -"
    none = F.array().cast("array<struct<start:int,end:int,m:string,left:string,right:string,part:boolean>>")

    def walked(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gaps[i])
            end = start + F.length(found[i])
            # A lone mark between two matches joins them.
            before = F.right(gaps[i], F.lit(2)).rlike(f"^[0-9][{marks}]") | ((i > 0) & gaps[i].isin(*marks))
            behind = F.left(gaps[i + 1], F.lit(2)).rlike(f"^[{marks}][0-9]") | ((i + 1 < F.size(found)) & gaps[i + 1].isin(*marks))
            if kind == PHONE:
                before = before & ~F.right(gaps[i], F.lit(5)).rlike(rf"\+[0-9]{{1,3}}[{marks}]$")
            one = F.struct(
                start.alias("start"), end.alias("end"), found[i].alias("m"), F.right(gaps[i], F.lit(1)).alias("left"),
                F.left(gaps[i + 1], F.lit(1)).alias("right"), (before | behind).alias("part"),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def stride(acc: Column, k: Column) -> Column:
            # Appending copies an array, so matches are gathered by the stride.
            some = F.sequence(k * STRIDE, F.least((k + 1) * STRIDE, F.size(found)) - 1)
            part = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.transform(F.array(part), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))[0]

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        strides = F.sequence(F.lit(0), ((F.size(found) - 1) / STRIDE).cast("int"))
        return F.when(F.size(found) > 0, F.aggregate(strides, start, stride, lambda acc: acc["out"])).otherwise(none)

    # An array of one binds both parts for the walk, which else would search the text again at each step.
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(guard, F.transform(F.array(both), walked)[0]).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _checked(g: int, m: Column, digits: Column) -> Column:
    """The check of a generator's loose proposals."""
    if g == 1:
        return m["m"].rlike(r"[^A-Za-z0-9-][A-Za-z]{2,}$")  # ends in a label of letters
    if g in (3, 4):
        return _luhn(digits)
    if g == 5:
        return ~digits.startswith("0")
    if g == 6:  # brackets, or the same mark twice and no more digits around
        return m["m"].contains("(") | (~m["part"] & m["m"].rlike(r"^[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$"))
    return F.lit(False)


def _passes(kind: int, m: Column) -> Column:
    """The check of a kind's base matches."""
    if kind == IP:
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == CARD:
        return _luhn(_digits(m))
    if kind == PHONE:
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _span(kind: int, m: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """(kind, start, end) of base matches, by kind and start."""

    def of(kind: int, pattern: str) -> Column:
        passing = F.filter(_matches(text, pattern, kind), lambda m: _passes(kind, m["m"]))
        return F.transform(passing, lambda m: _span(kind, m))

    return F.concat(*[of(kind, pattern) for kind, pattern in BASE.items()])


def _beside(c: Column) -> Column:
    """0 for white space or an end, 1 for a letter or digit, 2 for a mark."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 1).otherwise(2)


def proposals(text: Column) -> Column:
    """(kind, start, end, features, loose) of all generators' matches; what is loose
    is not a whole base match. Plain base matches of phones begin at the same plus, so
    proposals that are no base spans are all loose."""

    def one(g: int, kind: int, m: Column) -> Column:
        digits = _digits(m["m"])
        number = F.length(digits)
        size = F.lit(len(DIGITS))
        for k, most in reversed(list(enumerate(DIGITS))):
            size = F.when(number <= most, k).otherwise(size)
        form = _passes(IP, m["m"]) if kind == IP else m["m"].rlike(r"\.[A-Za-z]{2,}$") if kind == EMAIL else m["m"].contains("(")
        features = F.array(
            F.lit(g), _checked(g, m, digits).cast("int"), size, _beside(m["left"]), _beside(m["right"]), form.cast("int")
        )
        loose = m["part"] if kind == CARD else F.lit(g in CHANCE)
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), features.alias("features"), loose.alias("loose")
        )

    def of(g: int, kind: int, pattern: str) -> Column:
        return F.transform(_matches(text, pattern, kind), lambda m: one(g, kind, m))

    return F.concat(*[of(g, kind, pattern) for g, (kind, pattern) in enumerate(GENERATORS)])


@dataclass
class Node:
    """A split (feature at most a class) or, without a feature, a leaf."""

    value: float = 0.0
    feature: int | None = None
    most: int = 0
    low: Node | None = None
    high: Node | None = None

    def score(self, x: list[int]) -> float:
        if self.feature is None:
            return self.value
        return (self.low if x[self.feature] <= self.most else self.high).score(x)

    def column(self, x: Column) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(x[self.feature] <= self.most, self.low.column(x)).otherwise(self.high.column(x))


@dataclass
class Boosted:
    """Boosted trees, and for each generator the least score that adds a proposal (none if missing)."""

    prior: float = 0.0
    trees: list[Node] = field(default_factory=list)
    least: dict[int, float] = field(default_factory=dict)

    def score(self, x: list[int]) -> float:
        return self.prior + sum(t.score(x) for t in self.trees)

    def accepts(self, x: Column) -> Column:
        score = sum((t.column(x) for t in self.trees), F.lit(self.prior))
        least = F.lit(None).cast("double")
        for g, value in self.least.items():
            least = F.when(x[0] == g, F.lit(value)).otherwise(least)
        return F.coalesce(score >= least, F.lit(False))


def _grown(cells: list[tuple[list[int], float, float]], depth: int) -> Node:
    """A tree over (features, gradient, curvature) cells by greatest gain."""

    def worth(rows: list) -> float:
        return sum(g for _, g, _ in rows) ** 2 / (sum(h for *_, h in rows) + HOLD)

    best = (1e-9, None, 0)
    if depth:
        for f, classes in enumerate(CLASSES):
            for most in range(classes - 1):
                low, high = [c for c in cells if c[0][f] <= most], [c for c in cells if c[0][f] > most]
                if low and high and (gain := worth(low) + worth(high) - worth(cells)) > best[0]:
                    best = (gain, f, most)
    if best[1] is None:
        return Node(RATE * sum(g for _, g, _ in cells) / (sum(h for *_, h in cells) + HOLD))
    _, f, most = best
    return Node(
        0.0, f, most, _grown([c for c in cells if c[0][f] <= most], depth - 1), _grown([c for c in cells if c[0][f] > most], depth - 1)
    )


def weighed(cells: list[tuple[list[int], bool, int, int, int]]) -> list[tuple[list[int], bool, float, float]]:
    """(features, held out, true, false) from (features, held out, base, loose and other
    proposals). Loose ones that fail their check are false, and so are as many of those
    that pass it in the same surroundings as chance lets pass. Of rows written in another
    way any number counts in training; held out, where they would hide what the
    proposals themselves show, a cell has at most one."""
    failed = {(tuple(x), held): loose for x, held, _, loose, _ in cells if not x[1]}
    out = []
    for x, held, yes, loose, no in cells:
        wrong = min(loose, CHANCE.get(x[0], 0) * failed.get(((x[0], 0, *x[2:]), held), 0)) if x[1] else loose
        out.append((x, held, yes + loose - wrong, no + wrong))
    again: dict[tuple, int] = {}
    for x, held, yes, _, _ in cells:
        for g, (of, check, digits, forms) in REWRITTEN.items():
            if x[0] == of and yes:
                for form in forms:
                    key = (g, check, x[2] if digits is None else digits, *x[3:5], form), held
                    again[key] = again.get(key, 0) + yes
    return out + [(list(x), held, float(min(n, 1) if held else n), 0.0) for (x, held), n in sorted(again.items())]


def boosted(cells: list[tuple[list[int], bool, float, float]]) -> Boosted:
    """Trees and thresholds from (features, held out, true proposals, false proposals)."""
    train = [(x, yes, no) for x, held, yes, no in cells if not held]
    yes, no = sum(c[1] for c in train), sum(c[2] for c in train)
    model = Boosted(math.log((yes + 1) / (no + 1)))
    scores = [model.prior] * len(train)
    for _ in range(TREES if train else 0):
        chances = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _grown(
            [(x, y - (y + n) * p, (y + n) * p * (1 - p)) for (x, y, n), p in zip(train, chances, strict=True)], DEPTH
        )
        model.trees.append(tree)
        scores = [s + tree.score(x) for s, (x, _, _) in zip(scores, train, strict=True)]
    for group in GROUPS:
        by_score: dict[float, list[float]] = {}
        for x, held, y, n in cells:
            if held and x[0] in group:
                both = by_score.setdefault(round(model.score(x), 9), [0, 0])
                both[0] += y
                both[1] += n
        y = n = 0
        for score in sorted(by_score, reverse=True):
            y, n = y + by_score[score][0], n + by_score[score][1]
            if y >= PRECISION * (y + n) and by_score[score][0] > by_score[score][1]:
                model.least.update((g, score - 1e-9) for g in group)
    return model


def learned(found: DataFrame) -> Boosted:
    """The model for rows with ``base``, ``proposed`` and ``held_out``."""
    labelled = found.select(
        "held_out", "base", F.explode("proposed").alias("p")
    ).select(
        "held_out", F.col("p.features").alias("features"), F.col("p.loose").alias("loose"),
        F.exists("base", lambda b: (b["kind"] == F.col("p.kind")) & (b["start"] == F.col("p.start")) & (b["end"] == F.col("p.end"))).alias("yes"),
    )
    counts = labelled.groupBy("features", "held_out").agg(
        F.sum(F.col("yes").cast("long")).alias("yes"), F.sum((~F.col("yes") & F.col("loose")).cast("long")).alias("loose"),
        F.count(F.lit(1)).alias("all"),
    )
    rows = counts.collect()  # at most 2 * CELLS
    return boosted(weighed(sorted((list(r.features), r.held_out, r.yes, r.loose, r.all - r.yes - r.loose) for r in rows)))


def _found(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(f"{prefix}base", base_spans(whole)).withColumn(f"{prefix}proposed", proposals(whole))


def _all_spans(base: Column, proposed: Column, model: Boosted) -> Column:
    """Base spans and accepted proposals, by kind and start."""

    def news(p: Column) -> Column:
        held = F.exists(base, lambda b: (b["kind"] == p["kind"]) & (b["start"] <= p["start"]) & (b["end"] >= p["end"]))
        return model.accepts(p["features"]) & ~held

    def longest(some: Column) -> Column:
        # A number without its country code ends where the one with it does, which comes first.
        def inner(p: Column, i: Column) -> Column:
            ahead = F.get(some, i - 1)
            return F.coalesce((ahead["kind"] == p["kind"]) & (ahead["end"] == p["end"]) & (ahead["start"] < p["start"]), F.lit(False))

        return F.filter(some, lambda p, i: ~inner(p, i))

    by_end = F.array_sort(F.transform(F.filter(proposed, news), lambda p: F.struct(p["kind"].alias("kind"), p["end"].alias("end"), p["start"].alias("start"))))
    # An array of one binds the proposals, which else would be judged again for each.
    added = F.transform(F.transform(F.array(by_end), longest)[0], lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return F.array_sort(F.array_distinct(F.concat(base, added)))


def held_out(text: Column) -> Column:
    """The documents whose proposals set the thresholds."""
    return F.xxhash64(text) % 4 == 0


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``base`` and all ``spans``, as (kind, start, end)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(whole).alias("held_out"))
    found = stored(_found(named, "text").drop("text"), "spans")
    return found.select("doc_id", "base", _all_spans(F.col("base"), F.col("proposed"), learned(found)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by its first kind's name in brackets.

    Texts are searched twice, once to learn and once to redact, rather than moved.
    """
    own = "_" * (1 + max(map(len, docs.columns)))  # in front of a name, it makes one that docs can't have
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(text).alias("text"), held_out(whole).alias("held_out"))
    model = learned(stored(_found(named, "text").drop("text"), "spans"))
    found = _found(docs, text, own).withColumn(f"{own}spans", _all_spans(F.col(f"{own}base"), F.col(f"{own}proposed"), model))
    by_start = F.array_sort(F.transform(f"{own}spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        # Text up to the span goes out, then its name; a span that begins within the last one only widens it.
        apart = s["start"] >= acc["at"]
        between = F.substring(whole, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], F.array(between, names[s["kind"]]))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole)))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.when(F.size(f"{own}spans") == 0, F.col(text)).otherwise(F.aggregate(by_start, start, step, finish))
    return found.withColumn(text, clean).select(*docs.columns)


def rendered(spans_: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def counted(spans_: Column, kind: int) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
