"""Matching a whole history of sales to purchases, per holding.

Events run in (date, purchases before sales, id) order. A sale beyond what is
held at that moment is refused whole, and later sales see the holding without it.

Acceptance only depends on quantities, so it is settled first and for all
booking methods alike. Accepted sales are then matched:

* FIFO - cumulative purchases and cumulative sales are two partitions of the
  same axis; dispositions are their overlaps.
* LIFO - a holding is a stack over the axis of its running level. Chunks of
  events are matched on their own; what is left of them, at most one pop and one
  push interval each, is matched chunk by chunk, and the resulting level ranges
  are overlaps again.
* HIFO - a priority queue, scanned in order; large holdings are split by cost
  first, each sale into what it takes from either part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.running import BLOCK_BITS, maxima_before, sums_before
from tallybook.operators.lots import KEYS, known_method, priced_dispositions, with_wash_sales
from tallybook.schemas import BOOKING_METHODS, HOLDING_DAYS, QUANTITY
from tallybook.session import passing, stored, stored_parts

LEVEL = "decimal(38,8)"


# ---- acceptance -------------------------------------------------------------


def _closing_levels(lots: DataFrame, sales: DataFrame) -> DataFrame:
    """Per holding and day: what would be held if every sale went through, and
    the lowest such level of earlier days. One row per day."""
    bought = lots.select(*KEYS, F.col("acquired_date").alias("day"), F.col("original_quantity").cast(QUANTITY).alias("bought"), F.lit(0).cast(QUANTITY).alias("sold"))
    sold = sales.select(*KEYS, F.col("sell_date").alias("day"), F.lit(0).cast(QUANTITY).alias("bought"), F.col("quantity").cast(QUANTITY).alias("sold"))
    days = bought.unionByName(sold).groupBy(*KEYS, "day").agg(
        F.sum("bought").alias("bought"), F.sum("sold").alias("sold")
    )
    w = Window.partitionBy(*KEYS).orderBy("day")
    to_date = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    closing = days.withColumn("closing", (F.sum("bought").over(to_date) - F.sum("sold").over(to_date)).cast(LEVEL))
    lowest = F.least(F.coalesce(F.min("closing").over(earlier), F.lit(0).cast(LEVEL)), F.lit(0).cast(LEVEL))
    return closing.withColumn("lowest", lowest)


def _scan_refusals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Refused sale ids of one holding; the only state is the refused quantity."""
    refused = 0
    for batch in batches:
        out = []
        for sale_id, level, quantity in zip(batch["sale_id"], batch["level"], batch["quantity"]):
            if level + refused < 0:
                refused += quantity
                out.append(sale_id)
        yield pd.DataFrame({"sale_id": pd.Series(out, dtype="int64")})


def refused_sales(lots: DataFrame, sales: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(sale_id)`` of sales that exceed their holding at their time.

    Let L be the level after a sale if none were refused, and R the quantity
    refused so far. The holding is L + R and never negative, so R is at least
    -min(L) to date, and a sale can only be refused where L reaches a new low
    below zero. Only those sales are scanned in order, with R as the only state;
    all others never leave the relational plan.
    """
    # Read by a hot and a usual path; stored, a short list is not met by shuffling all sales.
    days = _closing_levels(lots, sales).filter(F.col("closing") < F.col("lowest")).select(
        *KEYS, "day", (F.col("closing") + F.col("sold")).alias("opening"), "lowest"
    )
    days = stored(days, "lows")
    suspects = sales.select(
        *KEYS, F.col("sell_date").alias("day"), F.col("id").alias("sale_id"), F.col("quantity").cast(QUANTITY).alias("quantity")
    ).join(days, [*KEYS, "day"])
    ordered = sums_before(
        suspects.withColumn("_major", F.shiftright("sale_id", 2 * block_bits)),
        [*KEYS, "day"], "_major", "sale_id", ["quantity"], block_bits,
    )
    level = (F.col("opening") - F.col("quantity_before") - F.col("quantity")).cast(LEVEL)
    lows = ordered.withColumn("level", level).filter(F.col("level") < F.col("lowest"))
    in_order = lows.select(*KEYS, "day", "sale_id", "level", "quantity").repartition(*KEYS).sortWithinPartitions(
        *KEYS, "day", "sale_id"
    )
    return in_order.groupBy(*KEYS).applyInPandas(_scan_refusals, "sale_id long")


# ---- overlaps ---------------------------------------------------------------


def overlaps(purchases: DataFrame, sales: DataFrame, segments: DataFrame) -> DataFrame:
    """Pieces of purchases and sales that cover the same stretch of an axis.

    ``purchases(keys, b_chunk, lo, hi, lot)``, ``sales(keys, s_chunk, lo, hi,
    sale)``, both disjoint within a chunk; ``segments(keys, b_chunk, s_chunk,
    seg_lo, seg_hi)`` are the stretches to cover. Result: keys, lot, sale,
    ``quantity``.

    Within a segment the upper ends of both sides are merged in descending
    order: each end closes a slice down to the next lower end, and the piece
    that covers it on either side is the last one seen. No pairs are formed, and
    a window holds one chunk of each side at most.
    """
    lo, hi = F.greatest("lo", "seg_lo"), F.least("hi", "seg_hi")

    def clipped(side: DataFrame, chunk: str, own: str, other: str, other_type) -> DataFrame:
        return side.join(segments, [*KEYS, chunk]).filter(
            (F.col("lo") < F.col("seg_hi")) & (F.col("hi") > F.col("seg_lo"))
        ).select(
            *KEYS, "b_chunk", "s_chunk", lo.alias("lo"), hi.alias("hi"), "seg_lo",
            F.col(own), F.lit(None).cast(other_type).alias(other),
        )

    rows = clipped(purchases, "b_chunk", "lot", "sale", sales.schema["sale"].dataType).unionByName(
        clipped(sales, "s_chunk", "sale", "lot", purchases.schema["lot"].dataType)
    )
    return _slices(rows, [*KEYS, "b_chunk", "s_chunk"])


def _slices(rows: DataFrame, segment: list[str]) -> DataFrame:
    """Pieces of either side, told by which of ``lot`` and ``sale`` is given, that cover the same stretch of a segment."""
    w = Window.partitionBy(*segment).orderBy(F.col("hi").desc())
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def covering(piece: str) -> Column:
        # The last piece seen covers the slice only if it reaches down to it.
        return F.last(F.when(F.col(piece).isNotNull(), F.struct(F.col(piece).alias("piece"), "lo")), True).over(seen)

    floor = F.coalesce(F.lead("hi").over(w), F.col("seg_lo"))
    slices = rows.select(
        *KEYS, "hi", floor.alias("floor"), covering("lot").alias("l"), covering("sale").alias("s")
    )
    return slices.filter(
        (F.col("hi") > F.col("floor")) & (F.col("l.lo") < F.col("hi")) & (F.col("s.lo") < F.col("hi"))
    ).select(*KEYS, (F.col("hi") - F.col("floor")).cast(QUANTITY).alias("quantity"), F.col("l.piece").alias("lot"), F.col("s.piece").alias("sale"))


_LOT = ["id", "acquired_date", "cost_price", "cost_currency"]
_SALE = ["id", "sell_transaction_id", "sell_date", "proceeds_per_unit", "proceeds_currency"]


def _matches(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        *KEYS, "quantity", F.col("lot.id").alias("lot_id"), F.col("sale.id").alias("sale_id"),
        *[f"lot.{c}" for c in _LOT[1:]], *[f"sale.{c}" for c in _SALE[1:]],
    )


def match_fifo(lots: DataFrame, sales: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Overlap of cumulative purchases and cumulative (accepted) sales.

    A holding of at most ``2**block_bits`` rows is one segment: both sums and the
    overlaps are taken where its rows have been brought together, so they move once.
    """
    one = F.lit(1).cast("long")

    def side(rows: DataFrame, day: str, quantity: str, piece: str, fields: list[str]) -> DataFrame:
        units = F.col(quantity).cast(QUANTITY).alias("units")
        return rows.select(*KEYS, "id", F.col(day).alias("day"), units, F.struct(*fields).alias(piece)).filter("units > 0")

    bought = side(lots, "acquired_date", "original_quantity", "lot", _LOT)
    sold = side(sales, "sell_date", "quantity", "sale", _SALE)
    sizes = bought.select(*KEYS).unionByName(sold.select(*KEYS)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.filter(F.col("n") > 1 << block_bits).select(*KEYS), "large")
    if large.isEmpty():
        return _matches(_one_segment(bought, sold))
    large = F.broadcast(large)

    def axis(rows: DataFrame, chunk: str, piece: str) -> DataFrame:
        summed = sums_before(rows.withColumn("one", one), KEYS, "day", "id", ["units", "one"], block_bits)
        return summed.select(
            *KEYS,
            F.shiftright(F.col("one_before"), block_bits).alias(chunk),
            F.col("units_before").cast(LEVEL).alias("lo"),
            (F.col("units_before") + F.col("units")).cast(LEVEL).alias("hi"),
            piece,
        )

    # Each axis is read twice, for the chunk ranges and for the overlaps.
    hot_bought = stored(axis(bought.join(large, KEYS, "left_semi"), "b_chunk", "lot"), "purchases")
    hot_sold = stored(axis(sold.join(large, KEYS, "left_semi"), "s_chunk", "sale"), "sales")

    def ranges(rows: DataFrame, chunk: str, side: str) -> DataFrame:
        return rows.groupBy(*KEYS, chunk).agg(F.min("lo").alias(f"{side}_lo"), F.max("hi").alias(f"{side}_hi"))

    # Chunk by chunk: at most one segment per chunk boundary of either side.
    segments = ranges(hot_bought, "b_chunk", "b").join(ranges(hot_sold, "s_chunk", "s"), KEYS).filter(
        "b_lo < s_hi and s_lo < b_hi"
    ).select(*KEYS, "b_chunk", "s_chunk", F.greatest("b_lo", "s_lo").alias("seg_lo"), F.least("b_hi", "s_hi").alias("seg_hi"))
    small = _one_segment(bought.join(large, KEYS, "left_anti"), sold.join(large, KEYS, "left_anti"))
    return _matches(small.unionByName(overlaps(hot_bought, hot_sold, segments)))


def _one_segment(bought: DataFrame, sold: DataFrame) -> DataFrame:
    """Overlaps of holdings that fit one window, both axes from zero."""
    rows = bought.unionByName(sold, allowMissingColumns=True)
    is_lot = F.col("lot").isNotNull()
    w = Window.partitionBy(*KEYS).orderBy("day", "id")
    to_date = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(0).cast(QUANTITY)
    ends = rows.select(
        *KEYS, "lot", "sale", "units",
        F.when(is_lot, F.sum(F.when(is_lot, F.col("units")).otherwise(none)).over(to_date))
        .otherwise(F.sum(F.when(is_lot, none).otherwise(F.col("units"))).over(to_date)).cast(LEVEL).alias("hi"),
    ).withColumn("lo", (F.col("hi") - F.col("units")).cast(LEVEL))
    return _slices(ends.withColumn("seg_lo", F.lit(0).cast(LEVEL)), KEYS)


# ---- LIFO -------------------------------------------------------------------

_PIECES = "account_id long, commodity string, chunk long, kind string, lot_id long, sale_id long, lo decimal(38,8), hi decimal(38,8)"


def _stack_chunk(events: pd.DataFrame) -> pd.DataFrame:
    """Match one chunk of a holding's events on a stack.

    Yields matched pieces, sales left to earlier chunks (pop) and lots left to
    later ones (push), each with its range of levels.
    """
    events = events.sort_values(["major", "id"])
    stack: list[list] = []
    out = []
    for side, event_id, level, quantity in zip(events["side"], events["id"], events["level"], events["quantity"]):
        if side == 0:
            stack.append([event_id, level, level + quantity])
            continue
        floor, top = level - quantity, level
        while stack and top > floor:
            lot = stack[-1]
            cut = max(floor, lot[1])
            out.append(("match", lot[0], event_id, cut, top))
            top = cut
            if cut == lot[1]:
                stack.pop()
            else:
                lot[2] = cut
        if top > floor:
            out.append(("pop", None, event_id, floor, top))
    out.extend(("push", lot_id, None, lo, hi) for lot_id, lo, hi in stack)
    pieces = pd.DataFrame(out, columns=["kind", "lot_id", "sale_id", "lo", "hi"])
    for name in ("lot_id", "sale_id"):
        pieces[name] = pieces[name].astype("Int64")
    pieces.insert(0, "chunk", events["chunk"].iloc[0])
    pieces.insert(0, "commodity", events["commodity"].iloc[0])
    pieces.insert(0, "account_id", events["account_id"].iloc[0])
    return pieces


_SEGMENTS = "account_id long, commodity string, b_chunk long, s_chunk long, seg_lo decimal(38,8), seg_hi decimal(38,8)"


def _stack_chunks(chunks: pd.DataFrame) -> pd.DataFrame:
    """The same over whole chunks: one pop and one push range each."""
    chunks = chunks.sort_values("chunk")
    stack: list[list] = []
    out = []
    for chunk, pop_lo, pop_hi, push_lo, push_hi in zip(
        chunks["chunk"], chunks["pop_lo"], chunks["pop_hi"], chunks["push_lo"], chunks["push_hi"]
    ):
        if pop_lo is not None:
            top = pop_hi
            while top > pop_lo and stack:
                below = stack[-1]
                cut = max(pop_lo, below[1])
                out.append((below[0], chunk, cut, top))
                top = cut
                if cut == below[1]:
                    stack.pop()
                else:
                    below[2] = cut
        if push_lo is not None:
            stack.append([chunk, push_lo, push_hi])
    segments = pd.DataFrame(out, columns=["b_chunk", "s_chunk", "seg_lo", "seg_hi"])
    segments.insert(0, "commodity", chunks["commodity"].iloc[0])
    segments.insert(0, "account_id", chunks["account_id"].iloc[0])
    return segments


def _events(lots: DataFrame, sales: DataFrame) -> DataFrame:
    """Purchases (side 0) and sales (side 1) of a holding in one order: (major, id)."""
    bought = lots.select(
        *KEYS, F.lit(0).alias("side"), (F.unix_date("acquired_date") * 2).alias("major"), "id",
        F.col("original_quantity").cast(QUANTITY).alias("quantity"),
    )
    sold = sales.select(
        *KEYS, F.lit(1).alias("side"), (F.unix_date("sell_date") * 2 + 1).alias("major"), "id",
        F.col("quantity").cast(QUANTITY).alias("quantity"),
    )
    return bought.unionByName(sold)


def match_lifo(lots: DataFrame, sales: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Stack matching of (accepted) sales, chunk-parallel within a holding."""
    signed = _events(lots, sales).select(
        "*", F.when(F.col("side") == 0, F.col("quantity")).otherwise(-F.col("quantity")).cast(QUANTITY).alias("step"),
        F.lit(1).cast("long").alias("one"),
    )
    levels = sums_before(signed, KEYS, "major", "id", ["step", "one"], block_bits).select(
        *KEYS, F.shiftright(F.col("one_before"), block_bits).alias("chunk"), "side", "major", "id",
        F.col("step_before").cast(LEVEL).alias("level"), F.col("quantity").cast(LEVEL).alias("quantity"),
    )
    # Matched once, read four times below.
    pieces = stored(levels.groupBy(*KEYS, "chunk").applyInPandas(_stack_chunk, _PIECES), "pieces")
    lot_piece, sale_piece = F.struct(F.col("lot_id").alias("id")), F.struct(F.col("sale_id").alias("id"))

    inside = pieces.filter("kind = 'match'").select(
        *KEYS, (F.col("hi") - F.col("lo")).cast(QUANTITY).alias("quantity"), "lot_id", "sale_id"
    )
    pushes = pieces.filter("kind = 'push'").select(*KEYS, F.col("chunk").alias("b_chunk"), "lo", "hi", lot_piece.alias("lot"))
    pops = pieces.filter("kind = 'pop'").select(*KEYS, F.col("chunk").alias("s_chunk"), "lo", "hi", sale_piece.alias("sale"))

    def bound(kind: str, fn, value: str) -> Column:
        return fn(F.when(F.col("kind") == kind, F.col(value)))

    left = pieces.filter("kind <> 'match'").groupBy(*KEYS, "chunk").agg(
        bound("pop", F.min, "lo").alias("pop_lo"), bound("pop", F.max, "hi").alias("pop_hi"),
        bound("push", F.min, "lo").alias("push_lo"), bound("push", F.max, "hi").alias("push_hi"),
    )
    segments = left.groupBy(*KEYS).applyInPandas(_stack_chunks, _SEGMENTS)
    across = overlaps(pushes, pops, segments).select(
        *KEYS, "quantity", F.col("lot.id").alias("lot_id"), F.col("sale.id").alias("sale_id")
    )
    return _with_attributes(inside.unionByName(across), lots, sales)


def _with_attributes(pairs: DataFrame, lots: DataFrame, sales: DataFrame) -> DataFrame:
    lot = lots.select(F.col("id").alias("lot_id"), *_LOT[1:])
    sale = sales.select(F.col("id").alias("sale_id"), *_SALE[1:])
    return pairs.join(lot, "lot_id").join(sale, "sale_id").select(
        *KEYS, "quantity", "lot_id", "sale_id", *_LOT[1:], *_SALE[1:]
    )


# ---- HIFO -------------------------------------------------------------------


def _scan_hifo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dispositions of one holding, highest cost first; state: its open lots."""
    queue: list[list] = []
    for batch in batches:
        out = []
        for side, event_id, cost, quantity in zip(batch["side"], batch["id"], batch["cost_price"], batch["quantity"]):
            if side == 0:
                heapq.heappush(queue, [-cost, event_id, quantity])
                continue
            while quantity > 0 and queue:
                lot = queue[0]
                used = min(lot[2], quantity)
                out.append((lot[1], event_id, used))
                quantity -= used
                lot[2] -= used
                if lot[2] == 0:
                    heapq.heappop(queue)
        yield pd.DataFrame(out, columns=["lot_id", "sale_id", "quantity"])


NODE = [*KEYS, "node"]


def _pivots(work: DataFrame, limit: int) -> DataFrame:
    """Nodes with too many rows and the value that halves their lots: by cost, or
    by id where all cost the same. At most one node per ``limit`` rows."""
    lot = F.col("side") == 0
    cost, id_ = F.when(lot, F.col("cost_price")), F.when(lot, F.col("id"))
    sizes = work.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.count(id_).alias("lots"),
        F.min(cost).alias("lo"), F.max(cost).alias("hi"), F.percentile_approx(cost, 0.5).alias("mid"),
        F.min(id_).alias("id_lo"), F.max(id_).alias("id_hi"), F.percentile_approx(id_, 0.5).alias("id_mid"),
    ).filter((F.col("n") > limit) & (F.col("lots") > 1))
    return sizes.select(
        *NODE, "lo", "hi", F.least(F.greatest("mid", "lo"), "hi").alias("mid"),
        "id_hi", F.least(F.greatest("id_mid", "id_lo"), "id_hi").alias("id_mid"),
    )


def _split_nodes(work: DataFrame, pivots: DataFrame, block_bits: int) -> DataFrame:
    """Split each pivot's node into the lots sold first and the others, and every
    sale into what it takes from either.

    Sales take from the first half while it lasts. Let X be its purchases less
    all sales so far; what it could not deliver so far is the largest -X to
    date, or 0, and a sale passes on by how much that grows.
    """
    marked = work.join(F.broadcast(pivots), NODE, "left")
    columns = work.columns
    same = F.col("lo") == F.col("hi")
    by_cost = F.when(F.col("mid") < F.col("hi"), F.col("cost_price") > F.col("mid")).otherwise(F.col("cost_price") == F.col("hi"))
    by_id = F.when(F.col("id_mid") < F.col("id_hi"), F.col("id") <= F.col("id_mid")).otherwise(F.col("id") < F.col("id_hi"))
    hot = marked.filter(F.col("hi").isNotNull()).withColumn("first", F.when(same, by_id).otherwise(by_cost))
    lots = hot.filter("side = 0").withColumn("node", F.col("node") * 2 + F.when(F.col("first"), 0).otherwise(1))

    step = F.when(F.col("side") == 0, F.col("quantity")).otherwise(-F.col("quantity")).cast(QUANTITY)
    events = hot.filter("side = 1 or first").select(*columns, step.alias("step"))
    levels = sums_before(events, NODE, "major", "id", ["step"], block_bits)
    short = levels.withColumn("short", (-(F.col("step_before") + F.col("step"))).cast(LEVEL)).drop("step_before", "step")
    seen = maxima_before(short, NODE, "major", "id", ["short"], block_bits)
    zero = F.lit(0).cast(LEVEL)
    before = F.greatest(zero, F.col("short_before"))
    passed = (F.greatest(before, F.col("short")) - before).cast(QUANTITY)
    parts = F.array(
        F.struct((F.col("node") * 2).alias("node"), (F.col("quantity") - F.col("passed")).cast(QUANTITY).alias("quantity")),
        F.struct((F.col("node") * 2 + 1).alias("node"), F.col("passed").alias("quantity")),
    )
    rest = [c for c in columns if c not in ("node", "quantity")]
    sales = seen.filter("side = 1").withColumn("passed", passed).select(*rest, F.explode(parts).alias("p")).select(
        *rest, "p.node", "p.quantity"
    ).filter("quantity > 0")
    untouched = marked.filter(F.col("hi").isNull())
    return untouched.select(*columns).unionByName(lots.select(*columns)).unionByName(sales.select(*columns))


def match_hifo(lots: DataFrame, sales: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Priority-queue matching of (accepted) sales.

    Holdings of at most ``2**block_bits`` rows are scanned in event order, one
    task each. Larger ones are first split by cost, again and again, until their
    parts are that small; a part left with a single lot needs no scan.
    """
    costs = lots.select(F.col("id"), F.lit(0).alias("side"), "cost_price")
    limit = 1 << block_bits
    work = stored(
        _events(lots, sales).join(costs, ["id", "side"], "left").withColumn("node", F.lit(1).cast("long")), "events"
    )
    split = False
    while True:
        pivots = stored(_pivots(work, limit), "pivots")
        if pivots.isEmpty():
            break
        work, split = stored(_split_nodes(work, pivots, block_bits), "events"), True

    def scan(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _scan_hifo(batches):
            out.insert(0, "commodity", key[1])
            out.insert(0, "account_id", key[0])
            yield out

    small, single = work, None
    if split:
        sizes = work.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
        large = F.broadcast(sizes.filter(F.col("n") > limit).select(*NODE))
        small = work.join(large, NODE, "left_anti")
        rest = work.join(large, NODE, "left_semi")
        sold = rest.filter("side = 1").select(*NODE, F.col("id").alias("sale_id"), "quantity")
        single = rest.filter("side = 0").select(*NODE, F.col("id").alias("lot_id")).join(sold, NODE)
    ordered = small.repartition(*NODE).sortWithinPartitions(*NODE, "major", "id")
    pairs = ordered.groupBy(*NODE).applyInPandas(
        scan, "account_id long, commodity string, lot_id long, sale_id long, quantity decimal(18,8)"
    )
    if single is not None:
        pairs = pairs.unionByName(single.select(*pairs.columns))
    return _with_attributes(pairs, lots, sales)


# ---- the whole job ----------------------------------------------------------


def matched_by_method(lots: DataFrame, sales: DataFrame, accounts: DataFrame, block_bits: int = BLOCK_BITS) -> Iterator[DataFrame]:
    """Matches of accepted sales, each holding by its account's booking method: a frame for each method."""
    methods = accounts.select(F.col("id").alias("account_id"), "booking_method")
    sales = sales.join(methods, "account_id")
    sold = stored(sales.select(*KEYS, "booking_method").distinct(), "holdings")
    lots = lots.join(sold, KEYS)

    def of(rows: DataFrame, method: str) -> DataFrame:
        return rows.filter(F.col("booking_method") == method).drop("booking_method")

    match = {
        "FIFO": lambda held, sold: match_fifo(held, sold, block_bits),
        "LIFO": lambda held, sold: match_lifo(held, sold, block_bits),
        "HIFO": lambda held, sold: match_hifo(held, sold, block_bits),
    }
    known = sold.filter(known_method()).select("booking_method").distinct().collect()  # three at most
    used = {row[0] for row in known} or {"HIFO"}
    for method in BOOKING_METHODS:
        if method in used:
            yield match[method](of(lots, method), of(sales, method))


def match_history(lots: DataFrame, sales: DataFrame, accounts: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The same as one frame."""
    return reduce(DataFrame.unionByName, matched_by_method(lots, sales, accounts, block_bits))


def priced_history(
    lots: DataFrame, sales: DataFrame, accounts: DataFrame, thresholds: Mapping[str, int] = HOLDING_DAYS, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """The same with gain and term, stored a method at a time: what one of them shuffles is gone before the next."""
    matched = matched_by_method(lots, sales, accounts, block_bits)
    with passing() as keep:
        return keep(stored_parts((priced_dispositions(matches, accounts, thresholds) for matches in matched), "dispositions"))


def unbooked_sales(lots: DataFrame, sales: DataFrame, accounts: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(sale_id, rule)`` of sales that ``dispose_history`` leaves out: beyond
    their holding, or of an account without a known booking method."""
    methods = accounts.select(F.col("id").alias("account_id"), F.col("booking_method").alias("_method"))
    of = sales.join(methods, "account_id", "left")
    unknown = of.filter(~known_method("_method")).select(F.col("id").alias("sale_id"), F.lit("unknown_method").alias("rule"))
    known = of.filter(known_method("_method")).select(*sales.columns)
    short = refused_sales(lots, known, block_bits).select("sale_id", F.lit("insufficient_lots").alias("rule"))
    return unknown.unionByName(short)


def dispose_accepted(
    lots: DataFrame,
    sales: DataFrame,
    accounts: DataFrame,
    thresholds: Mapping[str, int] = HOLDING_DAYS,
    wash_mode: str = "recorded",
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Dispositions of sales known not to exceed their holding.

    Lots, sales, the positions on each axis and the result are written to the
    shared folder on the way: each is read several times, and a lost executor
    costs no more than the stage it was in. What only the matching reads goes with it.
    """
    with passing() as keep:
        own = lots.select(*KEYS, "original_quantity", *_LOT)
        lots = own if hasattr(lots, "stored_at") else keep(stored(own, "lots"))
        sales = stored(sales.select(*KEYS, "quantity", *_SALE), "accepted")
        # Few of very many accounts may have a method: sales and matches don't move to meet the others.
        accounts = stored(accounts.filter(known_method()), "accounts")
        priced = keep(priced_history(lots, sales, accounts, thresholds, block_bits))
    return with_wash_sales(priced, lots, wash_mode)


def dispose_history(
    lots: DataFrame,
    sales: DataFrame,
    accounts: DataFrame,
    thresholds: Mapping[str, int] = HOLDING_DAYS,
    wash_mode: str = "recorded",
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Dispositions of a whole history. ``lots`` are as bought
    (``original_quantity`` is matched); ``lots.replay_lots`` gives what remains.
    Sales beyond their holding and those of unknown booking methods are left out
    (``unbooked_sales`` lists both)."""
    refused = stored(refused_sales(lots, sales, block_bits).withColumnRenamed("sale_id", "id"), "refused")
    accepted = sales.join(refused, "id", "left_anti")
    return dispose_accepted(lots, accepted, accounts, thresholds, wash_mode, block_bits)
