"""Band join on near numbers: items with every line whose value lies in their band.

Lines are reduced where they lie to at most ``k`` rows for each (value, item): the
first by rank, of which one carries how many lines there are and the sum of their
marks. The reduced rows are dealt to ranges of (value, hash of item) whose bounds
are quantiles of these rows, so a value that very many items share is split as
well. An item's band is known in closed form, so the item is sent to just the
ranges it meets. In a range, lines and items come in order of value; a window
slides over the lines while items pass, its sums are differences of running sums
less the item's own lines, and the nearest values are looked at outwards until
``k`` lines of others are found. Last, an item's sums and best lists of all ranges
are merged.

No range, item or value gathers more rows than its share: the window of a range is
held in memory, nothing goes to the driver but the ranges' bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import cut

#: Lines reduced at a time where they lie; parts a value can be split into; values beyond this size share the outermost ranges.
RUN, SPLITS, WIDEST = 1 << 18, 1 << 12, 1 << 50
#: Cents beyond this size are no amounts: twice them plus a quantity must fit into 64 bits.
MOST_CENTS = float(1 << 61)
#: Stands for a null line number, before all others.
NO_LINE = -(1 << 63)

_ROWS = "part int, at long, kind int, item long, a long, b long, n long, mark long"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles, as a long; null for what is not finite or beyond MOST_CENTS."""
    shifted = F.floor(F.lit(100.0) * x.cast("double") + F.lit(0.5))
    return F.when(F.abs(F.lit(100.0) * x.cast("double")) < MOST_CENTS, shifted)


def band(p: np.ndarray, least: int, permille: int) -> np.ndarray:
    """How far from p a value may lie: gap <= least, or 1000 * gap <= permille * p."""
    return np.maximum(least, (np.maximum(p, 0) // 1000) * permille + (np.maximum(p, 0) % 1000) * permille // 1000)


def reduce_lines(at: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, mark: np.ndarray, k: int) -> list[np.ndarray]:
    """The first ``k`` lines by (a, b) of each (at, item); the first carries the sums of n and mark, the others zero."""
    order = np.lexsort((b, a, item, at))
    at, item, a, b, n, mark = (x[order] for x in (at, item, a, b, n, mark))
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (item[1:] != item[:-1])])) if len(at) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x, first) if len(first) else x for x in (n, mark)]
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    keep = place < k
    n, mark = np.zeros_like(n), np.zeros_like(mark)
    n[first], mark[first] = sums
    return [x[keep] for x in (at, item, a, b, n, mark)]


def _reduced(lines: DataFrame, k: int) -> DataFrame:
    """Rows (at, item, a, b, mark) as rows (at, item, a, b, n, mark), reduced run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def close() -> pa.RecordBatch:
            at, item, a, b, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in reduce_lines(at, item, a, b, np.ones(len(at), np.int64), mark, k)], ["at", "item", "a", "b", "n", "mark"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
            if count >= RUN:
                yield close()
                held, count = [], 0
        if count:
            yield close()

    return lines.mapInArrow(run, "at long, item long, a long, b long, n long, mark long")


def _place(at: np.ndarray, split: np.ndarray | int) -> np.ndarray:
    """A number that orders by (value, split), for values within WIDEST."""
    return np.clip(at, -WIDEST, WIDEST) * SPLITS + split


class Window:
    """The lines of a range that items may still meet, in order of value."""

    def __init__(self, k: int):
        self.k = k
        self.rows = [np.zeros(0, np.int64) for _ in range(6)]

    def add(self, rows: list[np.ndarray]) -> None:
        """More lines, none of a smaller value than those held."""
        self.rows = [np.concatenate(x) for x in zip(self.rows, rows, strict=True)]
        at, item, a, b, n, mark = self.rows
        # ties by (a, b, item), as the result ranks them
        order = np.lexsort((item, b, a, at))
        self.rows = [x[order] for x in self.rows]

    def drop_below(self, low: int) -> None:
        """Values under the lowest band still to come leave the window."""
        start = np.searchsorted(self.rows[0], low)
        self.rows = [x[start:] for x in self.rows]

    def meet(self, item: np.ndarray, p: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each item its number of pairs, sum of gaps, sum of marks, and the rows of its k nearest lines (-1: none) with how many there are."""
        at, owner, _, _, n, mark = self.rows
        lo, mid, hi = (np.searchsorted(at, x, side) for x, side in ((p - width, "left"), (p, "left"), (p + width, "right")))
        sums = {x: np.concatenate([[0], np.cumsum(y)]) for x, y in (("n", n), ("nu", n * at), ("mark", mark))}

        def within(of: dict, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
            return [of["n"][j] - of["n"][i], (of["nu"][j] - of["nu"][m]) - p * (of["n"][j] - of["n"][m]) + p * (of["n"][m] - of["n"][i]) - (of["nu"][m] - of["nu"][i]), of["mark"][j] - of["mark"][i]]

        every = within(sums, lo, hi, mid)
        # an item's own lines are a run of the rows in order of (item, place)
        by_item = np.argsort(owner, kind="stable")
        theirs = {x: np.concatenate([[0], np.cumsum(y[by_item])]) for x, y in (("n", n), ("nu", n * at), ("mark", mark))}
        names, begins = np.unique(owner[by_item], return_index=True)
        code = np.searchsorted(names, item)
        known = np.isin(item, names)
        code = np.where(known, code, 0)
        size = len(owner) + 1
        keys = np.repeat(np.arange(len(names)), np.diff(np.append(begins, len(owner)))) * size + by_item
        i, m, j = (np.where(known, np.searchsorted(keys, code * size + x), 0) for x in (lo, mid, hi))
        own = within(theirs, i, j, m)
        return *(x - y for x, y in zip(every, own, strict=True)), *self._nearest(item, p, lo, mid, hi)

    def _nearest(self, item: np.ndarray, p: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest lines of other items, going outwards from p value by value, the smaller first of two as near."""
        at, owner, k = self.rows[0], self.rows[1], self.k
        best, found = np.full((len(item), k), -1, np.int64), np.zeros(len(item), np.int64)
        if not len(at):
            return best, found
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        values, ends = at[heads], np.append(heads[1:], len(at))
        # of a value the first k lines of each item, and of those the first 2k: k of them at most are the asking item's own
        group = np.repeat(np.arange(len(heads)), ends - heads)
        order = np.lexsort((np.arange(len(at)), owner, group))
        starts = np.flatnonzero(np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (owner[order][1:] != owner[order][:-1])]))
        nth = np.empty(len(at), np.int64)
        nth[order] = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        rows = np.flatnonzero(nth < k)
        place = np.arange(len(rows)) - np.searchsorted(group[rows], np.arange(len(heads)))[group[rows]]
        table = np.full((len(heads), 2 * k), -1, np.int64)
        table[group[rows[place < 2 * k]], place[place < 2 * k]] = rows[place < 2 * k]
        # left and right: the next value on either side, in numbers of values
        left, right = np.searchsorted(values, p) - 1, np.searchsorted(values, p)
        first, last = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
        active = np.arange(len(item))
        while True:
            l, r = left[active], right[active]
            can_l, can_r = l >= first[active], r < last[active]
            active, l, r, can_l, can_r = (x[can_l | can_r] for x in (active, l, r, can_l, can_r))
            if not len(active):
                return best, found
            gap_l, gap_r = p[active] - values[np.maximum(l, 0)], values[np.minimum(r, len(values) - 1)] - p[active]
            go_left = can_l & (~can_r | (gap_l <= gap_r))
            cand = table[np.where(go_left, l, r)]
            good = (cand >= 0) & (owner[cand] != item[active][:, None])
            slot = found[active][:, None] + np.cumsum(good, axis=1) - 1
            good &= slot < k
            who, where = np.nonzero(good)
            best[active[who], slot[who, where]] = cand[who, where]
            found[active] += good.sum(axis=1)
            left[active[go_left]] -= 1
            right[active[~go_left]] += 1
            active = active[found[active] < k]


def near_lines(items: DataFrame, lines: DataFrame, k: int = 5, least: int = 10, permille: int = 2) -> DataFrame:
    """Rows (item_id, p, copies, n_pairs, gap_sum, mark_sum, best): of each distinct (item_id, p) its pairs' count and sums and the k nearest lines.

    ``items`` has (item_id, p), ``lines`` (item_id, u, sale_id, line_no, mark), all
    longs. An item pairs with every line of another item_id whose gap |u - p| is at
    most ``least``, or 1000 * gap at most ``permille`` * p. ``best`` is an array of
    (gap, u, sale_id, line_no, line_item_id) in that order. Lines with a null in
    any of these columns, and items with a null, have no pairs; the items have a
    row with an empty ``best`` all the same. Repeated lines count and rank each;
    equal items are one row with their number in ``copies``. Other columns are not
    read; either table may be empty. Sums beyond 64 bits wrap.
    """
    spark = items.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = items.select(F.col("item_id").cast("long").alias("item"), F.col("p").cast("long").alias("a")).groupBy("item", "a").agg(F.count("*").alias("copies"))
    whole = lines.select(F.col("u").cast("long").alias("at"), F.col("item_id").cast("long").alias("item"), F.col("sale_id").cast("long").alias("a"), F.col("line_no").cast("long").alias("b"), F.col("mark").cast("long").alias("mark")).dropna()
    rows = cut(_reduced(whole, k))
    split = F.pmod(F.xxhash64("item"), F.lit(SPLITS))
    place = F.least(F.greatest("at", F.lit(-WIDEST)), F.lit(WIDEST)) * SPLITS + split
    cuts = rows.agg(F.percentile_approx(place, [(i + 1) / parts for i in range(parts - 1)], 20 * parts).alias("cuts")).first()["cuts"]
    cuts = np.array(cuts or [], np.int64)  # a bound for each range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, *_, split = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            part = np.searchsorted(cuts, _place(at, split)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), pa.array(np.zeros(len(part), np.int32)), *batch.columns[1:6]], _NAMES)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, p, copies = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            width = band(p, least, permille)
            low, high = np.searchsorted(cuts, _place(p - width, 0)), np.searchsorted(cuts, _place(p + width, SPLITS - 1))
            many = high - low + 1
            for some in np.array_split(np.arange(len(item)), max(1, int(many.sum()) // RUN)):
                i = np.repeat(some, many[some])
                part = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
                zero = np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.astype(np.int32), (p + width)[i], np.ones(len(i), np.int32), item[i], p[i], zero, copies[i], zero)], _NAMES)

    dealt = rows.withColumn("split", split).select("at", "item", "a", "b", "n", "mark", "split").mapInArrow(deal, _ROWS)
    sent = wanted.dropna().mapInArrow(replicate, _ROWS)
    ordered = dealt.union(sent).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "at", "kind", "a")

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, now, held, count = Window(k), None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal window, now, held, count
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, count = [], 0
            edges = np.flatnonzero(np.diff(columns[0])) + 1
            for run in zip(*(np.split(c, edges) for c in columns), strict=True):
                if now != run[0][0]:
                    window, now = Window(k), run[0][0]
                is_item = run[2] == 1
                _, at, _, item, a, b, n, mark = run
                window.add(reduce_lines(*(x[~is_item] for x in (at, item, a, b, n, mark)), k))
                if is_item.any():
                    item, p, copies, width = item[is_item], a[is_item], n[is_item], (at - a)[is_item]
                    pairs, gaps, marks, best, found = window.meet(item, p, width)
                    at_, owner, sale, line, *_ = window.rows
                    flat = best[best >= 0]
                    near = pa.StructArray.from_arrays([pa.array(x) for x in (np.abs(at_[flat] - np.repeat(p, found)), at_[flat], sale[flat], line[flat], owner[flat])], ["gap", "u", "sale_id", "line_no", "line_item_id"])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32)), near)
                    for i in range(0, len(item), 1 << 14):
                        s = slice(i, i + (1 << 14))
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[s]) for x in (item, p, copies, pairs, gaps, marks)), lists[s]], ["item_id", "p", "copies", "n_pairs", "gap_sum", "mark_sum", "best"])
                    # bands of later items end no sooner, so they begin no sooner
                    window.drop_below(int((p - width)[-1]))

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
            if count >= max(RUN // 4, len(window.rows[0])):
                yield from close()
        if count:
            yield from close()

    one = "struct<gap:long,u:long,sale_id:long,line_no:long,line_item_id:long>"
    met = ordered.mapInArrow(slide, f"item_id long, p long, copies long, n_pairs long, gap_sum long, mark_sum long, best array<{one}>")
    merged = met.groupBy("item_id", "p").agg(F.first("copies").alias("copies"), *[F.sum(c).alias(c) for c in ("n_pairs", "gap_sum", "mark_sum")], F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    zero = F.lit(0).cast("long")
    nulls = wanted.filter("item is null or a is null").select(F.col("item").alias("item_id"), F.col("a").alias("p"), "copies", zero.alias("n_pairs"), zero.alias("gap_sum"), zero.alias("mark_sum"), F.array().cast(f"array<{one}>").alias("best"))
    return merged.union(nulls)


def price_neighbours(items: DataFrame, lines: DataFrame, k: int = 5) -> DataFrame:
    """Items with the lines of other items sold at nearly their price: k ranked rows an item, its counts and sums on each.

    ``items`` has (item_id, price), ``lines`` (sale_id, line_no, item_id, quantity,
    amount). Prices and amounts become cents; a line's unit price is its cents
    over its quantity, rounded half up in whole numbers. Lines with a null
    in sale_id, item_id, quantity or amount, with a quantity of 0 or less, or with
    no finite amount under MOST_CENTS never pair, nor do items without a price or
    id. A null line_no ranks before all others and is an empty text in the mark.
    Each row of ``items`` gives its own rows; one without pairs gives one
    of rank 0. ``lines_crc`` sums the crc32 of ``sale_id,line_no,line_item_id``.
    """
    cent, count = cents(F.col("amount")), F.col("quantity").cast("long")
    twice = 2 * cent + count
    fit = lines.filter("sale_id is not null and item_id is not null and quantity > 0 and amount is not null").select("sale_id", "line_no", "item_id", twice.alias("twice"), (2 * count).alias("by"))
    mark = F.crc32(F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string")))
    whole = fit.select("item_id", F.expr("(twice - pmod(twice, by)) div by").alias("u"), "sale_id", F.coalesce(F.col("line_no").cast("long"), F.lit(NO_LINE)).alias("line_no"), mark.alias("mark"))
    found = near_lines(items.select("item_id", cents(F.col("price")).alias("p")), whole, k)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("item_id", F.posexplode_outer("best").alias("pos", "x"), "n_pairs", "gap_sum", F.col("mark_sum").alias("lines_crc"))
    return each.select(
        "item_id",
        F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("rank"),
        "x.gap",
        "x.u",
        "x.sale_id",
        F.when(F.col("x.line_no") != NO_LINE, F.col("x.line_no")).alias("line_no"),
        "x.line_item_id",
        "n_pairs",
        "gap_sum",
        "lines_crc",
    )
