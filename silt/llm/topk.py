"""Exact inner-product top-k with vector-approximation files.

Vectors are made integers. The approximation file keeps of each component only
the number of its cell, one byte; a dimension's range is cut into up to 256 cells
of equal width, the same for the whole table. With a cell's lower edge for every
component, a query's inner product is bounded from below and above, and the two
bounds of one query are always equally far apart - so one matrix product gives
both. The file is scanned alone, in blocks: a block leaves the candidates whose
upper bound reaches its k-th largest lower bound. Over all blocks the k-th
largest lower bound of a query is a floor under its k-th result, and only
candidates whose upper bound reaches that floor are left. Their exact vectors are
read in the order of that bound: first a few times k, and after these only what
may still reach the k-th exact score among them.

Of equal vectors in a block only the k + 1 with the smallest ids can be results,
so a vector that a third of all rows have leaves no more than others. Candidate
and query blocks meet by number; a meeting ships a few hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.llm.common import cut, row_numbers

#: Vectors in a block of queries and in a block of candidates; cells of a dimension; parts that a query block is sent to; so many times k vectors of a query are read first.
QUERIES, CANDIDATES, CELLS, PARTS, FIRST = 1024, 4096, 256, 32, 2


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null where the vector has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _edges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the lowest edge and the cell width of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dims, values in _by_length(batch.column(0)):
                low, high = values.min(axis=0), values.max(axis=0)
                if dims in seen:
                    low, high = np.minimum(low, seen[dims][0]), np.maximum(high, seen[dims][1])
                seen[dims] = low, high
        for dims, (low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, dims, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], ["dims", "at", "low", "high"])

    found = rows.select("v").mapInArrow(run, "dims int, at int, low long, high long").groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, list] = {}
    for r in sorted(found.collect()):  # a row for each dimension
        out.setdefault(r["dims"], []).append((r["low"], max(1, -(-(r["high"] - r["low"] + 1) // CELLS))))
    return {dims: tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) for dims, pairs in out.items()}


def _by_length(column: pa.Array, *others: pa.Array) -> Iterator[tuple]:
    """The vectors of each length as a matrix, with the other columns' values of their rows."""
    lengths = np.diff(np.asarray(column.offsets, dtype=np.int64))
    for dims in np.unique(lengths):
        rows = pa.array(np.flatnonzero(lengths == dims))
        yield int(dims), column.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), *(o.take(rows) for o in others)


def _blocks(rows: DataFrame, size: int, edges: dict | None = None, copies: int = 0) -> DataFrame:
    """Rows (id, num, v) of one partition as rows (block, dims, ids, nums, vals) of at most ``size``, one length each.

    With ``edges`` vals holds the numbers of the cells, one byte each, and of more
    than ``copies`` equal vectors in a block those with the smallest ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, {}

        def close(dims: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            values, ids, nums = (np.concatenate(x) for x in zip(*held[dims], strict=True))
            while len(ids) >= least:
                one, some, names = values[:size], ids[:size], nums[:size]
                if edges is not None:
                    group = np.unique(one, axis=0, return_inverse=True)[1].ravel()
                    order = np.lexsort((some, group))
                    first = np.searchsorted(group[order], np.arange(group.max() + 1))
                    keep = np.sort(order[np.arange(len(order)) - first[group[order]] < copies])
                    low, width = edges[dims]
                    one, some, names = ((one[keep] - low) // width).astype(np.uint8), some[keep], names[keep]
                yield pa.RecordBatch.from_arrays([pa.array(row_numbers(made, 1)), pa.array([dims], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()]) for x in (some, names, one))], ["block", "dims", "ids", "nums", "vals"])
                made, values, ids, nums = made + 1, values[size:], ids[size:], nums[size:]
            held[dims] = [(values, ids, nums)]

        for batch in batches:
            for dims, values, *names in _by_length(batch.column(2), *batch.columns[:2]):
                held.setdefault(dims, []).append((values, *(x.to_numpy(zero_copy_only=False) for x in names)))
                yield from close(dims, size)
        for dims in held:
            yield from close(dims, 1)

    return rows.mapInArrow(run, "block long, dims int, ids binary, nums binary, vals binary")


def scan_block(query_nums: np.ndarray, queries: np.ndarray, ids: np.ndarray, nums: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of a block of cells the candidates each query still needs, its own row left out: their rows, lower bounds, and how far above these the upper bounds lie."""
    asked = queries.astype(np.float64)
    lowest = (asked * width) @ cells.astype(np.float64).T
    constant = asked @ low.astype(np.float64) + np.minimum(asked, 0) @ (width - 1).astype(np.float64)
    # the sums of doubles may be off by a little where the numbers are large
    reach = np.abs(low).astype(np.float64) + CELLS * width.astype(np.float64)
    apart = np.abs(asked) @ (width - 1).astype(np.float64) + 2.0**-46 * (np.abs(asked) @ reach)
    out = []
    for q in range(len(asked)):
        bound = lowest[q] + constant[q]
        own = np.flatnonzero(nums == query_nums[q])
        bound[own] = -np.inf
        n = min(k, len(ids) - len(own))
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0), 0.0))
            continue
        floor = np.partition(bound, len(bound) - n)[len(bound) - n]
        rows = np.flatnonzero((bound + apart[q] >= floor) & (bound > -np.inf))
        if not apart[q]:  # the bounds are the scores: of equal ones the smallest ids
            rows = rows[np.lexsort((ids[rows], -bound[rows]))[:n]]
        out.append((rows, bound[rows], apart[q]))
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): the k highest integer inner products of each query row.

    ``is_query`` marks the rows that are queries; every other row of the table is
    a candidate of each, its own row is not; other rows with its id are, and each
    query row is answered by itself, so several with one id have k rows each. Components become floor(scale * x); ties go to the smaller id.
    Vectors that are null or hold null or non-finite components, and rows with a
    null id, take no part; vectors of another length than the query's are not
    compared. Components beyond 64 bits saturate and scores beyond them wrap.
    Other columns are not read. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null and size(v) > 0")
    rows = cut(rows.withColumn("num", F.monotonically_increasing_id()))
    edges = _edges(rows)
    wanted = rows.filter("q").select("id", "num", "v")
    scanned = cut(_blocks(rows.select("id", "num", "v"), CANDIDATES, edges, k + 1))
    queries = cut(_blocks(wanted.repartition(max(1, -(-wanted.count() // QUERIES))), QUERIES))
    order = Window.partitionBy("dims").orderBy("block")  # a number for each thousand queries, without their vectors
    numbers = queries.select("dims", "block").withColumn("number", F.row_number().over(order))
    asked = queries.join(F.broadcast(numbers), ["dims", "block"]).select("dims", "number", F.col("nums").alias("q_nums"), F.col("vals").alias("q_vals"))
    each = asked.groupBy("dims").agg(F.max("number").alias("most"))
    parts = F.broadcast(each)  # a row for each vector length
    left = scanned.join(parts, "dims").withColumn("number", F.explode(F.expr("sequence(1, most)"))).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)))
    right = asked.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])))
    meetings = left.join(right, ["dims", "number", "part"]).select("dims", "q_nums", "q_vals", "ids", "nums", "vals")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, q_nums, q_vals, ids, nums, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_nums, q_vals, ids, nums = (np.frombuffer(x, np.int64) for x in (q_nums, q_vals, ids, nums))
                low, width = edges[dims]
                for at in range(0, len(q_nums), 128):
                    found = scan_block(q_nums[at : at + 128], q_vals.reshape(-1, dims)[at : at + 128], ids, nums, np.frombuffer(cells, np.uint8).reshape(-1, dims), low, width, k)
                    counts = [len(r) for r, _, _ in found]
                    kept = np.concatenate([r for r, _, _ in found])
                    bound, apart = np.concatenate([b for _, b, _ in found]), np.repeat([a for *_, a in found], counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_nums[at : at + 128], counts)), pa.array(nums[kept]), pa.array(bound), pa.array(bound + apart)], ["query", "num", "lower", "upper"])

    bounds = cut(meetings.mapInArrow(meet, "query long, num long, lower double, upper double"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("lower").desc()))
    floors = bounds.withColumn("place", place).filter(F.col("place") <= k).groupBy("query").agg(F.min("lower").alias("floor"))
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.col("upper").desc(), "num"))
    needed = cut(bounds.join(floors, "query").filter("upper >= floor").select("query", "num", "upper", (turn <= FIRST * k).alias("first")))
    asks = wanted.select(F.col("num").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("x"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4))
            starts = np.asarray(batch.column(3).offsets, dtype=np.int64)
            sums = np.add.reduceat(x * y, (starts - starts[0])[:-1]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["query", "query_id", "id", "score"])

    def scores(wanted_pairs: DataFrame) -> DataFrame:
        pairs = wanted_pairs.join(rows.select("num", "id", "v"), "num").join(asks, "query").filter(F.size("x") == F.size("v"))
        return pairs.select("query", "query_id", "id", "x", "v").mapInArrow(exact, "query long, query_id long, id long, score long")

    first = cut(scores(needed.filter("first")))
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    kth = first.withColumn("rank", ranked).filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    # what wasn't read may be among the k only if it can reach the k-th read; fewer than k were read only where there are no more
    found = first.union(scores(needed.filter("not first").join(kth, "query").filter("upper >= kth")))
    best = found.withColumn("rank", ranked).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
