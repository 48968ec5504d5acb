"""Shared pieces of the training-data operators: checkpoints, Arrow slicing, components."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one vectorised step of a Python worker, in bytes; one longer text is a step by itself.
SLICE_BYTES = 8 << 20


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder named by ``spark.checkpoint.dir`` and forget its lineage.

    The folder is shared by all executors, so a lost executor loses nothing.
    Where the session names none it is one in the warehouse, or with a local
    master, whose executors are the driver, a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = tempfile.mkdtemp(prefix="ckpt") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that are sent to every executor at most.
MOST_SENT = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for sending to every executor if it has at most MOST_SENT rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text stays under ``limit`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at, n = 0, len(lengths)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: int) -> pa.Array:
    """A text column with nulls read as empty, offsets in 64 bits; a copy, for some kernels misread slices."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def row_numbers(first: int, count: int) -> np.ndarray:
    """Ids unique over a job: the task's partition above 33 bits, the row's place in it below."""
    from pyspark import TaskContext

    return (np.int64(TaskContext.get().partitionId()) << 33) + np.arange(first, first + count, dtype=np.int64)


def hash_sample(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """Rows with distinct values of ``cols``: all if there are at most about ``rows`` values, else at most ``rows``, chosen by their hash.

    Equal values count once before anything is chosen, so large groups of copies
    neither crowd the sample nor empty it. Rows below the hash's bound are
    picked where they lie; only those are shuffled. Of rows with equal values any
    one stays; columns beyond ``cols`` should follow from them.
    """
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*cols), F.lit(2**32)))
    n = hashed.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
    below = hashed if n <= rows else hashed.filter(F.col("_hash") < int(2**32 * 0.95 * rows / n))
    return below.dropDuplicates(list(cols)).orderBy("_hash", *cols).limit(rows).drop("_hash")


#: What a worker holds across batches and tasks: one table, by its key.
_held: dict = {}


def held(key, make):
    """The worker's table of this key, made if it isn't there; one of another key goes."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of the worker's table: an operator without one shouldn't have to fit beside it."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Return what a worker has freed to the system; workers live on between stages, and so would the memory of the last one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


class WordTable:
    """Ids of distinct words, segmented once each; bounded, and kept across batches by a worker.

    ``segment`` gives the ids of a list of words in a row, and how many each has. Beyond ``limit`` words
    those met only once since the last trim go; should too many stay, all go.
    """

    def __init__(self, segment, limit: int = 500_000):
        self.segment, self.limit = segment, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.starts = self.lengths = self.hits = np.zeros(0, np.int64)

    def trim(self) -> None:
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.limit // 2:
            self.clear()
            return
        new = np.full(len(self.hits), -1, np.int64)
        new[keep] = np.arange(len(keep))
        self.at = {w: int(new[i]) for w, i in self.at.items() if new[i] >= 0}
        self.pool = spread(self.pool, self.starts[keep], self.lengths[keep])
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hits = np.zeros(len(keep), np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        """The table's row for each of these distinct words."""
        found = list(map(self.at.get, words))
        new = [w for w, r in zip(words, found, strict=True) if r is None]
        if len(self.at) + len(new) > self.limit and self.at:
            self.trim()
            found = list(map(self.at.get, words))
            new = [w for w, r in zip(words, found, strict=True) if r is None]
        if new:
            ids, lengths = self.segment(new)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.at.update(zip(new, range(len(self.hits), len(self.hits) + len(new)), strict=True))
            self.pool, self.lengths = np.concatenate([self.pool, ids]), np.concatenate([self.lengths, lengths])
            fresh = iter(range(len(self.hits), len(self.hits) + len(new)))
            found = [next(fresh) if r is None else r for r in found]
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        out = np.fromiter(found, np.int64, len(found))
        self.hits[out] += 1
        return out

    def take(self, words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in order, and where each owner's begin; bounds[i] is owner i's first word."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        coded = words.dictionary_encode()
        rows = self.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[rows]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return spread(self.pool, self.starts[rows], lengths), before[bounds]


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in a row, and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(lengths.sum())), lengths


def spread(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of pool[s : s + n] for each start and length."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as rows (node, root) with root the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is a
    partially aggregated minimum per node and a join back, so a hub is split by
    AQE and no list of a node's neighbours is ever gathered. The edge list is
    written to the checkpoint folder after each round; it stops when a round
    changes nothing. Only nodes with an edge are returned.

    Null ends and self-loops are ignored; repeated edges count once.
    """
    x, y = F.col(a), F.col(b)
    now = cut(
        edges.filter(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct()
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u <> v").distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

