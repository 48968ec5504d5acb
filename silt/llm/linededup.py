"""Line dedup over a sharded minimal perfect hash.

A line is known by its key: stripped and lower-cased, as two independent 64-bit
hashes. Keys found in several documents go into an index: they are cut into
shards by hash, and each shard gets a minimal perfect hash - a cascade of bit
arrays, where a key takes the first bit that no other key of its level takes -
that numbers its keys without gaps. By that number lie a fingerprint (the second
hash), the smallest document that holds the line and the line's count, as plain
arrays; the lines themselves are nowhere kept. The index is a table of one row a
shard, written to the shared folder.

Documents then probe it: the hashes of their lines go to the shard they belong
to, where the arrays are held once and the hashes stream past. A shard stands in
several places, between which the probes are dealt by document, so a line that a
third of all documents has doesn't fill one task. Only the numbers of the lines
to drop come back to the documents, and texts are cut where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import cut, slices, spread, texts_of

#: Keys of a shard; places a shard stands in.
SHARD_KEYS, PLACES = 1 << 18, 4
#: Bits of a level for each key it gets; keys of a level's bit array between two stored ranks.
WIDTH, RANKED = 2, 512
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _mixed(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    """The hash of a key at a level, from both its hashes."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) ^ (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys, each a pair of 64-bit hashes: ``number`` is 0 to n - 1 for the n keys, any of these or -1 for others."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.bits = bits
        self.starts = np.cumsum(sizes) - sizes
        # keys before each run of RANKED bits
        counts = np.bitwise_count(bits.reshape(-1, RANKED // 8)).sum(axis=1, dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        """Over these keys, of which no two may be equal."""
        sizes, levels, left = [], [], np.arange(len(h))
        while len(left):
            size = -(-WIDTH * len(left) // RANKED) * RANKED
            at = (_mixed(h[left], g[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def number(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            at = start + (_mixed(h[left], g[left], level) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[left[hit]] = self._rank(at[hit])
            left = left[~hit]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        run = at // RANKED
        words = self.bits.reshape(-1, RANKED // 64, 8).view(np.uint64)[..., 0]
        inside, word = at % RANKED, (at % RANKED) // 64
        rank = self.before[run].copy()
        for w in range(RANKED // 64):
            full = word > w
            rank[full] += np.bitwise_count(words[run[full], w])
        part = words[run, word] & ((np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1))
        return rank + np.bitwise_count(part)


def _lines(df: DataFrame, id_col: str, text_col: str, least: int, *more: Column) -> DataFrame:
    """A row (id, *more, pos, h, g) for each line whose key has at least ``least`` code points."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *more, F.col(text_col).alias("text"))
    each = rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", key_of(F.col("line")))
    return each.filter(F.char_length("key") >= least).select(*[c for c in rows.columns if c != "text"], "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"))


def line_index(df: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of the lines that at least two documents hold, a row (shard, shards, keys, sizes, bits, marks, owners, counts) a shard.

    ``marks``, ``owners`` and ``counts`` lie by the perfect hash's number: the
    second hash, the smallest id and how many lines there are in all. Rows with a
    null id or text hold no line; rows of one id are one document. An empty table
    gives no rows.
    """
    held = _lines(df, id_col, text_col, least).groupBy("h", "g").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"))
    shared = cut(held.filter("owner < last").select("h", "g", "owner", "n"))
    keys = shared.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-parts // PLACES), -(-keys // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        h, g, owner, n = (table.column(c).to_numpy() for c in ("h", "g", "owner", "n"))
        hashed = PerfectHash.of(h, g)
        order = np.argsort(hashed.number(h, g))
        arrays = [pa.array([np.ascontiguousarray(x).tobytes()]) for x in (hashed.sizes, hashed.bits, g[order], owner[order], np.minimum(n[order], 2**31 - 1).astype(np.int32))]
        return pa.Table.from_arrays([table.column("shard").combine_chunks()[:1], pa.array([shards], pa.int32()), pa.array([len(h)], pa.int64()), *arrays], ["shard", "shards", "keys", "sizes", "bits", "marks", "owners", "counts"])

    sharded = shared.withColumn("shard", _shard(shards))
    return cut(sharded.groupBy("shard").applyInArrow(build, "shard int, shards int, keys long, sizes binary, bits binary, marks binary, owners binary, counts binary"))


def _shard(shards: int) -> Column:
    # the first hash's high half; the perfect hash mixes all of it anew
    return F.pmod(F.shiftright("h", 32), F.lit(shards)).cast("int")


class Shard:
    """One shard of the index, ready to be probed."""

    def __init__(self, sizes: bytes, bits: bytes, marks: bytes, owners: bytes, counts: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(bits, np.uint8))
        self.marks, self.owners, self.counts = np.frombuffer(marks, np.int64), np.frombuffer(owners, np.int64), np.frombuffer(counts, np.int32)

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys the index holds, and their owners and counts (0 where it doesn't)."""
        at = self.hash.number(h, g)
        held = at >= 0
        held[held] = self.marks[at[held]] == g[held]
        at = np.where(held, at, 0)
        zero = np.zeros(len(h), np.int64)
        return held, np.where(held, self.owners[at], 0) if len(self.owners) else zero, np.where(held, self.counts[at], 0) if len(self.counts) else zero


_PROBE = "shard int, place int, id long, hash long, pos int, h long, g long, arrays struct<sizes:binary,bits:binary,marks:binary,owners:binary,counts:binary>"


def drops(df: DataFrame, index: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, hash, at): which lines, from 0, of the rows of that id and text hash stand in a document of a smaller id as well."""
    shards = index.agg(F.max("shards")).first()[0] or 1
    probes = _lines(df, id_col, text_col, least, F.xxhash64(text_col).alias("hash"))
    probes = probes.select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("id", "hash"), F.lit(PLACES)).cast("int").alias("place"), F.col("id").cast("long").alias("id"), "hash", "pos", "h", "g")
    types = dict(f.split(" ", 1) for f in _PROBE.split(", "))
    none = {c: F.lit(None).cast(t) for c, t in types.items()}
    arrays = F.struct(*[F.col(c) for c in ("sizes", "bits", "marks", "owners", "counts")])
    standing = index.select("shard", F.explode(F.array(*[F.lit(i) for i in range(PLACES)])).alias("place"), *[none[c].alias(c) for c in ("id", "hash", "pos", "h", "g")], arrays.alias("arrays"))
    asked = probes.select(*[F.col(c) for c in ("shard", "place", "id", "hash", "pos", "h", "g")], none["arrays"].alias("arrays"))
    # a shard's arrays come first in each of its places, its probes after them
    task = F.col("shard") * PLACES + F.col("place")
    met = standing.union(asked).withColumn("task", task).repartitionById(shards * PLACES, F.col("task")).sortWithinPartitions("task", F.col("arrays").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            task = batch.column(batch.schema.get_field_index("task")).to_numpy()
            arrays = batch.column(batch.schema.get_field_index("arrays"))
            heads = np.flatnonzero(arrays.is_valid().to_numpy(zero_copy_only=False))
            edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, heads, heads + 1, [len(task)]]))
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if arrays[start].is_valid:
                    now, shard = task[start], Shard(**{k: v.as_py() for k, v in arrays[start].items()})
                elif now == task[start]:
                    ids, hashes, pos, h, g = (batch.column(i).slice(start, end - start).to_numpy() for i in range(2, 7))
                    held, owners, _ = shard.probe(h, g)
                    gone = np.flatnonzero(held & (owners != ids))
                    if len(gone):
                        yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (ids, hashes, pos)], ["id", "hash", "pos"])

    found = met.mapInArrow(run, "id long, hash long, pos int")
    return found.groupBy("id", "hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def kept_lines(df: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` (id, text) as rows (id, text, n_lines, n_dropped): its texts without the lines that a document of a smaller id holds.

    Texts are cut at line feeds; null and empty texts are one empty line. A line's
    key has no blanks at its ends and a-z for A-Z; lines of keys under ``least``
    code points always stay. All lines of a key stay in the document with the
    smallest id that has it, repeated or not, and go in all others. The text of
    the lines left is joined by line feeds (none left: empty). Rows of one id are
    one document: what goes in one goes in all. Rows with a null id stay
    whole and drop nothing elsewhere. Ids are longs. Other columns are not read,
    and an empty table gives no rows.
    """
    index = line_index(df, least, id_col, text_col)
    gone = drops(df, index, least, id_col, text_col)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    marked = docs.join(gone, ["id", "hash"], "left").select("id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts, counts, dropped = without(texts_of(part, 1), part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), texts.cast(pa.string()), pa.array(counts), pa.array(dropped)], ["id", "text", "n_lines", "n_dropped"])

    kept = marked.mapInArrow(run, "id long, text string, n_lines long, n_dropped long")
    return kept.withColumnsRenamed({"id": id_col, "text": text_col})


def without(texts: pa.Array, at: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without the lines at the given places, with how many lines they had and how many went."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    breaks = offsets[0] + np.flatnonzero(data[offsets[0] : offsets[-1]] == 10)
    before = np.searchsorted(breaks, offsets)
    counts = np.diff(before) + 1
    # all lines in a row: where each begins and ends, line feeds left out
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    starts, ends = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    inner = np.ones(len(owner), bool)
    inner[first] = False
    starts[first], starts[inner] = offsets[:-1], breaks + 1
    last = np.ones(len(owner), bool)
    last[first + counts - 1] = False
    ends[first + counts - 1], ends[last] = offsets[1:], breaks
    lists = at.take(pa.array(np.arange(len(at))))  # a copy, for slices keep their parent's values
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    keep = np.ones(len(owner), bool)
    keep[np.repeat(first, sizes) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = False
    dropped = counts - np.add.reduceat(keep, first).astype(np.int64) if len(texts) else counts
    # a line feed after each line kept but a text's last one
    owner, starts, ends = owner[keep], starts[keep], ends[keep]
    lengths = ends - starts
    more = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
    total = np.bincount(owner, lengths + more, len(texts)).astype(np.int64)
    out = np.full(int(total.sum()), 10, np.uint8)
    to = np.cumsum(lengths + more) - (lengths + more)
    out[spread(np.arange(len(out)), to, lengths)] = spread(data, starts, lengths)
    bounds = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(out)), counts, dropped
