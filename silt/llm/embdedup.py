"""Near-duplicate embeddings through a pivot-permutation index.

Reference vectors (pivots) come from a bounded, hash-ordered sample. Vectors and
pivots are seen from the sample's mean, so that vectors which all point one way
are still told apart. Every vector is described by its nearest pivots in order of
distance; how many is found on the sample, where pairs just as close as the
threshold are made along the data's own differences and must share two. The
inverted lists are kept per pair of pivots: a vector stands in the list of every
two of its nearest pivots, so two vectors meet where they share at least two.
Meeting pairs are counted by their shared pivots - a pair is taken at the
smallest two it shares, and nowhere else - and verified by cosine in double
precision.

Equal vectors are one class from the start. Lists hold numbers, pivots and a
sketch of signs; a first meeting discards pairs whose sketches differ too much
and leaves the members that still have a partner, and only those are sent their
vectors for the second, which verifies. Lists are cut into blocks of fixed size;
two blocks of a list meet as one row. A meeting leaves each vector's count of
links and the links themselves only as a spanning forest, never its pairs, so a
list that a third of all vectors stand in is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import components, cut, hash_sample

#: Pivots: one for so many classes, and at least and at most so many.
CLASSES_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 16, 64, 16_384
#: Pivots closer than this, seen from the mean, to one already taken are left out: many in one cluster would tell its members apart.
PIVOTS_APART = 0.8
#: Nearest pivots that describe a vector: the first of these with which so large a share of pairs at the threshold share two.
NEAREST, SHARE, PROBES = (8, 10, 12, 16, 24), 0.97, 512
#: Vectors in a block of an inverted list.
BLOCK = 256
#: Bits of a sketch, and by how many deviations more than expected at the threshold two may differ.
SKETCH, DEVIATIONS = 128, 5.5


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, sig, vec): a digest of the vector's doubles and its unit vector; both null where it links with nothing."""
    import hashlib

    for batch in batches:
        sigs, units = [], []
        for vector in batch.column(1).to_pylist():
            values = np.array(vector if vector is not None and None not in vector else [np.nan], np.float64)
            top = np.abs(values).max(initial=0.0)
            if not np.isfinite(values).all() or not top:
                sigs.append(None)
                units.append(None)
                continue
            values = values + 0.0  # one zero
            sigs.append(hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest())
            scaled = values / top
            units.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.string()), pa.array(units, pa.binary())], ["id", "sig", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length, stacked."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _pivots_of(column: pa.Array) -> np.ndarray:
    """Rows of pivot numbers."""
    return np.stack([np.frombuffer(x.as_buffer(), np.int16) for x in column]).astype(np.int64)


class Index:
    """A sample's mean, pivots seen from it, planes of the sketch, and how many nearest pivots describe a vector."""

    def __init__(self, sample: np.ndarray, threshold: float, wanted: int):
        rng = np.random.default_rng(5)
        self.mean = sample.mean(axis=0)
        self.planes = rng.standard_normal((sample.shape[1], SKETCH)).astype(np.float32)
        off = np.arccos(np.clip(threshold, -1, 1)) / np.pi
        self.most = int(SKETCH * off + DEVIATIONS * np.sqrt(SKETCH * off * (1 - off)) + 1)
        seen = self.seen(sample)
        near, kept = seen @ seen.T >= PIVOTS_APART, np.zeros(len(seen), bool)
        for i in range(len(seen)):
            kept[i] = not (near[i] & kept).any()
        self.pivots = seen[kept][:wanted]
        # pairs at the threshold: a sampled vector, and one turned from it towards the difference of two others
        one, two, three = (sample[rng.integers(0, len(sample), PROBES)] for _ in range(3))
        away = two - three
        away -= (away * one).sum(axis=1, keepdims=True) * one
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        probe = (size[:, 0] > 1e-9)
        turned = threshold * one[probe] + np.sqrt(max(0.0, 1 - threshold**2)) * away[probe] / size[probe]
        for self.nearest in NEAREST:
            a, b = self.describe(one[probe]), self.describe(turned)
            shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
            if not len(a) or (shared >= min(2, len(self.pivots))).mean() >= SHARE:
                break

    def seen(self, units: np.ndarray) -> np.ndarray:
        """Directions from the mean; the mean itself has none."""
        off = units - self.mean
        return (off / np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)

    def describe(self, units: np.ndarray) -> np.ndarray:
        """The numbers of each vector's nearest pivots in order of distance."""
        nearest = min(self.nearest, len(self.pivots))
        near = np.empty((len(units), nearest), np.int16)
        for at in range(0, len(units), 512):
            cosines = self.seen(units[at : at + 512]) @ self.pivots.T
            some = np.argpartition(-cosines, nearest - 1, axis=1)[:, :nearest]
            order = np.argsort(-np.take_along_axis(cosines, some, axis=1), axis=1, kind="stable")
            near[at : at + 512] = np.take_along_axis(some, order, axis=1)
        return near

    def sketch(self, units: np.ndarray) -> np.ndarray:
        """A row of bytes each: on which side of the planes a vector lies."""
        return np.packbits(units.astype(np.float32) @ self.planes > 0, axis=1)


def pair_keys(near: np.ndarray) -> np.ndarray:
    """The codes of all pairs of each vector's nearest pivots; of a single pivot, its own."""
    rising = np.sort(near, axis=1)
    pairs = [rising[:, a] << 16 | rising[:, b] for a, b in combinations(range(near.shape[1]), 2)]
    return np.stack(pairs, axis=1) if pairs else rising[:, :1] << 16 | rising[:, :1]


def shared_pivots(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many pivots up to number ``most`` each vector of a shares with each of b."""
    names, codes = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    hot = np.zeros((len(a) + len(b), len(names)), np.float32)
    hot[np.repeat(np.arange(len(hot)), a.shape[1]), codes] = 1
    hot[:, names > most] = 0
    return hot[: len(a)] @ hot[len(a) :].T


def taken_pairs(near: tuple, key: int, same: bool) -> np.ndarray:
    """Which vectors of two blocks of a list are compared at this key."""
    single = (key >> 16) == (key & 0xFFFF)  # one pivot in all
    taken = shared_pivots(near[0], near[1], key & 0xFFFF) == (1 if single else 2)
    return np.triu(taken, 1) if same else taken


def partners(near: tuple, sketches: tuple, key: int, most: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which members of two blocks have a partner in the other that is compared at this key and whose sketch is near."""
    taken = taken_pairs(near, key, same)
    a, b = (np.unpackbits(x, axis=1).astype(np.float32) for x in sketches)
    differ = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)
    taken &= differ <= most
    return taken.any(axis=1), taken.any(axis=0)


def link_blocks(near: tuple, units: tuple, counts: tuple, key: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of two blocks of a list that are taken at this key.

    The number of vectors that each one of either block is linked with, copies
    counted, and a spanning forest of the links as rows of both.
    """
    linked = taken_pairs(near, key, same) & (units[0] @ units[1].T >= threshold)
    counted = linked @ counts[1], linked.T @ counts[0]
    group, forest = np.arange(len(units[0]) + (0 if same else len(units[1]))), []
    shift = 0 if same else len(units[0])
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i]):
            if group[i] != group[j + shift]:
                forest.append((int(i), int(j)))
                group[group == group[j + shift]] = group[i]
    return (counted[0] + counted[1], np.zeros(0, np.int64), forest) if same else (*counted, forest)


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per vector row.

    Links are pairs of rows found with cosine >= threshold in double precision;
    equal vectors always link. n_links counts the other rows linked directly,
    component_id is the smallest id reachable over links, itself included, and
    kept marks the row whose id that is. Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing, as do vectors of
    different lengths. Repeated rows are vectors of their own; a null id is never
    the smallest and is not kept. Other columns are not read. An empty table
    gives no rows. Pairs that share fewer than two of their nearest pivots are
    not found.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_describe, f"id {id_type}, sig string, vec binary"))
    classes = rows.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = cut(classes.withColumn("num", F.monotonically_increasing_id()))
    found = None
    for width in classes.groupBy(F.octet_length("vec").alias("w")).count().collect():  # one row per vector length
        made = _linked(classes.filter(F.octet_length("vec") == width["w"]), width["count"], threshold)
        found = made if found is None else found.union(made)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    counted = found.filter("n > 0").groupBy("num").agg(F.sum("n").alias("n"))
    edges = found.filter("other is not null").select(F.col("num").alias("a"), F.col("other").alias("b"))
    joined = classes.join(components(edges), F.col("num") == F.col("node")).select("num", "low", "root")
    lowest = joined.groupBy("root").agg(F.min("low").alias("lowest"))
    labels = classes.join(joined.join(lowest, "root").select("num", "lowest"), "num", "left").join(counted, "num", "left")
    labels = labels.select("sig", F.coalesce("lowest", "low").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = rows.select("id", "sig").join(labels, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _meet(packed: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each two blocks of a list, and each block with itself: rows (key, members, others), others null for the same."""
    inner = packed.filter("size(members) > 1").select("key", "members", F.lit(None).cast(packed.schema["members"].dataType).alias("others"))
    left = packed.filter("blocks > 1").select("key", "block", "members", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with")).filter(F.col("block") < F.col("with"))
    right = packed.filter("blocks > 1").select("key", F.col("block").alias("with"), F.col("members").alias("others"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].values.flatten() for c in (1, 2) if batch.column(c)[row].is_valid]
                yield run(batch.column(0)[row].as_py(), sides if len(sides) == 2 else sides * 2, len(sides) == 1)

    return inner.union(left.join(right, ["key", "with"]).select("key", "members", "others")).mapInArrow(each, schema)


def _linked(classes: DataFrame, count: int, threshold: float) -> DataFrame:
    """Rows (num, n, other) of classes with vectors of one length: numbers of links to sum up, and links of a spanning forest."""
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, count // CLASSES_PER_PIVOT))
    sample = np.stack([np.frombuffer(r["vec"], np.float64) for r in hash_sample(classes, wanted, "sig").select("sig", "vec").orderBy("sig").collect()])  # at most MOST_PIVOTS rows
    shared = classes.sparkSession.sparkContext.broadcast(Index(sample, threshold, wanted))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _matrix(batch.column(2))
                made = [[x.tobytes() for x in rows] for rows in (shared.value.describe(units), shared.value.sketch(units))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m, pa.binary()) for m in made)], ["num", "copies", "vec", "near", "sketch"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pair_keys(_pivots_of(batch.column(1)))
                again = pa.array(np.repeat(np.arange(len(made)), made.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), *(c.take(again) for c in batch.columns)], ["key", "num", "near", "sketch"])

    def first(key: int, sides: list, same: bool) -> pa.RecordBatch:
        """Rows (key, num) of members with a partner."""
        near = tuple(_pivots_of(side[1]) for side in sides)
        sketches = tuple(np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in side[2]]) for side in sides)
        some = partners(near, sketches, key, shared.value.most, same)
        nums = np.unique(np.concatenate([side[0].to_numpy()[x] for side, x in zip(sides, some, strict=True)]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(nums), key)), pa.array(nums)], ["key", "num"])

    def second(key: int, sides: list, same: bool) -> pa.RecordBatch:
        """Rows (num, n, other) of verified links."""
        names = [side[0].to_numpy() for side in sides]
        n, m, forest = link_blocks(tuple(_pivots_of(side[3]) for side in sides), tuple(_matrix(side[2]) for side in sides), tuple(side[1].to_numpy() for side in sides), key, threshold, same)
        nums, counts = (names[0], n) if same else (np.concatenate(names), np.concatenate([n, m]))
        some = counts > 0
        i, j = (np.array([f[k] for f in forest], np.int64) for k in (0, 1))
        none = pa.nulls(int(some.sum()), pa.int64())
        columns = [pa.array(np.concatenate([nums[some], names[0][i]])), pa.array(np.concatenate([counts[some], np.zeros(len(i), np.int64)])), pa.concat_arrays([none, pa.array(names[1][j])])]
        return pa.RecordBatch.from_arrays(columns, ["num", "n", "other"])

    def blocked(rows: DataFrame) -> DataFrame:
        """Rows (key, num, ...) with the number of blocks of their list and the one they are in."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        placed = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        return placed.withColumn("block", F.pmod(F.xxhash64("num", "key"), F.col("blocks")).cast("int")).drop("size")

    described = cut(classes.select("num", "copies", "vec").mapInArrow(describe, "num long, copies long, vec binary, near binary, sketch binary"))
    listed = described.select("num", "near", "sketch").mapInArrow(keys, "key long, num long, near binary, sketch binary")
    packed = cut(blocked(listed).groupBy("key", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("num", "near", "sketch")).alias("members")))
    active = cut(_meet(packed, first, "key long, num long").distinct())
    held = blocked(active).join(described.drop("sketch"), "num")
    again = cut(held.groupBy("key", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("num", "copies", "vec", "near")).alias("members")))
    return cut(_meet(again, second, "num long, n long, other long"))
