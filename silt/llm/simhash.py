"""SimHash near-duplicates through pivot distance tables.

Reference fingerprints come in a base and one family per block of bits; a
family's members differ from the base inside their block only. The table of a
fingerprint holds its Hamming distances to them. Of two fingerprints the largest
coordinate difference of their tables is a lower bound of their distance: pairs
over the radius are discarded, survivors are verified.

``near_duplicates`` links fingerprints within a small radius. Within a family
the differences to the base distance depend on one block's bits alone, and two
fingerprints that differ in at most ``radius`` bits agree in all but ``radius``
blocks; so with ``radius`` + 2 blocks any such pair has two families with equal
distance differences, and the tuples of two families are the keys that pairs are
retrieved by - without loss. A key's group of more than GROUP members is split by
further coordinates in the same way: families of the blocks that the bits not
yet compared fall into. Three such steps leave eight bits, so no group stays
large, and none is treated otherwise for its size.

``similar_documents`` links documents by the similarity of their sets of word
shingles. In any one order of all shingles two sets of similarity t share one of
the first n - ceil(t n) + 1 of each; documents that do are candidates. Parity sketches
of the sets discard without loss, large sets' fingerprint tables discard beyond a
radius that alike sets stay under, and the whole sets verify the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.llm.common import components, cut, give_back, hash_sample, release, slices

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Members of each reference family.
FAMILY = 12
#: Key groups over this size are split by further coordinates, at most so often.
GROUP, SPLITS = 256, 3
#: Documents looked at for common shingles, in how many of them one is common, and how many are told apart.
SAMPLE_ROWS, COMMON_IN, COMMON = 4_000, 3, 100_000
#: Candidates of one shingle that are compared in one step; words of the bit set that tells whose sets are wanted.
BLOCK, BITS = 512, 1 << 25
#: Shingles from which on a set's fingerprint discards; words of a set's parity sketch.
SURE = 100
SKETCH = ["s0", "s1", "s2", "s3"]
#: Shingles before a set's shingle in the order, by which a pair is known to have met already.
PRIOR = ["p0", "p1", "p2", "p3"]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; of fewer words the one of all, of none nothing."""
    import xxhash

    clean = _SPACES.sub(b" ", text.translate(_LOWER)).strip(b" ")
    if not clean:
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(clean, np.uint8) == 32) + 1])
    ends = np.append(starts[1:] - 1, len(clean))
    if len(starts) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(clean[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 without a hash."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; 0 without a word."""
    return majority(shingle_hashes(text, shingle))


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp long) of all documents; a null text has fingerprint 0."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            made = [fingerprint(_bytes(t), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def references(free: int, blocks: int) -> tuple[list[np.ndarray], list[int]]:
    """Families of reference fingerprints, one for each block that the bits of ``free`` are cut into, and the blocks; the base reference is zero."""
    rng, families, masks = np.random.default_rng(64), [], []
    bits = np.array([b for b in range(64) if free >> b & 1], np.uint64)
    for block in np.array_split(bits, blocks):
        patterns = rng.permuted(np.tile(np.arange(len(block)) % 2, (FAMILY, 1)), axis=1).astype(np.uint64)
        families.append((patterns << block).sum(axis=1, dtype=np.uint64))
        masks.append(sum(1 << int(b) for b in block))
    return families, masks


ALL = (1 << 64) - 1


def distance_table(fps: np.ndarray, families: list[np.ndarray]) -> np.ndarray:
    """Hamming distances to the base and to each family's members: one column each."""
    refs = np.concatenate([np.zeros(1, np.uint64), *families])
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)


def _keys(fps: np.ndarray, free: int, blocks: int) -> list[tuple[int, np.ndarray]]:
    """For each two families of the free bits a 64-bit key of the distance differences to the base, and the bits that stay free."""
    families, masks = references(free, blocks)
    table = distance_table(fps, families)
    relative = (table[:, 1:] - table[:, :1]).astype(np.int64).view(np.uint64).reshape(len(fps), len(families), FAMILY)
    codes = np.zeros((len(fps), len(families)), np.uint64)
    for j in range(FAMILY):
        codes = codes * np.uint64(131) + relative[:, :, j] + np.uint64(64)
    out = []
    for a, b in combinations(range(len(families)), 2):
        mixed = (codes[:, a] * np.uint64(0x9E3779B97F4A7C15) + codes[:, b]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(masks[a] | masks[b])
        out.append((free & ~(masks[a] | masks[b]), mixed ^ (mixed >> np.uint64(29))))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, families: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Spanning links of one key's group: (larger row, smaller row)."""
    table = distance_table(fps, families)
    parent = np.arange(len(fps))
    links = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.abs(table[:i] - table[i]).max(axis=1) <= radius)
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        for root in np.unique(parent[near]):
            links.append((i, int(near[parent[near] == root][0])))
            parent[parent == root] = i
    return links


def link_edges(distinct: DataFrame, radius: int = 2, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, connecting exactly what links within ``radius`` bits connect."""
    blocks = radius + 2
    families, _ = references(ALL, blocks)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, free, fp) by two more families each."""
        for batch in batches:
            before, free, fps = (c.to_numpy().view(np.uint64) for c in batch.columns)
            for mask in np.unique(free):
                rows = np.flatnonzero(free == mask)
                for left, made in _keys(fps[rows], int(mask), blocks):
                    mixed = before[rows] * np.uint64(0x9E3779B97F4A7C15) + made
                    yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(np.full(len(rows), _signed(left), np.int64)), pa.array(fps[rows].view(np.int64))], ["key", "free", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                fps = np.array(members.as_py(), np.int64)
                for i, j in _forest(fps.view(np.uint64), families, radius):
                    a.append(int(fps[i]))
                    b.append(int(fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    schema, out = "key long, free long, fp long", None
    rows = distinct.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"), "fp")
    for split in range(SPLITS + 1):
        keyed = rows.mapInArrow(keys, schema)
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        shared = cut(keyed.join(sizes, "key"))
        last = split == SPLITS  # too few bits are free for more than a few hundred fingerprints
        small = shared if last else shared.filter(F.col("n") <= group)
        near = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(compare, "a long, b long")
        out = near if out is None else out.union(near)
        rows = shared.filter(F.col("n") > group).select("key", "free", "fp")
        if last or rows.isEmpty():
            return out.distinct()


def near_duplicates(df: DataFrame, radius: int = 2, shingle: int = 3, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id): one per document row, with the smallest id reachable over links.

    Fingerprints that differ in at most ``radius`` bits link; equal ones always
    do. Texts of fewer words than a shingle are one shingle; null, empty and
    wordless texts share fingerprint 0 and are linked like any other. Repeated
    rows stay; a null id is never the smallest, and is its component only where
    no other id is reachable. Other columns are not read. An empty table gives no
    rows.
    """
    docs = cut(fingerprints(df, shingle, id_col, text_col))
    distinct = cut(docs.groupBy("fp").agg(F.min("id").alias("low")))
    labels = _labels(distinct, components(link_edges(distinct, radius, group)), "fp")
    return docs.join(labels, "fp").select(F.col("id").alias(id_col), _hex("fp"), "component_id")


def _hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint")


def _labels(distinct: DataFrame, linked: DataFrame, name: str) -> DataFrame:
    """Rows (name, component_id): the smallest ``low`` that each of ``distinct`` is linked with."""
    roots = distinct.join(linked, F.col(name) == F.col("node")).select(name, "low", "root")
    lowest = roots.groupBy("root").agg(F.min("low").alias("lowest"))
    named = roots.join(lowest, "root").select(name, "lowest")
    return distinct.join(named, name, "left").select(name, F.coalesce("lowest", "low").alias("component_id"))


def prefix(sorted_hashes: np.ndarray, tenths: int, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two sets of that similarity share one; ``common`` (sorted) come last."""
    n = len(sorted_hashes)
    late = np.zeros(n, bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, sorted_hashes), len(common) - 1)] == sorted_hashes
    return np.concatenate([sorted_hashes[~late], sorted_hashes[late]])[: n - (n * tenths + 9) // 10 + 1]


def parity(hashes: np.ndarray) -> list[int]:
    """256 bits, each the parity of how many of a set's shingles fall to it: two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def _sets(df: DataFrame, shingle: int, schema: str, row, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows made of each (id, text) by ``row(hashes, set)``, after the id; of ids whose two bits are set in ``wanted``, if given."""
    names, kinds = zip(*(f.split(" ", 1) for f in schema.split(", ")), strict=True)
    arrow = [{"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[k] for k in kinds]
    id_type = df.schema["id"].dataType.simpleString()
    shared = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)  # BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            if shared is not None:
                both = [batch.column(c).to_numpy() for c in (2, 3)]
                hit = [shared.value[x >> 6] >> (x & 63).astype(np.uint64) & np.uint64(1) for x in both]
                batch = batch.filter(pa.array((hit[0] & hit[1]).astype(bool)))
            made = []
            for text in batch.column(1):
                hashes = shingle_hashes(_bytes(text), shingle)
                made.append(row(hashes, np.unique(hashes).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(arrow))], ["id", *names])
        give_back()

    return df.select("id", "text", *([] if wanted is None else _bits())).mapInArrow(run, f"id {id_type}, {schema}")


def _digest(hashes: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def _bits() -> list[Column]:
    """Two bits for an id."""
    return [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(BITS)).alias(f"bit{k}") for k in (1, 2)]


def _wanted(ids: DataFrame) -> np.ndarray:
    """The bits of all ids, as a set of fixed size: ids beyond it are told apart less, none is missed."""
    bit = ids.select(F.explode(F.array(*_bits())).alias("bit"))
    rows = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _meetings(rows: DataFrame, radius: int, tenths: int) -> DataFrame:
    """Pairs (a, b) of the members (key, m, ref, pos, prior keys, fp, n, root, sketch) of each key that differ in root and pass the distance tables and parity sketches.

    A pair meets at each shingle that the prefixes share, and is wanted once. Where
    one of the last few keys before this is in both prefixes, it has met there; the
    first that they share is never told so. If that one comes too late in one of the
    sets for enough to follow, the pair can't reach the similarity.

    The members of a key of at most BLOCK of them meet as one row. Of a larger
    key, a root's many members fill blocks of their own, which needn't meet each
    other; the others share blocks. Two blocks meet as one row, so a common key is
    spread over many tasks; only surviving pairs leave a meeting.
    """
    families, _ = references(ALL, 4)
    members = F.collect_list(F.struct("ref", "fp", "n", "root", "pos", *PRIOR, *SKETCH)).alias("members")
    few = rows.filter(F.col("m") <= BLOCK).groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), members).filter("r0 <> r1").select("members", F.lit(None).cast(rows.groupBy("key").agg(members).schema["members"].dataType).alias("others"))
    many = rows.filter(F.col("m") > BLOCK).drop("m")
    sized = many.groupBy("key", "root").agg(F.count("*").alias("m"))
    pooled = sized.groupBy("key").agg(F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))).alias("pool"), F.count("*").alias("roots")).filter("roots > 1")
    placed = many.join(sized, ["key", "root"]).join(pooled, "key").withColumn("large", F.col("m") > BLOCK)
    own = F.when(F.col("large"), F.col("root")).otherwise(F.lit(-1).cast("long"))
    part = F.when(F.col("large"), F.pmod(F.xxhash64("ref"), F.ceil(F.col("m") / BLOCK))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("pool") / BLOCK)))
    packed = cut(placed.groupBy("key", own.alias("own"), part.alias("part")).agg(members))
    inner = packed.filter("own = -1 and size(members) > 1").select("members", F.lit(None).cast(packed.schema["members"].dataType).alias("others"))
    # a key's blocks have numbers; each is sent to the numbers it meets, so a common key's meetings are dealt by (key, number)
    along = Window.partitionBy("key").orderBy("own", "part")
    numbers = packed.select("key", "own", "part").withColumn("number", F.row_number().over(along))
    most = numbers.groupBy("key").agg(F.max("number").alias("most"))
    numbered = cut(packed.join(numbers.join(most, "key"), ["key", "own", "part"]))
    sent = numbered.filter("number < most").withColumn("other", F.explode(F.expr("sequence(number + 1, most)"))).select("key", F.col("other").alias("number"), "own", "members")
    met = sent.join(numbered.select("key", "number", F.col("own").alias("theirs"), F.col("members").alias("others")), ["key", "number"])
    across = met.filter("own <> theirs or own = -1").select("members", "others")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(side)[row] for side in (0, 1) if batch.column(side)[row].is_valid]
                (a, fa, na, ra, ta, *ca), (b, fb, nb, rb, tb, *cb) = ([c.to_numpy() for c in side.values.flatten()] for side in (sides * 2)[:2])
                after = np.minimum((na - ta)[:, None], (nb - tb)[None, :])  # also says that the sizes are alike
                may = (ra[:, None] != rb[None, :]) & ((10 + tenths) * after >= tenths * (na[:, None] + nb[None, :]))
                i, j = np.nonzero(np.triu(may, 1) if len(sides) == 1 else may)
                # of sets of that similarity at most this share of the members is not in both
                like = (10 + tenths) * differing(ca[len(PRIOR) :], cb[len(PRIOR) :], i, j) <= (10 - tenths) * (na[i] + nb[j])
                i, j = i[like], j[like]
                met = np.zeros(len(i), bool)
                for x in ca[: len(PRIOR)]:
                    for y in cb[: len(PRIOR)]:
                        met |= (x[i] == y[j]) & (x[i] != 0)
                i, j = i[~met], j[~met]
                if not len(i):
                    continue
                i, j = discard(fa.view(np.uint64), fb.view(np.uint64), i, j, families, radius, np.minimum(na[i], nb[j]) >= SURE)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], ["a", "b"])

    return few.union(inner).union(across).mapInArrow(meet, "a long, b long").distinct()


def differing(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bits in which the sketches of the pairs i, j differ."""
    out = np.zeros(len(i), np.int64)
    for x, y in zip(left, right, strict=True):
        out += np.bitwise_count((x[i] ^ y[j]).view(np.uint64))
    return out


def discard(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, families: list[np.ndarray], radius: int, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a[i], b[j] those that are not ``sure``, or whose largest coordinate difference, and then whose distance, is within the radius."""
    left, right = distance_table(a, families), distance_table(b, families)
    out = [], []
    for at in range(0, len(i), 1 << 16):
        x, y, told = (z[at : at + (1 << 16)] for z in (i, j, sure))
        near = ~told | (np.abs(left[x] - right[y]).max(axis=1) <= radius)
        close = near & told
        near[close] = np.bitwise_count(a[x[close]] ^ b[y[close]]) <= radius
        out[0].append(x[near])
        out[1].append(y[near])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def similar_documents(df: DataFrame, shingle: int = 5, tenths: int = 8, radius: int = 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text_hash, fingerprint, component_id, leads) of all rows with an id, linked where the sets of word shingles have a Jaccard similarity of ``tenths`` / 10 or more.

    ``text_hash`` is xxhash64 of the text and tells rows of one id apart; the row
    that leads a group has its smallest id and, of that, the smallest hash. Equal
    sets always link; texts of fewer words than a shingle are one
    shingle, and null, empty and wordless texts are equal. ``radius`` only
    discards, and only sets of SURE shingles and more: a bit is what most of the
    distinct shingles have, so two sets of similarity 0.8 differ in it with a
    probability of 0.15 whatever they hold, in 9.7 of 64 bits on average; more
    than 26 is one link in five million, while of unlike documents one in twelve
    passes. Smaller sets scatter more and are told apart by their sketches alone, without loss. Repeated rows stay, rows without an id
    are left out, other columns are not read. An empty table gives no rows.

    The candidates of a shingle first meet one of them, that with the most
    copies; only those in different groups after that are compared with each
    other. Shingles that a sample shows to be common come last in the order; the
    sample steers the work, not the result.
    """
    named = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    docs = df.filter(F.col(id_col).isNotNull()).select(named.alias("id"), F.col(text_col).alias("text"))
    seen = _sets(hash_sample(docs, SAMPLE_ROWS, "id"), shingle, "all array<long>", lambda h, s: (s,)).select(F.explode("all").alias("key"))
    often = seen.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_IN)
    common = np.sort(np.array([r["key"] for r in often.orderBy(F.col("n").desc(), "key").limit(COMMON).collect()], np.int64))
    families, _ = references(ALL, 4)

    rows = cut(_sets(docs, shingle, "digest long, n long, fp long, first array<long>, " + ", ".join(f"{c} long" for c in SKETCH), lambda h, s: (_digest(s), len(s), _signed(majority(s.view(np.uint64))), prefix(s, tenths, common), *parity(s))))
    same = ["digest", "n"]
    texts = rows.groupBy(*same).agg(F.min(F.struct("id", "fp")).alias("low"), F.count("*").alias("copies"), F.first("first").alias("first"), *[F.first(c).alias(c) for c in SKETCH])
    # a row number that sorts texts of many copies first
    ref = F.monotonically_increasing_id() + (31 - F.floor(F.log2("copies"))) * F.lit(1 << 57)
    texts = cut(texts.select(*same, F.col("low.id").alias("low"), F.col("low.fp").alias("fp"), "first", ref.cast("long").alias("ref"), *SKETCH))
    told = texts.select("ref", "fp", "n")
    keyed = texts.filter("n > 0").select(F.posexplode("first").alias("pos", "key"), "ref")
    heads = keyed.groupBy("key").agg(F.min("ref").alias("head"), F.max("ref").alias("last"), F.count("*").alias("m")).filter("head < last").select("key", "head", "m")
    shared = cut(keyed.join(heads, "key"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in (2, 3))
            i, least = np.arange(len(a)), batch.column(4).to_numpy()
            yield batch.take(pa.array(discard(a, b, i, i, families, radius, least >= SURE)[0])).select([0, 1])

    def close(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) within the radius those whose whole sets, made again from the texts of those alone, have the similarity."""
        lows = texts.select("ref", "digest", F.col("low").alias("id"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct().join(lows, "ref")
        made = _sets(docs, shingle, "digest long, all array<long>", lambda h, s: (_digest(s), s), _wanted(wanted.select("id")))
        sets = cut(made.dropDuplicates(["id", "digest"]).join(wanted, ["id", "digest"]).select("ref", "all"))
        both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").withColumn("shared", F.size(F.array_intersect("x", "y")))
        return cut(both.filter(10 * F.col("shared") >= tenths * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b"))

    star = shared.filter("ref <> head").select(F.col("head").alias("a"), F.col("ref").alias("b")).distinct()
    star = star.join(told.toDF("a", "fa", "na"), "a").join(told.toDF("b", "fb", "nb"), "b").filter(10 * F.least("na", "nb") >= tenths * F.greatest("na", "nb"))
    starred = close(cut(star.select("a", "b", "fa", "fb", F.least("na", "nb").alias("least")).mapInArrow(near, "a long, b long")))
    roots = texts.select("ref", "fp", "n", "first", *SKETCH).join(components(starred), F.col("ref") == F.col("node"), "left").select("ref", "fp", "n", "first", F.coalesce("root", "ref").alias("root"), *SKETCH)
    prior = [F.when(F.col("pos") > i, F.element_at("first", F.greatest(F.col("pos") - i, F.lit(1)))).otherwise(F.lit(0)).alias(p) for i, p in enumerate(PRIOR)]
    apart = shared.select("key", "m", "ref", "pos").join(roots, "ref").select("key", "m", "ref", F.col("pos").cast("long").alias("pos"), *prior, "fp", "n", "root", *SKETCH)
    found = starred.union(close(cut(_meetings(apart, radius, tenths))))
    labels = texts.select("ref", *same, "low").join(_labels(texts.select("ref", "low"), components(found), "ref"), "ref").select(*same, "component_id")
    return rows.join(labels, same).select(F.col("id.id").alias(id_col), F.col("id.hash").alias("text_hash"), _hex("fp"), F.col("component_id.id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("leads"))
