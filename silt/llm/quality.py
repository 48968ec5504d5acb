"""Quality by ordinal cumulative-link regression on hashed text.

A document's grade y in 0..K-1 is modelled as P(y <= k) = sigmoid(t_k - w.x): one
weight vector w shared by all grades, over hashed words and hashed traits of the
text, and ordered thresholds t_0 < t_1 < ... Expected grade and the tail
probability of the top grade come from the same link; the tail selects.

The model is fitted on a bounded, hash-ordered sample of graded rows, gathered as
hashed features; everything else runs over all rows. A model has a fixed number
of weights, so it can be sent to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import cut, hash_sample, release, slices, texts_of

#: Graded rows that the model is fitted on at most; hashed weights.
SAMPLE_ROWS, BUCKETS = 8_000, 1 << 18
#: Bytes of text that are looked at in one step.
STEP = 1 << 20
#: Words in fewer sampled texts than this, or as common above as below every threshold (by this many deviations), get no weight.
LEAST_TEXTS, LEAST_DEVIATIONS = 8, 4.5
#: Letters of a word's openings that are features as the word is.
OPENINGS = (4, 6)
#: Weights after the hashed ones: shouted words, tails, signs alone, words repeated at once, and one of every text.
TRAITS = range(BUCKETS, BUCKETS + 5)
WEIGHTS = BUCKETS + len(TRAITS)
#: A token's punctuation ends are cut to see its word.
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”’…"


#: Powers of an odd number: the weights of a word's letters in its hash.
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def hashed(words: pa.Array, *openings: int) -> np.ndarray:
    """Buckets of words, and of their first letters for each of ``openings``: a column each."""
    lengths = pc.fill_null(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = (letters + np.uint64(1)) * _POWERS[place % 256] * (place // 256 + 1).astype(np.uint64)
    ends, out = np.concatenate([[0], np.cumsum(lengths)]), []
    for salt, most in enumerate((None, *openings)):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms if most is None else terms * (place < most))])
        sums = running[ends[1:]] - running[ends[:-1]]
        mixed = (sums + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % BUCKETS)
    return np.stack(out, axis=1)


def describe(tokens: pa.Array) -> np.ndarray:
    """A row each: a token's trait - 1 shouted, 2 a tail of two or more signs, 3 signs alone, else 0 - and the buckets of its word and the word's openings."""
    number = lambda x: x.to_numpy(zero_copy_only=False)
    word = pc.utf8_trim(tokens, characters=_ENDS)
    size = number(pc.utf8_length(word))
    tail = number(pc.utf8_length(tokens)) - number(pc.utf8_length(pc.utf8_rtrim(tokens, characters=_ENDS)))
    trait = np.select([size == 0, tail >= 2, (size > 1) & number(pc.utf8_is_upper(word))], [3, 2, 1], 0)
    return np.column_stack([trait, hashed(pc.utf8_lower(word), *OPENINGS)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whose, bucket and value of all features of texts, by text: words and openings by presence, traits by their share of the tokens."""
    parts = pc.utf8_split_whitespace(texts)
    counts = np.diff(np.asarray(parts.offsets, dtype=np.int64))
    owner, tokens = np.repeat(np.arange(len(texts)), counts), parts.flatten()
    full = pc.not_equal(pc.binary_length(tokens), 0)  # an empty text has one empty token
    owner, coded = owner[full.to_numpy(zero_copy_only=False)], tokens.filter(full).dictionary_encode()
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    told = describe(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    every = np.sort((owner[:, None] * BUCKETS + told[:, 1:]).ravel())
    present = every[np.concatenate([[True], every[1:] != every[:-1]])]
    n = np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(n)
    shares = [4 * np.bincount(owner[told[:, 0] == k], minlength=len(texts)) / np.maximum(n, 1) for k in (1, 2, 3)]
    again = np.flatnonzero((told[1:, 1] == told[:-1, 1]) & (owner[1:] == owner[:-1]))
    shares += [4 * np.bincount(owner[again], minlength=len(texts)) / np.maximum(n - 1, 1), np.full(len(texts), 0.5)]
    whose = np.concatenate([present // BUCKETS, *[some] * len(TRAITS)])
    at = np.concatenate([present % BUCKETS, *[np.full(len(some), t) for t in TRAITS]])
    value = np.concatenate([np.full(len(present), 0.5), *[share[some] for share in shares]])
    order = np.argsort(whose, kind="stable")
    return whose[order], at[order], value[order].astype(np.float32)


@dataclass
class Model:
    """Shared weights and ordered thresholds; without thresholds it knows one grade only."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grade(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade of each text, and the probability of the top grade."""
        if not len(self.thresholds):
            return np.zeros(len(texts)), np.ones(len(texts))
        whose, at, value = features(texts)
        score = np.bincount(whose, self.weights[at].astype(np.float64) * value, minlength=len(texts))
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return above.sum(axis=1), above[:, -1]


def telling(texts: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Features that get a weight; texts[i, k] is how many texts of grade k have feature i, grades[k] how many there are."""
    held, apart = texts.sum(axis=1), np.zeros(len(texts))
    for k in range(len(grades) - 1):
        share = grades[: k + 1].sum() / grades.sum()
        chance = np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
        apart = np.maximum(apart, np.abs(texts[:, : k + 1].sum(axis=1) - held * share) / chance)
    apart[list(TRAITS)] = np.inf  # every text has them; their values tell
    return np.flatnonzero((held >= LEAST_TEXTS) & (apart >= LEAST_DEVIATIONS))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray, int]], names: np.ndarray, grades: int, passes: int = 300, rate: float = 0.15, decay: float = 4e-4) -> Model:
    """Maximum likelihood of the cumulative link over the features ``names``, by Adam over all rows at once.

    Rows are (places in ``names``, values, grade). Thresholds are the first one
    and positive steps, so they stay ordered. Grades are weighed by the square
    root of how rare they are.
    """
    y = np.array([g for *_, g in rows])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(WEIGHTS, np.float32), np.zeros(0))
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, *_ in rows])
    at, x, size = np.concatenate([b for b, *_ in rows]), np.concatenate([v for _, v, _ in rows]).astype(np.float64), len(names)
    rarity = np.sqrt(len(y) / (grades * np.maximum(np.bincount(y, minlength=grades), 1)))[y]
    rarity /= rarity.sum()
    share = np.cumsum(np.bincount(y, minlength=grades))[:-1] / len(y)
    start = np.log((share + 0.01) / (1.01 - share))
    state = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, passes + 1):
        steps = np.exp(state[size + 1 :])
        t = state[size] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(owner, x * state[at], minlength=len(y))
        edges = np.concatenate([np.full((len(y), 1), -40.0), np.clip(t[None, :] - score[:, None], -40, 40), np.full((len(y), 1), 40.0)], axis=1)
        below = 1 / (1 + np.exp(-edges))
        rows_at = np.arange(len(y))
        low, high = below[rows_at, y], below[rows_at, y + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = rarity * high * (1 - high) / p, rarity * low * (1 - low) / p
        d_score = d_high - d_low  # of the loss, by the score
        d_t = np.array([d_low[y == k + 1].sum() - d_high[y == k].sum() for k in range(grades - 1)])
        tail = np.cumsum(d_t[::-1])[::-1]
        slope = np.concatenate([np.bincount(at, x * d_score[owner], minlength=size) + decay * state[:size], tail[:1], tail[1:] * steps])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(WEIGHTS, np.float32)
    weights[names] = state[:size]
    thresholds = state[size] + np.concatenate([[0.0], np.cumsum(np.exp(state[size + 1 :]))])
    return Model(weights, thresholds)


def fit(docs: DataFrame, graded: DataFrame, grades: int, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``graded`` rows (id, grade) and their texts in ``docs``.

    At most ``sample_rows`` graded ids are used, chosen by a hash; an id graded
    more than once counts with its lowest grade. Of texts that several rows have
    for one id, the one with the smallest hash counts. Null ids and grades beyond 0 to grades - 1 don't
    count. Without two different grades the model accepts everything.
    """
    once = graded.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).filter(f"id is not null and grade between 0 and {grades - 1}").groupBy("id").agg(F.min("grade").alias("grade"))
    sample = F.broadcast(cut(hash_sample(once, sample_rows, "id")))  # at most sample_rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (part for whole in batches for part in slices(whole, 1, STEP)):
            whose, at, value = features(texts_of(batch, 1))
            ends = np.searchsorted(whose, np.arange(len(batch) + 1))
            made = [[x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] for x in (at.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m, pa.binary()) for m in made), batch.column(2)], ["id", "b", "v", "grade"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (at, grade, n) of a batch."""
        for batch in batches:
            codes = [np.frombuffer(b, np.int32) * np.int64(grades) + g for b, g in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((code // grades).astype(np.int32)), pa.array((code % grades).astype(np.int32)), pa.array(n.astype(np.int64))], ["at", "grade", "n"])

    id_type = texts.schema["id"].dataType.simpleString()
    made = texts.select("id", "text", "grade").mapInArrow(run, f"id {id_type}, b binary, v binary, grade int")
    made = cut(made.groupBy("id").agg(F.min(F.struct(F.xxhash64("b"), "b", "v", "grade")).alias("r")).select("r.b", "r.v", "r.grade"))
    sizes = np.zeros(grades)
    for r in made.groupBy("grade").count().collect():
        sizes[r["grade"]] = r["count"]
    counted = made.mapInArrow(count, "at int, grade int, n long").groupBy("at").agg(*[F.sum(F.when(F.col("grade") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(grades)], F.sum("n").alias("n"))
    counts = counted.filter(F.col("n") >= LEAST_TEXTS).drop("n").toPandas()  # at most WEIGHTS rows
    held = np.zeros((WEIGHTS, grades))
    held[counts["at"].to_numpy(np.int64)] = counts.drop(columns="at").to_numpy(float)
    names = telling(held, sizes)
    place = np.full(WEIGHTS, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features that get a weight, by their place among those."""
        for batch in batches:
            at = [place[np.frombuffer(b, np.int32)] for b in batch.column(0).to_pylist()]
            value = [np.frombuffer(v, np.float32)[k >= 0].tobytes() for v, k in zip(batch.column(1).to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k[k >= 0].tobytes() for k in at], pa.binary()), pa.array(value, pa.binary()), batch.column(2)], ["b", "v", "grade"])

    rows = made.mapInArrow(used, "b binary, v binary, grade int").collect()  # at most sample_rows rows
    rows = sorted((r["grade"], r["b"], r["v"]) for r in rows)
    return fit_ordinal([(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(v, np.float32), g) for g, b, v in rows], names, grades)


def score(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and expected_grade, tail_prob (of the top grade) and accepted (tail_prob >= least).

    A null or empty text has no features and is graded by the thresholds alone.
    Rows are never dropped or repeated; columns named like the results are
    replaced. An empty table gives no rows.
    """
    names = ["expected_grade", "tail_prob", "accepted"]
    rest = [c for c in df.columns if c not in names]
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest) if c != text_col]
    cols = df.select(F.col(f"`{text_col}`").alias("text"), F.struct(*numbered, F.lit(0).alias("none")).alias("kept"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # WEIGHTS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (part for whole in batches for part in slices(whole, 0, STEP)):
            expected, tail = shared.value.grade(texts_of(batch, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], ["text", "kept", *names[:2]])

    schema = f"text string, kept {cols.schema['kept'].dataType.simpleString()}, expected_grade double, tail_prob double"
    out = cols.mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"kept.c{i}").alias(c) for i, c in enumerate(rest)], *names[:2], (F.col("tail_prob") >= least).alias(names[2]))
