"""Language identification, word first with backoff to shorter character n-grams.

For a known word, each language's log frequency counts; an unseen word is
scored by its longest character n-grams that are known, falling back from five
letters to one. Words are runs of letters (Unicode category L), cut by one rule
in fitting and in prediction. The model is fitted on a bounded, hash-ordered
sample of distinct labelled texts and has a bounded number of words and n-grams
for each language of that sample, so it can be sent to every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import cut, hash_sample, release, slices, texts_of

UNKNOWN = "und"
#: Labelled texts that the model is fitted on at most.
SAMPLE_ROWS = 10_000
#: Words, and n-grams of each length, that each language keeps at most.
WORDS, GRAMS = 10_000, 5_000
LONGEST = 5
#: Bytes of text that are looked at in one step.
STEP = 1 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The lower-cased words of texts: whose each is, the distinct ones, and which of them each is."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL]+")
    owner, words = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets, dtype=np.int64))), parts.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    return owner[full.to_numpy(zero_copy_only=False)], coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def gram_codes(letters: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of ``size`` code points."""
    made = np.zeros(max(len(letters) - size + 1, 0), np.uint64)
    for j in range(size):
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + letters[j : j + len(made)] + np.uint64(size)
    return made


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass
class Model:
    """Languages in order; words and n-grams with their row in ``logs``, the log frequency in each language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray
    #: For each length the sorted codes of its n-grams and their rows.
    sizes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        for size in range(1, LONGEST + 1):
            own = [(g, r) for g, r in self.grams.items() if len(g) == size]
            codes = gram_codes(letters_of("".join(g for g, _ in own)), size)[::size] if own else np.zeros(0, np.uint64)
            order = np.argsort(codes, kind="stable")
            self.sizes.append((codes[order], np.array([r for _, r in own], np.int64)[order]))

    def of(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words, a row each; an unseen one's are the mean of its longest known n-grams'."""
        out = np.zeros((len(words), len(self.langs)), np.float64)
        rows = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[rows >= 0] = self.logs[rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        for size in range(LONGEST, 0, -1):
            codes, at = self.sizes[size - 1]
            if not len(left) or not len(codes):
                continue
            marked = [f"<{words[i]}>" for i in left]
            letters, lengths = letters_of("".join(marked)), np.fromiter(map(len, marked), np.int64, len(marked))
            owner = np.repeat(np.arange(len(left)), lengths)
            found = gram_codes(letters, size)
            inside = np.flatnonzero(owner[: len(found)] == owner[size - 1 :])  # not across two words
            place = np.minimum(np.searchsorted(codes, found[inside]), len(codes) - 1)
            known = codes[place] == found[inside]
            mine, hit = owner[inside[known]], at[place[known]]
            times = np.bincount(mine, minlength=len(left))
            sums = np.stack([np.bincount(mine, self.logs[hit, k], minlength=len(left)) for k in range(len(self.langs))], axis=1)
            out[left[times > 0]] = sums[times > 0] / times[times > 0, None]
            left = left[times == 0]
        return out


def classify(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is the winner's share of the odds that the mean log frequency of
    a word gives, sharpened by the square root of the number of words. Of
    languages with equal odds the alphabetically first wins.
    """
    named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    owner, words, which = words_of(texts)
    if not len(owner) or not model.langs:
        return named, scores
    counts = np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(counts)
    starts = np.cumsum(counts[some]) - counts[some]
    mean = np.add.reduceat(model.of(words)[which], starts, axis=0) / np.sqrt(counts[some])[:, None]
    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
    best = odds.argmax(axis=1)
    scores[some] = odds.max(axis=1) / odds.sum(axis=1)
    for i, k in zip(some.tolist(), best.tolist(), strict=True):
        named[i] = model.langs[k]
    return named, scores


def count_tokens(words: list[str], counts: np.ndarray) -> dict[tuple[int, str], int]:
    """How often words (length 0) and the n-grams of marked words (by their length) stand in a text of these word counts."""
    out: dict[tuple[int, str], int] = {}
    for word, n in zip(words, counts.tolist(), strict=True):
        out[0, word] = n
        marked = f"<{word}>"
        for size in range(1, LONGEST + 1):
            for i in range(max(1, len(marked) - size + 1)):
                gram = len(marked[i : i + size]), marked[i : i + size]
                out[gram] = out.get(gram, 0) + n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, size, token, n) of a batch's (lang, text)."""
    release()
    for batch in (part for whole in batches for part in slices(whole, 1, STEP)):
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            _, words, which = words_of(texts_of(batch.filter(pa.array([x == lang for x in langs])), 1))
            counts = count_tokens(words, np.bincount(which, minlength=len(words)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "size", "token", "n"])


def fit(df: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with a text and a language.

    At most ``sample_rows`` distinct (text, language) are used, chosen by a hash
    of the text; copies count once. Entries that are counted as often as the
    first one beyond WORDS or GRAMS are left out together. Without any, the model has no language and
    predicts ``und``.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("text is not null and lang is not null")
    sample = hash_sample(rows.withColumn("h", F.xxhash64("text")), sample_rows, "h", "lang").select("lang", "text", "h")
    counts = cut(sample.repartition(16, "h").drop("h").mapInArrow(_count, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n")))
    # as many rows as the sample has different counts: it tells how often the last entry that is kept stands, so no language is sorted in one task
    seen: dict[tuple, int] = {}
    total: dict[tuple, int] = {}
    least: dict[tuple, int] = {}
    for r in sorted(counts.groupBy("lang", "size", "n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["n"]):
        key = (r["lang"], r["size"])
        seen[key], total[key] = seen.get(key, 0) + r["m"], total.get(key, 0) + r["m"] * r["n"]
        if seen[key] <= (GRAMS if r["size"] else WORDS):
            least[key] = r["n"]
    langs = sorted({lang for lang, _ in total})
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0), np.float32))
    bounds = df.sparkSession.createDataFrame([(*k, n) for k, n in least.items()], "lang string, size int, least long")
    kept = counts.join(F.broadcast(bounds), ["lang", "size"]).filter("n >= least").select("lang", "size", "token", "n").collect()  # at most WORDS + 5 GRAMS rows a language

    logs: list[np.ndarray] = []

    def table(rows: list, scale: list[float]) -> dict[str, int]:
        """Rows of new log frequencies, with half a count added to each."""
        found: dict[str, np.ndarray] = {}
        for r in sorted(rows, key=lambda r: (r["lang"], -r["n"], r["token"])):
            found.setdefault(r["token"], np.zeros(len(langs)))[langs.index(r["lang"])] = r["n"]
        first, scaled = len(logs), np.array(scale, float) + 0.5 * len(found)
        logs.extend(np.log((c + 0.5) / scaled).astype(np.float32) for c in found.values())
        return {t: first + i for i, t in enumerate(found)}

    words_at = table([r for r in kept if not r["size"]], [total.get((x, 0), 0) for x in langs])
    most = [max(total.get((x, n), 0) for n in range(1, LONGEST + 1)) for x in langs]
    grams_at = table([r for r in kept if r["size"]], most)
    matrix = np.stack(logs) if logs else np.zeros((0, len(langs)), np.float32)
    return Model(langs, words_at, grams_at, matrix)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows as (id, *keep, lang_pred, score).

    ``und`` with score 0 where the text is null or has no letter, or the model
    no language; of equal scores the alphabetically first language wins. Only
    the text counts. Repeated rows stay, a null id stays null; other columns are
    kept if ``keep`` names them, whatever their names. An empty table gives no
    rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS, GRAMS and the number of languages
    names = keep or []
    numbered = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col]  # a text is handed over once
    cols = df.select(F.col(f"`{text_col}`").alias("text"), F.struct(F.col(f"`{id_col}`").alias("id"), *numbered).alias("kept"))
    whole = text_col in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in (part for b in batches for part in slices(b, 0, STEP)):
            named, scores = classify(shared.value, texts_of(batch, 0))
            yield pa.RecordBatch.from_arrays([*(batch.columns[:1] if whole else []), batch.column(1), pa.array(named, pa.string()), pa.array(scores)], [*["text"] * whole, "kept", "lang_pred", "score"])

    schema = f"{'text string, ' * whole}kept {cols.schema['kept'].dataType.simpleString()}, lang_pred string, score double"
    out = cols.mapInArrow(run, schema)
    kept = [F.col("text").alias(c) if c == text_col else F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(F.col("kept.id").alias(id_col), *kept, "lang_pred", "score")
