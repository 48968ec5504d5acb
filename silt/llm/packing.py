"""Packing documents into fixed token windows by minimum bin slack.

Documents become token ids (through the distinct-word table of ``common``) and
are cut at multiples of the window; whole windows stand alone and the rest, one
piece shorter than a window per document, is packed. Packing needs only the
histogram of piece lengths, whose size is bounded by the window, never by the
data: again and again the longest remaining length is set into a window, a
bitset subset-sum finds the multiset of remaining lengths that fills the window
closest to capacity, its counts are traced back, and the multiset is repeated as
often as the histogram allows. Which piece gets which place follows from its
rank among the pieces of its length; ranks are counted per (length, salt) and
summed up, so a length that a third of all documents share is spread out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.llm.common import WordTable, cut, flat, held, row_numbers, slices, spread, texts_of

#: Parts that the pieces of one length are dealt into for ranking.
SALTS = 512
#: Distinct words that a worker keeps, and bytes of text it segments in one step.
WORDS, STEP = 100_000, 1 << 20


#: The tokenizer's own split of a word; used only for words of these characters, on which all Unicode versions agree.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\w\s]+|_")
_KNOWN = re.compile(r"(?!.*<\|)[!-^`-~À-ÖØ-öø-ÿ]+")


class Segmenter:
    """Ids of words, as the tokenizer gives them.

    A word of known characters is split as the tokenizer splits it and its parts
    go, many in one call, through the same merges: a word end is one more byte
    (zero, which no such part has), and a token's id is its merge rank. All
    other words go through the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        coded = {t: bytes(letters[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>") for t in model["vocab"] if not t.startswith("<|")}
        ranks = {b: model["vocab"][t] for t, b in coded.items()}
        firsts = max(model["vocab"][t] for t in coded if len(t.removesuffix("</w>")) == 1)
        order = [model["vocab"]["".join(m)] for m in model["merges"]]
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}) if order == sorted(order) and order[0] > firsts and len(ranks) == len(coded) else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for b, i in ranks.items() if b.endswith(b"\0")]] = True

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has."""
        if self.merges is None:
            return self.alone(words)
        known = np.fromiter((bool(_KNOWN.fullmatch(w)) for w in words), bool, len(words))
        split = [_SPLIT.findall(w.lower()) for w, k in zip(words, known, strict=True) if k]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        text = "".join([part + "\0" for parts in split for part in parts])
        ids = self.merges.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[np.concatenate([[0], np.cumsum(counts)])]
        if known.all():
            return ids, np.diff(stops)
        other, others = self.alone([w for w, k in zip(words, known, strict=True) if not k])
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[known], starts[known] = np.diff(stops), stops[:-1]
        lengths[~known], starts[~known] = others, len(ids) + np.cumsum(others) - others
        return spread(np.concatenate([ids, other]), starts, lengths), lengths


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


def word_table(tokenizer_path: str) -> WordTable:
    """A worker's distinct words. Tokens never cross a space, so words are segmented alone."""
    return held(("words", tokenizer_path), lambda: WordTable(Segmenter(tokenizer_path), limit=WORDS))


def token_ids(texts: pa.Array, known: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin."""
    plain = texts
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's string counts by its case
        plain = pc.ascii_lower(texts)
    parts = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
    return known.take(parts.flatten(), np.asarray(parts.offsets, dtype=np.int64))


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack on a histogram of lengths: [(repeats, [(length, count), ...]), ...].

    Each entry is a multiset of lengths for one window and how many windows are
    filled that way. Lengths are 1 to ``window``; every length of the histogram
    is used exactly as often as it occurs.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while left:
        anchor = max(left)
        left[anchor] -= 1
        room, reach, steps = window - anchor, 1, []
        full = (1 << (room + 1)) - 1
        for length in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
            if reach >> room & 1:
                break
            steps.append((length, reach))
            count, power = min(left[length], room // length), 1
            while count:
                take = min(power, count)
                reach |= reach << (take * length) & full
                count, power = count - take, power * 2
        at = reach.bit_length() - 1
        chosen = {anchor: 1}
        for length, before in reversed(steps):
            used = 0
            while not before >> at & 1:
                used, at = used + 1, at - length
            if used:
                chosen[length] = chosen.get(length, 0) + used
        left[anchor] += 1
        repeats = min(left[n] // c for n, c in chosen.items())
        for n, c in chosen.items():
            left[n] -= c * repeats
            if not left[n]:
                del left[n]
        plan.append((repeats, sorted(chosen.items(), reverse=True)))
    return plan


class Places:
    """For each length, which ranks go to which windows; built from a plan, bounded by the window."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        first, used, rows = 0, {}, {}
        for repeats, items in plan:
            offset = 0
            for length, count in items:
                rows.setdefault(length, []).append((used.get(length, 0), first, count, offset))
                used[length] = used.get(length, 0) + repeats * count
                offset += length * count
            first += repeats
        self.rows = {n: np.array(r, dtype=np.int64) for n, r in rows.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of the pieces of one length with these ranks (from 0)."""
        rows = self.rows[length]
        at = rows[np.searchsorted(rows[:, 0], ranks, side="right") - 1]
        within = ranks - at[:, 0]
        return at[:, 1] + within // at[:, 2], at[:, 3] + within % at[:, 2] * length


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int, window: int, payload: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, start, length, doc_tokens, piece, payload) of each document's pieces; piece is a number of its own."""
    id_type = df.schema[id_col].dataType.simpleString()
    kind = {"ids": "array<int>", "crc32": "bigint"}[payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = word_table(tokenizer_path), 0
        for batch in batches:
            for part in slices(batch, 1, STEP):
                ids, bounds = token_ids(texts_of(part, 1), known)
                rows, starts, lengths, totals, extra = [], [], [], [], []
                for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.int32(end_id)).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(piece))
                        totals.append(len(own))
                        extra.append(zlib.crc32(piece.tobytes()) if payload == "crc32" else piece.tolist())
                out = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(row_numbers(made, len(rows)))]
                out.append(pa.array(extra, pa.int64() if payload == "crc32" else pa.list_(pa.int32())))
                made += len(rows)
                yield pa.RecordBatch.from_arrays(out, ["id", "start", "length", "doc_tokens", "piece", payload])

    cols = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"id {id_type}, start long, length long, doc_tokens long, piece long, {payload} {kind}")


def pack(df: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, payload: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset and the piece's ids (or their crc32).

    A document is its text's ids and ``end_id``; a null or empty text is the end
    id alone. Pieces of a document are disjoint and cover it; no sequence has
    more than ``window`` ids and its offsets have no gaps. Repeated rows are
    packed each by itself; a null id stays null; other columns are not read. An
    empty table gives no rows.
    """
    pieces = cut(token_pieces(df, tokenizer_path, end_id, window, payload, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    places = Places(plan_windows(histogram, window))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("length", "salt").orderBy("piece")
    ranked = salted.withColumn("rank", F.row_number().over(inner) - 1).join(firsts, ["length", "salt"])
    keep = ["id", "start", "length", "doc_tokens", payload]
    ranked = ranked.select(*keep, (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                sequence[group], offset[group] = places.of(int(lengths[group[0]]), ranks[group])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:5]) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
