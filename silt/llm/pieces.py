"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model has a whitespace marker after another character, so a
merge can never cross from a word into the marker that follows it; the same
holds around a line feed, which is only ever a byte piece. A text is therefore
cut into marked words - a run of markers or a line feed, and what follows up to
the next - and each distinct one is segmented once by the library; ids are
joined back by position. The table of a Python worker lives across batches and
tasks and is trimmed at a fixed size, so memory is bounded and a new worker
only has to fill it again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import WordTable, flat, held, slices, texts_of

MARK = "▁"
#: Stands before each chunk while a text is cut; texts that hold it take the slower cut.
_CUT = ""
_CHUNK = re.compile(" +[^ \n]*|\n[^ \n]*")


class ChunkTable:
    """Distinct marked words with their ids."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = list(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        crossing = [p for p in pieces if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        self.mark_id = self.model.piece_to_id(MARK)
        self.words = WordTable(self.segment, limit=450_000)

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library puts one marker before a text by itself, none before an empty one."""
        ids = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return flat([i[1:] if c[0] == "\n" else i or [self.mark_id] for c, i in zip(chunks, ids, strict=True)])

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids of each text, and the text decoded from them."""
        spaced = pc.replace_substring(texts, MARK, " ")
        if pc.any(pc.match_substring(spaced, _CUT)).as_py():
            parts = pa.array([[""] + (_CHUNK.findall(" " + t) if t else []) for t in spaced.to_pylist()], pa.large_list(pa.large_string()))
        else:
            glue = pa.scalar("", pa.large_string())
            first = pc.if_else(pc.equal(pc.binary_length(spaced), 0), glue, pa.scalar(" ", pa.large_string()))
            marked = pc.binary_join_element_wise(first, spaced, glue)
            if pc.any(pc.match_substring(marked, "  ")).as_py():
                marked = pc.replace_substring_regex(marked, " +", _CUT + r"\0")
            else:
                marked = pc.replace_substring(marked, " ", _CUT + " ")
            parts = pc.split_pattern(pc.replace_substring(marked, "\n", _CUT + "\n"), _CUT)
        starts = np.asarray(parts.offsets, dtype=np.int64)
        keep = np.ones(int(starts[-1]), dtype=bool)
        keep[starts[:-1]] = False  # the empty string before the first chunk
        ids, bounds = self.words.take(parts.flatten().filter(pa.array(keep)), starts - np.arange(len(starts)))
        split = np.split(ids, bounds[1:-1]) if len(texts) else []
        decoded = self.model.decode([x.tolist() for x in split]) if split else []
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())


def chunk_table(model_path: str) -> ChunkTable:
    """The worker's table; it lives until another operator runs in the worker."""
    return held(("chunks", model_path), lambda: ChunkTable(model_path))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded string): each whole text's piece ids, and the text decoded from them.

    Ids equal the library's ``encode(text)`` without begin or end ids; decoded
    is its ``decode(ids)``. A null or empty text has no ids and decodes to the
    empty text. Repeated rows stay rows of their own, a null id stays null,
    other columns are not read. It fits models whose pieces cross no whitespace
    marker or line feed, with dummy prefix and identity normalisation; pieces
    that do cross are refused.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_table(model_path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, decoded = known.encode(texts_of(part, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], ["id", "ids", "decoded"])

    cols = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
