"""Licence scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined by Spark to the positions
of the same k-grams in the licence templates, a table of fixed size. A match at
text position p and template position t votes for the offset p - t of its
template; matches on one diagonal without a gap are a run, and runs of a
template on neighbouring diagonals (words put in or left out) are merged into a
span. A span is verified by a second hash of each k-gram and by the number of the
template's words it covers. Short phrases are templates that must be covered
whole on one diagonal.

A text's matches meet under its row number and template, never a whole table or
a common k-gram in one task: the hot k-grams are only looked up in the table that
every executor has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.llm.common import cut, row_numbers, slices

#: Words of a k-gram.
K = 3
#: A notice may miss one of so many of its words in a text; diagonals this near are merged.
MISS, NEAR = 12, 4
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices and their labels.
NOTICES = {
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3": "licensed under the GNU Affero General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return _WORD.findall(text.translate(_LOWER))


def gram_hashes(words: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit rolling hashes of each k-gram."""
    import xxhash

    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    codes: dict[bytes, int] = {}
    each = np.array([codes[w] if w in codes else codes.setdefault(w, digest(w)) for w in words], np.uint64)
    out = []
    for prime in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        made = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            made = (made ^ (made >> np.uint64(31))) * np.uint64(prime) + each[j : len(words) - k + 1 + j]
        out.append(made.view(np.int64))
    return out[0], out[1]


def template_rows(k: int = K) -> list[tuple]:
    """Rows (template, label, phrase, words, t_pos, hash, check) of all templates' k-grams."""
    rows = []
    for number, (text, label, phrase) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((n, x, False) for x, n in NOTICES.items())]):
        words = words_of(text.encode())
        rows += [(number, label, phrase, len(words), i, int(a), int(b)) for i, (a, b) in enumerate(zip(*gram_hashes(words, k), strict=True))]
    return rows


#: The hash that each document's own row carries through the join.
_HEAD = 0


def _matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, id, n_words, pos, template, ...): k-grams that stand in a template, and one row of template -1 per document."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, head = 0, np.array([_HEAD], np.int64)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                words = [words_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(1)]
                pairs = [gram_hashes(w) for w in words]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(a) + 1 for a, _ in pairs])]), pa.int32())
                hashes, checks = (pa.array(np.concatenate([y for x in side for y in (head, x)])) for side in zip(*pairs, strict=True))
                grams = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([hashes, checks], ["hash", "check"]))
                yield pa.RecordBatch.from_arrays([pa.array(row_numbers(made, len(words))), part.column(0), pa.array(list(map(len, words)), pa.int64()), grams], ["row", "id", "n_words", "grams"])
                made += len(words)

    schema = f"row long, id {id_type}, n_words long, grams array<struct<hash:long,check:long>>"
    hashed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    grams = hashed.select("row", "id", "n_words", F.posexplode("grams").alias("at", "gram"))
    grams = grams.select("row", "id", "n_words", (F.col("at") - 1).alias("pos"), "gram.hash", F.col("gram.check").alias("own_check"))
    rows = [(-1, "", False, 0, 0, _HEAD, _HEAD), *template_rows()]  # as long as the templates
    templates = spark.createDataFrame(rows, "template int, label string, phrase boolean, words int, t_pos int, hash long, check long")
    found = grams.join(F.broadcast(templates), "hash").filter(F.col("check") == F.col("own_check"))
    return found.select("row", "id", "n_words", "pos", "template", "label", "phrase", "words", "t_pos")


def _spans(matches: DataFrame) -> DataFrame:
    """Rows (row, label, phrase, first, last, score) of verified spans."""
    key = ["row", "template", "label", "phrase", "words"]
    votes = matches.filter("template >= 0").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    lines = votes.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + K - 1).alias("last"), F.collect_list("t_pos").alias("at"))
    whole = lines.filter(F.col("phrase") & (F.col("votes") == F.col("words") - K + 1)).select("row", "label", "phrase", "first", "last", F.lit(1.0).alias("score"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    island = lines.filter(~F.col("phrase")).withColumn("island", F.sum(apart.cast("int")).over(along))
    merged = island.groupBy(*key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("at")).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + K - 1)))))
    scored = merged.withColumn("covered", covered).filter(F.col("covered") >= F.col("words") - F.floor(F.col("words") / MISS)).withColumn("score", F.round(F.col("covered") / F.col("words"), 4))
    return whole.union(scored.select("row", "label", "phrase", "first", "last", "score"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, spans), one per row: spans are (label, phrase, first, last, score) by first word, label and phrase.

    First and last are words from 0; the score is the share of the template's
    words that the span's diagonals cover. Phrases are found at every place where
    all their words stand in a row, notices where all but one in MISS of their words do. A
    null or empty text has no words; a text shorter than a k-gram has no span.
    Repeated rows have results of their own, a null id stays null, other columns
    are not read.
    """
    matches = cut(_matches(df, id_col, text_col))
    spans = _spans(matches).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "label", "phrase", "last", "score"))).alias("spans"))
    spans = spans.select("row", F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["phrase"].alias("phrase"), x["first"].alias("first"), x["last"].alias("last"), x["score"].alias("score"))).alias("spans"))
    docs = matches.filter("template = -1").select("row", F.col("id").alias(id_col), "n_words")
    none = F.array().cast(spans.schema["spans"].dataType)
    return docs.join(spans, "row", "left").select(id_col, "n_words", F.coalesce("spans", none).alias("spans"))
