"""Licence notices in texts, found by MinHash over overlapping windows.

Words are runs of a-z and 0-9 after lower-casing, shingles are five words.  A
template with m shingles is looked for in windows of two blocks of B shingles,
B being the power of two from m up; windows begin at every block, so a copy of
the template lies in one of them.  A window and a template are compared when
the values of one band of their MinHash signatures agree.  The number of bands
follows from the least similarity that a window with ``SIMILARITY`` of the template's
shingles can have, so that such a window is missed with probability ``MISS`` at
most.  Then the share of the template's shingles in the window is counted exactly.

Block minima are taken once and merged for longer windows; all is a map over
blocks of texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import blocks, slim, utf8

WORDS = 5
SIMILARITY = 0.8
MISS = 1e-6

#: Wording of common licence notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
}

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def bands(least: float, miss: float = MISS) -> int:
    """Bands of one value each so that sets of similarity ``least`` agree in one, but for ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-least))) if least < 1 else 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


def _shingles(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and where each text's begin (one more at the end)."""
    kind = _ALNUM[raw]
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[bounds] = True
    at = np.flatnonzero(cut)
    runs = pa.Array.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(lower)]
    ).dictionary_encode()
    known = np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in runs.dictionary.to_pylist()), np.uint64, len(runs.dictionary)
    )
    word = np.flatnonzero(kind[at[:-1]])
    hashes = known[runs.indices.to_numpy(zero_copy_only=False)[word]]
    first = np.searchsorted(at[word], bounds)
    last = np.maximum(first[1:] - WORDS + 1, first[:-1])
    sizes = last - first[:-1]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.arange(upto[-1]) + np.repeat(first[:-1] - upto[:-1], sizes)
    joined = np.zeros(len(begin), np.uint64)
    for i in range(WORDS):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[begin + i]
    return _mix(joined), upto


class Templates:
    """Shingles of the notices, and their signatures, by the size of their windows' blocks."""

    def __init__(self, notices: Mapping[str, str], similarity: float, miss: float):
        self.similarity = similarity
        self.levels: dict[int, list[tuple[str, np.ndarray]]] = {}
        least = 1.0
        for name, text in sorted(notices.items()):
            raw = np.frombuffer(text.encode(), np.uint8)
            found = np.unique(_shingles(raw, np.array([0, len(raw)]))[0])
            if not len(found):
                raise ValueError(f"{name} has fewer than {WORDS} words")
            size = block_size(len(found))
            self.levels.setdefault(size, []).append((name, found))
            enough = math.ceil(similarity * len(found))
            least = min(least, enough / (2 * size + len(found) - enough))
        self.bands = bands(least, miss)
        draw = np.random.default_rng(11).integers(0, 1 << 63, (2, self.bands), dtype=np.uint64)
        self.factors, self.offsets = draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def block_size(shingles: int) -> int:
    return 1 << (shingles - 1).bit_length()


def _matches(templates: Templates, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    """``(text, name, first shingle of the window, share)`` of all windows that hold a notice."""
    largest = max(templates.levels)
    steps = [1 << i for i in range(largest.bit_length())]
    starts: dict[int, np.ndarray] = {}
    owner: dict[int, np.ndarray] = {}
    number: dict[int, np.ndarray] = {}
    counts = np.diff(bounds)
    for size in steps:
        n = -(-counts // size)
        owner[size] = np.repeat(np.arange(len(counts)), n)
        number[size] = np.arange(len(owner[size])) - np.repeat(np.cumsum(n) - n, n)
        starts[size] = bounds[:-1][owner[size]] + number[size] * size
    found = {
        size: [np.zeros(len(starts[size]), bool) for _ in own] for size, own in templates.levels.items()
    }
    for factor, offset in zip(templates.factors, templates.offsets):
        least = hashes * factor + offset
        for size in steps:
            if size > 1:
                first = np.flatnonzero(number[size // 2] % 2 == 0)
                least = np.minimum.reduceat(least, first)
            if size not in templates.levels:
                continue
            window = least.copy()
            same = owner[size][1:] == owner[size][:-1]
            np.minimum(window[:-1], np.where(same, least[1:], least[:-1]), out=window[:-1])
            for seen, (_, own) in zip(found[size], templates.levels[size]):
                seen |= window == (own * factor + offset).min()
    for size, own in templates.levels.items():
        for seen, (name, shingles) in zip(found[size], own):
            for w in np.flatnonzero(seen).tolist():
                text = owner[size][w]
                begin = starts[size][w]
                held = hashes[begin : min(begin + 2 * size, bounds[text + 1])]
                share = np.isin(shingles, held).sum() / len(shingles)
                if share >= templates.similarity:
                    yield int(text), name, int(begin - bounds[text]), float(share)


def scan(
    docs: DataFrame,
    notices: Mapping[str, str] = NOTICES,
    similarity: float = SIMILARITY,
    miss: float = MISS,
) -> DataFrame:
    """One row for each document and notice in it: ``doc_id, license_id, n_windows, containment, first_word``.

    ``containment`` is the largest share of the notice's shingles in a window,
    ``first_word`` the first word of the first such window.  Texts that are null
    or have fewer than five words match nothing and have no row; repeated rows have rows each; null
    ids are kept; an empty table gives no rows; other columns are not read.
    ``notices`` is a list for a program to hold, not a table.
    """
    if not notices:
        return docs.sparkSession.createDataFrame([], "doc_id long, license_id string, n_windows long, containment double, first_word long")
    wanted = dict(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(wanted, similarity, miss)
        for block in blocks(batches):
            hashes, bounds = _shingles(*utf8(block["text"]))
            rows: dict[tuple, list] = {}
            if len(hashes):
                for text, name, first, share in _matches(templates, hashes, bounds):
                    held = rows.setdefault((text, name), [0, 0.0, first])
                    rows[text, name] = [held[0] + 1, max(held[1], share), min(held[2], first)]
            texts = pa.array([t for t, _ in rows], pa.int64())
            columns = list(zip(*rows.values())) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"].combine_chunks().take(texts), pa.array([n for _, n in rows], pa.string()),
                 pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())],
                names=["doc_id", "license_id", "n_windows", "containment", "first_word"],
            )

    narrow = slim(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return narrow.mapInArrow(
        run, "doc_id long, license_id string, n_windows long, containment double, first_word long"
    )


def sql(notices: Mapping[str, str] = NOTICES, similarity: float = SIMILARITY) -> str:
    """The same by exact counting of every window, in SQL."""
    import re

    rows = []
    for name, text in sorted(notices.items()):
        words = re.findall("[a-z0-9]+", text.lower())
        shingles = sorted({" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)})
        rows += [f"('{name}', {len(shingles)}, {block_size(len(shingles))}, '{s}')" for s in shingles]
    return f"""
        WITH t(license_id, m, b, sh) AS (VALUES {", ".join(rows)}),
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {WORDS - 1})) AS pos FROM w),
        s AS (SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + {WORDS}], ' ') AS sh FROM p),
        h AS (SELECT doc_id, license_id, m, b, sh, unnest([pos // b - 1, pos // b]) AS win FROM s JOIN t USING (sh)),
        c AS (SELECT doc_id, license_id, b, win, count(DISTINCT sh) / max(m) AS share
              FROM h WHERE win >= 0 GROUP BY ALL)
        SELECT doc_id, license_id, count(*) AS n_windows, max(share) AS containment, min(win * b) AS first_word
        FROM c WHERE share >= {similarity} GROUP BY doc_id, license_id"""
