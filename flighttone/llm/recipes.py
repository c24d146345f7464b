"""Exact duplicates by content-defined chunks.

Normalised texts are cut where a rolling hash of the last 32 bytes says so, with
chunks of 512 to 8192 bytes.  Every chunk gets a 128-bit identifier.  The
chunks themselves are moved once, after copies within a block of texts and of
chunks that a task meets in block after block are dropped, to verify that no identifier names two different chunks; if one did,
all identifiers would be made anew with the next seed.  From then on a document
is the ordered list of its identifiers, some 130 times shorter than the text, and
documents are equal when their lists are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import blocks, slim, utf8
from flighttone.scale import materialize

LEAST, MOST = 512, 8192
#: Bytes of texts worked on at once; the rolling hash takes some twelve times as much memory.
BLOCK = 4 << 20
#: Bytes of chunks met in several blocks that a task remembers.
KEPT = 4 << 20
#: A cut on average every 2 ** 11 bytes where the hash is free to choose.
MEAN_BITS = 11


def _gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ends of possible chunks; each depends on the 32 bytes before it only."""
    h = _gear()[raw]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(points: Sequence[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the text from ``begin`` to ``end``, given the possible ends inside."""
    ends, last = [], begin
    for point in points:
        while point - last > MOST:
            last += MOST
            ends.append(last)
        if point - last >= LEAST and point < end:
            last = point
            ends.append(last)
    while end - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, end] if end > last else ends


def _documents(block: pa.Table) -> Iterator[tuple[memoryview, list[int]]]:
    """Normalised bytes of each text, and the ends of its chunks in them."""
    raw, bounds = utf8(block["text"])
    raw = lowered(raw)
    points = cut_points(raw)
    inside = np.searchsorted(points, bounds, "right")
    data, points = memoryview(raw.tobytes()), points.tolist()
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        ends = chunk_ends(points[inside[i] : inside[i + 1]], a, b)
        yield data[a:b], [e - a for e in ends]


def chunks(docs: DataFrame, seed: int) -> DataFrame:
    """Identifiers and bytes of chunks, ``id, bytes``, each once for a block of texts.

    A chunk of every other document is sent about once by a task: what two blocks
    that follow one another have is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All of both sets has been sent.
        before: set[bytes] = set()
        kept: set[bytes] = set()
        held = 0
        for block in blocks(batches, BLOCK):
            seen = set()
            for text, ends in _documents(block):
                seen.update(bytes(text[a:b]) for a, b in zip([0, *ends], ends))
            found = list(seen - before - kept)
            again = (seen & before) - kept
            if held > KEPT:
                kept, held = set(), 0
            kept |= again
            held += sum(map(len, again))
            before = seen
            for at in range(0, len(found), 2000):
                part = found[at : at + 2000]
                ids = [xxhash.xxh3_128_digest(c, seed) for c in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array(part, pa.binary())], names=["id", "bytes"]
                )

    return slim(docs).mapInArrow(run, "id binary, bytes binary")


def verified(docs: DataFrame, seed: int) -> bool:
    """Whether every identifier stands for one chunk, by comparing the chunks' bytes."""
    met = chunks(docs, seed).repartition("id").dropDuplicates(["id", "bytes"])
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0


def recipes(docs: DataFrame, keep: Sequence[str], seed: int) -> DataFrame:
    """``keep``, ``recipe`` (the identifiers in order), ``n_chunks`` and ``text_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK):
            lists, counts, said = [], [], []
            for text, ends in _documents(block):
                lists.append(b"".join(xxhash.xxh3_128_digest(text[a:b], seed) for a, b in zip([0, *ends], ends)))
                counts.append(len(ends))
                said.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(block[c].combine_chunks() for c in keep), pa.array(lists, pa.binary()),
                 pa.array(counts, pa.int64()), pa.array(said)],
                names=[*keep, "recipe", "n_chunks", "text_sha256"],
            )

    narrow = slim(docs, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name in keep)
    return narrow.mapInArrow(run, f"{kinds}, recipe binary, n_chunks long, text_sha256 string")


def exact_copies(docs: DataFrame, row: str | None = None) -> DataFrame:
    """For every document its group of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Texts are equal when identical after lower-casing A-Z; null is an empty text.
    The largest ``doc_id`` stays; of repeated rows with that id one stays, null
    ids are smaller than all others.  ``row`` names a column of ``docs`` that
    tells rows apart and is returned too; without it rows are numbered.  An
    empty table gives no rows; other columns are not read.
    """
    name = row or "_row"
    held = docs.select("doc_id", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias(name))
    seed = next(s for s in count() if verified(held, s))
    listed = materialize(recipes(held, ["doc_id", name], seed))
    groups = listed.groupBy("recipe").agg(
        F.max(F.struct("doc_id", name)).alias("last"), F.count(F.lit(1)).alias("group_size")
    )
    # A hot list is split by adaptive execution: only narrow rows meet here.
    out = listed.join(groups, "recipe").select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col(name) == F.col(f"last.{name}")).alias("kept"), "text_sha256", "n_chunks", name,
    )
    return out if row else out.drop(name)
