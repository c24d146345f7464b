"""Hierarchical packing: documents of all lengths into windows of several context sizes.

Every document is cut into full windows of the longest context and a rest.  The
rest goes to the shortest tier that holds it.  Tiers are packed from the longest
down: each window starts with a piece of its own tier, and its gap is filled
from shorter tiers, longest first.  Where shorter tiers run out, pieces of the
tier follow one another and are cut at the window's end.

A task packs the documents of its partition, one block of texts at a time.  What
does not fill a window goes on to the next block.  At the end of a partition it
is cut into the tiers' sizes; the last piece, shorter than the shortest tier,
shares a padded window with those of the partitions beside it.  So memory is
bounded by a block, text is never shuffled, and no more than one short piece a
partition is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flighttone.llm.texts import blocks, slim, tokenizer_encoder

TIERS = (2048, 1024, 512, 256)
#: Tokens of one training step; each step takes windows of one size only.
STEP_TOKENS = 65_536
#: Partitions whose last pieces share a window, at most.
SHARE = 8  # of at most 255 ids each, so they fit

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, context int, step_group long"
)


class _Packer:
    """Windows out of pieces.  A piece is ``(position in ids, length, document)``."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, partition: int):
        self.tiers = sorted(tiers, reverse=True)
        self.step_tokens = step_tokens
        self.partition = partition
        self.sequences = 0
        self.windows = dict.fromkeys(self.tiers, 0)
        self.ids = np.zeros(0, np.uint32)
        self.pieces = np.zeros((0, 3), np.int64)
        self.docs = [np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """Take a block of documents, give the rows of all windows that are full."""
        sizes = np.diff(bounds)
        base = bounds[:-1] + len(self.ids)
        known = len(self.docs[0])
        self.docs = [
            np.concatenate([old, new])
            for old, new in zip(self.docs, (doc_ids, base, sizes))
        ]
        self.ids = np.concatenate([self.ids, ids])
        longest = self.tiers[0]
        full, rest = sizes // longest, sizes % longest
        of = np.repeat(np.arange(len(sizes)), full)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
        whole = np.stack([base[of] + nth * longest, np.full(len(of), longest), of + known], 1)
        kept = np.flatnonzero(rest)
        rests = np.stack([base[kept] + full[kept] * longest, rest[kept], kept + known], 1)
        self.pieces = np.concatenate([self.pieces, rests])
        rows = self._rows(whole, np.arange(len(whole)), longest) if len(whole) else []
        return rows + self._fill()

    def _fill(self) -> list[tuple]:
        rows, left = [], []
        bounds = [*self.tiers[1:], 0]
        waiting = [
            self.pieces[(self.pieces[:, 1] > low) & (self.pieces[:, 1] <= high)]
            for high, low in zip(self.tiers, bounds)
        ]
        for tier, size in enumerate(self.tiers):
            own = waiting[tier]
            if not len(own):
                continue
            shorter = np.concatenate([waiting[t] for t in range(tier + 1, len(self.tiers))] or [own[:0]])
            upto = np.cumsum(size - own[:, 1])
            supply = int(shorter[:, 1].sum())
            n = int(np.searchsorted(upto, supply, "right"))
            if n:
                need = int(upto[n - 1])
                first, where = own[:n], np.arange(n)
                if need:  # else all pieces are as long as their windows
                    ends = np.cumsum(shorter[:, 1])
                    fill, _, at = _cut(shorter, np.union1d(upto[:n], ends[ends <= need]))
                    gap = np.searchsorted(upto[:n], at, "right")
                    first, where = np.concatenate([first, fill]), np.concatenate([where, gap])
                    spent = int(np.searchsorted(ends, need, "right"))
                    after = shorter[spent:].copy()
                    if len(after):
                        used = need - (int(ends[spent - 1]) if spent else 0)
                        after[0, 0] += used
                        after[0, 1] -= used
                    for t in range(tier + 1, len(self.tiers)):
                        low = bounds[t]
                        waiting[t] = after[(after[:, 1] > low) & (after[:, 1] <= self.tiers[t])]
                order = np.argsort(where, kind="stable")
                rows += self._rows(first[order], where[order], size)
                own = own[n:]
            if len(own):
                # What is shorter does not fill one more window: the tier's pieces follow one another.
                total = int(own[:, 1].sum())
                full = total // size * size
                ends = np.cumsum(own[:, 1])
                if full:
                    marks = np.union1d(np.arange(size, full + 1, size), ends[ends <= full])
                    cut, spent, at = _cut(own, marks)
                    rows += self._rows(cut, at // size, size)
                    own = own[spent:].copy()
                    used = full - (int(ends[spent - 1]) if spent else 0)
                    if len(own):
                        own[0, 0] += used
                        own[0, 1] -= used
                left.append(own)
        self._keep(np.concatenate(left) if left else self.pieces[:0])
        return rows

    def _keep(self, pieces: np.ndarray) -> None:
        """Forget all ids but those of the pieces left."""
        pieces = pieces[pieces[:, 1] > 0]
        ids = [self.ids[p : p + n] for p, n, _ in pieces]
        base = np.cumsum([0, *map(len, ids)])[: len(ids)]
        doc = pieces[:, 2]
        started = pieces[:, 0] - self.docs[1][doc]
        self.docs = [self.docs[0][doc], base - started, self.docs[2][doc]]
        self.ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        self.pieces = np.stack([base, pieces[:, 1], np.arange(len(pieces))], 1).astype(np.int64)

    def last(self) -> list[tuple]:
        """Windows of the tiers' sizes out of what is left, then one row list for the shared window."""
        rows = []
        for size in self.tiers:
            ends = np.cumsum(self.pieces[:, 1])
            full = (int(ends[-1]) if len(ends) else 0) // size * size
            if not full:
                continue
            marks = np.union1d(np.arange(size, full + 1, size), ends[ends <= full])
            cut, spent, at = _cut(self.pieces, marks)
            rows += self._rows(cut, at // size, size)
            rest = self.pieces[spent:].copy()
            if len(rest):
                used = full - (int(ends[spent - 1]) if spent else 0)
                rest[0, 0] += used
                rest[0, 1] -= used
            self.pieces = rest
        self.pieces = self.pieces[self.pieces[:, 1] > 0]
        if len(self.pieces):
            rows += self._rows(self.pieces, np.zeros(len(self.pieces), np.int64), 0)
        return rows

    def _rows(self, pieces: np.ndarray, window: np.ndarray, size: int) -> list[tuple]:
        doc = pieces[:, 2]
        doc_id, base, tokens = (x[doc] for x in self.docs)
        ends = np.cumsum(pieces[:, 1])
        new = np.concatenate([[True], window[1:] != window[:-1]])
        begin = np.maximum.accumulate(np.where(new, ends - pieces[:, 1], 0))
        offset = ends - pieces[:, 1] - begin
        crc = [zlib.crc32(self.ids[p : p + n].tobytes()) for p, n, _ in pieces.tolist()]
        if size:
            sequence = (self.partition << 33) + self.sequences + np.cumsum(new) - 1
            nth = self.windows[size] + np.cumsum(new) - 1
            step = (self.partition << 33) + (self.tiers.index(size) << 28) + nth // (self.step_tokens // size)
            self.sequences += int(new.sum())
            self.windows[size] += int(new.sum())
        else:
            sequence = step = np.full(len(pieces), -1 - self.partition // SHARE)
        return [
            tuple(x) for x in zip(
                doc_id, pieces[:, 0] - base, pieces[:, 1], crc, tokens, sequence, offset,
                [size] * len(pieces), step,
            )
        ]


def _cut(pieces: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Pieces, laid end to end, cut at ``marks``: parts, pieces used up, and where each part begins."""
    ends = np.cumsum(pieces[:, 1])
    marks = marks[marks > 0]
    begin = np.concatenate([[0], marks[:-1]]).astype(np.int64)
    of = np.searchsorted(ends, begin, "right")
    inside = begin - (ends - pieces[:, 1])[of]
    parts = np.stack([pieces[of, 0] + inside, marks - begin, pieces[of, 2]], 1)
    return parts, int(np.searchsorted(ends, marks[-1], "right")), begin


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pack all ``docs`` (``doc_id``, ``text``) and return one row per piece.

    ``tokenizer`` is a file of the tokenizers library; ``end_id`` ends every
    document.  ``context`` is the size of the piece's window, ``offset`` its place
    there; windows of one ``step_group`` have one size and together
    ``step_tokens`` tokens, but for a partition's last group of each size.  Only
    windows with a negative ``sequence_id`` are padded, to the longest size.

    A null or empty text is the end id alone.  Repeated rows and null ids are
    documents like any other; an empty table gives no rows; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_encoder(tokenizer)
        packer = _Packer(tiers, step_tokens, TaskContext.get().partitionId())
        nth = packer.partition << 33
        for block in blocks(batches):
            ids, bounds = encode(block["text"])
            n = len(bounds) - 1
            ended = np.full(len(ids) + n, end_id, np.uint32)
            ended[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            doc_ids = np.empty(n, object)
            doc_ids[:] = block["doc_id"].to_pylist()
            out = packer.add(doc_ids, ended, bounds + np.arange(n + 1))
            yield from _batches(out, nth)
            nth += len(out)
        yield from _batches(packer.last(), nth)

    schema = f"{PIECE_SCHEMA}, _nth long"
    rows = slim(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, schema)
    beside = Window.partitionBy("sequence_id").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.coalesce(F.sum("length").over(beside), F.lit(0))
    return rows.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", shared.alias("offset"),
        F.when(F.col("context") > 0, F.col("context")).otherwise(max(tiers)).alias("context"), "step_group",
    )


_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("context", pa.int32()), ("step_group", pa.int64()), ("_nth", pa.int64())]
)


def _batches(rows: list[tuple], nth: int, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        columns = [*zip(*part), range(nth + at, nth + at + len(part))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
