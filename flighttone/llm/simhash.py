"""Near duplicates by SimHash, found at the anchors of a covering code.

Of a fingerprint's 64 bits two blocks of 23 bits are each taken as a word over the
binary Golay code, in which every word lies within 3 bits of exactly one code
word.  The pairs of code words, 2 ** 24 of them, are the anchors.  A fingerprint
has its home at the anchor nearest to it and is copied to every anchor that a
fingerprint within the threshold of it can have as home: where a block is e bits
from its code word, max(e - 3, 0) of the threshold are spent, and the two blocks
together spend no more than all of it.  At each anchor the homes are compared
with all that came there, over all 64 bits.  So no link is missed.

With threshold 2 a fingerprint is copied to some 60 anchors.  Tasks return
spanning forests of the links, never pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.llm.graph import components
from flighttone.llm.texts import blocks, slim, utf8
from flighttone.scale import join_unique, materialize

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS, RADIUS = 23, 11, 3
WORDS, SEED, THRESHOLD = 3, 42, 2
#: Pairs compared and rows looked at, at a time.
STRIP, MET_ROWS = 1 << 22, 50_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text: a bit is 1 when it is set in more than half of the shingles' hashes."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        begin = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1].tolist()
        stop = (ends[words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(begin, stop)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """``keep`` and the fingerprint as signed ``fp`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            raw, bounds = utf8(block["text"])
            data = raw.tobytes()
            at = bounds.tolist()
            found = np.array([fingerprint(data[a:b], words) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(block[c].combine_chunks() for c in keep), pa.array(found)], names=[*keep, "fp"]
            )

    narrow = slim(docs, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name in keep)
    return narrow.mapInArrow(run, f"{kinds}, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of the words, as polynomials, by the generator."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return rest


class Cover:
    """For a word, by its syndrome: errors of up to ``RADIUS + threshold`` bits that lead to a code word."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold = threshold
        errors = [np.zeros(1, np.int64)]
        last = [(0, -1)]
        for _ in range(RADIUS + threshold):
            last = [(e | 1 << b, b) for e, top in last for b in range(top + 1, LENGTH)]
            errors.append(np.array([e for e, _ in last], np.int64))
        every = np.concatenate(errors)
        spent = np.repeat(np.maximum(np.arange(len(errors)) - RADIUS, 0), [len(e) for e in errors])
        of = _syndrome(every)
        order = np.lexsort((spent, of))
        self.errors, self.spent = every[order], spent[order]
        self.first = np.searchsorted(of[order], np.arange((1 << CHECKS) + 1))

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``(index of the fingerprint, anchor, whether it is its home)``."""
        low = (fps & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        high = (fps >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        one, two = _syndrome(low), _syndrome(high)
        at, i = _spread(self.first[one], self.first[one + 1])
        left, used = low[at] ^ self.errors[i], self.spent[i]
        # Of the second block only errors that what is left of the threshold allows.
        allowed = np.stack([
            np.searchsorted(self.spent[a:b], np.arange(self.threshold + 1), "right") + a
            for a, b in zip(self.first, self.first[1:])
        ])
        syndrome = two[at]
        row, j = _spread(self.first[syndrome], allowed[syndrome, self.threshold - used])
        right = high[at[row]] ^ self.errors[j]
        anchor = (left[row] >> CHECKS) << (LENGTH - CHECKS) | right >> CHECKS
        return at[row], anchor, (used[row] == 0) & (self.spent[j] == 0)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, repeated, and the numbers in it."""
    sizes = end - begin
    of = np.repeat(np.arange(len(begin)), sizes)
    upto = np.cumsum(sizes)
    return of, np.arange(len(of)) + np.repeat(begin - (upto - sizes), sizes)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: every node but the smallest, and the smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        least = least[least]
        new = least[root]
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _compare(key: np.ndarray, fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the homes and all rows of each anchor; keys are sorted, homes first."""
    anchor, home = key >> 1, key & 1 == 0
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.append(first[1:], len(key))
    homes = np.add.reduceat(home.astype(np.int64), first)
    use = (homes > 0) & (end - first > 1)
    first, end, homes = first[use], end[use], homes[use]
    pairs = homes * (end - first)
    small = pairs <= STRIP
    of, row = _spread(first[small], (first + homes)[small])
    sizes = (end - first)[small][of]
    upto = np.cumsum(sizes)
    begun = 0
    while begun < len(row):
        stop = max(begun + 1, int(np.searchsorted(upto, (upto[begun - 1] if begun else 0) + STRIP, "right")))
        r, other = _spread(first[small][of[begun:stop]], end[small][of[begun:stop]])
        u, v = fp[row[begun:stop][r]], fp[other]
        near = (np.bitwise_count(u ^ v) <= threshold) & (u != v)
        if near.any():
            yield forest(u[near], v[near])
        begun = stop
    for a, b, n in zip(first[~small], end[~small], homes[~small]):
        step = max(1, STRIP // int(n))
        for at in range(a, b, step):
            for h in range(a, a + n, STRIP):
                own, others = fp[h : min(h + STRIP, a + n)], fp[at : min(at + step, b)]
                near = np.bitwise_count(own[:, None] ^ others[None, :]) <= threshold
                u, v = np.nonzero(near)
                keep = own[u] != others[v]
                if keep.any():
                    yield forest(own[u[keep]], others[v[keep]])


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints ``fp`` of up to ``threshold`` differing bits."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 5000):
                part = fps[at : at + 5000]
                of, anchor, home = cover.anchors(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor << 1 | ~home), pa.array(part[of].view(np.int64))], names=["key", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _whole_anchors(batches):
            for u, v in _compare(key, fp.view(np.uint64), threshold):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]
                )

    copied = distinct.select("fp").mapInArrow(replicate, "key long, fp long")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = copied.repartition(n, F.shiftright("key", 1)).sortWithinPartitions("key")
    return placed.mapInArrow(compare, "u long, v long")


def _whole_anchors(batches: Iterator[pa.RecordBatch], rows: int = MET_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some ``rows`` rows at a time, cut so that no anchor is torn apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1] & ~1))
        if at:
            yield key[:at], whole.column(1).to_numpy()[:at]
        held = [whole.slice(at)]
    left = [b for b in held if b.num_rows]
    if left:
        table = pa.Table.from_batches(left)
        yield table.column(0).to_numpy(), table.column(1).to_numpy()


def near_copies(docs: DataFrame, row: str | None = None, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document, and ``row`` and ``root`` if ``row`` is named.

    ``root`` is the component's smallest fingerprint: it tells components apart
    also where ids are null or repeated.

    A-Z are lower-cased, words are runs of what is not ASCII white space,
    shingles are ``words`` words joined by a blank.  A text with fewer words is one
    shingle, a text without words (null or empty too) has fingerprint 0 and is
    linked like any other.  ``component_id`` is the smallest ``doc_id`` reachable
    over links of up to ``threshold`` differing bits; null ids count only where
    there is no other.  Equal texts meet as one fingerprint, so groups of copies
    cost nothing.  An empty table gives no rows; other columns are not read.
    """
    keep = ["doc_id"] + [row] * bool(row)
    marked = materialize(fingerprints(docs, keep, words))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    found = components(materialize(links(distinct, threshold)))
    member = distinct.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    member = member.withColumn("root", F.coalesce("root", "fp"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialize(member.join(named, "root").select("fp", "component_id", "root", "rows"))
    return join_unique(marked, member, ["fp"], "rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *([row, "root"] if row else []),
    )
