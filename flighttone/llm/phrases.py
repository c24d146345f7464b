"""Fingerprints of documents from the phrases of a Lempel-Ziv parse.

A text is parsed into phrases as LZ78 does: each phrase is the shortest run of
bytes not yet a phrase.  Texts that compress alike share phrases.  The set of
phrases is hashed to 32 bits each, and the ``SIZE`` smallest hashes are the
signature (Lempel-Ziv Jaccard distance).  Likeness of two signatures is the
share of the smallest hashes of both together that both have.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import slim

SIZE = 64
#: Rows of one range of ids, at most about; there are ``RANGES`` ranges for each shuffle partition at least.
RANGE_ROWS = 100_000
RANGES = 8
#: Keys looked at for each range, and bytes of a text in a key.
SAMPLED, HEAD_BYTES = 10, 32


def parse(text: bytes, phrases: set[bytes], fresh: list[bytes], begin: int = 0) -> int:
    """Add the phrases of ``text`` from ``begin`` on, to ``fresh`` too; where the last, unfinished one begins."""
    for end in range(begin + 1, len(text) + 1):
        phrase = text[begin:end]
        if phrase not in phrases:
            phrases.add(phrase)
            fresh.append(phrase)
            begin = end
    return begin


def smallest(phrases: list[bytes], known: list[int], size: int = SIZE) -> list[int]:
    """The smallest hashes of the phrases and of those ``known`` already, in order."""
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases))
    if len(hashes) > 4 * size:
        # Phrases are distinct, so few of their hashes are equal; else all are looked at.
        least = np.partition(hashes, 2 * size)[: 2 * size]
        hashes = least if len(set(least.tolist())) >= size else hashes
    return sorted({*hashes.tolist(), *known})[:size]


def likeness(one: list[int], two: list[int], size: int = SIZE) -> float:
    """Estimated share of phrases in common, 1 for two empty texts."""
    first, second = set(one), set(two)
    both = sorted(first | second)[:size]
    return len(first & second & set(both)) / len(both) if both else 1.0


class Fingerprint:
    """Signature of a text and of the text with another end."""

    def __init__(self, text: str, size: int = SIZE):
        self.text, self.size = text, size
        self.swapped = len(text) // 4
        self._kept = text[: len(text) - self.swapped].encode()
        # Phrases of the kept part serve both texts; the parse goes on from its last, unfinished phrase.
        self._phrases: set[bytes] = set()
        fresh: list[bytes] = []
        self._at = parse(self._kept, self._phrases, fresh)
        self._known = smallest(fresh, [], size)
        self.signature = self._end(text.encode())

    def _end(self, whole: bytes) -> list[int]:
        fresh: list[bytes] = []
        at = parse(whole, self._phrases, fresh, self._at)
        self._phrases.difference_update(fresh)
        if at < len(whole):
            fresh.append(whole[at:] + b"\0end")
        return smallest(fresh, self._known, self.size)

    def edited(self, following: str) -> tuple[bytes, list[int]]:
        """Bytes and signature with the last quarter replaced by the beginning of ``following``."""
        whole = self._kept + following[: self.swapped].encode()
        return whole, self._end(whole)


def _hex(found: list[int]) -> str:
    return np.array(found, ">u4").tobytes().hex()


#: A place in the order of documents: id, first bytes and hash of the text; a null id comes first.
_Key = tuple[int, bytes, int]
_NONE = -(1 << 63) - 1


def _keys() -> list[Column]:
    return [F.substring(F.col("text").cast("binary"), 1, HEAD_BYTES).alias("head"), F.xxhash64("text").alias("hash")]


@dataclass
class Ranges:
    """Ranges of keys with some rows each; a key of very many rows, which are equal, has ``parts`` numbers of its own."""

    ends: list[_Key]
    parts: dict[int, int]
    first: list[int]

    @staticmethod
    def of(ends: list[_Key], hot: dict[_Key, int]) -> Ranges:
        ends = sorted({*ends, *hot, *((i, head, h + 1) for i, head, h in hot)})
        parts = {bisect_right(ends, key): n for key, n in hot.items()}
        sizes = [parts.get(r, 1) for r in range(len(ends) + 1)]
        return Ranges(ends, parts, [0, *accumulate(sizes)])

    def followers(self, heads: dict[int, _Key]) -> dict[_Key, list[int]]:
        """Numbers to whose end the first document of each range goes: that before it, and those of equal rows but the last."""
        met = sorted(heads)
        out = {}
        for before, r in zip([*met[-1:], *met], met):
            last = self.first[before] + self.parts.get(before, 1) - 1
            out[heads[r]] = [last, *range(self.first[r], self.first[r] + self.parts.get(r, 1) - 1)]
        return out


def _plan(rows: DataFrame, range_rows: int) -> tuple[Ranges, dict[_Key, list[int]]]:
    """Ranges of some ``range_rows`` rows, and the followers.  The driver holds some ten keys for each range."""
    keys = rows.select("doc_id", *_keys())
    n = keys.count()
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // range_rows), min(n // 50, RANGES * shuffled))
    own = lambda r: (_NONE if r.doc_id is None else r.doc_id, bytes(r.head), r.hash)
    some = sorted(map(own, keys.sample(min(1.0, SAMPLED * parts / n), seed=1).collect())) if parts > 1 else []
    ends = [some[len(some) * i // parts] for i in range(1, parts)] if some else []
    each = -(-n // parts)
    # At most half as many as there are ranges.
    counts = keys.groupBy("doc_id", "head", "hash").count().filter(F.col("count") > 2 * each).collect() if parts > 1 else []
    ranges = Ranges.of(ends, {own(r): -(-r["count"] // each) for r in counts})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect_right(ranges.ends, (_NONE if i is None else i, head, h)) for i, head, h in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], names=["range", "doc_id", "head", "hash"])

    placed = keys.mapInArrow(place, "range int, doc_id long, head binary, hash long")
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "head", "hash")).alias("first")
    heads = {r.range: own(r.first) for r in placed.groupBy("range").agg(first).select("range", "first").collect()}
    return ranges, ranges.followers(heads)


def fingerprints(docs: DataFrame, size: int = SIZE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how alike they and the next document are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The edited text has the last quarter of its code points
    (rounded down) replaced by as many of the next document's first.  Documents are
    ordered by id, null first, then by the first bytes and a hash of the text; after the last comes the first, and
    a single document follows itself.  Null texts are empty; a text without a phrase has an
    empty fingerprint.  Repeated rows are documents of their own; an empty table
    gives no rows; other columns are not read.

    Documents are dealt to ranges once; the first document of a range goes to the end of the range
    before as well, so tasks need no other rows.  Very many equal rows are dealt to ranges of their own, in each of which
    they follow each other; the last of these, which every task deals to first, is where the next document follows.
    """
    rows = slim(docs, F.col("doc_id").cast("long").alias("doc_id"))
    ranges, followers = _plan(rows, range_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[_Key] = set()
        dealt: dict[int, int] = {}
        for batch in batches:
            take, where, follows = [], [], []
            for n, (i, _, head, h) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                key = (_NONE if i is None else i, head, h)
                r = bisect_right(ranges.ends, key)
                number = ranges.first[r]
                if r in ranges.parts:
                    many = ranges.parts[r] - 1
                    turn = dealt.setdefault(r, -1)
                    number += many if turn < 0 else turn % many
                    dealt[r] = TaskContext.get().partitionId() if turn < 0 else turn + 1
                take.append(n)
                where.append(number)
                follows.append(False)
                if key in followers and key not in sent:
                    sent.add(key)
                    for to in followers[key]:
                        take.append(n)
                        where.append(to)
                        follows.append(True)
            chosen = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array(follows, pa.bool_()), batch.column("doc_id").take(chosen), batch.column("text").take(chosen)],
                names=["range", "follows", "doc_id", "text"],
            )

    dealt = rows.select("doc_id", "text", *_keys()).mapInArrow(deal, "range int, follows boolean, doc_id long, text string")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges.first[-1] // RANGES)
    placed = dealt.repartition(parts, "range").sortWithinPartitions("range", "follows", "doc_id", *_keys())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []
        for batch in batches:
            for where, follows, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    if held[0] == where:
                        own = Fingerprint(text, size) if text != held[2].text else held[2]
                        out.append(_row(held[1], held[2], own, size))
                        held = None if follows else (where, doc_id, own)
                    else:
                        raise ValueError("a range has no document that follows it")
                elif not follows:
                    held = (where, doc_id, Fingerprint(text, size))
            if len(out) > 500:
                yield _arrow(out)
                out = []
        if out:
            yield _arrow(out)

    return placed.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )


def _row(doc_id: int | None, own: Fingerprint, following: Fingerprint, size: int) -> tuple:
    whole, edited = own.edited(following.text)
    return (
        doc_id, len(own.text), hashlib.sha256(whole).hexdigest(), _hex(own.signature), _hex(edited),
        likeness(own.signature, edited, size), likeness(own.signature, following.signature, size),
    )


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
