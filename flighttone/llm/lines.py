"""Lines that recur across documents, by a sharded minimal perfect hash.

Lines are known by 128-bit hashes.  The hashes of lines found in at least two
documents are dealt to shards of some ``SHARD_LINES`` lines.  A shard is a minimal perfect
hash (hash and displace) over its lines and, in the order it gives, two compact
arrays: a 64-bit fingerprint, which turns away lines that are not in the shard,
and the number of documents.  Documents send their lines' hashes, packed into one
row for each shard, and probe the arrays; lines are never joined.  Shards are
copied to as many groups as keep each group of documents small.  Lines so frequent
that they would swell their shard have a shard of their own, with
as many copies as their number asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import blocks, slim
from flighttone.scale import materialize

#: What is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
MIN_DOCS = 10
#: Lines of one shard, about, and lines that meet one copy of a shard.
SHARD_LINES = 50_000
GROUP_LINES = 400_000
#: Lines that have a share of more than 1 in ``FREQUENT`` of all, so there are no more of them.
FREQUENT = 100_000
#: Shard of frequent lines.
OWN_SHARD = -1
#: Lines of one document sent in one row.
ROW_LINES = 4096
_BUCKET = 4
_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(_MIX1)
    x = (x ^ x >> np.uint64(33)) * np.uint64(_MIX2)
    return x ^ x >> np.uint64(33)


class MinimalHash:
    """Minimal perfect hash of pairs ``(h1, h2)``: every key has a place of its own below their number."""

    def __init__(self, shift: np.ndarray, size: int):
        self.shift, self.size = shift, size

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalHash:
        n = len(h1)
        buckets = -(-n // _BUCKET)
        of = (h2 % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(buckets + 1))
        sizes = np.diff(first)
        shift = np.zeros(buckets, np.int64)
        free = np.ones(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        many = by_size[sizes[by_size] > 1]
        tries = np.arange(64)
        for b in many:
            keys = h1[order[first[b] : first[b + 1]]]
            at = 0
            while True:
                places = cls._place(keys[None, :], (tries + at)[:, None], n)
                good = free[places].all(axis=1)
                for t in np.flatnonzero(good):
                    if len(np.unique(places[t])) == len(keys):
                        free[places[t]] = False
                        shift[b] = at + t
                        break
                else:
                    at += len(tries)
                    continue
                break
        # A key alone in its bucket takes any place left: stored as such, below zero.
        single = by_size[sizes[by_size] == 1]
        shift[single] = -1 - np.flatnonzero(free)[: len(single)]
        return cls(shift, n)

    @staticmethod
    def _place(h1: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (_mix(h1 + shift.astype(np.uint64) * np.uint64(_STEP)) % np.uint64(n)).astype(np.int64)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        shift = self.shift[(h2 % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._place(h1, np.maximum(shift, 0), self.size))


def _lines(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of a block: the row, the two hashes and whether its key is not empty."""
    texts = block["text"].combine_chunks().cast(pa.large_string())
    split = pc.split_pattern(texts, "\n")
    keys = pc.ascii_lower(pc.ascii_trim(split.flatten(), characters=BLANKS)).dictionary_encode()
    which = keys.indices.to_numpy(zero_copy_only=False)
    found = b"".join(map(xxhash.xxh3_128_digest, keys.dictionary.to_pylist()))
    pair = np.frombuffer(found, np.uint64).reshape(-1, 2)
    filled = pc.greater(pc.binary_length(keys.dictionary), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return row, pair[which, 0], pair[which, 1], filled[which] if len(which) else np.zeros(0, bool)


def document_counts(docs: DataFrame) -> DataFrame:
    """Number of documents of every line's key: ``h1, h2, n``; each block adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, h1, h2, filled = _lines(block)
            seen = np.empty(int(filled.sum()), [("h1", "u8"), ("h2", "u8"), ("row", "i8")])
            seen["h1"], seen["h2"], seen["row"] = h1[filled], h2[filled], row[filled]
            order = np.lexsort((seen["row"], seen["h2"], seen["h1"]))
            seen = seen[order]
            if not len(seen):
                continue
            other = (seen["h1"][1:] != seen["h1"][:-1]) | (seen["h2"][1:] != seen["h2"][:-1])
            new_line = np.concatenate([[True], other])
            new = new_line | np.concatenate([[True], seen["row"][1:] != seen["row"][:-1]])
            first = np.flatnonzero(new_line)
            n = np.add.reduceat(new.astype(np.int64), first)
            for at in range(0, len(first), 50_000):
                part = first[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen["h1"][part].view(np.int64)), pa.array(seen["h2"][part].view(np.int64)),
                     pa.array(n[at : at + 50_000])],
                    names=["h1", "h2", "n"],
                )

    counted = slim(docs).mapInArrow(run, "h1 long, h2 long, n long")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, shards: int, frequent: int) -> DataFrame:
    """One row for each shard: ``shard, shift, prints, counts`` as bytes of arrays.

    Lines of more than ``frequent`` documents are in the shard ``OWN_SHARD``.
    """

    def run(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        h2 = table["h2"].to_numpy().view(np.uint64)
        place = MinimalHash.build(h1, h2)
        at = place(h1, h2)
        prints, n = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.int64)
        prints[at], n[at] = h1, table["n"].to_numpy()
        return pa.table({
            "shard": table["shard"][:1],
            "shift": [place.shift.tobytes()], "prints": [prints.tobytes()], "counts": [n.tobytes()],
        })

    shard = F.when(F.col("n") > frequent, F.lit(OWN_SHARD)).otherwise(F.pmod("h1", F.lit(shards)))
    dealt = counts.withColumn("shard", shard.cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, "shard long, shift binary, prints binary, counts binary")


def _among(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return ordered[at] == hashes


def _sent(docs: DataFrame, shards: int, salts: int, own: np.ndarray, own_salts: int) -> DataFrame:
    """Each document's lines for each shard, packed: ``r1, r2, shard, salt, at, keys``.

    ``own`` are the first hashes of frequent lines, in order, ``own_salts`` the copies of their shard.
    """
    known = docs.sparkSession.sparkContext.broadcast(own)  # fewer than FREQUENT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, h1, h2, filled = _lines(block)
            begin = np.searchsorted(row, np.arange(block.num_rows))
            at = (np.arange(len(row)) - begin[row]).astype(np.int64)
            shard = np.where(_among(h1, known.value), OWN_SHARD, np.mod(h1.view(np.int64), shards))
            kept = np.flatnonzero(filled)
            order = kept[np.lexsort((at[kept], shard[kept], row[kept]))]
            r, s, a = row[order], shard[order], at[order]
            pairs = np.stack([h1[order], h2[order]], 1)
            if not len(order):
                continue
            change = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
            run_of = np.flatnonzero(change)
            inside = np.arange(len(order)) - np.repeat(run_of, np.diff(np.append(run_of, len(order))))
            first = np.flatnonzero(inside % ROW_LINES == 0)
            spans = list(zip(first.tolist(), np.append(first[1:], len(order)).tolist()))
            r1, r2 = block["r1"].to_numpy()[r[first]], block["r2"].to_numpy()[r[first]]
            copies = np.where(s[first] == OWN_SHARD, own_salts, salts).astype(np.uint64)
            salt = _mix(r1.view(np.uint64) + inside[first].astype(np.uint64)) % copies
            for i in range(0, len(first), 10_000):
                part = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r1[part]), pa.array(r2[part]), pa.array(s[first][part]),
                     pa.array(salt[part].astype(np.int64)),
                     pa.array([a[x:y].tobytes() for x, y in spans[part]], pa.binary()),
                     pa.array([pairs[x:y].tobytes() for x, y in spans[part]], pa.binary())],
                    names=["r1", "r2", "shard", "salt", "at", "keys"],
                )

    return docs.mapInArrow(run, "r1 long, r2 long, shard long, salt long, at binary, keys binary")


def _probe(min_docs: int):
    def run(rows: pa.Table, index: pa.Table) -> pa.Table:
        out = {"r1": [], "r2": [], "drop": []}
        if rows.num_rows and index.num_rows:
            shift = np.frombuffer(index["shift"][0].as_py(), np.int64)
            prints = np.frombuffer(index["prints"][0].as_py(), np.uint64)
            counts = np.frombuffer(index["counts"][0].as_py(), np.int64)
            place = MinimalHash(shift, len(prints))
            for part in rows.to_batches(max_chunksize=20_000):
                keys, ats = part.column("keys").to_pylist(), part.column("at").to_pylist()
                pairs = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
                at = np.frombuffer(b"".join(ats), np.int64)
                slot = place(pairs[:, 0], pairs[:, 1])
                hit = (prints[slot] == pairs[:, 0]) & (counts[slot] >= min_docs)
                ends = np.cumsum([len(x) // 8 for x in ats])
                upto = np.concatenate([[0], np.cumsum(hit)])
                some = upto[ends] - upto[np.concatenate([[0], ends[:-1]])] > 0
                r1, r2 = part.column("r1").to_numpy(), part.column("r2").to_numpy()
                for i in np.flatnonzero(some):
                    span = slice(ends[i - 1] if i else 0, ends[i])
                    out["r1"].append(r1[i])
                    out["r2"].append(r2[i])
                    out["drop"].append(at[span][hit[span]].tobytes())
        return pa.table([pa.array(out["r1"], pa.int64()), pa.array(out["r2"], pa.int64()), pa.array(out["drop"], pa.binary())],
                        names=["r1", "r2", "drop"])

    return run


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, with_text: bool = False) -> DataFrame:
    """Documents without the lines found in ``min_docs`` documents or more.

    Returns ``doc_id, n_lines, n_dropped, kept_sha256`` and, if asked for, the
    kept ``text``.  Lines are split at the line feed; a line's key is the line
    without ``BLANKS`` at its ends and with A-Z lower-cased; empty keys always
    stay.  Null and empty texts are one empty line.  Every row counts as a document, repeated rows
    too; null ids are kept; an empty table gives no rows; other columns are not read.
    ``min_docs`` must be 2 or more.
    """
    if min_docs < 2:
        raise ValueError("lines of a single document are not indexed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    marked = slim(
        docs.select(key.alias("doc_id"), text.alias("text"))
        .withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "doc_id", "text")}),
        "doc_id", "r1", "r2",
    )
    counts = materialize(document_counts(docs).filter("n > 1"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # All lines are sent, those of single documents too.
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    total = docs.agg(F.sum(breaks.cast("long") + 1)).first()[0] or 0
    held = counts.count()
    shards = max(1, -(-held // SHARD_LINES))
    frequent = max(GROUP_LINES, total // FREQUENT)
    own = counts.filter(F.col("n") > frequent).select("h1", "n").collect()  # fewer than FREQUENT
    hashes = np.sort(np.array([r.h1 for r in own], np.int64).view(np.uint64))
    # A document can hold a frequent line several times; lines of the other shards are no more than all.
    salts = max(1, -(-total // (shards * GROUP_LINES)), -(-parts // shards))
    own_salts = max(1, -(-total // GROUP_LINES)) if own else 1
    index = materialize(build_index(counts, shards, frequent))
    last = F.when(F.col("shard") == OWN_SHARD, F.lit(own_salts)).otherwise(F.lit(salts)) - 1
    copied = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    sent = _sent(marked.select("r1", "r2", "text"), shards, salts, hashes, own_salts)
    found = sent.groupBy("shard", "salt").cogroup(copied.groupBy("shard", "salt")).applyInArrow(
        _probe(min_docs), "r1 long, r2 long, drop binary"
    )
    # Equal rows send equal lists, of which one is enough.
    drops = found.distinct().groupBy("r1", "r2").agg(F.collect_list("drop").alias("drops"))
    joined = marked.join(drops, ["r1", "r2"], "left").select("doc_id", "text", "drops")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, dropped, said, kept = [], [], [], []
            for text, lists in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist()):
                lines = text.split("\n")
                totals.append(len(lines))
                if lists:
                    gone = np.unique(np.frombuffer(b"".join(lists), np.int64))
                    stay = np.ones(len(lines), bool)
                    stay[gone] = False
                    lines = [lines[i] for i in np.flatnonzero(stay)]
                dropped.append(totals[-1] - len(lines))
                kept.append("\n".join(lines))
                said.append(hashlib.sha256(kept[-1].encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(said, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(
        finish, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    )
