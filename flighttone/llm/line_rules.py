"""Quality rules on documents, among them how many documents of a host share each line.

Lines are known by 128-bit hashes of their words, lower-cased and joined by one
space.  One pass over the texts writes a narrow row for each document: what the
rules of a single document need, and the hashes of its distinct lines.  Lines are counted
over all documents of each host; those above the limits are
removed, and documents that lose too much with them are rejected.  Texts are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import blocks, no_collector, slim, sums, utf8
from flighttone.scale import join_unique, materialize, small_side

#: A line goes that more than this many documents of its host have, and more than this share of them.
LIMIT_DOCS, LIMIT_SHARE = 10, 0.01
#: A document is depleted with fewer words left, or a smaller share of its words.
LEAST_WORDS, LEAST_SHARE = 20, 0.5
#: Bytes of text looked at together: numbers of all words, windows and lines take some twenty times as much.
BLOCK = 4 << 20
#: Words of a window looked for twice, per cent of a text's words in such windows, characters counted.
WINDOW, REPEATED = 8, 30
SYMBOLS = "#*$%&|<>"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _numbers(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers from 0 on."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _spans(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct ones of the spans of ``raw``, and which of them each span is."""
    sizes = last - first
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
    array = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[at])]
    ).dictionary_encode()
    return array.indices.to_numpy(zero_copy_only=False).astype(np.int64), array.dictionary.to_pylist()


def _repeated(word: np.ndarray, text: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words are in a window of ``size`` (a power of two) that its text holds twice or more."""
    out = np.zeros(len(word), bool)
    if len(word) < size:
        return out
    windows = word
    for step in (2**k for k in range(size.bit_length() - 1)):
        left, right = windows[:-step], windows[step:]
        windows = _numbers(left * (windows.max() + 1) + right)
    inside = np.flatnonzero(text[: len(windows)] == text[size - 1 :])
    if not len(inside):
        return out
    same = _numbers(text[inside] * (windows.max() + 1) + windows[inside])
    again = inside[np.bincount(same)[same] > 1]
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _facts(block: pa.Table) -> dict[str, np.ndarray]:
    """For each text of a block the numbers the rules need, and its distinct lines' hashes and words."""
    raw, bounds = utf8(block["text"])
    n = len(bounds) - 1
    filled = ~_BLANK[raw]
    before = np.concatenate([[False], filled])[: len(raw)]
    starts = filled & ~before
    # A word cannot reach over a text's end.
    edge = bounds[:-1][bounds[:-1] < len(raw)]
    starts[edge] |= filled[edge]
    first = np.flatnonzero(starts)
    ends = filled & ~np.concatenate([filled[1:], [False]])[: len(raw)]
    edge = bounds[1:][bounds[1:] > 0] - 1
    ends[edge] |= filled[edge]
    last = np.flatnonzero(ends) + 1
    text_of = np.searchsorted(bounds, first, "right") - 1
    which, _ = _spans(raw, first, last)
    repeated = _repeated(which, text_of)
    lead = filled & ((raw & 0xC0) != 0x80)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    # Lines, of which only those with a word count.
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    begin = begin[begin < len(raw)]
    stop = np.minimum(np.append(begin[1:], len(raw)), bounds[np.searchsorted(bounds, begin, "right")])
    stop -= raw[stop - 1] == 10
    words = np.searchsorted(first, stop) - np.searchsorted(first, begin)
    some = words > 0
    begin, stop, words = begin[some], stop[some], words[some]
    line_text = np.searchsorted(bounds, begin, "right") - 1
    line, distinct = _spans(raw, begin, stop)
    pair = line_text * (len(distinct) + 1) + line
    keys = b"".join(xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in distinct)
    hashes = np.frombuffer(keys, np.uint64).reshape(-1, 2)[line]
    # Distinct keys of each text, with all the words of their lines.
    order = np.lexsort((hashes[:, 1], hashes[:, 0], line_text))
    of, h = line_text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return {
        "n_words": np.bincount(text_of, minlength=n),
        "word_chars": per_text(lead),
        "n_symbols": per_text(_SYMBOL[raw]),
        "n_dup_lines": np.bincount(line_text, minlength=n) - np.bincount(np.unique(pair) // (len(distinct) + 1), minlength=n),
        "n_repeat_words": np.bincount(text_of[repeated], minlength=n),
        "lines": np.searchsorted(of[at], np.arange(n + 1)),
        "h1": h[at, 0].view(np.int64), "h2": h[at, 1].view(np.int64),
        "words": sums(words[order], np.append(at, len(order))),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host``, the numbers of the rules and ``lines``, an array of hashes and words: a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK):
            with no_collector():
                found = _facts(block)
            inner = pa.StructArray.from_arrays([pa.array(found[c]) for c in ("h1", "h2", "words")], names=["h1", "h2", "words"])
            columns = [block["doc_id"].combine_chunks(), block["host"].combine_chunks()]
            columns += [pa.array(found[c].astype(np.int64)) for c in _COUNTS]
            columns += [pa.ListArray.from_arrays(pa.array(found["lines"], pa.int32()), inner)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", *_COUNTS, "lines"])

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text"),
    )
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return slim(named, "doc_id", "host").mapInArrow(
        run, f"doc_id long, host string, {counts}, lines array<struct<h1: long, h2: long, words: long>>"
    )


def above_limits(lines: DataFrame, hosts: DataFrame, limit_docs: int, limit_share: float) -> DataFrame:
    """Lines of more documents of a host than both limits allow: ``host, h1, h2, n``."""
    counted = lines.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit_docs)
    return join_unique(counted, hosts, ["host"], "docs").filter(F.col("n") > F.col("docs") * limit_share).drop("docs")


def judge(
    docs: DataFrame,
    host: str = "source",
    limit_docs: int = LIMIT_DOCS,
    limit_share: float = LIMIT_SHARE,
    least_words: int = LEAST_WORDS,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Numbers of each document, words left without its host's frequent lines, and whether it is kept.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, words_left``.  A line is removed, in all documents of its host, that more
    than ``limit_docs`` and more than ``limit_share`` of the host's documents have; lines without
    a word are never counted.  A document is rejected that fails the rules of a single document
    (``base_failed``), or whose lines left hold fewer than ``least_words`` words or less than
    ``least_share`` of its words.  Every row is a document, repeated rows and
    copies too; null and empty hosts are one host; a null or empty text has no word and fails; null ids
    are kept; an empty table gives no rows; other columns are not read.
    """
    narrow = materialize(facts(docs, host).withColumn("row", F.monotonically_increasing_id()))
    lines = narrow.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    hosts = materialize(narrow.groupBy("host").agg(F.count(F.lit(1)).alias("docs")))
    frequent = materialize(above_limits(lines, hosts, limit_docs, limit_share))
    # A small list leaves the lines in place; beyond that only very frequent ones do.
    broadcast = small_side(frequent)
    met = lines.join(broadcast, ["host", "h1", "h2"]) if broadcast is not frequent else join_unique(
        lines, frequent, ["host", "h1", "h2"], "n")
    removed = met.groupBy("row").agg(F.sum("words").alias("removed"))
    judged = narrow.drop("lines").join(removed, "row", "left").withColumn(
        "words_left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    return judged.select("doc_id", *_COUNTS, _failed().alias("base_failed"), (
        ~_failed() & (F.col("words_left") >= least_words) & (F.col("words_left") >= F.col("n_words") * least_share)
    ).alias("kept"), "words_left")


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def sql() -> str:
    """The default rules as DuckDB SQL, rows told apart by number."""
    blank, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '{word}') AS ws FROM d),
    win AS (SELECT r, b, array_to_string(ws[b : b + {WINDOW - 1}], ' ') AS g
            FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS b FROM w)),
    again AS (SELECT r, b FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    rep AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(b, b + {WINDOW})) AS pos FROM again) GROUP BY r),
    l AS (SELECT r, host, line, len(regexp_extract_all(line, '{word}')) AS words,
                 trim(regexp_replace({lower.format('line')}, '{blank}', ' ', 'g')) AS key
          FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{word}')),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
    hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
    often AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT r) AS n FROM l GROUP BY host, key) JOIN hosts USING (host)
              WHERE n > {LIMIT_DOCS} AND n > docs * CAST({LIMIT_SHARE} AS DOUBLE)),
    gone AS (SELECT r, sum(words) AS n FROM l SEMI JOIN often USING (host, key) GROUP BY r),
    f AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                 length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                 coalesce(rep.n, 0) AS n_repeat_words, len(ws) - coalesce(gone.n, 0) AS words_left
          FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
    b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND words_left >= {LEAST_WORDS} AND words_left >= n_words * {LEAST_SHARE} AS kept,
           CAST(words_left AS BIGINT) AS words_left
    FROM b"""
