"""Blocks of texts inside a task: cut into pieces, each distinct piece looked at once.

Tokens of the public tokenizers never reach from a word over white space that
follows it, nor from a letter to a punctuation mark.  Texts can therefore be cut
there, equal pieces met once, and the results put together again.  Cutting is
cautious: where a byte could be the end of a white space character outside
ASCII no cut is made, which only makes a piece longer.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; one longer text makes a block of its own.
BLOCK_BYTES = 14 << 20
#: Distinct pieces whose result a Python worker keeps between blocks.
KEPT_PIECES = 200_000
#: Rows in one Arrow batch; the bytes of a block bound what is held.
BATCH_ROWS = 2000


#: Kinds of bytes: 1 white space, 2 punctuation, 4 letter, 8 surely no white space.
_KIND = np.zeros(256, np.uint8)
for _bit, _spans in (
    (1, ((9, 13), (32, 32))),
    (2, ((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))),
    (4, ((65, 90), (97, 122))),
    (8, ((33, 126), (128, 255))),
):
    for _low, _high in _spans:
        _KIND[_low : _high + 1] |= _bit


def slim(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text, null as empty, and nothing else of the table.

    Batches are made no longer than ``BATCH_ROWS``; shorter ones that the session asks for stay.
    """
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    return df.select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


@contextmanager
def no_collector() -> Iterator[None]:
    """Without the cycle search, which walks all kept pieces again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches put together up to ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        if held and held_bytes + batch.nbytes > size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, held_bytes = [], 0
        for part in _halves(batch, size):
            held.append(part)
            held_bytes += part.nbytes
            if held_bytes > size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _halves(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= size or batch.num_rows < 2:
        yield batch
        return
    middle = batch.num_rows // 2
    yield from _halves(batch.slice(0, middle), size)
    yield from _halves(batch.slice(middle), size)


def utf8(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the offsets of the texts in them."""
    array = column.cast(pa.large_binary())
    array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        kind = _KIND[raw]
        wide = np.flatnonzero(raw >= 0x80)
        back2, back3 = raw[np.maximum(wide - 1, 0)], raw[np.maximum(wide - 2, 0)]
        space2 = (back2 == 0xC2) & ((raw[wide] == 0x85) | (raw[wide] == 0xA0))
        kind[wide[space2 | ((back3 >= 0xE1) & (back3 <= 0xE3))]] = 0
        here, before = kind[1:], kind[:-1]
        cut[1:-1] = (here & 1 & (before >> 3)) | ((here >> 1) & (before >> 2) & 1)
    cut[bounds] = True
    return np.flatnonzero(cut)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each run, the runs beginning at ``first`` (one more at the end); each by itself."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out


class Pieces:
    """The pieces of a block of texts: ``distinct`` ones, and which of them each text has in order."""

    def __init__(self, column: pa.ChunkedArray):
        raw, self.bounds = utf8(column)
        at = _cuts(raw, self.bounds)
        self.first = np.searchsorted(at, self.bounds)
        count = len(at) - 1
        array = pa.Array.from_buffers(
            pa.large_string(), count, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]
        ).dictionary_encode()
        self.which = array.indices.to_numpy(zero_copy_only=False)
        self.distinct: list[str] = array.dictionary.to_pylist()

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the pieces of each text of ``values`` given for each distinct piece."""
        return sums(values[self.which], self.first)


class Encoder:
    """Ids of texts, from a function that encodes a list of distinct pieces.

    Results for pieces met more than once in a block stay in the worker, up to
    ``KEPT_PIECES``; then the store starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self._encode = encode
        self._kept: dict[str, list[int]] = {}

    def __call__(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text begins (one more at the end)."""
        with no_collector():
            return self._ids(column)

    def _ids(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        pieces = Pieces(column)
        if not pieces.distinct:
            return np.zeros(0, np.uint32), np.zeros(len(pieces.bounds), np.int64)
        known = list(map(self._kept.get, pieces.distinct))
        new = [i for i, ids in enumerate(known) if ids is None]
        if len(self._kept) + len(new) > KEPT_PIECES:
            self._kept.clear()
        often = (np.bincount(pieces.which, minlength=len(known)) > 1).tolist()
        for i, ids in zip(new, self._encode([pieces.distinct[i] for i in new])):
            known[i] = ids
            if often[i] and len(ids) < 32:
                self._kept[pieces.distinct[i]] = ids
        sizes = np.fromiter(map(len, known), np.int32, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        taken = sizes[pieces.which]
        upto = np.concatenate([[0], np.cumsum(taken)])
        where = np.arange(upto[-1], dtype=np.int32 if upto[-1] < 1 << 31 else np.int64)
        where += np.repeat((begin[pieces.which] - upto[:-1]).astype(where.dtype), taken)
        return flat[where], upto[pieces.first]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_WORD = re.compile("[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_encoders: dict[tuple, Encoder] = {}


def tokenizer_encoder(path: str) -> Encoder:
    """Encoder of a file for the tokenizers library, one for each worker.

    A piece that is one word of Latin letters, with a blank or line break
    before it at most, goes to the library's model as the file's own splitting
    rules would hand it over; any other piece takes the library's whole way.
    """
    if ("tokenizers", path) in _encoders:
        return _encoders["tokenizers", path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    model = tokenizer.model
    letters = dict(enumerate(byte_letters()))
    words = bool(model.end_of_word_suffix)
    blank, tokenize = letters[32], model.tokenize
    line = tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest, broken = [], []
        for i, piece in enumerate(pieces):
            if not _WORD(piece):
                rest.append(i)
                continue
            if piece[0] == "\n":
                broken.append(i)
            if words:
                piece = piece.strip().lower()
            elif piece[0] == "\n":
                piece = piece[1:]
            if not piece.isascii():
                piece = piece.encode().decode("latin-1")
                piece = piece.translate(letters)
            elif not words and piece[0] == " ":
                piece = blank + piece[1:]
            out[i] = [t.id for t in tokenize(piece)]
        for i in broken:
            out[i] = line + out[i]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            said = tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, said):
                out[i] = e.ids
        return out

    return _encoders.setdefault(("tokenizers", path), Encoder(encode))
