"""Byte-level BPE by a sentencepiece model that is written down directly from a rank file.

The model holds one piece for each rank: the token's bytes, each as the printable
character that stands for it, with the negative rank as score.  So the merge
with the lowest rank is the merge with the highest score.  Normalisation is the
identity, no blank is added or taken away.  A text is split by the vocabulary's
pattern, each match is encoded by itself, and ids are decoded by the inverse
mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.llm.texts import Encoder, blocks, byte_letters, slim

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Fixed values of the model format: field numbers, wire types and enumerations.
_VARINT, _BYTES, _FLOAT = 0, 2, 5
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_BPE = 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == _BYTES:
        return head + _varint(len(value)) + value
    return head + (_varint(value) if kind == _VARINT else value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file's bytes: pieces in order of rank, so a piece's id is its rank."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = bytearray()
    for rank, token in enumerate(order):
        piece = "".join(letters[b] for b in token).encode()
        body = _field(1, _BYTES, piece) + _field(2, _FLOAT, struct.pack("<f", -rank)) + _field(3, _VARINT, _NORMAL)
        out += _field(_PIECES, _BYTES, body)
    unknown = _field(1, _BYTES, b"<unk>") + _field(2, _FLOAT, struct.pack("<f", 0)) + _field(3, _VARINT, _UNKNOWN)
    out += _field(_PIECES, _BYTES, unknown)
    out += _field(_TRAINER, _BYTES, _field(3, _VARINT, _BPE))
    plain = _field(1, _BYTES, b"identity")
    for option in (3, 4, 5):  # blank in front, blanks removed, blanks escaped
        plain += _field(option, _VARINT, 0)
    return bytes(out + _field(_NORMALIZER, _BYTES, plain))


class PieceCoder:
    """Encodes texts and decodes ids of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.tokens = sorted(ranks, key=ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self._split = regex.compile(pattern).findall
        self._letters = dict(enumerate(byte_letters()))
        self._whole = ranks
        self.encoder = Encoder(self._encode)
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self._begin, self._size = np.cumsum(sizes) - sizes, sizes
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        words, counts = [], []
        for piece in pieces:
            found = self._split(piece)
            counts.append(len(found))
            words += [w.encode().decode("latin-1").translate(self._letters) for w in found]
        ids = iter(self.model.encode(words, num_threads=1)) if words else iter(())
        out = []
        for n in counts:
            part = next(ids) if n else []
            for _ in range(n - 1):
                part = part + next(ids)
            out.append(part)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encoder(pa.chunked_array([pa.array([text])]))[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, by the inverse of the mapping."""
        ids = np.asarray(ids, np.int64)
        sizes = self._size[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self._begin[ids] - (ends - sizes), sizes)
        return self._bytes[where + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_coders: dict[tuple[str, str], PieceCoder] = {}


def coder(path: str, pattern: str) -> PieceCoder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = PieceCoder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Ids of every text, decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    ``ranks`` is a rank file, ``pattern`` splits texts before the merges.  Null
    texts are empty and have no ids; repeated rows and null ids are kept as they
    are; an empty table gives no rows; other columns are not read.  A map: no
    shuffle, memory bounded by a block of texts.
    """
    from array import array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        decimal = [str(i).encode() for i in range(len(own.tokens))]
        for block in blocks(batches):
            ids, bounds = own.encoder(block["text"])
            listed = ids.tolist()
            spans = list(zip(bounds.tolist(), bounds[1:].tolist()))
            said = [hashlib.sha256(b" ".join([decimal[i] for i in listed[a:b]])).hexdigest() for a, b in spans]
            back = [hashlib.sha256(own.decode(ids[a:b])).hexdigest() for a, b in spans]
            columns = [block["doc_id"].combine_chunks(), pa.array(np.diff(bounds)), pa.array(said), pa.array(back)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([array("q", listed[a:b]) for a, b in spans], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = slim(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return narrow.mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)
