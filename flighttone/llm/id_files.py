"""Token ids in files: each document compressed by itself with one shared dictionary.

A file holds consecutive documents in ascending ``doc_id`` order::

    magic 8 bytes | version, id width, unused: 3 x uint16 | dictionary sha256 32 bytes
    one zstandard frame for each document
    index: doc_id int64 (int64 min: null), frame begin uint64, ids uint64, crc32 uint32, each as one array
    number of documents uint64 | index begin uint64 | magic 8 bytes

The index gives any document by two short reads.  The dictionary lies beside
the files, named by its hash, which is checked whenever a file is opened.  Files
are written by tasks through Arrow's file systems (local, HDFS, S3, GCS): under
a name of the attempt first and moved when complete, so lost executors leave no
half files in the list that is returned.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flighttone.llm.texts import blocks, slim, tokenizer_encoder
from flighttone.scale import ensure_checkpoint_dir, materialize

MAGIC = b"IDFILE01"
HEAD = "<8s3H32s"
TAIL = "<QQ8s"
#: Documents the dictionary is trained on, about, and ids of each.
TRAIN_DOCS = 1500
TRAIN_IDS = 16_384
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Compressed bytes of one file, about.
FILE_BYTES = 128 << 20
_NULL = np.iinfo(np.int64).min
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/").match


def id_type(vocabulary: int) -> np.dtype:
    """Two bytes an id where the vocabulary allows, else four."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, dtype: np.dtype, train_docs: int = TRAIN_DOCS) -> bytes:
    """Dictionary of at most ``DICTIONARY_BYTES`` from a bounded sample of serialised documents.

    Only the dictionary depends on the sample: about ``train_docs`` documents, at
    most twice as many, chosen by the hash of id and text, and at most ``TRAIN_IDS``
    ids of each.
    """

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_encoder(tokenizer)
        for block in blocks(batches):
            ids, bounds = encode(block["text"])
            parts = [ids[a : min(b, a + TRAIN_IDS)].astype(dtype).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["ids"])

    share = min(1.0, train_docs / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    found = slim(docs.filter(chosen).limit(2 * train_docs)).mapInArrow(serialise, "ids binary")
    samples = [bytes(r.ids) for r in found.collect() if len(r.ids) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if _SCHEME(path) else (pafs.LocalFileSystem(), path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    # Spark has qualified this path, so that tasks open it in the file system Spark uses.
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenise ``docs`` (``doc_id``, ``text``) and write their ids; one row per file.

    Rows: ``file``, ``path``, ``n_docs``, ``n_ids``.  Null texts are empty, so the
    end id alone; null ids come first; rows with one id are ordered by their
    bytes, and also they are spread over files.  An empty table writes no file.  Other
    columns are not read.  On a cluster ``folder`` must name its file system.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    if not _SCHEME(folder) and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{folder} names no file system, so each executor would take its own disk")
    dtype = id_type(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    trained = train_dictionary(docs, tokenizer, dtype)
    digest = hashlib.sha256(trained).digest()
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{digest.hex()}.dictionary") as out:
        out.write(trained)
    dictionary = spark.sparkContext.broadcast(trained)  # at most DICTIONARY_BYTES

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary.value)).compress
        for block in blocks(batches):
            ids, bounds = encode(block["text"])
            frames, counts, crcs = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                whole = np.append(ids[a:b], np.uint32(end_id))
                frames.append(pack(whole.astype(dtype).tobytes()))
                counts.append(len(whole))
                crcs.append(zlib.crc32(whole.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"].combine_chunks(), pa.array(frames, pa.binary()),
                 pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "frame", "n", "crc"],
            )

    narrow = slim(docs, F.col("doc_id").cast("long").alias("doc_id"))
    frames = materialize(narrow.mapInArrow(compress, "doc_id long, frame binary, n long, crc long"))
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(shuffled, -(-size // file_bytes))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _open(folder)
        name = f"{root}/part-{task.partitionId():06d}.ids"
        own = f"{root}/_attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        index: list[list[np.ndarray]] = [[], [], [], []]
        at = struct.calcsize(HEAD)
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(own)
                out.write(struct.pack(HEAD, MAGIC, 1, dtype.itemsize, 0, digest))
            parts = batch.column("frame").to_pylist()
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = batch.column("doc_id").fill_null(int(_NULL)).to_numpy(zero_copy_only=False)
            begin = at + np.cumsum(sizes) - sizes
            for x, found in zip(index, (ids, begin, batch.column("n").to_numpy(), batch.column("crc").to_numpy())):
                x.append(found)
            out.write(b"".join(parts))
            at += int(sizes.sum())
        if out is None:
            return
        columns = [np.concatenate(x) for x in index]
        for x, kind in zip(columns, ("<i8", "<u8", "<u8", "<u4")):
            out.write(x.astype(kind).tobytes())
        out.write(struct.pack(TAIL, len(columns[0]), at, MAGIC))
        out.close()
        fs.move(own, name)
        uri = f"{folder}/{name.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_pydict(
            {"file": [task.partitionId()], "path": [uri], "n_docs": [len(columns[0])], "n_ids": [int(columns[2].sum())]}
        )

    # Rows that are equal, or have no id, could not be split between files but for the last key; written rows keep it.
    order = ("doc_id", "n", "crc", "tie")
    placed = frames.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(files, *order)
    placed = placed.sortWithinPartitions("doc_id", "n", "crc", "frame", "tie").drop("tie")
    return materialize(placed.mapInArrow(store, "file long, path string, n_docs long, n_ids long"))


class IdFile:
    """One file, of which the index is read at once and documents when asked for."""

    def __init__(self, path: str):
        self._fs, self._path = _open(path)
        self._file = self._fs.open_input_file(self._path)
        magic, _, width, _, digest = struct.unpack(HEAD, self._file.read_at(struct.calcsize(HEAD), 0))
        end = self._file.size()
        n, begin, closing = struct.unpack(TAIL, self._file.read_at(struct.calcsize(TAIL), end - struct.calcsize(TAIL)))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{path} is no complete id file")
        with self._fs.open_input_stream(f"{self._path.rsplit('/', 1)[0]}/{digest.hex()}.dictionary") as f:
            trained = f.read()
        if hashlib.sha256(trained).digest() != digest:
            raise ValueError(f"{path} was written with another dictionary")
        self._dtype = np.dtype(f"<u{width}")
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
        index = io.BytesIO(self._file.read_at(end - struct.calcsize(TAIL) - begin, begin))
        take = lambda kind: np.frombuffer(index.read(n * np.dtype(kind).itemsize), kind)
        self.doc_ids, starts, self.counts, self.crcs = take("<i8"), take("<u8"), take("<u8"), take("<u4")
        self._begin = np.append(starts, np.uint64(begin)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frames(self, first: int, last: int) -> list[bytes]:
        low = int(self._begin[first])
        data = self._file.read_at(int(self._begin[last]) - low, low)
        cut = (self._begin[first : last + 1] - low).tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the file's document ``i``, checked."""
        return self._whole(self.frames(i, i + 1)[0], i)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        step = 1000
        for at in range(0, len(self), step):
            for i, frame in enumerate(self.frames(at, min(at + step, len(self))), at):
                key = int(self.doc_ids[i])
                yield (None if key == _NULL else key), self._whole(frame, i)

    def _whole(self, frame: bytes, i: int) -> np.ndarray:
        size = int(self.counts[i]) * self._dtype.itemsize
        ids = np.frombuffer(self._unpack.decompress(frame, max_output_size=size), self._dtype).astype("<u4")
        if len(ids) != self.counts[i] or zlib.crc32(ids.tobytes()) != self.crcs[i]:
            raise ValueError(f"document {i} of {self._path} is damaged")
        return ids


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files that ``write`` listed: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before, over all files in order.
    One task reads one file, so a file is the unit of recovery as well.
    """
    # One row per file of FILE_BYTES, so the window stays small beside the data.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    begun = files.withColumn("begun", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("begun").to_pylist()):
                for part in _parts(IdFile(path)):
                    counts = np.array([len(x) for _, x in part], np.int64)
                    upto = start + np.cumsum(counts)
                    columns = [
                        pa.array([k for k, _ in part], pa.int64()), pa.array(upto - counts), pa.array(counts),
                        pa.array([zlib.crc32(x.tobytes()) for _, x in part], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for _, x in part], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start = int(upto[-1])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = begun.select("path", "begun").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(load, schema)


def _parts(file: IdFile, rows: int = 2000, size: int = 4_000_000) -> Iterator[list]:
    part, held = [], 0
    for row in file:
        part.append(row)
        held += len(row[1])
        if len(part) >= rows or held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part
