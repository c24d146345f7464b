"""Scan of a tree of WAV files.

The scan is a map over files: identity, group, name facts and samples all come
from one file, so nothing is shuffled.  Load order is a table of its own over
the narrow file list (``load_order``), joined only where order matters.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flighttone.functions.names import decode_filename, normalise_temp, split_path
from flighttone.functions.waveform import pad_waveform, scale_waveform
from flighttone.operators.order import with_group, with_load_seq
from flighttone.params import DEFAULT, Params

# Fixed codes of the sample formats that are read.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE

#: Zero crossings of the resampling kernel on each side, and its Kaiser shape.
SINC_ZEROS = 32
SINC_SHAPE = 10.0
#: Largest matrix of resampling weights that is kept, 16 MB.
CYCLE_CELLS = 2_000_000


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in [-1, 1] of one RIFF file; channels are averaged."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == EXTENSIBLE:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("format or data chunk is missing")
    code, channels, rate, _, _, bits = form
    width = bits // 8
    if channels < 1 or rate < 1 or width < 1:
        raise ValueError("impossible sample format")
    data = data[: len(data) - len(data) % (width * channels)]
    if code == FLOAT and bits in (32, 64):
        x = np.frombuffer(data, f"<f{width}").astype(float)
    elif code == PCM and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif code == PCM and bits == 24:
        low, mid, high = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32).T
        x = (((low | mid << 8 | high << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    elif code == PCM and bits in (16, 32):
        x = np.frombuffer(data, f"<i{width}") / float(1 << (bits - 1))
    else:
        raise ValueError(f"unsupported sample format {code} with {bits} bits")
    return rate, x.reshape(-1, channels).mean(axis=1)


def _kernel(t: np.ndarray, cut: float, reach: int) -> np.ndarray:
    inside = np.clip(1 - (t / (reach + 1)) ** 2, 0, None)
    return cut * np.sinc(cut * t) * np.i0(SINC_SHAPE * np.sqrt(inside)) / np.i0(SINC_SHAPE)


def _kernel_reach(rate: int, target: int) -> tuple[float, int]:
    cut = min(1.0, target / rate)
    return cut, int(np.ceil(SINC_ZEROS / cut))


@functools.lru_cache(maxsize=8)
def _cycle_weights(rate: int, target: int) -> np.ndarray:
    """Weights of one cycle of output samples over the input samples they need.

    The kernel's phases come round again after ``up`` output samples, which is
    ``step`` input samples further on.
    """
    cut, reach = _kernel_reach(rate, target)
    up, step = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    weights = np.zeros((step + 2 * reach + 1, up))
    for phase in range(up):
        base, part = divmod(phase * step, up)
        weights[base : base + 2 * reach + 1, phase] = _kernel(part / up - np.arange(-reach, reach + 1), cut, reach)
    return weights


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Windowed-sinc interpolation at the new sample times, cut off below both Nyquist limits.

    One matrix product a clip; rates with few common factors, whose weights
    would exceed ``CYCLE_CELLS``, are evaluated sample by sample.
    """
    if rate == target or len(x) == 0:
        return x
    cut, reach = _kernel_reach(rate, target)
    n = -(-len(x) * target // rate)
    up, step = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    if up * (step + 2 * reach + 1) <= CYCLE_CELLS:
        weights = _cycle_weights(rate, target)
        cycles = -(-n // up)
        padded = np.zeros((cycles - 1) * step + len(weights))
        kept = min(len(x), len(padded) - reach)
        padded[reach : reach + kept] = x[:kept]
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(weights))[::step]
        return (windows @ weights).ravel()[:n]
    offsets = np.arange(-reach, reach + 1)
    padded = np.pad(x, reach + 1)
    out = np.empty(n)
    for start in range(0, n, 4096):
        at = np.arange(start, min(start + 4096, n)) * (rate / target)
        base = np.floor(at).astype(int)
        weight = _kernel(at[:, None] - (base[:, None] + offsets), cut, reach)
        out[start : start + len(at)] = (padded[base[:, None] + offsets + reach + 1] * weight).sum(axis=1)
    return out


def resample_column(target: int):
    """Function of samples and their rate: the samples at the rate ``target``."""
    @F.arrow_udf("array<double>")
    def apply(samples: pa.Array, rates: pa.Array) -> pa.Array:
        out = [
            None if x is None else resampled(np.asarray(x, float), rate, target)
            for x, rate in zip(samples.to_numpy(zero_copy_only=False), rates.to_pylist())
        ]
        return pa.array(out, pa.list_(pa.float64()))

    return apply


def resample(df: DataFrame, sr: int = 8000, column: str = "rawdata", rate: str = "fs_in") -> DataFrame:
    """Bring every recording to ``sr``."""
    return df.withColumn(column, resample_column(sr)(column, rate))


def _decoded(content: pa.Array) -> pa.Array:
    rates, samples, errors = [], [], []
    for item in content:
        try:
            rate, x = decode_wav(item.as_py() or b"")
            problem = None
        except (ValueError, struct.error) as failure:
            rate, x, problem = None, None, str(failure)
        rates.append(rate)
        samples.append(x)
        errors.append(problem)
    return pa.StructArray.from_arrays(
        [pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.float64())), pa.array(errors, pa.string())],
        names=["fs_in", "rawdata", "error"],
    )


def read_content(content: Column | str) -> Column:
    """Bytes of a file as ``struct<fs_in, rawdata, error>``."""

    @F.arrow_udf("struct<fs_in:int,rawdata:array<double>,error:string>")
    def decode(files: pa.Array) -> pa.Array:
        return _decoded(files)

    return decode(content)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Files ending in exactly ``.wav`` anywhere below ``root``; reading only paths is cheap.

    Spark leaves out files without a single byte, and names starting with ``_`` or a dot.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.wav")
        .load(root)
        .withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        .withColumn("rec_id", F.xxhash64("path"))
    )


def check_ids(files: DataFrame) -> None:
    """Raise if two paths share an id."""
    shared = files.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.sum("n")).first()[0]
    if shared:
        raise ValueError(f"{shared} paths share an id with another path")


def load_order(files: DataFrame) -> DataFrame:
    """``rec_id, load_seq`` of a scan with groups; ids are checked to be unique."""
    check_ids(files)
    return with_load_seq(files.select("rec_id", "path", "group_name")).select("rec_id", "load_seq")


def decode_files(files: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Name facts, samples at the common rate and ``error`` for each file of a scan."""
    named = decode_filename(split_path(files))
    read = named.withColumn("_read", read_content("content")).drop("content")
    flat = read.select(*[c for c in read.columns if c != "_read"], "_read.*")
    ready = resample(flat, p.sr).withColumn("temp_norm", normalise_temp("temp", p.temp_min, p.temp_max))
    ready = ready.withColumns({"fs": F.lit(float(p.sr)), "waveform": F.col("rawdata")})
    return scale_waveform(pad_waveform(ready, p.min_samples), p.scale)


def read_recordings(spark: SparkSession, root: str, p: Params = DEFAULT) -> DataFrame:
    """One row per file; rows with an ``error`` have no samples."""
    return decode_files(with_group(scan_files(spark, root), root), p)


def good_records(df: DataFrame) -> DataFrame:
    return df.filter("error is null")


def bad_records(df: DataFrame) -> DataFrame:
    """The quarantine table: files that could not be read, and why."""
    return df.filter("error is not null").select("rec_id", "path", "group_name", "error")


def encode_pcm16(df: DataFrame, column: str = "waveform") -> DataFrame:
    """A WAV file of each waveform as ``content``, for the reader's own round trip."""

    @F.arrow_udf("binary")
    def encode(samples: pa.Array, rates: pa.Array) -> pa.Array:
        out = []
        for x, rate in zip(samples.to_numpy(zero_copy_only=False), rates.to_pylist()):
            data = np.clip(np.floor(np.asarray(x) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
            head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16,
                               PCM, 1, rate, rate * 2, 2, 16, b"data", len(data))
            out.append(head + data)
        return pa.array(out, pa.binary())

    return df.withColumn("content", encode(column, F.col("fs").cast("int")))
