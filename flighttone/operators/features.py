"""Feature matrices: base attribute, reduction, parameters, scaling - in that order."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.functions.batches import row_map
from flighttone.functions.wavelets import dwt_features
from flighttone.params import DEFAULT, Params
from flighttone.scale import materialize, percentiles, tree_sum

# Fixed names of the scalers offered.
SCALERS = ("NoScaler", "StandardScaler", "Normalizer", "RobustScaler")
#: Attribute behind each base feature; ``DWT_<wavelet>`` is computed on request.
FEATURES = {"PSD": "psd", "PSD_DB": "psd_db", "MFCC": "mfcc", "f1": "f1", "RAW": "rawdata"}


def _tuples(x: object) -> object:
    return tuple(map(_tuples, x)) if isinstance(x, (list, tuple, np.ndarray)) else float(x)


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature matrix is made of."""

    use: str = "MFCC"
    reduce: str | None = None
    temp: bool = False
    power: bool = False
    scaler: str = "NoScaler"
    filters: Mapping[str, tuple] | None = field(default=None, hash=False)

    def __post_init__(self) -> None:
        if self.filters is not None:
            object.__setattr__(self, "filters", {name: _tuples(taps) for name, taps in self.filters.items()})
        if self.reduce not in (None, "pca", "rbm"):
            raise ValueError("reduce by 'pca' or 'rbm', not both")
        if self.scaler not in SCALERS:
            raise ValueError(f"scaler must be one of {SCALERS}")

    @property
    def descriptor(self) -> str:
        # Taps of one's own are told apart by what they are, as names do not.
        own = self.filters and hashlib.md5(json.dumps(self.filters, sort_keys=True).encode()).hexdigest()[:12]
        parts = [self.use, own, self.reduce, "temp" if self.temp else None, "pwr" if self.power else None]
        return "_".join([*[p for p in parts if p], self.scaler])


@dataclass(frozen=True)
class FittedFeatures:
    """A specification with everything learned from the data, so new data get the same map."""

    spec: FeatureSpec
    reducer: dict | None = None
    centre: list[float] | None = None
    spread: list[float] | None = None

    def transform(self, df: DataFrame, p: Params = DEFAULT) -> DataFrame:
        x = append_params(self._reduced(base_features(df, self.spec, p)), self.spec)
        return _described(apply_scaler(x, self.spec.scaler, self.centre, self.spread), self.spec)

    def _reduced(self, x: DataFrame) -> DataFrame:
        if self.spec.reduce == "pca":
            return apply_pca(x, self.reducer)
        if self.spec.reduce == "rbm":
            return apply_rbm(x, self.reducer)
        return x

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @staticmethod
    def from_json(text: str) -> FittedFeatures:
        data = json.loads(text)
        return FittedFeatures(FeatureSpec(**data.pop("spec")), **data)


def _described(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.withMetadata("features", {"descriptor": spec.descriptor})


def descriptor_of(df: DataFrame) -> str:
    return df.schema["features"].metadata.get("descriptor", "")


def base_features(df: DataFrame, spec: FeatureSpec, p: Params = DEFAULT) -> DataFrame:
    """The base attribute as ``features array<double>``; other columns stay."""
    if spec.use.startswith("DWT_"):
        made = dwt_features(df, spec.use[4:], p, filters=spec.filters)
        return made.withColumnRenamed("dwt_features", "features")
    column = FEATURES[spec.use]
    if spec.use == "f1":
        return df.withColumn("features", F.array(F.col(column)))
    return df.withColumn("features", F.col(column))


def check_width(df: DataFrame) -> int:
    """Width of the matrix; recordings of different length cannot form one."""
    low, high = df.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if low != high:
        raise ValueError(f"features differ in length ({low} to {high}): cut or pad the recordings first")
    return high


def build_features(df: DataFrame, spec: FeatureSpec, p: Params = DEFAULT) -> tuple[DataFrame, FittedFeatures]:
    """Fit ``spec`` on ``df``; returns ``(rec_id, features)`` with its descriptor, and the fit."""
    keep = [c for c in ("label", "group_id", "group_name") if c in df.columns]
    base = base_features(df, spec, p)
    width = check_width(base)
    reducer = None
    if spec.reduce == "pca":
        reducer = fit_pca(base, min(p.pca_components, width))
    elif spec.reduce == "rbm":
        reducer = fit_rbm(base, 2 * width)
    fitted = FittedFeatures(spec, reducer)
    x = append_params(fitted._reduced(base), spec)
    centre, spread = fit_scaler(x, spec.scaler)
    fitted = dataclasses.replace(fitted, centre=centre, spread=spread)
    return fitted.transform(df, p).select("rec_id", *keep, "features"), fitted


def append_params(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Add normalised temperature and linear signal power to the end."""
    extra: list[Column] = []
    if spec.temp:
        extra.append(F.col("temp_norm"))
    if spec.power:
        extra.append(F.col("fd_power"))
    if not extra:
        return df
    return df.withColumn("features", F.concat("features", F.array(*extra)))


# --- scalers --------------------------------------------------------------------


def fit_scaler(df: DataFrame, name: str) -> tuple[list[float] | None, list[float] | None]:
    """Centre and spread per column - as many numbers as the matrix is wide."""
    if name in ("NoScaler", "Normalizer"):
        return None, None
    if name == "StandardScaler":
        moments = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("features"))
        m = df.select(moments.alias("m")).first()["m"]
        # the summary divides by n - 1, this scaler by n
        spread = np.sqrt(m["variance"].toArray() * (max(m["count"] - 1, 0) / m["count"]))
        return m["mean"].toArray().tolist(), np.where(spread > 0, spread, 1.0).tolist()
    cells = df.select(F.posexplode("features").alias("pos", "x"))
    rows = percentiles(cells, ["pos"], "x", {"lo": 0.25, "c": 0.5, "hi": 0.75}).orderBy("pos").collect()
    return [r["c"] for r in rows], [r["hi"] - r["lo"] or 1.0 for r in rows]


def apply_scaler(df: DataFrame, name: str, centre: list[float] | None = None,
                 spread: list[float] | None = None) -> DataFrame:
    if name == "NoScaler":
        return df
    if name == "Normalizer":
        length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
        normed = df.withColumn("_length", F.when(length > 0, length).otherwise(1.0))
        return normed.withColumn(
            "features", F.transform("features", lambda x: x / F.col("_length"))
        ).drop("_length")
    c, s = np.asarray(centre), np.asarray(spread)
    return df.withColumn("features", row_map(lambda x: (x - c) / s)("features"))


def scale(df: DataFrame, name: str) -> DataFrame:
    """Fit a scaler on ``df`` and apply it."""
    return apply_scaler(df, name, *fit_scaler(df, name))


# --- principal components ----------------------------------------------------------


def fit_pca(df: DataFrame, k: int) -> dict:
    """Centre, components and explained shares; a column of the component matrix each."""
    centre, _ = fit_scaler(df, "StandardScaler")
    c = np.asarray(centre)
    centred = df.select(array_to_vector(row_map(lambda x: x - c)("features")).alias("v"))
    model = PCA(k=min(k, len(c)), inputCol="v", outputCol="o").fit(centred)
    parts = model.pc.toArray()
    # the largest weight of a component is positive, so signs are reproducible
    signs = np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(parts.shape[1])])
    return {
        "centre": list(centre),
        "components": (parts * signs).tolist(),
        "explained": [float(v) for v in model.explainedVariance.toArray()],
    }


def apply_pca(df: DataFrame, fitted: dict) -> DataFrame:
    c, parts = np.asarray(fitted["centre"]), np.asarray(fitted["components"])
    return df.withColumn("features", row_map(lambda x: (x - c) @ parts)("features"))


# --- restricted Boltzmann machine ------------------------------------------------------

RBM_SEED = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


#: Rows of a block.
RBM_ROWS = 2048


def _draws(seed: int, turn: int, ids: np.ndarray, units: int) -> np.ndarray:
    """Uniform numbers of each row and unit in a round, from these alone."""
    key = (seed * 1_000_003 + turn) * 0xD6E8FEB86659FD93 % (1 << 64)
    x = (ids.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(units, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    # splitmix64, once for the row and unit and once more with the round.
    for add in (0, key):
        x = x + np.uint64((add + 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x = x ^ x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def _blocks_of(df: DataFrame) -> DataFrame:
    """``block, ids, rows``: the rows of each block in the order of their ids, as bytes; a row's block hangs on its id alone."""
    blocks = max(1, -(-df.count() // RBM_ROWS))

    def run(table: pa.Table) -> pa.Table:
        ids = table["rec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.stack(table["features"].to_pandas().to_numpy())[order]
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block], pa.int64()), "ids": [ids[order].tobytes()], "rows": [x.astype(float).tobytes()]})

    dealt = df.select(F.col("rec_id").cast("long"), F.col("features").cast("array<double>"),
                      F.pmod(F.xxhash64("rec_id"), F.lit(blocks)).alias("block"))
    return materialize(dealt.groupBy("block").applyInArrow(run, "block long, ids binary, rows binary"))


def fit_rbm(df: DataFrame, units: int, rate: float = 0.1, rounds: int = 100, seed: int = RBM_SEED, batch_rows: int = 10,
            minmax: bool = False) -> dict:
    """Contrastive divergence of ``(rec_id, features)`` by batches of ``batch_rows``.

    Rows are dealt to blocks by the hash of their ids.  In each round every block learns from its batches one after the
    other, starting from the same weights, and the blocks' changes are averaged by their rows.  The weights are
    the same however the table is laid out: a row's draws come from seed, round, id and unit, and sums
    are added up in one order.  With ``minmax`` each feature is brought to 0 to 1 first by its own
    range, which ``low`` and ``range`` hold.  ``loss`` holds the mean reconstruction error of every round.
    """
    spark = df.sparkSession
    width = check_width(df)
    if width is None:
        raise ValueError("an empty table cannot be learned")
    low, scale = np.zeros(width), np.ones(width)
    if minmax:
        ends = df.agg(*[f(F.col("features")[i]) for i in range(width) for f in (F.min, F.max)]).first()
        low, high = np.array(ends[::2], float), np.array(ends[1::2], float)
        scale = np.where(high > low, high - low, 1.0)
    held = _blocks_of(df)
    blocks = held.count()
    size = (width + 1) * (units + 1)
    # Weights with the biases of hidden units below and of seen ones beside them.
    model = np.zeros((width + 1, units + 1))
    model[:-1, :-1] = np.random.default_rng(seed).normal(0, 0.01, (width, units))
    losses: list[float] = []
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def learn(parts: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for block, ids, rows in zip(*(part.column(c).to_pylist() for c in ("block", "ids", "rows"))):
                    keys, x = np.frombuffer(ids, np.int64), (np.frombuffer(rows).reshape(-1, width) - low) / scale
                    draws = _draws(seed, turn, keys, units + 1)
                    order = np.argsort(draws[:, units], kind="stable")
                    m, loss = shared.value.copy(), 0.0
                    for at in range(0, len(x), batch_rows):
                        own = order[at : at + batch_rows]
                        v, one = x[own], np.ones((len(own), 1))
                        h = _sigmoid(v @ m[:-1, :-1] + m[-1, :-1])
                        back = _sigmoid((draws[own, :units] < h) @ m[:-1, :-1].T + m[:-1, -1])
                        again = _sigmoid(back @ m[:-1, :-1] + m[-1, :-1])
                        change = np.hstack([v, one]).T @ np.hstack([h, one]) - np.hstack([back, one]).T @ np.hstack([again, one])
                        loss += ((v - back) ** 2).sum()
                        m += change * rate / len(own)
                    sums = np.concatenate([((m - shared.value) * len(x)).ravel(), [loss, len(x)]])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums.tobytes()])], names=["block", "sums"])

        sums = tree_sum(held.mapInArrow(learn, "block long, sums binary"), size + 2, blocks)
        shared.unpersist()
        model = model + sums[:size].reshape(model.shape) / sums[-1]
        losses.append(float(sums[-2] / sums[-1]))
    return {"weights": model[:-1, :-1].tolist(), "hidden": model[-1, :-1].tolist(), "loss": losses,
            "low": low.tolist(), "range": scale.tolist()}


def apply_rbm(df: DataFrame, fitted: dict) -> DataFrame:
    w, b = np.asarray(fitted["weights"]), np.asarray(fitted["hidden"])
    low, scale = np.asarray(fitted.get("low", 0.0)), np.asarray(fitted.get("range", 1.0))
    return df.withColumn("features", row_map(lambda v: _sigmoid((v - low) / scale @ w + b))("features"))


# --- temperature slots --------------------------------------------------------------------


def temp_bucket(column: Column | str, p: Params = DEFAULT) -> Column:
    """Slot of half a degree, held at both ends; halves round to even."""
    c = F.col(column) if isinstance(column, str) else column
    top = round((p.temp_max - p.temp_min) / p.temp_step)
    slot = F.bround((c - p.temp_min) / p.temp_step).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(top), slot))


def temp_one_hot(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    top = round((p.temp_max - p.temp_min) / p.temp_step)
    slot, zero = F.col("_slot"), F.lit(0.0)
    hot = F.concat(F.array_repeat(zero, slot), F.array(F.lit(1.0)), F.array_repeat(zero, F.lit(top) - slot))
    return df.withColumn("_slot", temp_bucket("temp", p)).withColumn("temp_one_hot", hot).drop("_slot")


# --- reuse ----------------------------------------------------------------------------------


class FeatureCache:
    """Keeps the matrix of each table, descriptor and parameters persisted until reset.

    Two tables are one when their plans give the same result.
    """

    def __init__(self) -> None:
        self._held: dict[tuple[str, Params], list[tuple[DataFrame, DataFrame, FittedFeatures]]] = {}

    def get(self, df: DataFrame, spec: FeatureSpec, p: Params = DEFAULT) -> tuple[DataFrame, FittedFeatures]:
        known = self._held.setdefault((spec.descriptor, p), [])
        for table, made, fitted in known:
            if df.sameSemantics(table):
                return made, fitted
        made, fitted = build_features(df, spec, p)
        known.append((df, made.persist(), fitted))
        return made, fitted

    def reset(self) -> None:
        for known in self._held.values():
            for _, made, _ in known:
                made.unpersist()
        self._held.clear()


# --- two dimensions -----------------------------------------------------------------------------


def project_2d(df: DataFrame) -> DataFrame:
    """First two principal components: ``rec_id, x, y``."""
    reduced = apply_pca(df, fit_pca(df, 2))
    return reduced.select("rec_id", F.col("features")[0].alias("x"), F.get("features", F.lit(1)).alias("y"))
