"""Training, applying and judging classifiers on ``(rec_id, label, features)``."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flighttone.functions.batches import row_map
from flighttone.operators.boosting import Booster, boost
from flighttone.operators.features import FittedFeatures, descriptor_of
from flighttone.operators.stats import accuracy, balance_report, binary_metrics, class_metrics, confusion
from flighttone.scale import with_position

__all__ = [
    "CLASSIFIERS", "Model", "balance_report", "evaluate", "feature_importance", "holdout_split",
    "predict", "train", "train_boosted", "train_mlp", "training_curves",
]

# Fixed values.
SPLIT_SEED = 2017
MIN_PROBABILITIES = (0.6, 0.7, 0.8, 0.9)


def holdout_split(df: DataFrame, share: float = 0.2, seed: int = SPLIT_SEED) -> DataFrame:
    """Mark the first ``ceil(share * n)`` rows by hash of id and seed as ``is_test``.

    Only ids are sorted; the last hash inside is a constant, so the wide rows
    are marked where they are.
    """
    hashed = F.md5(F.concat(F.col("rec_id").cast("string"), F.lit(str(seed))).cast("binary"))
    placed = with_position(df.select("rec_id", hashed.alias("h")), ["h", "rec_id"], "at")
    n = placed.count()
    last = placed.filter(F.col("at") == math.ceil(share * n) - 1).first()
    if last is None:
        return df.withColumn("is_test", F.lit(False))
    inside = (hashed < last["h"]) | ((hashed == last["h"]) & (F.col("rec_id") <= last["rec_id"]))
    return df.withColumn("is_test", inside)


@dataclass
class Model:
    """A trained classifier and what is needed to apply it to new recordings."""

    kind: str
    parts: list
    n_classes: int
    n_features: int
    descriptor: str = ""
    class_names: list[str] = field(default_factory=list)
    features: FittedFeatures | None = None
    path: str | None = None


def check_descriptor(model: Model, df: DataFrame) -> None:
    """Features must be the ones the model was trained on."""
    found = descriptor_of(df)
    if model.descriptor and found != model.descriptor:
        raise ValueError(f"the model needs features {model.descriptor!r}, got {found!r}")


def _ready(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector("features"))


def _shape(df: DataFrame) -> tuple[int, int]:
    low, high, width = df.agg(F.min("label"), F.max("label"), F.max(F.size("features"))).first()
    if low is None or low < 0:
        raise ValueError("labels must be 0 or more: leave out noise and poor matches first")
    return high + 1, width


def _best_round(losses: Sequence[float], tolerance: float, patience: int) -> tuple[int, bool]:
    """The round with the lowest loss, and whether ``patience`` rounds after it did not improve it."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best] - tolerance:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def train_boosted(df: DataFrame, rounds: int = 1000, tolerance: float = 0.0, depth: int = 6,
                  rate: float = 0.3, patience: int = 10, features: FittedFeatures | None = None) -> Model:
    """Boosted trees with one loss for all classes.

    ``is_test`` rows only decide when to stop: when ``patience`` rounds have not
    improved their loss by more than ``tolerance``.  The rounds up to the best
    one are kept.
    """
    classes, width = _shape(df)
    booster = boost(df, max(classes, 2), width, rounds, depth, rate, lambda losses: _best_round(losses, tolerance, patience))
    return Model("boosted", [booster], max(classes, 2), width, descriptor_of(df), features=features)


def train_mlp(df: DataFrame, hidden: int = 100, rounds: int = 200,
              features: FittedFeatures | None = None) -> Model:
    """One hidden layer, trained on the rows not held out."""
    classes, width = _shape(df)
    data = _ready(df).filter("not is_test").withColumn("_y", F.col("label").cast("double"))
    net = MultilayerPerceptronClassifier(
        featuresCol="_v", labelCol="_y", layers=[width, hidden, classes], maxIter=rounds, seed=SPLIT_SEED
    )
    return Model("mlp", [net.fit(data)], classes, width, descriptor_of(df), features=features)


CLASSIFIERS = {"boosted": train_boosted, "mlp": train_mlp}


def train(df: DataFrame, kind: str = "boosted", **options) -> tuple[Model, DataFrame]:
    """Split, train and score the held-out rows: the model and ``rec_id, label, prediction``."""
    ready = df if "is_test" in df.columns else holdout_split(df)
    model = CLASSIFIERS[kind](ready, **options)
    held = ready.filter("is_test")
    scored = probabilities(model, held)
    return model, scored.select("rec_id", "label", _argmax("probability").alias("prediction"))


# --- applying ---------------------------------------------------------------------


def probabilities(model: Model, df: DataFrame) -> DataFrame:
    """Add ``probability array<double>``, one share per class."""
    if model.kind == "boosted":
        booster = model.parts[0]
        return df.withColumn("probability", row_map(lambda x: booster.probabilities(x))(F.col("features").cast("array<double>")))
    net = model.parts[0]
    net.setFeaturesCol("_v").setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_y")
    scored = net.transform(_ready(df))
    return scored.withColumn("probability", vector_to_array("_p")).drop("_v", "_raw", "_p", "_y")


def _argmax(column: str) -> Column:
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def choose_label(df: DataFrame, min_probability: float = 0.0, column: str = "probability") -> DataFrame:
    """Most probable label; below ``min_probability`` it is -1 and not core."""
    sure = F.array_max(column) >= min_probability
    return df.withColumns(
        {
            "label": F.when(sure, _argmax(column)).otherwise(-1),
            "is_core": sure,
        }
    )


def predict(model: Model, df: DataFrame, min_probability: float = 0.0) -> DataFrame:
    """``assignments`` for feature rows; their descriptor must be the model's."""
    check_descriptor(model, df)
    return choose_label(probabilities(model, df), min_probability).select("rec_id", "label", "is_core")


def predict_recordings(model: Model, recordings: DataFrame, min_probability: float = 0.0,
                       refit_scaler: bool = False) -> DataFrame:
    """Prepare new recordings as in training, then predict.

    ``refit_scaler`` scales new data by themselves, as older analyses did.
    """
    from flighttone.operators.features import build_features

    if model.features is None:
        raise ValueError("the model was stored without its feature preparation")
    if refit_scaler:
        x, _ = build_features(recordings, model.features.spec)
    else:
        x = model.features.transform(recordings)
    return predict(model, x, min_probability)


# --- judging ------------------------------------------------------------------------


def evaluate(scored: DataFrame) -> dict[str, DataFrame]:
    return {
        "accuracy": accuracy(scored),
        "confusion": confusion(scored),
        "binary": binary_metrics(scored),
        "classes": class_metrics(scored),
    }


def training_curves(model: Model, df: DataFrame) -> DataFrame:
    """``round, is_test, logloss, error`` after every round, as the training itself saw them; ``df`` gives the session."""
    if model.kind != "boosted":
        raise ValueError("only boosted trees are trained in rounds")
    rows = [
        (i, test, curve[2 * test], curve[2 * test + 1])
        for i, curve in enumerate(model.parts[0].curves, 1) for test in (False, True) if not math.isnan(curve[2 * test])
    ]
    return df.sparkSession.createDataFrame(rows, "round int, is_test boolean, logloss double, error double")


def feature_importance(spark: SparkSession, model: Model) -> DataFrame:
    """``feature, splits, importance``: how often trees split by a feature, and its share."""
    counts = model.parts[0].split_counts()
    rows = [(i, int(n), float(n / max(1, counts.sum()))) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "feature int, splits long, importance double")


# --- storing --------------------------------------------------------------------------


def save_model(spark: SparkSession, model: Model, folder: str) -> str:
    """Write the model below ``folder``; the descriptor is part of its name."""
    path = f"{folder.rstrip('/')}/{model.kind}_{model.descriptor or 'features'}"
    if model.kind == "mlp":
        model.parts[0].write().overwrite().save(f"{path}/part-0")
    facts = {
        "kind": model.kind, "trees": model.parts[0].to_dict() if model.kind == "boosted" else None, "n_classes": model.n_classes,
        "n_features": model.n_features, "descriptor": model.descriptor,
        "class_names": model.class_names,
        "features": model.features.to_json() if model.features else None,
    }
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")
    model.path = path
    return path


def load_model(spark: SparkSession, path: str) -> Model:
    facts = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    trees = facts.pop("trees")
    parts = [Booster.from_dict(trees) if trees else MultilayerPerceptronClassificationModel.load(f"{path}/part-0")]
    stored = facts.pop("features")
    return Model(parts=parts, features=FittedFeatures.from_json(stored) if stored else None, path=path, **facts)
