import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flighttone.plans.pipeline import configure, ship

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(configure(session))
    session.stop()


def tone(*parts, ms=400, sr=8000):
    """Sum of ``(frequency, amplitude)`` sines."""
    t = np.arange(int(ms * sr / 1000)) / sr
    return sum(a * np.sin(2 * np.pi * f * t) for f, a in parts)


def waves(spark, **named):
    rows = [(i, n, [float(v) for v in x]) for i, (n, x) in enumerate(named.items())]
    return spark.createDataFrame(rows, "rec_id long, name string, waveform array<double>")


def blobs(k=2, n=200, d=5, seed=3, apart=10.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (k, d))
    centres = centres / np.linalg.norm(centres, axis=1, keepdims=True) * apart
    x = np.vstack([rng.normal(c, 1, (n, d)) for c in centres])
    return x, np.repeat(np.arange(k), n)


def matrix(spark, x, labels=None):
    labels = np.zeros(len(x), int) if labels is None else labels
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "rec_id long, features array<double>, label int")
