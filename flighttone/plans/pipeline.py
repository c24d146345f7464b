"""The whole analysis as one chain of operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from flighttone.functions import spectrum, tone, waveform
from flighttone.params import DEFAULT, Params


def configure(spark: SparkSession) -> SparkSession:
    """Settings for rows that hold waveforms: short Arrow batches, skew handling on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """In local mode let Python workers find this package wherever the session was started.

    On a cluster pass the package with ``--py-files`` or install it.
    """
    context = spark.sparkContext
    if context.master.startswith("local") and context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="flighttone-")) / package.name
        context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return spark


def kernels(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """What numpy computes from a waveform: spectrum, mel levels, baseline, peaks, lag curve, duration."""
    x = spectrum.psd_db(spectrum.welch_psd(df, p))
    x = spectrum.mfcc(spectrum.mel_spectrum(x, p), p)
    x = spectrum.psd_peaks(spectrum.spectral_baseline(x, p.baseline_degree), p)
    return waveform.duration(tone.autocorrelation_curve(x, p), p)


def attributes(df: DataFrame, p: Params = DEFAULT, f1: str = "harmonic") -> DataFrame:
    """All attributes of recordings with a ``waveform``; no shuffle, unused columns are pruned.

    The kernels come first: Catalyst merges projections below a Python function
    and would repeat the column expressions.  For the same reason, and so that
    later steps do not compute them again, write the attributes to a table
    before adding features or other kernels.
    """
    x = spectrum.f1_estimate(spectrum.refine_peaks(kernels(df, p), p), p)
    x = spectrum.signal_to_noise(spectrum.signal_powers(x, p))
    x = tone.best_lag(tone.harmonic_f1(waveform.rms(x), p), p)
    return tone.select_f1(x, f1)
