"""Signals with known answers."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flighttone import DEFAULT, Params
from flighttone.functions import spectrum, tone as tones, waveform, wavelets
from flighttone.plans.pipeline import attributes
from tests.conftest import tone, waves


@pytest.fixture(scope="module")
def found(spark):
    burst = np.zeros(3200)
    burst[800:1600] = tone((500, 0.5), ms=100)
    noise = np.random.default_rng(1).normal(0, 0.1, 3200)
    rows = waves(
        spark,
        tone500=tone((500, 0.5)),
        series400=tone((400, 0.5), (800, 0.3), (1200, 0.2), (1600, 0.1)),
        missing_f1=tone((800, 0.5), (1200, 0.4), (1600, 0.3)),
        silence=np.zeros(3200),
        noise=noise,
        burst=burst,
    )
    return {r["name"]: r for r in attributes(rows).collect()}


def test_pure_tone(found):
    r = found["tone500"]
    assert r["rms"] == pytest.approx(0.35355, abs=1e-4)
    assert int(np.argmax(r["psd"])) == 16
    assert r["ac_f1"] == pytest.approx(500, abs=2)
    assert r["f1_est"] == pytest.approx(500, abs=5)
    assert len(r["psd"]) == 129 and len(r["mfcc"]) == 13 and len(r["melspec_db"]) == 26


def test_harmonic_series(found):
    r = found["series400"]
    assert r["ha_f1"] == pytest.approx(400, abs=8)
    assert r["ha_count"] >= 4 and r["ha_grade"] == "A" and r["f1"] == r["ha_f1"]


def test_missing_fundamental(found):
    assert found["missing_f1"]["ha_f1"] == pytest.approx(400, abs=8)


def test_silence(found):
    r = found["silence"]
    assert r["ac_f1"] == 0 and r["dur_ms"] == 0 and r["rms"] == 0
    assert r["ha_verbose"][0] in "FD"


def test_noise_and_tone_differ_in_s2n(found):
    assert found["noise"]["s2n"] < 10
    assert found["tone500"]["s2n"] > 100 * found["noise"]["s2n"]


def test_burst_duration(found):
    assert found["burst"]["dur_ms"] == pytest.approx(100, abs=4)


def test_welch_by_definition(spark):
    x = np.random.default_rng(0).normal(0, 1, 1600)
    psd = np.array(spectrum.welch_psd(waves(spark, x=x)).first()["psd"])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    parts = [x[s : s + 256] for s in range(0, 1600 - 255, 128)]
    want = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0)
    want = want / (8000 * (window**2).sum())
    want[1:-1] *= 2
    assert len(parts) == 11
    np.testing.assert_allclose(psd, want + 1e-10, rtol=1e-10)


def test_short_segment(spark):
    psd = spectrum.welch_psd(waves(spark, x=tone((500, 1.0))[:255])).first()["psd"]
    assert len(psd) == 129 and int(np.argmax(psd)) == 16


@pytest.mark.parametrize("n, want", [(200, 256), (255, 255), (253, 257), (256, 256), (300, 300), (0, 256)])
def test_padding(spark, n, want):
    assert len(waveform.pad_waveform(waves(spark, x=np.ones(n))).first()["waveform"]) == want


def test_scaling_keeps_silence(spark):
    rows = waveform.scale_waveform(waves(spark, a=np.zeros(4), b=np.array([1.0, -4, 2, 0])), 0).collect()
    assert rows[0]["waveform"] == [0, 0, 0, 0] and rows[1]["waveform"] == [0.25, -1, 0.5, 0]
    assert waveform.scale_waveform(waves(spark, b=np.array([1.0, -4])), -1).first()["waveform"] == [-1, 4]


def test_baseline_ignores_peaks(spark):
    k = np.arange(129)
    floor = -60 - 0.1 * k
    levels = floor + 40 * np.exp(-(((k[:, None] - [16, 32, 48]) / 1.0) ** 2)).sum(axis=1)
    rows = spark.createDataFrame([(1, levels.tolist())], "rec_id long, psd_db array<double>")
    base = np.array(spectrum.spectral_baseline(rows).first()["psd_baseline_db"])
    assert np.abs(base - floor).max() < 8 and base[16] < levels[16] - 30


def test_highest_peak_clears_its_neighbours(spark):
    y = [0.0, 5.0, 0.0, 9.0, 0.0, 7.0, 0.0, 0.0, 6.0, 0.0]
    rows = spark.createDataFrame([(1, y)], "rec_id long, y array<double>")
    assert spectrum.find_peaks(rows, "y", 0.1).first()["peak_idx"] == [1, 3, 5, 8]
    assert spectrum.find_peaks(rows, "y", 0.1, 2).first()["peak_idx"] == [3, 8]
    assert spectrum.find_peaks(rows, "y", 0.1, 5).first()["peak_idx"] == [3]


@pytest.mark.parametrize(
    "y, found",
    [([0, 1, 3, 3, 1, 0, 2, 0], [2, 6]), ([0, 3, 3, 3, 0], [2]), ([0, 3, 3, 3, 3, 0], [2]), ([3, 3, 0, 1, 1], []),
     ([0, 2, 2, 3, 3, 2, 2, 0], [3]), ([1, 1, 1, 1], []), ([0, 2, 1, 1, 2, 0], [1, 4])],
)
def test_a_flat_top_is_one_peak(spark, y, found):
    rows = spark.createDataFrame([(1, [float(v) for v in y])], "rec_id long, y array<double>")
    assert spectrum.find_peaks(rows, "y", 0.1).first()["peak_idx"] == found


def test_the_middle_of_a_flat_top_is_its_vertex(spark):
    y = [-90.0, -90.0, -50.0, -50.0, -50.0, -90.0, -90.0]
    rows = spark.createDataFrame([(1, y)], "rec_id long, psd_db array<double>")
    p = dataclasses.replace(DEFAULT, f1_min=50)
    found = spectrum.refine_peaks(spectrum.find_peaks(rows, "psd_db", 0.25), p).first()
    assert found["peak_idx"] == [3] and [(k["idx"], k["freq"]) for k in found["peaks"]] == [(3, pytest.approx(3 * p.df))]


def test_harmonic_rule_by_hand(spark):
    peaks = [(13, 400.0, -20.0), (26, 800.0, -25.0), (38, 1200.0, -30.0), (52, 1610.0, -40.0)]
    rows = spark.createDataFrame([(1, peaks), (2, [(0, 0.0, -100.0)])], f"rec_id long, peaks {spectrum.PEAK_TYPE}")
    one, none = tones.harmonic_f1(rows).orderBy("rec_id").collect()
    assert one["ha_f1"] == pytest.approx(400.625) and one["psd_delta"] == 400
    assert (one["ha_verbose"], one["ha_grade"], one["ha_count"], one["ha_score"]) == ("A (1/5)", "A", 4, 2)
    assert (none["ha_f1"], none["ha_verbose"], none["ha_score"], none["ha_count"]) == (0, "F (0)", 0, 0)


def test_lag_correlation_by_definition(spark):
    x = np.random.default_rng(5).normal(0, 1, 400) + 3
    ac = tones.autocorrelation(waves(spark, x=x)).first()["ac"]
    want = [1] + [np.corrcoef(x[l:], x[:-l])[0, 1] for l in range(1, 80)] + [0]
    np.testing.assert_allclose(ac, want, atol=1e-10)


def test_als_by_dense_solve(spark):
    y = tone((300, 0.3), ms=20) + np.linspace(0, 1, 160)
    d = np.zeros((160, 158))
    for i in range(158):
        d[i : i + 3, i] = 1, -2, 1
    w = np.ones(160)
    for _ in range(5):
        z = np.linalg.solve(np.diag(w) + 500 * d @ d.T, w * y)
        w = 0.002 * (y > z) + 0.998 * (y < z)
    np.testing.assert_allclose(tones.als_baseline(waves(spark, y=y)).first()["bias"], z, atol=1e-8)


def test_spline_is_exact_on_cubics(spark):
    p = Params(f_max=4000)
    f = np.arange(129) * p.df
    cubic = 1 + 2e-3 * f - 3e-6 * f**2 + 1e-9 * f**3
    rows = spark.createDataFrame([(1, cubic.tolist())], "rec_id long, psd array<double>")
    fine = np.array(spectrum.interpolate_psd(rows).first()["psd_interp"])
    g = np.arange(4001)
    assert len(fine) == 4001
    np.testing.assert_allclose(fine, 1 + 2e-3 * g - 3e-6 * g**2 + 1e-9 * g**3, atol=1e-8)


def test_harmonic_product(spark):
    x = tone(*[(400 * h, 0.5 / h) for h in range(1, 8)]) + np.random.default_rng(4).normal(0, 0.02, 3200)
    p = DEFAULT
    rows = spectrum.interpolate_psd(spectrum.welch_psd(waves(spark, x=x)))
    r = tones.hps(rows.withColumn("f1_est", F.lit(400.0)), p).first()
    assert r["hps_f1"] == pytest.approx(400, abs=6) and max(r["hps_y"]) == 1
    assert r["hps_n"] == 6 and r["hps_start"] == 190


def test_wavelet_filters_are_orthonormal():
    for name in ("haar", "db2", "db4", "db10", "db20", "sym4", "sym9", "sym20"):
        h = wavelets.scaling_filter(name)
        for k in range(len(h) // 2):
            assert (h[2 * k :] * h[: len(h) - 2 * k]).sum() == pytest.approx(float(k == 0), abs=1e-6)
    np.testing.assert_allclose(wavelets.scaling_filter("db2"), [0.48296291, 0.8365163, 0.22414387, -0.12940952], atol=1e-7)
    with pytest.raises(ValueError):
        wavelets.scaling_filter("dmey")


@pytest.mark.parametrize("pair", wavelets.SPLINE_PAIRS)
def test_biorthogonal_pairs(pair):
    low, back = wavelets._biorthogonal(*pair)
    assert len(low) == len(back) and low.sum() == pytest.approx(math.sqrt(2)) and back.sum() == pytest.approx(math.sqrt(2))
    both = np.convolve(low, back)
    middle = len(low) - 1
    want = np.zeros_like(both[middle % 2 :: 2])
    want[middle // 2] = 1
    np.testing.assert_allclose(both[middle % 2 :: 2], want, atol=1e-9)


def test_biorthogonal_by_table():
    low, high = wavelets.filter_pair("bior2.2")
    np.testing.assert_allclose(low, [0, -0.1767767, 0.35355339, 1.06066017, 0.35355339, -0.1767767], atol=1e-7)
    np.testing.assert_allclose(high, [0, 0.35355339, -0.70710678, 0.35355339, 0, 0], atol=1e-7)
    low, high = wavelets.filter_pair("rbio2.2")
    np.testing.assert_allclose(low, [0, 0, 0.35355339, 0.70710678, 0.35355339, 0], atol=1e-7)
    np.testing.assert_allclose(high, [0.1767767, 0.35355339, -1.06066017, 0.35355339, 0.1767767, 0], atol=1e-7)
    assert wavelets.filter_pair("bior4.4")[0][5] == pytest.approx(0.8526986790088938)
    with pytest.raises(ValueError):
        wavelets.filter_pair("bior6.8")


def test_band_sizes_and_energy(spark):
    x = np.random.default_rng(2).normal(0, 1, 1600)
    low, _ = wavelets.filter_pair("sym9")
    level = wavelets.level_count(1600, len(low))
    assert level == math.floor(math.log2(1600 / 17))
    bands = wavelets.dwt(waves(spark, x=x)).first()["bands"]
    sizes, n = [], 1600
    for _ in range(level):
        n = (n + 17) // 2
        sizes.append(n)
    assert [len(b) for b in bands] == [n, *reversed(sizes)]
    energy = sum(np.square(b).sum() for b in bands)
    assert energy == pytest.approx(np.square(x).sum(), rel=0.1)


def test_own_filter_table(spark):
    s = 1 / math.sqrt(2)
    mine = {"mine": ((s, s), (-s, s))}
    a = wavelets.dwt(waves(spark, x=np.arange(16.0)), "mine", level=2, filters=mine).first()["bands"]
    b = wavelets.dwt(waves(spark, x=np.arange(16.0)), "haar", level=2).first()["bands"]
    for x, y in zip(a, b):
        np.testing.assert_allclose(x, y)


def test_band_numbers_agree_with_long_form(spark):
    x = np.round(np.random.default_rng(2).normal(0, 1, 64), 1)
    df = waves(spark, x=x)
    wide = np.array(wavelets.dwt_features(df, "haar", level=2).first()["dwt_features"]).reshape(3, -1)
    bands = wavelets.bands_long(wavelets.dwt(df, "haar", level=2)).cache()
    stats = {r["band"]: r for r in wavelets.band_stats(bands).collect()}
    entropy = {r["band"]: r for r in wavelets.band_entropy(bands).collect()}
    cross = {r["band"]: r for r in wavelets.crossings(bands, ("rec_id", "band")).collect()}
    for band in range(3):
        want = [entropy[band]["entropy"], cross[band]["zero_crossings"], cross[band]["mean_crossings"]]
        want += [stats[band][c] for c in wavelets.BAND_FEATURES[3:]]
        np.testing.assert_allclose(wide[band], want, atol=1e-9)


@pytest.mark.parametrize("name", ["morl", "mexh", "gaus4", "fbsp10-0.5-1"])
def test_wavelet_power_peaks_at_the_tone(spark, name):
    p = Params(f_min=200, f_max=1000, cwt_step=20)
    image = np.array(wavelets.cwt_power(waves(spark, x=tone((600, 0.5), ms=100)), name, p).first()["cwt"])
    assert image.shape == (41, 800)
    best = wavelets.cwt_frequencies(p)[int(np.argmax((10**image)[:, 300:500].mean(axis=1)))]
    assert best == pytest.approx(600, abs=60)


def test_mother_wavelets_have_unit_norm():
    t = np.linspace(-20, 20, 400001)
    for name in ("mexh", "gaus1", "gaus5", "gaus8"):
        assert (wavelets.mother(name, t) ** 2).sum() * (t[1] - t[0]) == pytest.approx(1, abs=1e-6)


def test_default_image_size():
    f = wavelets.cwt_frequencies()
    assert len(f) == 381 and f[0] == 200 and f[-1] == 4000


def test_unbiased_waveforms_are_correlated_on_request(spark):
    """A slow bias hides the tone unless it is taken off."""
    t = np.arange(1600) / 8000
    biased = np.sin(2 * np.pi * 400 * t) * 0.1 + 3 * np.exp(-((t - 0.1) ** 2) / 0.002)
    rows = waves(spark, biased=biased)
    p = dataclasses.replace(DEFAULT, use_unbiased=True)
    with_bias, without = (tones.autocorrelation(rows, q).first() for q in (DEFAULT, p))
    assert without["ac_f1"] == pytest.approx(400, rel=0.01) and without["ac_coeff"] > with_bias["ac_coeff"] - 1e-9
    assert without.asDict().keys() == with_bias.asDict().keys() and not np.allclose(with_bias["ac"], without["ac"])
