"""Checks on waveforms: spectrum, peaks, tone, duration, wavelet bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import PER_MS, SIG, SIG_SAMPLES, WAV, WAV_SAMPLES, big, r, sig, wav, wav_samples
from flighttone.functions import spectrum, tone, waveform, wavelets
from flighttone.operators import order
from flighttone.operators.views import recording_curves
from flighttone.plans.pipeline import attributes
from flighttone.sources import sinks
from flighttone.sources.wav import encode_pcm16, read_content, resample_column

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- samples ----------------------------------------------------------------------


def _long(df: DataFrame, column: str = "waveform") -> DataFrame:
    return df.select("rec_id", F.posexplode(column).alias("n", "x")).select("rec_id", big("n").alias("n"), r("x").alias("x"))


@check("scale_normalize", f"""WITH {SIG_SAMPLES} SELECT rec_id, n,
  round(x / max(abs(x)) OVER (PARTITION BY rec_id), 6) + 0.0 AS x FROM samples""")
def scale_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _long(waveform.scale_waveform(sig(spark, d), 0))


@check("scale_invert", f"WITH {SIG_SAMPLES} SELECT rec_id, n, round(-x, 6) + 0.0 AS x FROM samples")
def scale_invert(spark: SparkSession, d: str) -> DataFrame:
    return _long(waveform.scale_waveform(sig(spark, d), -1))


@check("pad", f"""WITH {WAV_SAMPLES}, sized AS (SELECT rec_id, count(*) AS len FROM wav GROUP BY rec_id),
w AS (SELECT rec_id, len, CASE WHEN len < 80 THEN CAST(round_even((80 - len) / 2, 0) AS BIGINT) ELSE 0 END AS w FROM sized),
grid AS (SELECT rec_id, w, unnest(range(len + 2 * w)) AS n FROM w)
SELECT g.rec_id, g.n, round(coalesce(s.x, 0), 6) + 0.0 AS x FROM grid g
LEFT JOIN wav s ON s.rec_id = g.rec_id AND s.n = g.n - g.w""")
def pad(spark: SparkSession, d: str) -> DataFrame:
    return _long(waveform.pad_waveform(wav(spark, d), 80))


@check("time_axis", f"""WITH {SIG_SAMPLES} SELECT rec_id, n, round(n * 1000.0 / 64, 6) AS t_ms,
  round(count(*) OVER (PARTITION BY rec_id) * 1000.0 / 64, 6) AS t_max_ms FROM samples""")
def time_axis(spark: SparkSession, d: str) -> DataFrame:
    timed = waveform.time_axis(sig(spark, d), SIG)
    rows = timed.select("rec_id", "t_max_ms", F.posexplode("t_ms").alias("n", "t_ms"))
    return rows.select("rec_id", big("n").alias("n"), r("t_ms").alias("t_ms"), r("t_max_ms").alias("t_max_ms"))


@check("rms", f"""WITH {SIG_SAMPLES} SELECT rec_id, round(avg(x * x), 9) AS td_power,
  round(sqrt(avg(x * x)), 9) AS rms FROM samples GROUP BY rec_id""")
def rms(spark: SparkSession, d: str) -> DataFrame:
    return waveform.rms(sig(spark, d)).select("rec_id", r("td_power", 9).alias("td_power"), r("rms", 9).alias("rms"))


@check("wav_roundtrip", f"WITH {SIG_SAMPLES} SELECT rec_id, n, floor(x * 32768 + 0.5) / 32768 AS x FROM samples")
def wav_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every waveform as the bytes of a WAV file and back."""
    read = encode_pcm16(sig(spark, d)).select("rec_id", read_content("content").alias("f"))
    cells = read.select("rec_id", F.posexplode("f.rawdata").alias("n", "x"))
    return cells.select("rec_id", big("n").alias("n"), (F.col("x") + 0.0).alias("x"))


@check("resample", f"""WITH {SIG_SAMPLES}, pairs AS (SELECT j, n, j * 64 / 48.0 - n AS t FROM range(48) a(j), range(64) b(n)
  WHERE abs(j * 64 // 48 - n) <= 43),
shaped AS (SELECT j, n, 0.75 * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.75 * t) / (pi() * 0.75 * t) END AS sinc,
  5 * sqrt(greatest(0, 1 - (t / 44) * (t / 44))) AS half FROM pairs),
terms AS (SELECT m, CAST(factorial(CAST(m AS INTEGER)) AS DOUBLE) AS f FROM range(30) c(m)),
top AS (SELECT sum(power(power(5.0, m) / f, 2)) AS i0 FROM terms),
w AS (SELECT j, n, sinc * sum(power(power(half, m) / f, 2)) / any_value(i0) AS w FROM shaped, terms, top GROUP BY j, n, sinc)
SELECT rec_id, j AS n, round(sum(x * w), 6) + 0.0 AS x FROM samples JOIN w USING (n) GROUP BY rec_id, j""")
def resample(spark: SparkSession, d: str) -> DataFrame:
    """64 Hz to 48 Hz: three output samples for four."""
    x = resample_column(48)("waveform", F.col("fs").cast("int"))
    return _long(sig(spark, d).withColumn("waveform", x))


@check("duration", f"""WITH {SIG_SAMPLES}, p AS (SELECT rec_id, n, count(*) OVER (PARTITION BY rec_id) AS len,
  avg(x * x) OVER (PARTITION BY rec_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 4 AS power FROM samples)
SELECT rec_id, CAST(count(*) FILTER (n BETWEEN 2 AND len - 2 AND power > 0.025 / len * 10) AS DOUBLE) AS dur_ms
FROM p GROUP BY rec_id""")
def duration(spark: SparkSession, d: str) -> DataFrame:
    return waveform.duration(sig(spark, d), PER_MS).select("rec_id", "dur_ms")


@check("moving_power", f"""WITH {WAV_SAMPLES} SELECT rec_id, n, round(avg(x * x) OVER (PARTITION BY rec_id ORDER BY n
  ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 13) AS power FROM wav""")
def moving_power(spark: SparkSession, d: str) -> DataFrame:
    found = waveform.moving_power(wav_samples(spark, d), 3)
    return found.select("rec_id", "n", r("power", 13).alias("power"))


# --- spectrum ------------------------------------------------------------------------

_PSD = f"""{SIG_SAMPLES},
seg AS (SELECT rec_id, s, n - 16 * s AS m, x FROM samples, range(3) t(s) WHERE n >= 16 * s AND n < 16 * s + 32),
win AS (SELECT rec_id, s, m, (x - avg(x) OVER (PARTITION BY rec_id, s)) * (0.5 - 0.5 * cos(2 * pi() * m / 32)) AS y FROM seg),
dft AS (SELECT rec_id, s, k, sum(y * cos(2 * pi() * k * m / 32)) AS re, sum(y * sin(2 * pi() * k * m / 32)) AS im
  FROM win, range(17) t(k) GROUP BY rec_id, s, k),
psd AS (SELECT rec_id, k, avg(re * re + im * im) / (64 * 12.0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END + 1e-10 AS psd
  FROM dft GROUP BY rec_id, k),
db AS (SELECT rec_id, k, psd, 10 * log10(psd) AS level FROM psd)"""


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.psd_db(spectrum.welch_psd(sig(spark, d), SIG))


@check("psd", f"""WITH {_PSD} SELECT rec_id, k, round(psd * 1000000, 3) AS psd, round(level, 4) AS psd_db,
  round(min(level) OVER (PARTITION BY rec_id), 4) AS psd_min FROM db""")
def psd(spark: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip("psd", "psd_db")
    rows = _spectra(spark, d).select("rec_id", "psd_min", F.posexplode(both).alias("k", "v"))
    return rows.select(
        "rec_id", big("k").alias("k"), r(F.col("v.psd") * 1000000, 3).alias("psd"),
        r("v.psd_db", 4).alias("psd_db"), r("psd_min", 4).alias("psd_min"),
    )


@check("scale_limits", f"""WITH {_PSD} SELECT round(least(0, min(level)), 4) AS psd_min, 32.0 AS f_top FROM db""")
def scale_limits(spark: SparkSession, d: str) -> DataFrame:
    from flighttone.operators.stats import scale_limits as limits

    rows = _spectra(spark, d).withColumn("f_top", F.lit(SIG.top_frequency))
    return limits(rows, SIG).select(r("psd_min", 4).alias("psd_min"), "f_top")


_MEL = f"""{_PSD}, w AS (SELECT m, k, greatest(0, least((2 * k - c0) / (c1 - c0), (c2 - 2 * k) / (c2 - c1))) * 2 / (c2 - c0) AS w
  FROM (SELECT m, 32.0 * m / 6 AS c0, 32.0 * (m + 1) / 6 AS c1, 32.0 * (m + 2) / 6 AS c2 FROM range(5) t(m)), range(17) u(k)),
mel AS (SELECT rec_id, m, 10 * log10(sum(psd * w)) AS level FROM psd JOIN w USING (k) GROUP BY rec_id, m)"""


@check("mel", f"WITH {_MEL} SELECT rec_id, m, round(level, 4) AS level FROM mel")
def mel(spark: SparkSession, d: str) -> DataFrame:
    rows = spectrum.mel_spectrum(_spectra(spark, d), SIG).select("rec_id", F.posexplode("melspec_db").alias("m", "v"))
    return rows.select("rec_id", big("m").alias("m"), r("v", 4).alias("level"))


@check("mfcc", f"""WITH {_MEL} SELECT rec_id, c, round(CASE WHEN c = 0 THEN sqrt(1 / 5.0) ELSE sqrt(2 / 5.0) END
  * sum(level * cos(pi() * c * (2 * m + 1) / 10)), 4) + 0.0 AS v FROM mel, range(4) t(c) GROUP BY rec_id, c""")
def mfcc(spark: SparkSession, d: str) -> DataFrame:
    found = spectrum.mfcc(spectrum.mel_spectrum(_spectra(spark, d), SIG), SIG)
    rows = found.select("rec_id", F.posexplode("mfcc").alias("c", "v"))
    return rows.select("rec_id", big("c").alias("c"), r("v", 4).alias("v"))


@check("psd_power", f"""WITH {_PSD} SELECT rec_id, round(2 * sum(psd) FILTER (k >= 2), 9) AS fd_power,
  round(2 * sum(psd) FILTER (k < 2), 9) AS fd_power_lf,
  round(10 * log10(2 * sum(psd) FILTER (k >= 2)), 4) AS fd_power_db FROM psd GROUP BY rec_id""")
def psd_power(spark: SparkSession, d: str) -> DataFrame:
    rows = spectrum.signal_powers(_spectra(spark, d).withColumn("psd_baseline", F.col("psd")), SIG)
    return rows.select(
        "rec_id", r("fd_power", 9).alias("fd_power"), r("fd_power_lf", 9).alias("fd_power_lf"),
        r("fd_power_db", 4).alias("fd_power_db"),
    )


# --- peaks -----------------------------------------------------------------------------

_PEAKS = f"""{_PSD},
near AS (SELECT rec_id, k, level, lag(level) OVER o AS a, lead(level) OVER o AS c,
  min(level) OVER (PARTITION BY rec_id) AS lo, max(level) OVER (PARTITION BY rec_id) AS hi
  FROM db WINDOW o AS (PARTITION BY rec_id ORDER BY k)),
found AS (SELECT rec_id, k, level, a, c, 0.5 * (a - c) / (a - 2 * level + c) AS p FROM near
  WHERE level > a AND level > c AND level > lo + 0.25 * (hi - lo)),
fine AS (SELECT rec_id, k, (k + p) * 2 AS freq, level - 0.25 * (a - c) * p AS top FROM found WHERE (k + p) * 2 >= 2),
peaks AS (SELECT rec_id, k, freq, top FROM fine UNION ALL
  SELECT rec_id, 0, 0.0, -100.0 FROM (SELECT DISTINCT rec_id FROM db) WHERE rec_id NOT IN (SELECT rec_id FROM fine))"""


def _with_peaks(spark: SparkSession, d: str) -> DataFrame:
    found = spectrum.find_peaks(_spectra(spark, d), "psd_db", SIG.peak_threshold, SIG.peak_distance)
    return spectrum.f1_estimate(spectrum.refine_peaks(found, SIG), SIG)


@check("peaks", f"WITH {_PEAKS} SELECT rec_id, k FROM found")
def peaks(spark: SparkSession, d: str) -> DataFrame:
    found = spectrum.find_peaks(_spectra(spark, d), "psd_db", SIG.peak_threshold)
    return found.select("rec_id", F.explode("peak_idx").alias("k")).select("rec_id", big("k").alias("k"))


@check("peaks_flat", f"""WITH {_PSD}, q AS (SELECT rec_id, k, floor(level / 4) AS v FROM db),
turns AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY rec_id ORDER BY k) THEN 0 ELSE 1 END AS t FROM q),
runs AS (SELECT rec_id, min(k) AS b, max(k) AS e, any_value(v) AS v
  FROM (SELECT *, sum(t) OVER (PARTITION BY rec_id ORDER BY k) AS run FROM turns) GROUP BY rec_id, run),
near AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS c, min(v) OVER (PARTITION BY rec_id) AS lo,
  max(v) OVER (PARTITION BY rec_id) AS hi FROM runs WINDOW o AS (PARTITION BY rec_id ORDER BY b))
SELECT rec_id, CAST(b + (e - b) // 2 AS BIGINT) AS k FROM near WHERE v > a AND v > c AND v > lo + 0.25 * (hi - lo)""")
def peaks_flat(spark: SparkSession, d: str) -> DataFrame:
    """Levels in steps of 4 dB, so that most tops are flat."""
    stepped = _spectra(spark, d).withColumn("psd_db", F.transform("psd_db", lambda x: F.floor(x / 4).cast("double")))
    found = spectrum.find_peaks(stepped, "psd_db", SIG.peak_threshold)
    return found.select("rec_id", F.explode("peak_idx").alias("k")).select("rec_id", big("k").alias("k"))


@check("peaks_apart", f"""WITH RECURSIVE {_PEAKS}, ranked AS (SELECT rec_id, k,
  row_number() OVER (PARTITION BY rec_id ORDER BY level DESC, k DESC) AS place FROM found),
greedy(rec_id, place, kept) AS (SELECT rec_id, place, [k] FROM ranked WHERE place = 1
  UNION ALL SELECT g.rec_id, g.place + 1, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - n.k) <= 2)) = 0
    THEN list_append(g.kept, n.k) ELSE g.kept END
  FROM greedy g JOIN ranked n ON n.rec_id = g.rec_id AND n.place = g.place + 1)
SELECT rec_id, unnest(arg_max(kept, place)) AS k FROM greedy GROUP BY rec_id""")
def peaks_apart(spark: SparkSession, d: str) -> DataFrame:
    """With a minimum distance: the highest peak clears two bins on both sides."""
    found = spectrum.find_peaks(_spectra(spark, d), "psd_db", SIG.peak_threshold, 2)
    return found.select("rec_id", F.explode("peak_idx").alias("k")).select("rec_id", big("k").alias("k"))


@check("peak_refine", f"""WITH {_PEAKS}, e AS (SELECT rec_id, arg_max(freq, top) AS f1_est FROM peaks WHERE freq <= 16 GROUP BY rec_id)
SELECT rec_id, k, round(freq, 4) AS freq, round(top, 4) AS psd_db, round(coalesce(f1_est, 16.0), 4) AS f1_est
FROM peaks LEFT JOIN e USING (rec_id)""")
def peak_refine(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_peaks(spark, d).select("rec_id", "f1_est", F.inline("peaks"))
    return rows.select(
        "rec_id", big("idx").alias("k"), r("freq", 4).alias("freq"), r("psd_db", 4).alias("psd_db"), r("f1_est", 4).alias("f1_est")
    )


@check("top5_peaks", f"""WITH {_PEAKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY top DESC, freq DESC) AS place FROM peaks)
SELECT rec_id, place, round(freq, 4) AS freq, round(top, 4) AS psd_db FROM ranked WHERE place <= 5""")
def top5_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = spectrum.top_peaks(_with_peaks(spark, d), 5).select("rec_id", F.posexplode("top_peaks").alias("i", "t"))
    return rows.select(
        "rec_id", big(F.col("i") + 1).alias("place"), r("t.freq", 4).alias("freq"), r("t.psd_db", 4).alias("psd_db")
    )


@check("peak_spacing", f"""WITH {_PEAKS}, g AS (SELECT rec_id, freq - coalesce(lag(freq) OVER (PARTITION BY rec_id ORDER BY freq), 0) AS gap FROM peaks)
SELECT rec_id, round(median(gap), 4) AS spacing FROM g GROUP BY rec_id""")
def peak_spacing(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_peaks(spark, d).select("rec_id", F.inline("peaks")).select("rec_id", "freq")
    return spectrum.peak_spacing(rows).select("rec_id", r("spacing", 4).alias("spacing"))


@check("s2n", f"""WITH {_PEAKS}, near2 AS (SELECT rec_id, k, freq, top, lag(k) OVER o AS before, lead(k) OVER o AS after
  FROM peaks WINDOW o AS (PARTITION BY rec_id ORDER BY k)),
best AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY top DESC, k) AS place FROM near2),
ground AS (SELECT b.rec_id, b.freq, b.top, greatest(
  min(level) FILTER (d.k >= coalesce(b.before, 0) AND d.k < coalesce(b.after, 17)), avg(level)) AS g
  FROM best b JOIN db d USING (rec_id) WHERE place = 1 GROUP BY b.rec_id, b.freq, b.top)
SELECT rec_id, round(power(10, (top - g) / 10), 4) AS s2n, round(freq, 4) AS s2n_freq FROM ground""")
def s2n(spark: SparkSession, d: str) -> DataFrame:
    """Against a baseline at the mean level."""
    mean = F.aggregate("psd_db", F.lit(0.0), lambda a, x: a + x) / F.size("psd_db")
    based = _with_peaks(spark, d).withColumn("_mean", mean)
    based = based.withColumn("psd_baseline_db", F.transform("psd_db", lambda x: F.col("_mean")))
    return spectrum.signal_to_noise(based).select("rec_id", r("s2n", 4).alias("s2n"), r("s2n_freq", 4).alias("s2n_freq"))


@check("harmonics", f"""WITH {_PEAKS},
kept AS (SELECT rec_id, freq, top, row_number() OVER (PARTITION BY rec_id ORDER BY top DESC, freq DESC) AS place FROM fine),
strongest AS (SELECT rec_id, coalesce(arg_min(freq, place) FILTER (freq <= 16), arg_min(freq, place)) AS fs FROM kept GROUP BY rec_id),
strong AS (SELECT rec_id, freq, freq - coalesce(lag(freq) OVER (PARTITION BY rec_id ORDER BY freq), 0) AS gap FROM kept WHERE place <= 5),
delta AS (SELECT rec_id, median(gap) AS delta FROM strong GROUP BY rec_id),
pairs AS (SELECT i, j, CAST(i AS DOUBLE) / j AS v FROM range(1, 4) a(i), range(1, 6) b(j) WHERE i <> j),
hit AS (SELECT s.rec_id, i, freq * v AS g FROM strong s JOIN strongest USING (rec_id), pairs
  WHERE freq <> fs AND freq * v / fs BETWEEN 0.9 AND 1.1),
guess AS (SELECT t.rec_id, i, count(g) + 1 AS n, (coalesce(sum(g), 0) + any_value(fs)) / (count(g) + 1) / i AS f1
  FROM (SELECT rec_id, fs, i FROM strongest, range(1, 4) a(i)) t LEFT JOIN hit USING (rec_id, i) GROUP BY t.rec_id, i),
scored AS (SELECT rec_id, i, f1, delta, n + CASE WHEN delta / f1 BETWEEN 0.9 AND 1.1 THEN 1 ELSE 0 END AS hits
  FROM guess JOIN delta USING (rec_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY hits DESC, i) AS place FROM scored),
series AS (SELECT b.rec_id, n, count(*) FILTER (freq / (n * f1) BETWEEN 0.9 AND 1.1) AS c
  FROM best b JOIN strong USING (rec_id), range(1, 6) t(n) WHERE b.place = 1 GROUP BY b.rec_id, n),
ends AS (SELECT rec_id, coalesce(min(n) FILTER (n >= 2 AND c = 0), 6) AS stop FROM series GROUP BY rec_id),
counted AS (SELECT rec_id, CAST(sum(c) AS BIGINT) AS ha_count FROM series JOIN ends USING (rec_id) WHERE n < stop GROUP BY rec_id)
SELECT a.rec_id, round(coalesce(f1, 0.0), 4) AS ha_f1, round(coalesce(delta, 0.0), 4) AS psd_delta,
  coalesce([0, 1, 2, 2, 2][least(hits, 5)], 0) AS ha_score, coalesce(['F', 'D', 'C', 'B', 'A'][least(hits, 5)], 'F') AS ha_grade,
  CASE WHEN hits IS NULL THEN 'F (0)' ELSE ['F', 'D', 'C', 'B', 'A'][least(hits, 5)] || ' (' || i || '/' || hits || ')' END AS ha_verbose,
  coalesce(ha_count, 0) AS ha_count
FROM (SELECT DISTINCT rec_id FROM db) a LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (rec_id) LEFT JOIN counted USING (rec_id)""")
def harmonics(spark: SparkSession, d: str) -> DataFrame:
    found = tone.select_f1(tone.harmonic_f1(_with_peaks(spark, d), SIG).withColumn("ac_f1", F.lit(0.0)))
    return found.select(
        "rec_id", r("f1", 4).alias("ha_f1"), r("psd_delta", 4).alias("psd_delta"), big("ha_score").alias("ha_score"),
        "ha_grade", "ha_verbose", big("ha_count").alias("ha_count"),
    )


# --- autocorrelation --------------------------------------------------------------------

_CURVE = f"""{WAV_SAMPLES},
pairs AS (SELECT a.rec_id, b.n - a.n AS lag, a.x AS early, b.x AS late FROM wav a JOIN wav b
  ON a.rec_id = b.rec_id AND b.n - a.n BETWEEN 1 AND 24),
sums AS (SELECT rec_id, lag, CASE WHEN min(early) = max(early) OR min(late) = max(late) OR count(*) < 2 THEN 0.0
  ELSE corr(early, late) END AS r FROM pairs GROUP BY rec_id, lag),
sized AS (SELECT rec_id, count(*) AS len FROM wav GROUP BY rec_id),
curve AS (SELECT rec_id, lag, r FROM sums UNION ALL SELECT rec_id, 0, 1.0 FROM sized
  UNION ALL SELECT rec_id, 25, 0.0 FROM sized WHERE len > 25)"""


@check("autocorr", f"WITH {_CURVE} SELECT rec_id, lag, round(r, 6) + 0.0 AS r FROM curve")
def autocorr(spark: SparkSession, d: str) -> DataFrame:
    found = tone.autocorrelation(wav(spark, d), WAV).select("rec_id", F.posexplode("ac").alias("lag", "r"))
    return found.select("rec_id", big("lag").alias("lag"), r("r").alias("r"))


@check("autocorr_f1", f"""WITH {_CURVE},
near AS (SELECT rec_id, lag, r, lag(r) OVER o AS a, lead(r) OVER o AS c, min(r) OVER w + 0.1 * (max(r) OVER w - min(r) OVER w) AS lim
  FROM curve WINDOW o AS (PARTITION BY rec_id ORDER BY lag), w AS (PARTITION BY rec_id)),
peak AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY lag) AS place FROM near
  WHERE lag >= 4 AND r > a + 1e-12 AND r > c + 1e-12 AND r > lim),
fine AS (SELECT rec_id, place, r - 0.25 * (a - c) * p AS coeff, 100.0 / (lag + p) AS f
  FROM (SELECT *, 0.5 * (a - c) / (a - 2 * r + c) AS p FROM peak WHERE place <= 2)),
best AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(coeff, 9) DESC, place) AS b FROM fine)
SELECT rec_id, round(coalesce(f, 0.0), 4) AS ac_f1, round(coalesce(coeff, 0.0), 4) + 0.0 AS ac_coeff
FROM sized LEFT JOIN (SELECT * FROM best WHERE b = 1) USING (rec_id)""")
def autocorr_f1(spark: SparkSession, d: str) -> DataFrame:
    found = tone.autocorrelation(wav(spark, d), WAV)
    return found.select("rec_id", r("ac_f1", 4).alias("ac_f1"), r("ac_coeff", 4).alias("ac_coeff"))


@check("lag_pairs", f"""WITH {WAV_SAMPLES} SELECT b.n - a.n AS lag, count(*) AS n, round(sum(a.x * b.x), 6) AS s
FROM wav a JOIN wav b ON a.rec_id = b.rec_id AND b.n - a.n BETWEEN 1 AND 24 GROUP BY b.n - a.n""")
def lag_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = tone.lag_pairs(wav_samples(spark, d), 24)
    return found.groupBy(big("lag").alias("lag")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("early") * F.col("late")), 6).alias("s")
    )


# --- wavelet bands --------------------------------------------------------------------------


@check("dwt_haar", f"""WITH {SIG_SAMPLES},
l1 AS (SELECT rec_id, n // 2 AS n, sum(x) / sqrt(2) AS a, sum(CASE WHEN n % 2 = 0 THEN x ELSE -x END) / sqrt(2) AS d
  FROM samples GROUP BY rec_id, n // 2),
l2 AS (SELECT rec_id, n // 2 AS n, sum(a) / sqrt(2) AS a, sum(CASE WHEN n % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d
  FROM l1 GROUP BY rec_id, n // 2)
SELECT rec_id, 0 AS band, n, round(a, 6) + 0.0 AS x FROM l2 UNION ALL SELECT rec_id, 1, n, round(d, 6) + 0.0 FROM l2
UNION ALL SELECT rec_id, 2, n, round(d, 6) + 0.0 FROM l1""")
def dwt_haar(spark: SparkSession, d: str) -> DataFrame:
    rows = wavelets.bands_long(wavelets.dwt(sig(spark, d), "haar", level=2))
    return rows.select("rec_id", big("band").alias("band"), big("n").alias("n"), r("x").alias("x"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return wav_samples(spark, d).withColumn("band", (F.col("n") % 2).cast("int"))


_NUMBERS = (
    "entropy", "zc", "mc", "quantile_cont(x, 0.05)", "quantile_cont(x, 0.25)", "quantile_cont(x, 0.75)",
    "quantile_cont(x, 0.95)", "median(x)", "avg(x)", "stddev_pop(x)", "var_pop(x)", "avg(abs(x))",
)


@check("dwt_features_haar", f"""WITH {SIG_SAMPLES},
l1 AS (SELECT rec_id, n // 2 AS n, sum(x) / sqrt(2) AS a, sum(CASE WHEN n % 2 = 0 THEN x ELSE -x END) / sqrt(2) AS d
  FROM samples GROUP BY rec_id, n // 2),
l2 AS (SELECT rec_id, n // 2 AS n, sum(a) / sqrt(2) AS a, sum(CASE WHEN n % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS d
  FROM l1 GROUP BY rec_id, n // 2),
bands AS (SELECT rec_id, 0 AS band, n, a AS x FROM l2 UNION ALL SELECT rec_id, 1, n, d FROM l2
  UNION ALL SELECT rec_id, 2, n, d FROM l1),
signs AS (SELECT *, x > 0 AS z, x > avg(x) OVER (PARTITION BY rec_id, band) AS m FROM bands),
turns AS (SELECT *, z <> lag(z) OVER o AS tz, m <> lag(m) OVER o AS tm FROM signs
  WINDOW o AS (PARTITION BY rec_id, band ORDER BY n)),
stats AS (SELECT rec_id, band, ln(count(*)) AS entropy, CAST(count(*) FILTER (tz) AS DOUBLE) AS zc,
  CAST(count(*) FILTER (tm) AS DOUBLE) AS mc, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_NUMBERS) if i > 2)}
  FROM turns GROUP BY rec_id, band),
listed AS (SELECT rec_id, band, [entropy, zc, mc, {', '.join(f'f{i}' for i in range(3, 12))}] AS f FROM stats)
SELECT rec_id, band * 12 + i - 1 AS i, round(f[i], 6) + 0.0 AS v FROM listed, range(1, 13) t(i)""")
def dwt_features_haar(spark: SparkSession, d: str) -> DataFrame:
    made = wavelets.dwt_features(sig(spark, d), "haar", level=2)
    rows = made.select("rec_id", F.posexplode("dwt_features").alias("i", "v"))
    return rows.select("rec_id", big("i").alias("i"), r("v").alias("v"))


@check("band_entropy", f"""WITH {WAV_SAMPLES}, c AS (SELECT rec_id, n % 2 AS band, x, count(*) AS c FROM wav GROUP BY ALL),
p AS (SELECT rec_id, band, c / sum(c) OVER (PARTITION BY rec_id, band) AS p FROM c)
SELECT rec_id, band, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY rec_id, band""")
def band_entropy(spark: SparkSession, d: str) -> DataFrame:
    found = wavelets.band_entropy(_bands(spark, d))
    return found.select("rec_id", big("band").alias("band"), r("entropy").alias("entropy"))


_STATS = ("p5", "p25", "p75", "p95", "median", "mean", "std", "var", "mean_abs")


@check("band_stats", f"""WITH {WAV_SAMPLES} SELECT rec_id, n % 2 AS band,
  {', '.join(f'round(quantile_cont(x, {q}), 12) + 0.0 AS {c}' for c, q in zip(_STATS, (0.05, 0.25, 0.75, 0.95, 0.5)))},
  round(avg(x), 12) + 0.0 AS mean, round(stddev_pop(x), 12) AS std, round(var_pop(x), 12) AS var, round(avg(abs(x)), 12) AS mean_abs
FROM wav GROUP BY rec_id, n % 2""")
def band_stats(spark: SparkSession, d: str) -> DataFrame:
    found = wavelets.band_stats(_bands(spark, d))
    return found.select("rec_id", big("band").alias("band"), *[r(c, 12).alias(c) for c in _STATS])


@check("crossings", f"""WITH {WAV_SAMPLES}, m AS (SELECT rec_id, n, x > 0 AS z, x > avg(x) OVER (PARTITION BY rec_id) AS m FROM wav),
l AS (SELECT rec_id, z <> lag(z) OVER o AS z, m <> lag(m) OVER o AS m FROM m WINDOW o AS (PARTITION BY rec_id ORDER BY n))
SELECT rec_id, count(*) FILTER (z) AS zero_crossings, count(*) FILTER (m) AS mean_crossings FROM l GROUP BY rec_id""")
def crossings(spark: SparkSession, d: str) -> DataFrame:
    return wavelets.crossings(wav_samples(spark, d))


# --- operators without a statement in SQL -------------------------------------------------------


@check("attributes")
def all_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Baseline, peaks above it, signal to noise, both tone estimates, power, duration."""
    found = attributes(sig(spark, d), SIG)
    return found.select(
        "rec_id", "f1", "ac_f1", "ac_coeff", "ha_count", "ha_grade", "s2n", "s2n_freq", "fd_power_db",
        "fd_baseline_db", "rms", "dur_ms", "f1_est", F.size("peaks").alias("n_peaks"),
    )


@check("als_baseline")
def als_baseline(spark: SparkSession, d: str) -> DataFrame:
    found = tone.als_baseline(sig(spark, d))
    return found.select("rec_id", F.posexplode("bias").alias("n", "bias"))


@check("als_residual", f"WITH {SIG_SAMPLES} SELECT rec_id, n, 0.0 AS rest FROM samples")
def als_residual(spark: SparkSession, d: str) -> DataFrame:
    """Once the weights are settled, the bias solves its penalised equations at every sample."""
    found = tone.als_baseline(sig(spark, d), rounds=50)
    both = found.withColumn("last", F.size("bias") - 1)
    bend = "(bias[{0} - 1] - 2 * bias[{0}] + bias[{0} + 1])"
    bends = [
        f"if(i > 1, {bend.format('(i - 1)')}, 0D)", f"- 2 * if(i > 0 and i < last, {bend.format('i')}, 0D)",
        f"+ if(i < last - 1, {bend.format('(i + 1)')}, 0D)",
    ]
    weight = "if(waveform[i] > bias[i], 0.002D, if(waveform[i] < bias[i], 0.998D, 0D))"
    rest = both.withColumn(
        "rest", F.expr(f"transform(sequence(0, last), i -> {weight} * (bias[i] - waveform[i]) + 500 * ({' '.join(bends)}))")
    )
    return _long(rest, "rest").withColumnRenamed("x", "rest")


@check("hps")
def hps(spark: SparkSession, d: str) -> DataFrame:
    fine = spectrum.interpolate_psd(_spectra(spark, d), SIG)
    found = spectrum.find_peaks(fine, "psd_db", SIG.peak_threshold, SIG.peak_distance)
    return tone.hps(spectrum.f1_estimate(spectrum.refine_peaks(found, SIG), SIG), SIG).select(
        "rec_id", "hps_f1", "hps_n", "hps_start"
    )


@check("psd_interp")
def psd_interp(spark: SparkSession, d: str) -> DataFrame:
    fine = spectrum.interpolate_psd(_spectra(spark, d), SIG)
    return fine.select("rec_id", F.posexplode("psd_interp").alias("f", "psd"))


@check("psd_interp_knots", f"""WITH {_PSD} SELECT rec_id, k, round(psd * 1000000, 3) AS psd, CASE WHEN k < 16 THEN 0.0 END AS bend FROM psd""")
def psd_interp_knots(spark: SparkSession, d: str) -> DataFrame:
    """The finer spectrum meets the bins, and is a cubic between each two of them."""
    fine = spectrum.interpolate_psd(_spectra(spark, d), SIG, 0.5)
    fourth = " + ".join(f"({c}) * psd_interp[4 * k + {i}]" for i, c in enumerate((1, -4, 6, -4, 1)))
    cells = F.expr(f"transform(sequence(0, 16), k -> struct(bigint(k) as k, psd_interp[4 * k] as psd, if(k < 16, {fourth}, null) as bend))")
    rows = fine.select("rec_id", F.inline(cells))
    return rows.select("rec_id", "k", r(F.col("psd") * 1000000, 3).alias("psd"), r("bend", 9).alias("bend"))


@check("psd_map")
def psd_map(spark: SparkSession, d: str) -> DataFrame:
    based = spectrum.spectral_baseline(_spectra(spark, d))
    rows = based.withColumn("load_seq", F.col("rec_id"))
    return order.psd_map(rows, "cluster").select("position", "rec_id", F.posexplode("psd_above_db").alias("k", "level"))


@check("cwt_power", f"""WITH {SIG_SAMPLES},
psi AS (SELECT f, k, scale, exp(-(k / scale) * (k / scale) / 2) * cos(5 * k / scale) AS psi
  FROM (SELECT f, k, 0.8125 * 64 / f AS scale FROM range(4, 33) a(f), range(-63, 64) b(k)) WHERE abs(k / scale) <= 8),
cells AS (SELECT rec_id, f, n - k AS at, power(sum(x * psi), 2) / any_value(scale) AS p
  FROM samples, psi WHERE n - k BETWEEN 0 AND 63 GROUP BY rec_id, f, n - k),
rows AS (SELECT rec_id, f, sum(p) AS e, max(p) AS top FROM cells GROUP BY rec_id, f)
SELECT rec_id, arg_max(f, e) AS freq, CAST(floor(greatest(0, least(255, (log10(max(top)) - log10(0.0005)) * 255
  / (log10(5) - log10(0.0005)))) + 0.5) AS BIGINT) AS level FROM rows GROUP BY rec_id""")
def cwt_power(spark: SparkSession, d: str) -> DataFrame:
    """Strongest frequency row of each recording's wavelet image."""
    freqs = [4.0 + i for i in range(29)]
    image = sinks.scalogram_levels(wavelets.cwt_power(sig(spark, d), "morl", SIG, freqs))
    energy = F.transform("cwt", lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x)))
    return image.withColumn("_e", energy).select(
        "rec_id", big(F.array_position("_e", F.array_max("_e")) + 3).alias("freq"),
        big(F.array_max(F.flatten("image"))).alias("level"),
    )


@check("recording_curves")
def curves(spark: SparkSession, d: str) -> DataFrame:
    rows = attributes(tone.als_baseline(sig(spark, d)), SIG)
    return recording_curves(rows, SIG.sr, SIG.df)


@check("spectrum_curves", f"""WITH {_PEAKS} SELECT rec_id, 'waveform' AS curve, n AS i, round(n * 1000.0 / 64, 4) AS x,
  round(x, 4) + 0.0 AS y FROM samples
UNION ALL SELECT rec_id, 'spectrum', k, round(k * 2.0, 4), round(level, 4) FROM db
UNION ALL SELECT rec_id, 'peak', row_number() OVER (PARTITION BY rec_id ORDER BY k) - 1, round(freq, 4), round(top, 4) FROM peaks""")
def spectrum_curves(spark: SparkSession, d: str) -> DataFrame:
    """Waveform, spectrum and marked peaks of every recording."""
    rows = _with_peaks(spark, d).select("rec_id", "waveform", "psd_db", "peaks")
    found = recording_curves(rows, SIG.sr, SIG.df)
    return found.select("rec_id", "curve", big("i").alias("i"), r("x", 4).alias("x"), r("y", 4).alias("y"))


@check("psd_map_mean", f"""WITH {_PSD}, place AS (SELECT vec_id AS rec_id, row_number() OVER (ORDER BY label, vec_id) AS position FROM embeddings)
SELECT position, rec_id, k, round(level - avg(level) OVER (PARTITION BY rec_id), 4) + 0.0 AS level FROM db JOIN place USING (rec_id)""")
def psd_map_mean(spark: SparkSession, d: str) -> DataFrame:
    """Above the mean level, in cluster order."""
    mean = F.aggregate("psd_db", F.lit(0.0), lambda a, x: a + x) / F.size("psd_db")
    based = _spectra(spark, d).withColumn("psd_baseline_db", F.transform("psd_db", lambda x: mean))
    rows = order.psd_map(based.withColumn("load_seq", F.col("rec_id")), "cluster")
    cells = rows.select("position", "rec_id", F.posexplode("psd_above_db").alias("k", "level"))
    return cells.select("position", "rec_id", big("k").alias("k"), r("level", 4).alias("level"))


@check("dwt_features")
def dwt_features(spark: SparkSession, d: str) -> DataFrame:
    made = wavelets.dwt_features(sig(spark, d), "sym4", SIG)
    return made.select("rec_id", F.posexplode("dwt_features").alias("i", "v"))
