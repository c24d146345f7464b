"""Analysis parameters, passed explicitly to every operator that needs them."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Every recording shares one sample rate ``sr`` after ingest.

    The defaults are fixed values: results only agree with earlier analyses
    when they are left alone.
    """

    # reading
    sr: int = 8000
    scale: float = -1.0
    segment_ms: float = 200.0
    min_samples: int = 256
    # duration
    noise_floor: float = 0.001
    duration_factor: float = 10.0
    half_window_ms: int = 2
    close_s: float = 0.5
    # power spectral density
    nperseg: int = 256
    overlap: int = 128
    nfft: int = 256
    epsilon: float = 1e-10
    # spectrum
    f_min: float = 200.0
    f_max: float = 4000.0
    n_mels: int = 26
    n_mfcc: int = 13
    peak_threshold: float = 0.25
    baseline_degree: int = 9
    # continuous wavelet power
    cwt_step: float = 10.0
    cwt_power_low: float = 0.0005
    cwt_power_high: float = 5.0
    # harmonic product spectrum
    hps_harmonics: int = 6
    hps_tolerance: float = 0.05
    # autocorrelation
    ac_threshold: float = 0.1
    ac_peaks: int = 2
    use_unbiased: bool = False
    # harmonic analysis
    ha_hypotheses: int = 3
    ha_peaks: int = 5
    ha_tolerance: float = 0.1
    f1_min: float = 100.0
    f1_max: float = 1000.0
    f1_step: float = 10.0
    # features
    temp_min: float = 5.0
    temp_max: float = 55.0
    temp_step: float = 0.5
    pca_components: int = 5

    @property
    def df(self) -> float:
        """Distance between two bins of the spectrum in Hz."""
        return self.sr / self.nfft

    @property
    def n_bins(self) -> int:
        """Bins kept: those at or below ``f_max``."""
        return min(self.nfft // 2, math.floor(self.f_max / self.df)) + 1

    @property
    def first_signal_bin(self) -> int:
        """First bin at or above ``f_min``."""
        return math.ceil(self.f_min / self.df)

    @property
    def top_frequency(self) -> float:
        return (self.n_bins - 1) * self.df

    @property
    def peak_distance(self) -> int:
        """Bins within which only the highest peak is kept."""
        return round(self.f1_min / self.top_frequency * self.n_bins - 1)

    @property
    def lag_start(self) -> int:
        return int(self.sr / self.f1_max + 0.5)

    @property
    def lag_stop(self) -> int:
        return int(self.sr / self.f1_min + 0.5)


DEFAULT = Params()
