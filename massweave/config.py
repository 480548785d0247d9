"""Settings with their defaults, as frozen dataclasses; JSON in and out."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChromatogramSettings:
    eic_tolerance_ppm: float = 5.0
    smooth_window: int = 5
    smooth_method: str = "savgol"
    smooth_order: int = 2
    min_peak_datapoints: int = 5
    derivative_threshold: float = 0.0005
    eic_signal_threshold: float = 0.01
    persistence_smoothing: int = 1
    cluster_mz_relative: float = 5e-6
    cluster_rt_min: float = 0.3
    ms1_average: int = 1
    deconvolution_correlation: float = 0.8
    dda_rt_min: float = 0.15
    dda_mz: float = 0.05
    min_entropy_score: float = 0.2


@dataclass(frozen=True)
class SpectrumSettings:
    noise_method: str = "log"
    noise_sigma: float = 6.0
    noise_correction: float = 0.463
    noise_bins: int = 500
    noise_min_std: float = 6.0
    relative_abundance: float = 1.0
    absolute_abundance: float = 1_000_000.0
    min_mz: float = 50.0
    max_mz: float = 1200.0
    pad_points: int = 3
    calibration_order: int = 2
    calibration_ppm: tuple[float, float] = (-1.0, 1.0)
    calibration_s2n: float = 2.0
    kendrick_base: tuple[tuple[str, int], ...] = (("C", 1), ("H", 2))
    kendrick_rounding: str = "floor"
    prominence_percent: float = 0.1


@dataclass(frozen=True)
class GasSettings:
    ri_window: float = 35.0
    rt_window: float = 1.0
    score_threshold: float = 0.0
    correlation: float = 0.5
    ri_std: float = 3.0
    max_rt_distance: float = 0.025


@dataclass(frozen=True)
class FormulaSettings:
    atoms: tuple[tuple[str, int, int], ...] = (("C", 1, 90), ("H", 4, 200), ("O", 0, 12), ("N", 0, 0), ("S", 0, 0))
    mz: tuple[float, float] = (50.0, 1200.0)
    dbe: tuple[float, float] = (0.0, 50.0)
    h_c: tuple[float, float] = (0.3, 3.0)
    o_c: tuple[float, float] = (0.0, 1.2)
    ppm: tuple[float, float] = (-10.0, 10.0)
    abundance_error_percent: float = 100.0
    mz_weight: float = 0.6
    isotopologue_weight: float = 0.4
    mz_error_std: float = 1.66
    min_score: float = 0.1


@dataclass(frozen=True)
class Settings:
    chromatogram: ChromatogramSettings = field(default_factory=ChromatogramSettings)
    spectrum: SpectrumSettings = field(default_factory=SpectrumSettings)
    gas: GasSettings = field(default_factory=GasSettings)
    formula: FormulaSettings = field(default_factory=FormulaSettings)


def _value(kind: type, raw: dict):
    def frozen(x):
        return tuple(map(frozen, x)) if isinstance(x, list) else x

    unknown = set(raw) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**{k: frozen(v) for k, v in raw.items()})


def to_json(settings: Settings) -> str:
    return json.dumps(dataclasses.asdict(settings), indent=1)


def from_json(text: str) -> Settings:
    raw = json.loads(text)
    kinds = {"chromatogram": ChromatogramSettings, "spectrum": SpectrumSettings, "gas": GasSettings, "formula": FormulaSettings}
    return Settings(**{k: _value(kinds[k], v) for k, v in raw.items()})


def from_toml(text: str) -> Settings:
    import tomllib

    return from_json(json.dumps(tomllib.loads(text)))
