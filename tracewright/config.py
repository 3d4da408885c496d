"""Defaults of detection and repair; times in seconds, lengths in samples where said."""

from __future__ import annotations

from dataclasses import dataclass, replace

SATURATION = 1020.0


@dataclass(frozen=True)
class Detection:
    """What the detectors use at a sampling rate."""

    sr: float = 6.625
    spike_window_s: float = 2.0
    spike_k: float = 8.0
    step_k: float = 12.0
    freeze_s: float = 30.0
    freeze_common_s: float = 120.0
    freeze_common_runs: int = 50
    rms_short_s: float = 10.0
    rms_long_s: float = 120.0
    rms_ratio: float = 5.0
    low_rms: float = 4.0
    low_gain: float = 3.0
    burst_s: float = 5.0
    merge_s: float = 120.0
    pad_short_s: float = 5.0
    pad_long_s: float = 30.0
    longest_s: float = 7200.0
    event_s: float = 30.0
    event_missing: float = 0.05
    event_morph: float = 0.03
    event_spike: float = 0.04
    event_head_mid: float = 1.15
    event_coda: float = 100.0
    event_smooth: float = 0.12
    catalog_before_s: float = 300.0
    catalog_after_s: float = 3600.0

    def samples(self, seconds: float) -> int:
        return int(seconds * self.sr)

    @property
    def spike_window(self) -> int:
        return self.samples(self.spike_window_s) | 1


@dataclass(frozen=True)
class Repair:
    """What grading and repair use."""

    linear_max: int = 2
    zscore_max: int = 20
    missing_share: float = 0.30
    core_missing_share: float = 0.50
    zscore: float = 4.0
    zscore_context_s: float = 30.0
    spike_window: int = 7
    spike_k: float = 8.0
    reference_min_s: float = 120.0
    reference_max_s: float = 600.0
    reference_share: float = 0.5
    reference_gap_s: float = 1.0
    merged_max_s: float = 1800.0
    quantize: bool = True

    def with_options(self, **options) -> Repair:
        return replace(self, **options)


#: Settings that users may give: default, least, greatest.
SETTINGS = {
    "reference_gap_s": (1.0, 0.0, 60.0), "reference_min_s": (120.0, 10.0, 3600.0), "reference_max_s": (600.0, 10.0, 7200.0), "zscore": (4.0, 1.0, 20.0),
    "missing_share": (0.30, 0.0, 1.0), "core_missing_share": (0.50, 0.0, 1.0), "linear_max": (2, 0, 100), "zscore_max": (20, 0, 1000), "spike_k": (8.0, 1.0, 50.0), "quantize": (True, None, None),
}


def settings(given: dict) -> Repair:
    """Repair options from a mapping: cast to the default's type and clipped; what can't be read keeps its default, and other keys are ignored."""
    out = {}
    for name, (default, least, greatest) in SETTINGS.items():
        value = given.get(name, default)
        if isinstance(default, bool):
            out[name] = value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
            continue
        try:
            number = float(value)
            out[name] = type(default)(min(max(number, least), greatest)) if number == number else default
        except (TypeError, ValueError):
            out[name] = default
    return Repair().with_options(**out)
