"""Job parameters: an immutable value passed to every plan, never a module global."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Band:
    """A named frequency range, half-open: ``fmin <= f < fmax``."""

    name: str
    fmin: float
    fmax: float

    def __post_init__(self):
        if not self.fmin < self.fmax:
            raise ValueError(f"band {self.name}: fmin {self.fmin} must be below fmax {self.fmax}")


# The default frequency bands in Hz.
DEFAULT_BANDS = (
    Band("Delta", 0.5, 4.0),
    Band("Theta", 4.0, 8.0),
    Band("Alpha", 8.0, 12.0),
    Band("Beta", 12.0, 30.0),
)

# The alternative, lower-case band set reaching into gamma.
EXTENDED_BANDS = (
    Band("delta", 0.5, 4.0),
    Band("theta", 4.0, 8.0),
    Band("alpha", 8.0, 13.0),
    Band("beta", 13.0, 30.0),
    Band("gamma", 30.0, 100.0),
)


@dataclasses.dataclass(frozen=True)
class JobParams:
    """Everything a feature job needs to know besides its input tables.

    ``block_samples`` bounds how many samples of one channel are handled as one
    group: a recording is cut into blocks of about that many samples, so that a
    single huge recording spreads over as many tasks as it has blocks.
    """

    sfreq: float = 500.0
    window_length: float = 3.0
    step_size: float = 0.3
    bands: tuple[Band, ...] = DEFAULT_BANDS
    method: str = "welch"
    n_fft: int | None = None
    n_overlap: int = 0
    taper: str = "hamming"
    detrend: bool = True
    data_path: str = ""
    derivatives: bool = True
    block_samples: int = 65_536

    def __post_init__(self):
        if self.method != "welch":
            raise ValueError(f"unknown spectral method {self.method!r}; only 'welch' is supported")
        if self.window_length <= 0 or self.step_size <= 0 or self.sfreq <= 0:
            raise ValueError("sfreq, window_length and step_size must be positive")
        if not self.bands:
            raise ValueError("at least one band is required")

    @property
    def n_times(self) -> int:
        """Samples per epoch; both window ends belong to the epoch."""
        return int(self.window_length * self.sfreq) + 1

    @property
    def stride(self) -> float:
        """Distance between epoch starts, in samples (not always a whole number)."""
        return self.step_size * self.sfreq

    @property
    def epochs_per_block(self) -> int:
        return max(1, int((self.block_samples - self.n_times) / self.stride))

    @property
    def fmin(self) -> float:
        return min(b.fmin for b in self.bands)

    @property
    def fmax(self) -> float:
        return max(b.fmax for b in self.bands)

    def replace(self, **changes) -> JobParams:
        return dataclasses.replace(self, **changes)


# Parameter-file keys and the fields they set.
FILE_KEYS = {
    "data_path": "data_path",
    "derivatives": "derivatives",
    "method": "method",
    "windowLength": "window_length",
    "stepSize": "step_size",
    "sfreq": "sfreq",
    "nFft": "n_fft",
    "nOverlap": "n_overlap",
    "taper": "taper",
    "detrend": "detrend",
    "blockSamples": "block_samples",
}


def params_from_mapping(raw: Mapping) -> JobParams:
    """Build parameters from the file form (``windowLength``, ``stepSize``, ``freqBands`` …)."""
    unknown = set(raw) - set(FILE_KEYS) - {"freqBands"}
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    known = {field: raw[key] for key, field in FILE_KEYS.items() if key in raw}
    if "freqBands" in raw:
        known["bands"] = tuple(
            Band(name, float(lo), float(hi)) for name, (lo, hi) in raw["freqBands"].items()
        )
    return JobParams(**known)


def load_params(path: str) -> JobParams:
    """Read parameters from a YAML or JSON file; a missing file is an error, not a prompt."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return params_from_mapping(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML parameters needs PyYAML; use a .json file instead") from e
    return params_from_mapping(yaml.safe_load(text))
