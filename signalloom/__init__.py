"""Feature engineering for multichannel time series as Spark plans."""

from signalloom.params import Band, JobParams, load_params

__all__ = ["Band", "JobParams", "load_params"]
