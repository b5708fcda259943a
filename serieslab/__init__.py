"""serieslab: resampling-based inference on time series, declared as Spark plans."""

__version__ = "0.1.0"
