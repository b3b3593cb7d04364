"""Point-in-time (as-of) feature, contract, evaluation and resampling operators for Spark."""

__version__ = "0.1.0"
