"""Image time series on Spark: movies, factor tables and the plans that work on them."""

__version__ = "0.1.0"
