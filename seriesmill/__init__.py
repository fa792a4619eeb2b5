"""seriesmill: a PySpark-native engine for market and metric time series."""

__version__ = "0.1.0"
