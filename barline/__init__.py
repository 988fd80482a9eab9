"""barline: a PySpark-native analytics engine for panel time series."""

__version__ = "0.1.0"
