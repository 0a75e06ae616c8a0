"""loomspan: a PySpark-native engine for time-varying graphs and large corpora."""

__version__ = "0.1.0"
