"""loomyard: a PySpark-native engine for matched-experiment and scenario-level analytics."""

__version__ = "0.1.0"
