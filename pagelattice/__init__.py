"""A PySpark-native document-image analytics engine."""

__version__ = "0.1.0"
