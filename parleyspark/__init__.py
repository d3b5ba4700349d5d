"""A PySpark-native engine for chat archives: relational, text, tree and graph analytics."""

__version__ = "0.1.0"
