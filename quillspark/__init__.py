"""A Spark-native lexical search and text-analytics engine."""

__version__ = "0.1.0"
