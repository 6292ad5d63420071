"""ledgerlens: Spark-native retrieval and metric analytics over long, semi-structured reports."""

__version__ = "0.1.0"
