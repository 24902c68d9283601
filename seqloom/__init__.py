"""seqloom: a Spark-native engine for probabilistic profile search over sequence tables."""

__version__ = "0.1.0"
