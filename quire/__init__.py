"""quire: a Spark-native engine for turning documents into retrieval records."""

__version__ = "0.1.0"
