"""lodestone: a PySpark-native retrieval engine for text and source code."""

__version__ = "0.1.0"
