"""Quernstone: a PySpark-native analytics engine for guarded SQL, dataset building and evaluation."""

__version__ = "0.1.0"
