"""Spark-native building, searching and measuring of text corpora and knowledge graphs."""

__version__ = "0.1.0"
