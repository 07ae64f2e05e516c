"""Spark-native engine for typographic correction and text-corpus engineering."""
