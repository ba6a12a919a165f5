"""Spark-native survey and evidence analytics engine."""
