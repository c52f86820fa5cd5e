"""Loomstone: a Spark-native analytics engine."""
