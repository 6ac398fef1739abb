"""Spark-native warehouse inventory analytics."""
