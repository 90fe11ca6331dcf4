"""Spark-native vector and language analytics."""
