"""Spark-native analytics over source code and change history."""
