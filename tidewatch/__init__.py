"""Spark-native analytics over collected articles and the events they report."""
