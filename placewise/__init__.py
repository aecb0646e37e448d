"""Spark-native analytics on business and territorial tables."""
