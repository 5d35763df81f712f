"""Spark-native analytics over transaction graphs and network observations."""
