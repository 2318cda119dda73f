"""Spark-native analytics over dependency graphs, change history, time series and text."""
