"""Spark-native mass-univariate analytics for event-driven time series."""
