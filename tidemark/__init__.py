"""Spark-native engine for logs and metrics: parsing, rollups, PromQL, LogQL, SQL."""
