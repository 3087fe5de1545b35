"""Spark-native analytics over logistics, retrieval, audit and telemetry tables."""
