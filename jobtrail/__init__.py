"""Spark-native analytics over job logs, job ledgers, registries and cluster snapshots."""

__version__ = "0.1.0"
