"""Spark-native sensitive-data gate: scan, resolve, redact, decide, profile and classify with DataFrame operations."""
