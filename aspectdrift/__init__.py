"""Spark-native engine for temporal aspect-based opinion analysis."""
