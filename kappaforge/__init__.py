"""Spark-native engine for clinical-coding agreement studies."""
