"""Spark-native retrieval and memory analytics."""
