"""Spark-native document retrieval engine."""
