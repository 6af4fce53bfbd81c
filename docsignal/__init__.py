"""Spark-native engine for monitoring streams of public documents."""
