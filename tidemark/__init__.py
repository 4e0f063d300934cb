"""Spark-native analytics over conversation memories."""
