"""Spark-native analytics engine for expert discovery."""
