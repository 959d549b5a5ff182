"""Spark-native code-intelligence and text analytics engine."""
