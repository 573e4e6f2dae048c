"""Spark-native evidence-timeline analytics engine."""
