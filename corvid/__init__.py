"""Spark-native program-graph, run-analytics and corpus engine."""
