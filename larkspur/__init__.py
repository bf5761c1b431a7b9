"""Spark-native retrieval, graph and corpus analytics."""
