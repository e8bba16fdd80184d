"""Palimpsest: a Spark-native engine for evidence retrieval and corpus analytics."""
