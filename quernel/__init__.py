"""Spark-native analytics over ontologies, property graphs, documents and session state."""
