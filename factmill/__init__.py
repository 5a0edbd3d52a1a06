"""Spark-native engine for curating, versioning and searching tables of extracted facts."""
